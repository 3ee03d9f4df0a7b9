"""Candidates of similarity mining against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from knotwork.functions import similarity
from knotwork.operators import cosine_join, mining
from knotwork.operators.cosine_join import ROOM, cosine_cells, cosine_pairs

VECTOR = "norm string, embedding array<double>"


def brute(rows, least):
    width = max(len(v or []) for _, v in rows)
    full = {n: np.pad(np.asarray(v, float), (0, width - len(v))) for n, v in rows if v}
    full = {n: v / np.linalg.norm(v) for n, v in full.items() if v.any()}
    return {(a, b) for a in full for b in full if a < b and full[a] @ full[b] >= least}


def vectors(kind, n, rng):
    if kind == "dense":
        base = rng.normal(size=(8, 12))
        return [base[i % 8] + rng.normal(scale=0.4, size=12) for i in range(n)]
    out = []
    for i in range(n):
        v = np.zeros(60)
        at = rng.choice(60, 5, replace=False, p=np.arange(1, 61) / 1830)
        v[at] = rng.normal(size=5) if kind == "signed" else rng.integers(1, 4, 5)
        if i % 3 == 2:  # near one before
            v = out[i - 1] + v * 0.2
        out.append(v)
    return out


@pytest.mark.parametrize("kind", ["counts", "signed", "dense"])
@pytest.mark.parametrize("least", [0.3, 0.82])
@pytest.mark.parametrize("row_cost", [0, 6])
def test_cosine_pairs(spark, monkeypatch, kind, least, row_cost):
    monkeypatch.setattr(cosine_join, "ROW_COST", row_cost)  # lists of pairs or of single dimensions, wherever they compare less
    rng = np.random.default_rng(4)
    rows = [(f"n{i:03}", v.tolist()) for i, v in enumerate(vectors(kind, 150, rng))]
    rows += [("zero", [0.0] * 60), ("none", None), ("empty", []), ("short", rows[0][1][:7]), ("same", rows[0][1])]
    for cell_rows in (7 if row_cost else 64,):
        got = [tuple(r) for r in cosine_pairs(spark.createDataFrame(rows, VECTOR).repartition(3), least, cell_rows).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(rows, least - ROOM)


def test_nothing_to_compare(spark):
    assert cosine_pairs(spark.createDataFrame([], VECTOR), 0.5).count() == 0
    assert cosine_pairs(spark.createDataFrame([("a", [1.0])], VECTOR), 0.5).count() == 0
    with pytest.raises(ValueError, match="above 0"):
        cosine_pairs(spark.createDataFrame([], VECTOR), 0.0)


def names(n, seed=1):
    rng = random.Random(seed)
    part = lambda: "".join(rng.choice("bcdfghklmnprstvz") + rng.choice("aeiou") for _ in range(rng.randint(2, 4)))
    return sorted({f"{part()} {part()}" for _ in range(n)})


def test_few_comparisons(spark, monkeypatch):
    """Of names without much in common a small share is compared; all pairs over the threshold are found.

    With more rows lists pay at their real cost too, as what they compare grows no faster than all pairs.
    """
    monkeypatch.setattr(cosine_join, "ROW_COST", 1)
    rows = names(3000)
    rows += [f"{x}s" for x in rows[:200]]
    table, _ = similarity.encode_texts(spark.createDataFrame([(x,) for x in rows], "norm string"), F.col("norm"))
    table = table.select("norm", "embedding").cache()
    _, compared = cosine_cells(table, 0.82, 256)
    assert compared < 0.15 * len(rows) * (len(rows) - 1) / 2
    got = {tuple(r) for r in cosine_pairs(table, 0.82, 256).collect()}
    assert got == brute([tuple(r) for r in table.collect()], 0.82)
    assert len(got) >= 200


CONTEXT = "norm string, name string, out_preds array<string>, in_preds array<string>, child_terms array<string>, occ_count long, document_ids array<int>, component_id long, embedding array<double>"


def contexts(spark, n, shared):
    rng = random.Random(n)
    some = lambda k: sorted(rng.sample([f"i{x}" for x in range(40)], rng.randrange(k)))
    rows = []
    for k in range(n):
        v = [0.0] * 30
        for at in rng.sample(range(30), 3):
            v[at] = float(rng.randint(1, 3))
        if k % 4 == 3:
            v = [x + (0.1 if i == k % 30 else 0) for i, x in enumerate(rows[-1][-1])]
        rows.append((f"c{k:03}", f"c{k:03}", some(3) if shared else [], [], some(2) if shared else [], rng.choice([0, 1, 1, 2, 5]), [k % 4], k % 3, v))
    return spark.createDataFrame(rows, CONTEXT)


@pytest.mark.parametrize("frames,many", [(True, 1), (False, 1), (True, 20_000)])
def test_reports_equal_all_pairs(spark, monkeypatch, frames, many):
    """Whatever the way to them, and the level that fills the report first, the best pairs are the same."""
    monkeypatch.setattr(mining, "MANY_ROWS", many)
    for shared in (True, False)[: 1 + frames]:
        c = contexts(spark, 60, shared).cache()
        scored = mining.context_pair_scores(c, frames)
        for limit in (5, 100_000):
            want = scored.where("round(combined, 12) >= 0.45 and round(structural, 12) >= 0.10").select(*(F.round(x, 6) for x in ("combined", "structural", "embedding")), "support", "l_norm", "r_norm")
            want = sorted((tuple(r) for r in want.collect()), key=lambda r: (*(-x for x in r[:4]), *r[4:]))[:limit]
            got = mining.synonyms(c, frames, limit=limit).select("combined_score", "structural_score", "embedding_score", "support", "l_norm", "r_norm")
            assert [tuple(r) for r in got.collect()] == want
            bridge = scored.where("round(bridge, 12) >= 0.35 and round(structural, 12) >= 0.10 and l_component_id <> r_component_id").select(*(F.round(x, 6) for x in ("bridge", "combined", "structural", "embedding")), "support", "l_norm", "r_norm")
            bridge = sorted((tuple(r) for r in bridge.collect()), key=lambda r: (*(-x for x in r[:5]), *r[5:]))[:limit]
            got = mining.context_bridges(c, frames, limit=limit).select("bridge_score", "combined_score", "structural_score", "embedding_score", "support", "l_norm", "r_norm")
            assert [tuple(r) for r in got.collect()] == bridge


def test_unshared_counts_are_not_candidates(spark):
    """Concepts that only occur equally often are compared by their vectors."""
    rows = [(x, x, [], [], [], 1, [], 0, None) for x in names(400)]
    table, _ = similarity.encode_texts(spark.createDataFrame(rows, CONTEXT).drop("embedding"), F.col("norm"))
    found = mining.candidate_pairs(table, 0.10, True, 0.8777).count()
    assert found < 400
    assert mining.candidate_pairs(table, 0.10, True).count() == len(rows) * (len(rows) - 1) // 2


@pytest.mark.parametrize("least", [0.82, 0.0])
def test_aliases_over_any_limit(spark, least):
    table, _ = similarity.encode_texts(spark.createDataFrame([(x, x, 1 + len(x) % 3) for x in names(60) + ["bada goku", "bada gokus"]], "norm string, name string, support int"), F.col("norm"))
    got = {(r.canonical_norm, r.alias_norm) for r in mining.alias_candidates(table, least_cosine=least, limit=1 << 30).collect()}
    rows = [(r.norm, list(r.embedding)) for r in table.collect()]
    want = brute(rows, least - 1e-12)
    assert {tuple(sorted(p)) for p in got} == want and ("bada goku", "bada gokus") in got


def test_scored_pairs_move_no_vectors(spark):
    """The join's own cosines are those of the expression, and a vector of any width is not joined to its pairs again."""
    rows = [(f"n{i:03}", v.tolist()) for i, v in enumerate(vectors("counts", 90, np.random.default_rng(5)))]
    table = spark.createDataFrame(rows, VECTOR)
    full = dict(rows)
    for r in cosine_join.cosine_scores(table, 0.5, 16).collect():
        a, b = np.array(full[r.l_norm]), np.array(full[r.r_norm])
        assert r.cosine == pytest.approx(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b), abs=1e-14)
    found = mining.alias_candidates(table.select("norm", F.col("norm").alias("name"), F.lit(1).alias("support"), "embedding"), least_cosine=0.5)
    assert found.count() > 0
    c = contexts(spark, 30, True)
    scored = mining.context_pair_scores(c, candidates=cosine_join.cosine_scores(c, 0.5))
    assert "l_embedding" not in scored.columns and scored.count() > 0


def test_top_neighbours_in_cells(spark, monkeypatch):
    """Cells of any size give what all pairs give: ties by id, zero, null, short and repeated vectors too."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(90)] + [(90, None), (91, []), (92, [0.0] * 4), (93, [1.0, 2.0])]
    table = spark.createDataFrame(rows, "id long, embedding array<double>").cache()
    asked = table.where("id % 10 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("q"))
    every = table.join(asked, F.col("id") != F.col("query_id")).select("query_id", "id", F.round(similarity.cosine(F.col("q"), F.col("embedding")), 6).alias("cosine"))
    want = {}
    for r in sorted(every.collect(), key=lambda r: (r.query_id, -r.cosine, r.id)):
        want.setdefault(r.query_id, []).append((r.id, r.cosine))
    for cell in (7, 1000):
        monkeypatch.setattr(mining, "NEIGHBOUR_CELL", cell)
        monkeypatch.setattr(mining, "QUERY_CELL", 4)
        got = {}
        for r in mining.top_neighbours(table, F.col("id") % 10 == 0).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.id, r.cosine))
        assert got == {q: x[:5] for q, x in want.items()}
    assert "NestedLoopJoin" not in mining.top_neighbours(table, F.col("id") % 10 == 0)._jdf.queryExecution().executedPlan().toString()
