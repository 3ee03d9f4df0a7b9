import random
import re

import numpy as np
import pytest

from knotwork.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s or "")


def brute(texts, items, width):
    windows = {}
    for i, t in items:
        w = WORD.findall(lower(t))
        for a in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[a : a + width]), set()).add(str(i))
    out = []
    for t in texts:
        w = WORD.findall(lower(t))
        hit, found = set(), set()
        for k, names in windows.items():
            for a in range(len(w) - len(k) + 1):
                if tuple(w[a : a + len(k)]) == k:
                    hit |= set(range(a, a + len(k)))
                    found |= names
        out.append((len(w), len(hit), sorted(found), bool(hit)))
    return out


def run(spark, docs, items, **kw):
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = d.find_contamination(docs, bench, **kw)
    rows = {r.doc_id: r for r in d.digest(found).collect()}
    items_of = {r.doc_id: sorted(r["items"]) for r in found.collect()}
    return rows, items_of


def brute_near(texts, items, width, k, slop):
    """Items by document: some window's k rarest words that occur at all, all within ``slop`` of the rarest."""
    docs = [WORD.findall(lower(t)) for t in texts]
    df = {}
    for w in docs:
        for x in set(w):
            df[x] = df.get(x, 0) + 1
    out = [set() for _ in texts]
    for i, t in items:
        w = WORD.findall(lower(t))
        for a in range(max(1, len(w) - width + 1) if w else 0):
            window = w[a : a + width]
            ranked = sorted((df[x], o, x) for o, x in enumerate(window) if x in df)[: min(k, len(window))]
            if i is None or len(ranked) < min(k, len(window)):
                continue
            for d, doc in enumerate(docs):
                at = {x: [p for p, y in enumerate(doc) if y == x] for _, _, x in ranked}
                if any(all(any(abs(q - p) <= slop for q in at[x]) for _, _, x in ranked) for p in at[ranked[0][2]]):
                    out[d].add(str(i))
    return [sorted(x) for x in out]


@pytest.mark.parametrize(("width", "block", "k", "slop"), [(4, 1 << 20, 3, 4), (4, 60, 3, 4), (10, 1 << 20, 5, 10), (3, 1 << 20, 5, 1)])
def test_proximity_against_brute_force(spark, docs_of, width, block, k, slop):
    rng = random.Random(k)
    vocabulary = [f"w{n}" for n in range(40)]
    texts = [None, "", *(" ".join(rng.choice(vocabulary[:36]) for _ in range(rng.randrange(80))) for _ in range(30))]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 16)))) for i in range(12)] + [(None, texts[4]), (50, texts[5])]
    found = {r.doc_id: r for r in d.find_contamination(docs_of(texts), spark.createDataFrame(items, "item_id long, text string"), width, (k, slop), block).collect()}
    assert [sorted(found[i].near_items) for i in range(len(texts))] == brute_near(texts, items, width, k, slop)
    assert [sorted(found[i]["items"]) for i in range(len(texts))] == [sorted(x for x in row[2] if x != "None") for row in brute(texts, items, width)]


def test_one_index_for_several_benchmarks(spark, docs_of):
    """The index holds all words of the documents, so a benchmark that comes later finds its own."""
    index = d.build_index(docs_of(["a b c d", "x y z"]))
    ask = lambda t: {r.doc_id: r.hit_spans for r in d.query_index(index, spark.createDataFrame([(1, t)], "item_id long, text string"), 3).collect()}
    assert ask("b c d") == {0: [[1, 4]], 1: []} and ask("x y z") == {0: [], 1: [[0, 3]]}
    with pytest.raises(ValueError, match="gap"):
        d.query_index(index, spark.createDataFrame([(1, "a")], "item_id long, text string"), d.GAP)


def test_blocks_keep_rows_apart(spark, docs_of):
    """Repeated and null ids stay rows of their own, however many blocks a benchmark takes."""
    items = [(i, f"k{i} l{i} m{i}") for i in range(8)]
    texts = ["k1 l1 m1", "k2 l2 m2 k3 l3 m3", "k4 l4 m4", None]
    for block in (1 << 20, 20):
        rows = d.digest(d.find_contamination(docs_of(texts, [5, 5, None, None]), spark.createDataFrame(items, "item_id long, text string"), 3, block_bytes=block)).collect()
        assert sorted((r.doc_id or 0, r.n_words, r.n_hit, r.n_items) for r in rows) == [(0, 0, 0, 0), (0, 3, 3, 1), (5, 3, 3, 1), (5, 6, 6, 2)]


@pytest.mark.parametrize(("width", "block"), [(3, 1 << 20), (3, 40), (10, 1 << 20)])
def test_against_brute_force(spark, docs_of, odd_texts, width, block):
    rng = random.Random(width)
    vocabulary = ["the", "The", "of", "é", "ß1", "x", "longer-word", "Q"]
    texts = [*odd_texts[:4], *(" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(60))) for _ in range(40))]
    items = [(i, t) for i, t in enumerate([None, "", "!!", "x", "of x", *(" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 14))) for _ in range(12))])]
    items.append((99, items[-1][1]))
    rows, items_of = run(spark, docs_of(texts), items, width=width, block_bytes=block)
    got = [(rows[i].n_words, rows[i].n_hit, items_of[i], rows[i].contaminated) for i in range(len(texts))]
    assert got == brute(texts, items, width)


def test_long_text_repeats_and_null_id(spark, docs_of):
    leak = "one two three four five six seven eight nine ten"
    texts = ["pad " * 200_000 + leak.upper() + " tail", leak, leak, leak + " "]
    rows = d.digest(d.find_contamination(docs_of(texts, [1, 2, 2, None]), spark.createDataFrame([(5, leak)], "item_id long, text string"))).collect()
    assert sorted(((r.doc_id or 0), r.n_words, r.n_hit) for r in rows) == [(0, 10, 10), (1, 200_011, 10), (2, 10, 10), (2, 10, 10)]


def test_empty_tables(spark, docs_of):
    none = spark.createDataFrame([], "item_id long, text string")
    assert d.find_contamination(docs_of([]), none).count() == 0
    rows = d.digest(d.find_contamination(docs_of(["a b"]), none)).collect()
    assert [(r.n_words, r.n_items, r.contaminated) for r in rows] == [(2, 0, False)]


def test_proximity(spark, docs_of):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    texts = ["gamma x x beta y alpha", "alpha " + "pad " * 50 + "beta " + "pad " * 50 + "gamma", item]
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    found = {r.doc_id: r.near_items for r in d.find_contamination(docs_of(texts), bench, near=(3, 6)).collect()}
    assert found[2] == ["7"] and found[1] == []
    # Rarest terms: those of no document come first, so only windows of known terms can match loosely.
    assert found[0] in ([], ["7"])


def test_candidates_are_cut_into_blocks(monkeypatch, spark, docs_of):
    monkeypatch.setattr(d, "CANDIDATES_AT_ONCE", 4)
    windows = d.Windows.of([(1, b"a b"), (2, b"b a")], 2)
    (batch,) = d.index_segments(3)(iter([docs_of(["a b a b a", "b b a"]).select("doc_id", "text").toArrow().combine_chunks().to_batches()[0]]))
    segment = d.Segment({c: batch.column(c)[0].as_py() for c in batch.schema.names}, windows.vocabulary)
    order = np.argsort(windows.terms, axis=1)
    hits = [x for w, s in d.exact_matches(segment, windows.terms, order) for x in zip(w.tolist(), s.tolist(), strict=True)]
    assert len(hits) == 5
