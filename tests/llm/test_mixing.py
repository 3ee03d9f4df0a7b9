from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from knotwork.llm import mixing


def brute_targets(sizes):
    """Shares by exact fractions, the excess dealt again until no source is above three times its size."""
    weights = [1 + i % 3 for i in range(len(sizes))]
    out = [None] * len(sizes)
    while None in out:
        open_ = [i for i, t in enumerate(out) if t is None]
        rest = sum(sizes) - sum(t for t in out if t is not None)
        shares = {i: Fraction(rest * weights[i], sum(weights[j] for j in open_)) for i in open_}
        above = [i for i in open_ if shares[i] > 3 * sizes[i] or not sizes[i]]
        for i in above or open_:
            out[i] = Fraction(3 * sizes[i]) if above else shares[i]
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000])
def test_permutation(n):
    keys = mixing.round_keys("a", 0, 1)
    got = mixing.permuted(np.arange(n), n, keys)
    assert sorted(got.tolist()) == list(range(n))
    assert mixing.permuted(got, n, keys, inverse=True).tolist() == list(range(n))
    assert n < 64 or (got != np.arange(n)).sum() > n / 2


def test_share_out():
    rng = np.random.default_rng(0)
    for _ in range(200):
        sizes = (rng.pareto(0.6, rng.integers(1, 12)) * 20).astype(np.int64) * rng.integers(0, 2, 1)[0] + rng.integers(0, 9)
        got = mixing.share_out(sizes, np.array([1 + i % 3 for i in range(len(sizes))]))
        assert got == pytest.approx([float(t) for t in brute_targets(sizes.tolist())])


def test_slots_meet_quotas():
    rng = np.random.default_rng(1)
    for _ in range(300):
        size, block = int(rng.integers(1, 400)), int(rng.integers(1, 40))
        s = mixing.Source("x", size, int(rng.integers(0, 3 * size + 1)), block, 5)
        if s.slots:
            turn, at, words = s.take(0, s.slots)
            assert words.sum() == s.quota and words.min() > 0
            assert len(set(zip(turn.tolist(), at.tolist()))) == s.slots
        else:
            assert s.quota == 0


def test_draws(monkeypatch):
    slots = np.array([5, 0, 100, 7])
    for exact in (10**9, 1):  # without replacement, and its normal limit
        monkeypatch.setattr(mixing, "EXACT_DRAWS", exact)
        got = np.array([mixing.drawn(slots, 40, np.random.default_rng(i)) for i in range(2000)])
        assert (got.sum(1) == 40).all() and (got >= 0).all() and (got <= slots).all()
        assert got.mean(0) == pytest.approx(slots * 40 / 112, abs=0.15)


def check(docs, mixed, out):
    rows = docs.select("doc_id", "source", "text").collect()
    size = lambda t: len((t or "").encode().split())
    sources = sorted({r.source for r in rows}, key=lambda s: (s is None, (s or "").encode()))
    total = Counter()
    for r in rows:
        total[r.source] += size(r.text)
    target = dict(zip(sources, brute_targets([total[s] for s in sources]), strict=True))
    want = sorted(((r.doc_id, size(r.text), total[r.source], float(target[r.source])) for r in rows), key=repr)
    got = mixing.digest(mixed).collect()
    assert [x[:3] for x in sorted((tuple(r)[:4] for r in got), key=repr)] == [x[:3] for x in want]
    assert sorted(r.target for r in got) == pytest.approx(sorted(x[3] for x in want))
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    taken = Counter()
    for r in mixed.fragments.join(mixed.sources, "source_index").groupBy("source").agg(F.sum("n_words").alias("n")).collect():
        taken[r.source] = r.n
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in sources)
    assert sum(r.taken for r in got) == sum(taken.values())
    return got


def test_mix(spark, docs_of, odd_texts):
    rng = np.random.default_rng(2)
    texts = [*odd_texts, *(" ".join(f"w{i}" for i in rng.integers(0, 50, rng.integers(1, 300))) for _ in range(60))]
    ids = [None, None, *range(len(texts) - 2)]
    name = F.when(F.col("doc_id") % 3 == 0, "hot").when(F.col("doc_id") % 7 == 1, None).otherwise(F.concat(F.lit("s"), F.col("doc_id") % 5))
    docs = docs_of(texts, ids).withColumn("source", name)
    docs = docs.unionByName(docs.where("doc_id > 40")).cache()  # repeated rows
    out = []
    for n in (1, 7):
        mixed = mixing.mix(docs.repartition(n), block=64, shard=16)
        got = check(docs, mixed, out)
        out.append(sorted(map(tuple, got), key=repr))
        filled = Counter(r.shard for r in mixed.fragments.select("shard", "slot").distinct().collect())
        assert all(c == 16 for s, c in filled.items() if s < max(filled))
    assert out[0] == out[1]  # alike however the rows are dealt


def test_texts(spark, docs_of):
    texts = [" ".join(f"d{d}w{i}" for i in range(5 + 13 * d % 70)) for d in range(30)]
    docs = docs_of(texts).withColumn("source", F.concat(F.lit("s"), F.col("doc_id") % 4))
    mixed = mixing.mix(docs, block=16, shard=8)
    got = {(r.shard, r.slot): r.text.split() for r in mixing.shard_texts(docs, mixed).collect()}
    taken = defaultdict(list)
    for r in mixed.fragments.collect():
        taken[r.shard, r.slot].append((r.place, texts[r.doc_id].split()[r.word : r.word + r.n_words]))
    assert got == {k: [w for _, ws in sorted(v) for w in ws] for k, v in taken.items()}
    assert max(map(len, got.values())) == 16
    stream = {s: [w for d in range(30) if d % 4 == s for w in texts[d].split()] for s in range(4)}
    whole = {s: {tuple(stream[s][i : i + 16]) for i in range(0, len(stream[s]), 16)} for s in range(4)}
    source = lambda words: int(words[0][1 : words[0].index("w")]) % 4
    assert all(any(b[: len(w)] == tuple(w) for b in whole[source(w)]) for w in got.values())


def test_without_words(spark, docs_of):
    assert mixing.digest(mixing.mix(docs_of([]))).count() == 0
    got = mixing.digest(mixing.mix(docs_of([None, "", " "]))).collect()
    assert [(r.size, r.source_size, r.target, r.taken) for r in got] == [(0, 0, 0.0, 0)] * 3
    assert [(r.target, r.taken) for r in mixing.digest(mixing.mix(docs_of(["one"]))).collect()] == [(1.0, 1)]


def test_too_many_sources(spark, docs_of, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_SOURCES", 1)
    with pytest.raises(ValueError, match="sources"):
        mixing.mix(docs_of(["a", "b"]).withColumn("source", F.col("doc_id").cast("string")))
