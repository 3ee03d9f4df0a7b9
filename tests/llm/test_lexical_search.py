import math
import random
from collections import Counter

import numpy as np
import pytest

from knotwork.llm import lexical_search as ls
from knotwork.llm.decontaminate import words


def brute(docs, queries, top=20):
    """Every document scored for every query."""
    counted = [(i, Counter(words(t.encode() if t else None))) for i, t in docs]
    n_docs, n_terms = sum(1 for _, c in counted if c), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in queries:
        asked = words(text.encode() if text else None)
        found = []
        for doc, c in counted:
            m = 100 - 25 + (25 * sum(c.values()) * n_docs) // max(1, n_terms)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in asked if c[t])
            if score > 0:
                found.append((-score, doc is not None, doc or 0))
        found.sort()
        out += [(item, k + 1, d if known else None, -s) for k, (s, known, d) in enumerate(found[:top])]
    return sorted(out, key=repr)


def test_bytes():
    rng = np.random.default_rng(0)
    values = np.concatenate([[0, 127, 128, 16383, 16384, (1 << 28), (1 << 34)], rng.integers(0, 1 << 30, 1000)])
    data, end = ls.pack(values)
    assert ls.unpack(data).tolist() == values.tolist() and end[-1] == len(data)
    assert ls.unpack(ls.pack(np.zeros(0, np.int64))[0]).tolist() == []


@pytest.mark.parametrize("top", [1, 3, 20])
def test_merge(top):
    rng = random.Random(top)
    for _ in range(300):
        lists = []
        for _ in range(rng.randint(1, 8)):
            at = sorted(rng.sample(range(200), rng.randint(1, 120)))
            gain = [rng.randint(0, 6) for _ in at]
            lists.append((at, gain, max(gain), rng.randint(1, 3)))
        total = Counter()
        for at, gain, _, times in lists:
            for d, g in zip(at, gain, strict=True):
                total[d] += g * times
        want = sorted(((s, -d) for d, s in total.items() if s > 0), reverse=True)[:top]
        assert ls.best(lists, top) == want


@pytest.mark.parametrize("shard_bytes,block_bytes", [(1 << 20, 1 << 20), (400, 60)])
def test_search(spark, docs_of, shard_bytes, block_bytes):
    rng = random.Random(3)
    vocabulary = ["the", "of", "The", "naïve", "日本", "x1", *(f"w{i}" for i in range(40))]
    say = lambda n: " ".join(rng.choice(vocabulary[: rng.randint(1, len(vocabulary))]) for _ in range(n))
    docs = [(None, None), (1, ""), (2, " \n.,"), (None, "the w1"), (3, "the of " * 20_000), (3, "the w2"), (7, "same same w3"), (8, "same same w3"), *((i, say(rng.randint(1, 60))) for i in range(10, 150))]
    docs += [(i, "the copy of w5") for i in range(200, 260)]
    queries = [(0, "the of The w1, w2-w2"), (1, None), (2, "..."), (None, "same w3"), (4, "copy"), (4, "copy"), (5, say(30)), (6, "unknown words"), (7, "日本 naïve x1")]
    table = docs_of([t for _, t in docs], [i for i, _ in docs]).repartition(3)
    asked = spark.createDataFrame([(*q, "x") for q in queries], "item_id long, text string, term string")
    got = ls.search(table, asked, shard_bytes=shard_bytes, block_bytes=block_bytes)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(docs, queries)


def test_nothing(spark, docs_of):
    none = spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ls.search(docs_of([]), one).count() == 0
    assert ls.search(docs_of([None, ""]), one).count() == 0
    assert ls.search(docs_of(["a"]), none).count() == 0
    assert [tuple(r) for r in ls.search(docs_of(["a b", "c"]), one).collect()] == brute([(0, "a b"), (1, "c")], [(1, "a")])
