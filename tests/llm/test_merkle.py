import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from knotwork.llm import merkle


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(r, text):
    fields = [r.doc_id, r.source, r.lang, r.n_chars, text]
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def climb(levels, at, node):
    """The siblings, in order, and the top that a node gives."""
    seen = []
    for level in levels[:-1]:
        a = at - at % 16
        run = level[a : a + 16]
        seen += run[: at - a] + run[at - a + 1 :]
        node = h(*run[: at - a], node, *run[at - a + 1 :])
        at //= 16
    return seen, node


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        by[s].sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r, r.text)))
    own = {s: tree([leaf(r, r.text) for r in by[s]]) for s in order}
    upper = tree([own[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, r in enumerate(by[s]):
            bent = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and r.text is not None
            text = "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text) if bent else r.text
            inner, mid = climb(own[s], i, leaf(r, text))
            outer, top = climb(upper, k, mid)
            out.append((r.doc_id, leaf(r, r.text), own[s][-1][0], upper[-1][0], h(*inner, *outer), top, top == upper[-1][0]))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def table(docs_of, odd_texts):
    texts = [*odd_texts, *(f"Text {i} Über É" for i in range(700))]
    ids = [None, None, 5, 5, *range(6, 2 + len(texts))]
    name = F.when(F.col("doc_id") < 300, "hot").when(F.col("doc_id") > 690, "").otherwise(F.concat(F.lit("s"), F.col("doc_id") % 40))
    docs = docs_of(texts, ids).withColumn("source", name).withColumn("place", F.lit("x")).withColumn("tree", F.lit("y")).withColumn("lang", F.when(F.col("doc_id") % 9 > 0, F.col("lang")))
    return docs.unionByName(docs.where("doc_id between 20 and 60 or doc_id is null"))


@pytest.mark.parametrize("levels,top,parts", [(3, 4096, 1), (1, 4096, 3), (1, 50, 3), (1, 4, 2)])
def test_verify(spark, table, levels, top, parts):
    """With small blocks and a small top, blocks are reduced in several rounds, and subroots by blocks too."""
    docs = table.repartition(parts)
    got = merkle.digest(merkle.verify(docs, merkle.tampered(docs), levels, top))
    want = brute(table.collect())
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert 0 < sum(not x[-1] for x in want) < len(want)


def test_proofs(spark, table):
    for r in merkle.proofs(table, levels=1).where("doc_id % 11 = 0").collect():
        path = [(s.left.encode(), s.right.encode()) for s in r.path]
        assert merkle.folded(r.leaf.encode(), path) == r.root.encode()
        assert merkle.folded(("0" * 64).encode(), path) != r.root.encode()


def test_small(spark, docs_of):
    assert merkle.verify(docs_of([])).count() == 0
    for texts in (["a"], [None, ""], ["a"] * 17):
        docs = docs_of(texts)
        got = merkle.digest(merkle.verify(docs, merkle.tampered(docs)))
        assert sorted(map(tuple, got.collect()), key=repr) == brute(docs.collect())
    bare = spark.createDataFrame([(1,)], "doc_id long")
    assert merkle.verify(bare).first().verified
