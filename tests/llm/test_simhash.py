import random

import numpy as np
import pytest
import xxhash

from knotwork.llm import simhash as s


def brute_fingerprint(text):
    words = text.lower().split(" ") if text else []
    shingles = [" ".join(words[a : a + 3]) for a in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def components(fps):
    label = list(range(len(fps)))
    for _ in range(len(fps)):
        for i in range(len(fps)):
            for j in range(len(fps)):
                if (fps[i] ^ fps[j]).bit_count() <= 2:
                    label[i] = label[j] = min(label[i], label[j])
    return label


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_golay_is_perfect():
    patterns, first = s.coset_patterns(0)
    assert (np.diff(first) == 1).all() and len(patterns) == 1 << 11
    assert len(s.coset_patterns(1)[0]) == 8855 and len(s.coset_patterns(2)[0]) == 33649


def test_syndromes_by_halves():
    x = np.random.default_rng(3).integers(0, 1 << 23, 500)
    assert s.syndrome(x).tolist() == [s.remainder(int(v)) for v in x]


@pytest.mark.parametrize("flips", [0, 1, 2])
def test_anchors_cover_every_flip(flips):
    rng = random.Random(flips)
    for _ in range(200):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), flips):
            y ^= 1 << b
        a, _ = s.anchors_of(np.array([signed(y)], np.int64), 2)
        assert s.home(np.array([signed(x)], np.int64))[0] in set(a.tolist())
    a, _ = s.anchors_of(np.array([rng.getrandbits(63) for _ in range(500)], np.int64), 2)
    assert 50 < len(a) / 500 < 72


def near_groups(rng, n, flips):
    """Fingerprints and some that differ from them in a few bits."""
    fps = {rng.getrandbits(64) for _ in range(n)}
    for x in list(fps)[: n // 3]:
        y = x
        for _ in range(4):
            for b in rng.sample(range(64), rng.randrange(1, flips)):
                y ^= 1 << b
            fps.add(y)
    return sorted(fps)


def roots(fps, pairs):
    pairs = list(pairs)
    at = {signed(x): i for i, x in enumerate(fps)}
    label = list(range(len(fps)))
    for _ in range(len(fps)):
        for x, y in pairs:
            label[at[x]] = label[at[y]] = min(label[at[x]], label[at[y]])
    return label


@pytest.mark.parametrize("pairs_at_once", [1 << 19, 3])
def test_links_against_brute_force(monkeypatch, pairs_at_once):
    monkeypatch.setattr(s, "PAIRS_AT_ONCE", pairs_at_once)
    fps = near_groups(random.Random(5), 40, 4)
    a, owner = s.anchors_of(np.array([signed(x) for x in fps], np.int64), 2)
    fp = np.array([signed(fps[i]) for i in owner], np.int64)
    own = s.home(fp) == a
    src, dst = s.links_in(np.concatenate([a, a[own]]), np.repeat([0, 1], [len(a), own.sum()]), np.concatenate([fp, fp[own]]), 2)
    assert roots(fps, zip(src.tolist(), dst.tolist(), strict=True)) == components(fps)


@pytest.mark.parametrize("side", [1, 3, 1 << 10])
def test_grid_of_cells_against_brute_force(spark, monkeypatch, side):
    """However small the cells of an anchor, each home meets each copy in one of them."""
    monkeypatch.setattr(s, "HOMES", side)
    monkeypatch.setattr(s, "COPIES", 2 * side)
    rng = random.Random(side)
    x = rng.getrandbits(64)
    fps = sorted({*near_groups(rng, 24, 4), *(x ^ 1 << 50 + k ^ 1 << 57 + j for k in range(7) for j in range(7))})
    df = spark.createDataFrame([(signed(f), i) for i, f in enumerate(fps)], "fp long, low long")
    want = components(fps)
    got = {r.fp: r.root for r in s.link_components(df).collect()}
    linked = {i for i, c in enumerate(want) if want.count(c) > 1}
    assert set(got) == {signed(fps[i]) for i in linked}
    assert len({got[signed(fps[i])] for i in linked}) == len({want[i] for i in linked})
    assert all(got[signed(fps[i])] == got[signed(fps[want[i]])] for i in linked)


def test_a_large_group_goes_to_many_bounded_cells(spark):
    """40,000 near copies around one anchor: every cell is bounded, and the group is one component."""
    rng = random.Random(6)
    top, fps = rng.getrandbits(46), set()
    while len(fps) < 40_000:
        fps.add(top | rng.getrandbits(18) << 46)
    df = spark.createDataFrame([(signed(f), i) for i, f in enumerate(fps)], "fp long, low long")
    size = s.cells(df, 2).groupBy("cell", "side").count().groupBy("side").max("count").collect()
    assert max(r[1] for r in size if r.side == 1) < 1.3 * s.HOMES and max(r[1] for r in size if r.side == 0) < 1.3 * s.COPIES
    out = s.link_components(df)
    assert (out.count(), out.select("root").distinct().count()) == (40_000, 1)


def test_pieces_end_between_cells(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(s, "ROWS_AT_ONCE", 50)
    rng = random.Random(8)
    fps = [rng.getrandbits(63) for _ in range(30)]
    fps = np.array(sorted({*fps, *(x ^ 1 for x in fps), *(x ^ 6 for x in fps)}), np.int64)
    anchor, owner = s.anchors_of(fps, 2)
    own = s.home(fps[owner]) == anchor
    cell = np.concatenate([anchor, anchor[own]])
    order = np.argsort(cell, kind="stable")
    side, fp = np.repeat([0, 1], [len(anchor), own.sum()])[order], np.concatenate([fps[owner], fps[owner][own]])[order]
    whole = pa.RecordBatch.from_arrays([pa.array(cell[order]), pa.array(side.astype(np.int32)), pa.array(fp)], names=["cell", "side", "fp"])
    pairs = set()
    for batch in s.compare(2)(iter([whole.slice(k, 37) for k in range(0, whole.num_rows, 37)])):
        pairs |= set(zip(*(c.to_pylist() for c in batch.columns), strict=True))
    label = {int(x): int(x) for x in fps}
    for _ in range(4):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    assert len(set(label.values())) == 30


def test_documents(spark, docs_of):
    rng = random.Random(1)
    base = [" ".join(rng.choice("abcdefghij") * rng.randrange(1, 4) for _ in range(400)) for _ in range(6)]
    near = [t + " zz" for t in base] + [t.upper() for t in base[:2]]
    texts = [None, "", "  ", "one", "one two", *base, *near, "x " * 100_000]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in s.digest(s.near_duplicates(docs_of(texts))).collect()}
    fps = [brute_fingerprint(" ".join((t or "").split())) for t in texts]
    label = components(fps)
    assert {i: (f"{fps[i]:016x}", label[i]) for i in range(len(texts))} == got
    assert got[0] == got[1] == ("0" * 16, 0)


def test_repeats_null_ids_and_empty(spark, docs_of):
    rows = s.near_duplicates(docs_of(["a b c d", "a b c d", "a b c d"], [3, None, 3])).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in rows) == [(0, 3), (3, 3), (3, 3)]
    assert s.near_duplicates(docs_of([])).count() == 0


def test_group_of_near_copies_gives_a_forest(spark):
    rng = random.Random(2)
    x = rng.getrandbits(63)
    fps = sorted({x ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a)} | {x})
    df = spark.createDataFrame([(signed(f), i) for i, f in enumerate(fps)], "fp long, low long")
    out = s.link_components(df).collect()
    assert len(out) == len(fps) and len({r.root for r in out}) == 1


def test_survivors_are_not_broadcast(spark, docs_of):
    """Those that stay are nearly as many as the documents."""
    kept = s.survivors(docs_of(["one two three four", "five six seven eight", "one two three four"]), ("doc_id", "text"))
    assert "LeftSemi" in (plan := kept._jdf.queryExecution().optimizedPlan().toString()) and "strategy=merge" in plan
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1]
