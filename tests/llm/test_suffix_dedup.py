import random

import numpy as np
import pytest

from knotwork.llm import induced_sort
from knotwork.llm import suffix_dedup as s


def brute(texts, ids, window):
    """By scanning documents in order of id: bytes covered by a window that was seen before."""
    seen, out = {}, {}
    for i in sorted(range(len(texts)), key=lambda k: (ids[k] is not None, ids[k] or 0)):
        t = (texts[i] or "").encode()
        place = -1 if ids[i] is None else ids[i]
        covered = bytearray(len(t))
        for a in range(len(t) - window + 1):
            first = seen.setdefault(t[a : a + window], (place, a))
            if first < (place, a):
                covered[a : a + window] = b"\1" * window
        out.setdefault(ids[i], []).append(bytes(x for x, c in zip(t, covered, strict=True) if not c))
    return {k: sorted(v) for k, v in out.items()}


def found(docs, window, gram, hot=s.HOT_FRAGMENTS):
    out = {}
    for r in s.dedup(docs, window, gram, hot).collect():
        assert r.n_bytes - r.n_removed == len(r.kept)
        out.setdefault(r.doc_id, []).append(bytes(r.kept))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("memory", [4, 1 << 20])
def test_suffix_order(memory):
    rng = random.Random(memory)
    for _ in range(150):
        t = np.array([*(rng.randint(1, rng.choice([1, 2, 5])) for _ in range(rng.randrange(60))), 0], np.int16)
        depth = rng.choice([1, 3, 8, 100])
        order, common = induced_sort.suffix_order(t, depth, memory)
        assert sorted(order.tolist()) == list(range(len(t)))
        cut = [t[i:][:depth].tolist() for i in order]
        for x, y, n in zip(cut, cut[1:], common[1:].tolist(), strict=False):
            same = next((k for k, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
            assert x <= y and n == same


@pytest.mark.parametrize(("seed", "hot"), [(0, 100), (1, 100), (2, 1), (3, 3)])
def test_against_brute_force(spark, docs_of, seed, hot, monkeypatch):
    monkeypatch.setattr(s, "SORT_BYTES", 500)
    monkeypatch.setattr(s, "FOLD_ROWS", 20)
    rng = random.Random(seed)
    shared = ["".join(rng.choice("abcdé") for _ in range(90)) for _ in range(5)]
    texts = [None, "", "short"]
    for _ in range(30):
        texts.append("".join(rng.choice([*shared, "xy", "".join(rng.choice("abc") for _ in range(40))]) for _ in range(rng.randrange(8))))
    texts += [texts[-1], "a" * 300, "a" * 150, "ab" * 200, "abc" * 90 + shared[0]]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    assert found(docs_of(texts, ids), 40, 16, hot) == brute(texts, ids, 40)


def test_production_window_and_long_text(spark, docs_of):
    rng = random.Random(9)
    base = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    edited = base[:1500] + "#" + base[1500:]
    texts = [base, edited, base[200:299], base[200:300], "z" + base[1000:2000] + "z", base * 40]
    assert found(docs_of(texts), s.WINDOW, s.GRAM) == brute(texts, list(range(6)), s.WINDOW)


def test_repeated_and_null_ids_and_empty(spark, docs_of):
    rng = random.Random(4)
    t = "".join(rng.choice("abcdefgh") for _ in range(200))
    got = found(docs_of([t, t, t + "x"], [5, 5, None]), 100, 32)
    assert got[5] == [b"", b""] and got[None] == [(t + "x").encode()]
    same = found(docs_of([t, t], [5, 5]), 100, 32)
    assert same[5] == [t.encode(), t.encode()]
    assert s.dedup(docs_of([])).count() == 0


def test_cut_ranges():
    assert s.cut_ranges(b"0123456789", [(2, 3), (4, 2), (8, 5), (20, 3)]) == (b"0167", 2)
