import numpy as np

from knotwork.llm import media as m


def melody(seed, notes=60):
    rng = np.random.default_rng(seed)
    t = np.arange(m.NOTE) / m.RATE
    return np.concatenate([0.5 * np.sin(2 * np.pi * 110 * 2 ** (n / 12) * t) for n in rng.integers(0, 24, notes)])


def table(spark, rows):
    return spark.createDataFrame(rows, "id long, media binary, fp string")


def test_wav_and_chroma():
    x = np.sin(2 * np.pi * 440 * np.arange(4000) / m.RATE)
    y = m.decode_wav(m.encode_wav(x))
    assert np.abs(x - y).max() < 1e-3
    assert (m.chroma(y).argmax(1) == 0).all()
    for bad in (None, b"", b"RIFFnope", b"\0" * 100):
        assert m.decode_wav(bad) is None
    assert len(m.fingerprint(np.zeros(100))) == 0


def test_filters_by_hand():
    x = melody(1)
    c = m.chroma(x)
    got = m.fingerprint(x)
    for at in (0, 7, len(got) - 1):
        value = 0
        for plus, minus in m.filter_bank():
            area = lambda rs: sum(c[at + a : at + a + w, y : y + h].sum() for a, y, w, h in rs)
            r = np.log1p(area(plus)) - np.log1p(area(minus))
            value = value << 2 | int(m.GRAY[np.searchsorted(m.THRESHOLDS, r)])
        assert bin(value ^ int(got[at])).count("1") <= 1  # float sums may differ at a threshold


def test_alignment_by_offset(spark):
    x = melody(2, 80)
    part, noisy = x[10 * m.HOP :], x + np.random.default_rng(0).normal(0, 0.005, len(x))
    media = [(100, m.encode_wav(x), "c"), (1, m.encode_wav(part), "c"), (2, m.encode_wav(noisy), "c"), (3, m.encode_wav(melody(9)), "c"), (4, m.encode_wav(x), "c"), (5, None, "c"), (6, b"bad", "c"), (7, m.encode_wav(x[:600]), "c"), (200, m.encode_wav(melody(11)), "c")]
    out = {r.id: r for r in m.align_recordings(m.fingerprints(table(spark, media))).collect()}
    assert out[100].class_id == out[4].class_id == 4 and out[100].n_links == 2
    assert (out[100].best_class, out[100].best_offset, out[100].best_error) == (1, -10, 0.0)
    assert out[200].n_links == 0 and out[200].best_class is None and out[3].n_links is None
    assert out[5].class_id is None and out[6].n_frames == 0 and out[7].n_frames == 0 and out[7].class_id == 7


def test_blocks_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    base = [melody(s, 40) for s in range(4)]
    rows = [(i, m.encode_wav(base[i % 4][int(rng.integers(0, 8)) * m.HOP :] * (1 + i / 100)), "c") for i in range(24)]
    prints = m.fingerprints(table(spark, rows)).collect()
    fp = {r.id: np.frombuffer(r.fp, "<u4") for r in prints}

    def best(a, b):
        """(votes, offset, error) of b against query a."""
        hist = {}
        for i, x in enumerate(fp[b]):
            for j, y in enumerate(fp[a]):
                if x == y:
                    hist[i - j] = hist.get(i - j, 0) + 1
        if not hist or max(hist.values()) < 3:
            return None
        o = min(k for k, v in hist.items() if v == max(hist.values()))
        pairs = [(i, i - o) for i in range(len(fp[b])) if 0 <= i - o < len(fp[a])]
        return o, sum(int(fp[b][i] ^ fp[a][j]).bit_count() for i, j in pairs) / (32 * len(pairs))

    expected = {}
    reps = {f.tobytes(): min(i for i in fp if fp[i].tobytes() == f.tobytes()) for f in fp.values()}
    classes = sorted(set(reps.values()))
    for q in range(0, 24, 6):
        mine = reps[fp[q].tobytes()]
        hits = sorted((round(r[1], 6), c, r[0]) for c in classes if c != mine and (r := best(mine, c)) and r[1] <= 0.2)
        expected[q] = (len(hits), *(hits[0] if hits else (None, None, None)))
    for block in (2048, 1):
        out = {r.id: (r.n_links, r.best_error, r.best_class, r.best_offset) for r in m.align_recordings(m.fingerprints(table(spark, rows)), 6, block=block).collect() if r.is_query}
        assert out == expected


def test_vectors_and_empty(spark):
    v = spark.createDataFrame([(0, [0.1, 0.2, None] * 20), (1, None), (2, [])], "id long, vector array<float>")
    out = {r.id: r for r in m.fingerprint_vectors(v).collect()}
    assert out[0].n_frames > 0 and out[1].n_frames == out[2].n_frames == 0
    assert m.fingerprint_vectors(v.where("false")).count() == 0


def test_recall_against_a_search_over_all_offsets():
    """Noisy, quieter, cut recordings: links found, of those that any offset with half of the shorter one shows."""
    rng = np.random.default_rng(7)

    def least_error(a, b):
        out = 1.0
        for o in range(-len(a) + 1, len(b)):
            x, y = max(o, 0), max(-o, 0)
            n = min(len(b) - x, len(a) - y)
            if 2 * n >= min(len(a), len(b)):
                out = min(out, np.bitwise_count(b[x : x + n] ^ a[y : y + n]).sum() / (32 * n))
        return out

    linked = found = near = near_found = 0
    for seed in range(40):
        x = melody(seed, 64)
        a = m.fingerprint(x)
        for noise in (0.002, 0.005, 0.01, 0.02, 0.04, 0.08, 0.15):
            y = x[int(rng.integers(0, 2000)) :]
            b = m.fingerprint(y * rng.uniform(0.3, 1) + rng.normal(0, noise, len(y)))
            least = least_error(a, b)
            if least <= 0.2:
                row, _, _, _, error = m.QueryBlock([0], [a]).align([b], 3)
                hit = bool(len(row) and error[0] <= 0.2)
                linked, found, near, near_found = linked + 1, found + hit, near + (least <= 0.1), near_found + (hit and least <= 0.1)
    assert linked > 250 and found / linked >= 0.9 and near_found / near >= 0.98


def least_error(a, b):
    """The least bit error of any offset with half of the shorter recording."""
    out = 1.0
    for o in range(-len(a) + 1, len(b)):
        x, y = max(o, 0), max(-o, 0)
        n = min(len(b) - x, len(a) - y)
        if 2 * n >= min(len(a), len(b)):
            out = min(out, np.bitwise_count(b[x : x + n] ^ a[y : y + n]).sum() / (32 * n))
    return out


def test_recall_in_every_band():
    """Links by their least bit error up to the limit: each band is found, not only the easy ones."""
    rng = np.random.default_rng(77)
    bands = {k: [] for k in range(4)}
    for seed in range(60):
        x = melody(1000 + seed, 64)
        a = m.fingerprint(x)
        for noise in (0.01, 0.02, 0.05, 0.08, 0.1, 0.12, 0.15, 0.2):
            y = x[int(rng.integers(0, 4000)) :]
            b = m.fingerprint(y * rng.uniform(0.3, 1) + rng.normal(0, noise, len(y)))
            least = least_error(a, b)
            if least <= 0.2:
                row, _, _, _, error = m.QueryBlock([0], [a]).align([b], 3)
                bands[min(3, int(least / 0.05))].append(bool(len(row) and error[0] <= 0.2))
    assert all(len(b) >= 20 and np.mean(b) >= 0.9 for b in bands.values()), {k: (len(b), np.mean(b)) for k, b in bands.items()}


def test_halves_vote_apart():
    """An upper half never meets a lower one of the same bits."""
    a, b = np.array([0x00010002] * 5, np.uint32), np.array([0x00020001] * 5, np.uint32)
    assert len(m.QueryBlock([0], [a]).align([b], 1)[0]) == 0
    row, _, offset, votes, error = m.QueryBlock([0], [a]).align([a], 1)
    assert (row[0], offset[0], votes[0], error[0]) == (0, 0, 10, 0.0)


def test_takes_find_each_other(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(0, 0.15, 64)]) for i in range(40)] + [(None, [0.1] * 64), (41, None), (42, [])]
    out = m.fingerprint_takes(spark.createDataFrame(rows, "id long, vector array<float>"), 10).collect()
    assert len(out) == 47 and {(r.id, r["take"]) for r in out if r.id is not None} == {(i, 0) for i in [*range(40), 41, 42]} | {(i, 1) for i in range(0, 40, 10)}
    prints = {2 * r.id + r["take"]: r for r in m.fingerprints(m.takes(spark.createDataFrame(rows[:40], "id long, vector array<float>"), 10)).selectExpr("id div 2 id", "id % 2 take", "fp").collect()}
    prints = {k: np.frombuffer(r.fp, "<u4") for k, r in prints.items()}
    for r in out:
        if r.is_query and r.id is not None and r.id < 40:
            close = {k for k in prints if k != 2 * r.id and least_error(prints[2 * r.id], prints[k]) <= 0.2}
            assert r["take"] == 0 and r.n_links == len(close) and (not close or r.best_class == 2 * r.id + 1)
    assert sum(r.n_links or 0 for r in out) >= 3
