"""Strong components, trimming, descendants and cycles against plain searches."""

import random

import pytest

from knotwork import session
from knotwork.operators import graph, strong


def table(spark, pairs):
    return spark.createDataFrame(sorted(pairs), "src long, dst long")


def reach(pairs):
    after = {}
    for a, b in pairs:
        after.setdefault(a, set()).add(b)
        after.setdefault(b, set())
    out = {}
    for s in after:
        seen, todo = set(), [s]
        while todo:
            for n in after[todo.pop()]:
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        out[s] = seen
    return out


def brute_strong(pairs):
    r = reach(pairs)
    return {n: min({n} | {m for m in r[n] if n in r[m]}) for n in r}


def brute_core(pairs):
    core = set(pairs)
    while True:
        fed, feeding = {b for _, b in core}, {a for a, _ in core}
        kept = {(a, b) for a, b in core if a in fed and b in feeding}
        if kept == core:
            return core
        core = kept


def graphs():
    rng = random.Random(0)
    yield "chain", {(i, i + 1) for i in range(40)}
    yield "ring", {(i, (i + 1) % 30) for i in range(30)}
    yield "rings on a chain", {(i, i + 1) for i in range(30)} | {(9, 3), (25, 18), (26, 26)}
    yield "tree up and down", {(i // 2, i) for i in range(2, 60)} | {(100 + i, 100 + i // 2) for i in range(2, 60)}
    yield "empty", set()
    for n, m in ((25, 30), (25, 45)):
        yield f"random {n} {m}", {(rng.randrange(n), rng.randrange(n)) for _ in range(m)}


@pytest.mark.parametrize("name,pairs", list(graphs()))
def test_against_searches(spark, monkeypatch, name, pairs):
    monkeypatch.setattr(strong, "FEW_PASSING", 2)
    e = table(spark, pairs)
    assert {tuple(r) for r in strong.trimmed(e).collect()} == brute_core(pairs)
    want = brute_strong(pairs)
    got = [tuple(r) for r in strong.strong_components(e).collect()]
    assert len(got) == len(want) and dict(got) == want
    r = reach(pairs)
    assert {tuple(x) for x in strong.cyclic_nodes(e).collect()} == {(n, c) for n, c in want.items() if n in r[n]}


def test_long_chain_in_few_rounds(spark, monkeypatch):
    """A chain of 100,000 nodes, and one that is closed to a ring: rounds follow the logarithm."""
    made = []
    real = session.materialize
    monkeypatch.setattr(strong, "materialize", lambda df, label="": made.append(label) or real(df, label))
    pairs = spark.range(100_000).selectExpr("id as src", "id + 1 as dst")
    assert graph.is_cyclic(pairs).first()[0] is False
    assert len(made) < 60 and made.count("core") < 10
    ring = spark.range(20_000).selectExpr("id as src", "(id + 1) % 20000 as dst")
    got = strong.cyclic_nodes(ring)
    assert got.count() == 20_000 and got.select("component").distinct().collect()[0][0] == 0


def brute_roots(pairs):
    """Component (by smallest node) to the descendants of its best candidate, and those that have as many."""
    r = reach(pairs)
    near = {n: set() for n in r}
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    comps, seen = [], set()
    for n in sorted(r):
        if n not in seen:
            comp, todo = {n}, [n]
            while todo:
                for m in near[todo.pop()] - comp:
                    comp.add(m)
                    todo.append(m)
            seen |= comp
            comps.append(comp)
    fed = {b for _, b in pairs}
    out = {}
    for comp in comps:
        asked = [n for n in comp if n not in fed] or list(comp)
        count = {n: len(r[n] - {n}) for n in asked}
        out[min(comp)] = max(count.values()), {n for n in asked if count[n] == max(count.values())}
    return out


@pytest.mark.parametrize("size", [64, 3])
def test_component_roots(spark, monkeypatch, size):
    """Roots equal those of the closure; small sketches bring in estimates, hubs and exact counts."""
    monkeypatch.setattr(strong, "SKETCH", size)
    monkeypatch.setattr(strong, "MARGIN", 1e9 if size == 3 else 8)  # three hashes say little
    rng = random.Random(size)
    for k, (n, m) in enumerate(((30, 36), (30, 60))):
        pairs = {(rng.randrange(n), rng.randrange(n)) for _ in range(m)}
        if k == 1:  # sources before a ring, and beside it
            pairs = {(a, b) for a, b in pairs if b > 5 and a != b} | {(20, 21), (21, 22), (22, 20), (0, 20), (1, 22), (1, 7)}
        e = table(spark, pairs)
        ranks = graph.edge_nodes(e).selectExpr("node", "0.1D as pagerank")
        got = {r.component: (r.root_descendants, r.root_norm) for r in graph.component_roots(e, ranks).collect()}
        want = brute_roots(pairs)
        assert {c: d for c, (d, _) in got.items()} == {c: d for c, (d, _) in want.items()}
        assert all(got[c][1] in nodes for c, (_, nodes) in want.items())


def test_no_closure(spark, monkeypatch):
    """Many sources before one large ring: what the ring reaches is counted once, not for each source."""
    sizes = []
    real = strong.spread
    monkeypatch.setattr(strong, "spread", lambda *a, **k: sizes.append((out := real(*a, **k)).count()) or out)
    n, ring = 200, 100
    pairs = {(i, (i + 1) % ring) for i in range(ring)} | {(1000 + i, i % ring) for i in range(n)} | {(1007, 1000 + n + j) for j in range(3)}
    got = graph.component_roots(table(spark, pairs), graph.edge_nodes(table(spark, pairs)).selectExpr("node", "0.1D as pagerank")).collect()
    assert [(r.root_norm, r.root_descendants) for r in got] == [(1007, ring + 3)]
    assert sum(sizes) < 3 * (n + ring)


def brute_cycles(pairs):
    after = {}
    for a, b in pairs:
        after.setdefault(a, []).append(b)
    out = []

    def walk(path):
        for n in after.get(path[-1], ()):
            if n == path[0]:
                out.append((len(path), " -> ".join(map(str, path))))
            elif n > path[0] and n not in path:
                walk([*path, n])

    for s in after:
        walk([s])
    return sorted(out)


@pytest.mark.parametrize("seed", range(2))
def test_cycles(spark, seed):
    rng = random.Random(seed)
    pairs = {(rng.randrange(8), rng.randrange(8)) for _ in range(15)}
    want = brute_cycles(pairs)
    for limit, most in ((20, None), (10_000, 4)):
        got = [tuple(r) for r in graph.simple_cycles(table(spark, pairs), limit=limit, max_length=most).collect()]
        assert got == [c for c in want if most is None or c[0] <= most][:limit]


def test_one_long_cycle_in_a_dense_core(spark):
    """Layers that are wholly linked lead nowhere but to two small cycles; the one long cycle passes beside them."""
    layers = [list(range(100 * k, 100 * k + 6)) for k in range(1, 4)]
    dense = {(a, b) for x, y in zip(layers, layers[1:]) for a in x for b in y}
    small = {(1, 2), (2, 1), (901, 902), (902, 901)} | {(2, a) for a in layers[0]} | {(a, 901) for a in layers[-1]}
    long = {(2000 + i, 2000 + (i + 1) % 7) for i in range(7)} | {(2003, 100), (305, 2004)}
    got = [tuple(r) for r in graph.simple_cycles(table(spark, dense | small | long), limit=3).collect()]
    assert [x[0] for x in got] == [2, 2, 7]
