"""Graph operators on small literal graphs and against independent brute force on random ones."""

import random

import pytest
from pyspark.sql import functions as F

from knotwork.operators import graph, structure

GRAPHS = {
    "chain": [("a", "b"), ("b", "c")],
    "cycle": [("a", "b"), ("b", "c"), ("c", "a")],
    "self": [("a", "a")],
    "two": [("a", "b"), ("c", "d")],
    "bowtie": [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "c")],
    "barbell": [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "f"), ("f", "d")],
}


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def parts(nodes, pairs):
    left, out = set(nodes), []
    while left:
        seen, todo = set(), [left.pop()]
        while todo:
            n = todo.pop()
            seen.add(n)
            todo += [y for x, y in [*pairs, *((b, a) for a, b in pairs)] if x == n and y in left | set() and y not in seen]
        left -= seen
        out.append(seen)
    return out


def brute(pairs):
    nodes = {n for p in pairs for n in p}
    und = {tuple(sorted(p)) for p in pairs if p[0] != p[1]}
    base = parts(nodes, und)
    largest = max(map(len, base))
    out = {}
    for n in nodes:
        rest = parts(nodes - {n}, {p for p in und if n not in p})
        out[n] = (max(len(rest) - len(base), 0), round((largest - max(map(len, rest), default=0)) / largest, 6))
    bridges = {p for p in und if len(parts(nodes, und - {p})) > len(base)}
    return out, bridges


@pytest.mark.parametrize("name", list(GRAPHS))
def test_structure(spark, name):
    pairs = GRAPHS[name]
    impact, bridges = brute(pairs)
    e = edges(spark, pairs)
    got = {r.node: (r.component_gain, r.largest_component_loss) for r in structure.removal_impact(e).collect()}
    assert got == impact
    assert {(r.a, r.b) for r in structure.bridge_edges(e).collect()} == bridges


def test_structure_random(spark):
    rng = random.Random(7)
    for n, m in ((9, 8), (12, 16)):
        pairs = [(f"n{rng.randrange(n):02d}", f"n{rng.randrange(n):02d}") for _ in range(m)]
        impact, bridges = brute(pairs)
        e = edges(spark, pairs)
        assert {r.node: (r.component_gain, r.largest_component_loss) for r in structure.removal_impact(e).collect()} == impact
        assert {(r.a, r.b) for r in structure.bridge_edges(e).collect()} == bridges
        assert {r.node for r in structure.articulation_points(e).collect()} == {k for k, v in impact.items() if v[0] > 0}


def low_link(e, task_edges):
    return sorted(map(repr, map(tuple, structure.low_link(e, task_edges).collect())))


def test_large_components_by_joins(spark):
    """Components over the bound are searched by joins; the result is that of one task each, and of brute force."""
    rng = random.Random(5)
    pairs = [("alone", "alone")] + [(f"chain{i:02}", f"chain{i + 1:02}") for i in range(12)]
    for c, (n, m) in enumerate(((16, 18), (9, 24))):
        pairs += [(f"{c}-{rng.randrange(n):02}", f"{c}-{rng.randrange(n):02}") for _ in range(m)]
    e = edges(spark, pairs)
    whole = low_link(e, len(pairs))
    assert low_link(e, 0) == whole
    assert low_link(e, 12) == whole
    impact, bridges = brute(pairs)
    found = [r.asDict() for r in structure.low_link(e, len(pairs)).collect()]
    assert {(r["node"], r["other"]) for r in found if r["kind"] == "bridge"} == bridges
    assert {r["node"] for r in found if r["pieces"] > 1} == {k for k, v in impact.items() if v[0] > 0}
    assert low_link(edges(spark, []), 0) == []


def test_fragility_of_barbell_and_of_nothing(spark):
    row = structure.fragility(edges(spark, GRAPHS["barbell"])).first()
    assert (row.articulation_points_count, row.bridge_edges_count, row.max_component_gain) == (2, 1, 1)
    empty = structure.fragility(edges(spark, [])).first()
    assert empty.fragility_score == 0.0 and empty.articulation_points_count == 0


def test_pagerank_sums_to_one_and_prefers_the_sink(spark):
    for pairs in GRAPHS.values():
        got = {r.node: r.pagerank for r in graph.pagerank(edges(spark, pairs)).collect()}
        assert abs(sum(got.values()) - 1) < 1e-9
    got = {r.node: r.pagerank for r in graph.pagerank(edges(spark, GRAPHS["chain"])).collect()}
    assert got["c"] > got["b"] > got["a"]
    assert graph.pagerank(edges(spark, [])).count() == 0


@pytest.mark.parametrize(("name", "cyclic"), [("chain", False), ("cycle", True), ("self", True), ("two", False), ("barbell", True)])
def test_cycles(spark, name, cyclic):
    e = edges(spark, GRAPHS[name])
    assert graph.is_cyclic(e).first().is_cyclic is cyclic
    got = [tuple(r) for r in graph.simple_cycles(e).collect()]
    assert got == {"cycle": [(3, "a -> b -> c")], "self": [(1, "a")], "barbell": [(3, "a -> b -> c"), (3, "d -> e -> f")]}.get(name, [])


def test_cycles_of_any_length(spark):
    ring = [f"n{k:02d}" for k in range(11)]
    pairs = [*zip(ring, [*ring[1:], ring[0]]), ("n03", "n05"), ("n10", "tail")]
    got = [tuple(r) for r in graph.simple_cycles(edges(spark, pairs)).collect()]
    assert got == [(10, " -> ".join(n for n in ring if n != "n04")), (11, " -> ".join(ring))]
    assert graph.simple_cycles(edges(spark, pairs), limit=1).count() == 1
    assert graph.simple_cycles(edges(spark, pairs), max_length=10).count() == 1


def test_long_chain_components(spark):
    n = 200
    pairs = [(f"v{i:03d}", f"v{i + 1:03d}") for i in range(n)] + [("x", "y"), ("z", "z"), (None, "q")]
    got = {r.node: r.component for r in graph.components(edges(spark, pairs)).collect()}
    assert {got[f"v{i:03d}"] for i in range(n + 1)} == {"v000"}
    assert got["y"] == got["x"] == "x" and got["z"] == "z" and "q" not in got


def test_roots_degrees_and_global_root(spark):
    e = edges(spark, [*GRAPHS["cycle"], ("r", "s"), ("r", "t"), ("s", "t"), ("q", "t")])
    roots = graph.component_roots(e)
    got = {r.component: (r.root_norm, r.nodes_count, r.edges_count, r.zero_in_degree_nodes, r.root_descendants) for r in roots.collect()}
    assert got == {"a": ("a", 3, 3, 0, 2), "q": ("r", 4, 4, 2, 2)}
    g = graph.global_root(roots).first()
    assert (g.root_type, g.components_count, g.children) == ("virtual", 2, "a, r")
    d = {r.node: (r.in_degree, r.out_degree, r.total_degree) for r in graph.degrees(edges(spark, GRAPHS["self"])).collect()}
    assert d == {"a": (1, 1, 2)}


def test_simple_digraph_last_wins(spark):
    rel = spark.createDataFrame([("a", "b", "x", 1), ("a", "b", "y", 2), ("b", "b", "z", 3)], "src string, dst string, predicate string, n int")
    got = {(r.src, r.dst): r.predicate for r in graph.simple_digraph(rel, "n", ("predicate",)).collect()}
    assert got == {("a", "b"): "y", ("b", "b"): "z"}
    named = spark.createDataFrame([("a", "A", "b", "B", 1, 5), ("a", "AA", "a", "AAA", 2, None)], "src string, src_name string, dst string, dst_name string, n int, document_id long")
    assert {r.node: r.label for r in graph.node_labels(named, "n").collect()} == {"a": "AAA", "b": "B"}
    assert {r.node: r.document_ids for r in graph.node_documents(named).collect()} == {"a": [5], "b": [5]}


def test_projection_and_descendants(spark):
    e = edges(spark, GRAPHS["two"])
    assert tuple(graph.project_components(e, edges(spark, [("b", "c")])).first()) == (2, 1, 1, 1)
    assert {r.node: r.descendants for r in graph.descendant_counts(edges(spark, GRAPHS["cycle"])).collect()} == {"a": 2, "b": 2, "c": 2}
    assert graph.descendant_counts(e, spark.createDataFrame([("b",)], "node string")).first().descendants == 0
    assert e.where(F.col("src").isNull()).count() == 0
