"""Graph metrics on edges (src, dst): degrees, PageRank, components and roots, reachability, cycles.

Every operator is a loop of joins and aggregations over edge and vertex tables; nothing gathers a graph in one
task. Loops cut their lineage through tables in the shared folder and read back only counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import drop_materialized, materialize
from .components import star_components
from .store import numbered
from .strong import best_reach, cyclic_nodes, trimmed

# Key and name of the root above all component roots.
VIRTUAL_ROOT = "__graph_root__"
VIRTUAL_ROOT_NAME = "Global graph root"


def simple_digraph(relations: DataFrame, order: str | None = None, attributes: tuple[str, ...] = ()) -> DataFrame:
    """Parallel edges collapse; of their attributes the last in ``order`` win. Self-loops stay."""
    known = relations.where("src is not null and dst is not null")
    if not attributes:
        return known.select("src", "dst").distinct()
    last = F.max_by(F.struct(*attributes), order) if order else F.max(F.struct(*attributes))
    return known.groupBy("src", "dst").agg(last.alias("a")).select("src", "dst", "a.*")


def edge_nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def node_labels(relations: DataFrame, order: str) -> DataFrame:
    """(node, label): the label that came last, from (src, src_name, dst, dst_name)."""
    ends = F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("src_name").alias("label"), F.lit(0).alias("side")), F.struct(F.col("dst").alias("node"), F.col("dst_name").alias("label"), F.lit(1).alias("side"))))
    return relations.select(order, ends.alias("e")).groupBy("e.node").agg(F.max_by("e.label", F.struct(F.col(order), F.col("e.side"))).alias("label"))


def node_documents(relations: DataFrame) -> DataFrame:
    """(node, document_ids): the documents of the relations at a node, sorted."""
    ends = relations.where("document_id is not null").select(F.explode(F.array("src", "dst")).alias("node"), "document_id").distinct()
    return ends.groupBy("node").agg(F.array_sort(F.collect_list("document_id")).alias("document_ids"))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, in_degree, out_degree, total_degree) of a simple digraph; a self-loop counts once in each.

    One shuffle: both ends of an edge are counted in the same aggregation.
    """
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("e.*")
    counted = ends.groupBy("node").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    return counted.select("node", "in_degree", "out_degree", (F.col("in_degree") + F.col("out_degree")).alias("total_degree"))


def degree_metrics(edges: DataFrame) -> DataFrame:
    """One row: node and edge counts, largest and mean degrees."""
    d = degrees(edges)
    return d.agg(
        F.count("*").alias("nodes_count"), F.coalesce(F.sum("out_degree"), F.lit(0)).alias("edges_count"), F.coalesce(F.max("in_degree"), F.lit(0)).alias("max_in_degree"), F.coalesce(F.max("out_degree"), F.lit(0)).alias("max_out_degree"),
        F.round(F.coalesce(F.avg("in_degree"), F.lit(0.0)), 4).alias("avg_in_degree"), F.round(F.coalesce(F.avg("out_degree"), F.lit(0.0)), 4).alias("avg_out_degree"),
    )


def pagerank(edges: DataFrame, alpha: float = 0.85, max_iter: int = 100, tol: float = 1e-6) -> DataFrame:
    """(node, pagerank), summing to one.

    Rank of nodes without successors is spread evenly; each step is normalised; the loop ends when the sum of
    absolute changes falls under ``tol`` (0: after exactly ``max_iter`` steps). The edge table carries the
    share 1/out-degree, so a step is one join and one aggregation.
    """
    out = edges.groupBy("src").agg(F.count("*").alias("n"))
    links = materialize(edges.join(out, "src").select("src", "dst", (F.lit(alpha) / F.col("n")).alias("w")), "links")
    nodes = materialize(edge_nodes(edges).join(out.select(F.col("src").alias("node"), F.lit(False).alias("dangling")), "node", "left").select("node", F.coalesce("dangling", F.lit(True)).alias("dangling")), "nodes")
    count = nodes.count()
    if not count:
        return nodes.select("node", F.lit(0.0).alias("pagerank"))
    ranks = nodes.select("node", "dangling", F.lit(1.0 / count).alias("r"))
    loose = nodes.where("dangling").count() / count
    for step in range(max_iter):
        base = (1 - alpha) / count + alpha * loose / count
        got = links.join(ranks.select(F.col("node").alias("src"), "r"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("w") * F.col("r")).alias("c"))
        fresh = materialize(ranks.join(got, "node", "left").select("node", "dangling", F.col("r").alias("old"), (F.lit(base) + F.coalesce("c", F.lit(0.0))).alias("r")), "ranks")
        # A step keeps the sum at one but for rounding, so the change can be taken before it is divided by it.
        total, loose_sum, error = fresh.agg(F.sum("r"), F.coalesce(F.sum(F.when(F.col("dangling"), F.col("r"))), F.lit(0.0)), F.sum(F.abs(F.col("r") - F.col("old")))).first()
        if step:
            drop_materialized(ranks)
        ranks = fresh.select("node", "dangling", (F.col("r") / total).alias("r"))
        loose = loose_sum / total
        if tol and error < tol:
            break
    return ranks.select("node", F.col("r").alias("pagerank"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): weakly connected components, named by their smallest node."""
    return star_components(edges)


def component_sizes(edges: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """(component_id, component, nodes_count, edges_count); ids are dense, in order of the smallest node."""
    members = members if members is not None else components(edges)
    nodes = members.groupBy("component").agg(F.count("*").alias("nodes_count"))
    inside = edges.select("src", "dst").distinct().join(members.withColumnRenamed("node", "src"), "src").groupBy("component").agg(F.count("*").alias("edges_count"))
    sized = nodes.join(inside, "component", "left").select("component", "nodes_count", F.coalesce("edges_count", F.lit(0).cast("long")).alias("edges_count"))
    return numbered(sized, ["component"], "component_id").select("component_id", "component", "nodes_count", "edges_count")


def reachable(edges: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """(start, node): all nodes that a start reaches by one edge or more, itself left out.

    Semi-naive: only pairs found in the last round are extended. The result is the closure, so it is asked for
    from candidate starts, not from all nodes of a large graph.
    """
    e = edges.where("src <> dst").select("src", "dst").distinct()
    begin = e if starts is None else e.join(starts.select(F.col("node").alias("src")).distinct(), "src", "left_semi")
    frontier = materialize(begin.select(F.col("src").alias("start"), F.col("dst").alias("node")), "reach")
    parts = [frontier]
    seen = frontier
    while True:  # each round finds new pairs or is the last
        grown = frontier.join(e.withColumnRenamed("src", "node"), "node").select("start", F.col("dst").alias("node")).where("start <> node").distinct()
        frontier = materialize(grown.join(seen, ["start", "node"], "left_anti"), "reach")
        if frontier.isEmpty():
            break
        parts.append(frontier)
        seen = seen.unionByName(frontier)
        if len(parts) > 16:  # keep plans short
            seen = materialize(seen, "reach")
            parts = [seen]
    return seen


def descendant_counts(edges: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """(node, descendants) of the starts (all nodes by default); 0 for those that reach none."""
    every = starts.select("node").distinct() if starts is not None else edge_nodes(edges)
    found = reachable(edges, starts).groupBy(F.col("start").alias("node")).agg(F.count("*").alias("descendants"))
    return every.join(found, "node", "left").select("node", F.coalesce("descendants", F.lit(0).cast("long")).alias("descendants"))


def component_roots(edges: DataFrame, ranks: DataFrame | None = None, labels: DataFrame | None = None, members: DataFrame | None = None) -> DataFrame:
    """One row per component: its root and sizes.

    Candidates are nodes without incoming edges, or all nodes if there is none. The root has the most
    descendants, then the highest PageRank, the fewest incoming and most outgoing edges, the first label.
    Descendants are counted only where they can decide (see :func:`strong.best_reach`), not for all candidates.
    """
    members = members if members is not None else materialize(components(edges), "members")
    d = degrees(edges)
    ranks = ranks if ranks is not None else pagerank(edges)
    info = materialize(members.join(d, "node").join(ranks, "node"), "info")
    per = Window.partitionBy("component")
    zero = F.col("in_degree") == 0
    sums = info.groupBy("component").agg(F.count_if(zero).alias("zero_in"))
    candidates = materialize(info.join(sums, "component").where(zero | (F.col("zero_in") == 0)), "candidates")
    counted = candidates.join(best_reach(edges, members, candidates), "node")
    named = counted.join(labels, "node", "left") if labels is not None else counted.withColumn("label", F.col("node").cast("string"))
    order = [F.desc("descendants"), F.desc(F.round("pagerank", 12)), F.asc("in_degree"), F.desc("out_degree"), F.asc(F.coalesce("label", F.col("node").cast("string"))), F.asc("node")]
    best = named.withColumn("rn", F.row_number().over(per.orderBy(*order))).where("rn = 1")
    return component_sizes(edges, members).join(best, "component").select(
        "component_id", "component", "nodes_count", "edges_count", F.col("node").alias("root_norm"), F.coalesce("label", F.col("node").cast("string")).alias("root_name"), F.col("zero_in").alias("zero_in_degree_nodes"), F.col("descendants").alias("root_descendants")
    )


def global_root(roots: DataFrame) -> DataFrame:
    """The one root, or a virtual root over all component roots; no row for an empty graph."""
    one = roots.agg(F.count("*").alias("n"), F.min("root_norm").alias("norm"), F.min_by("root_name", "component_id").alias("name"), F.transform(F.array_sort(F.collect_list(F.struct("component_id", "root_name"))), lambda x: x["root_name"]).alias("children"))
    single = F.col("n") == 1
    return one.where("n > 0").select(
        F.when(single, "concept").otherwise("virtual").alias("root_type"), F.when(single, F.col("norm")).otherwise(VIRTUAL_ROOT).alias("root_norm"), F.when(single, F.col("name")).otherwise(VIRTUAL_ROOT_NAME).alias("root_name"), F.col("n").alias("components_count"),
        F.when(~single, F.array_join("children", ", ")).otherwise("").alias("children"),
    )


def cyclic_core(edges: DataFrame) -> DataFrame:
    """The edges that are left when nodes without incoming or without outgoing edges are peeled: none without a cycle."""
    return trimmed(edges)


def is_cyclic(edges: DataFrame) -> DataFrame:
    return cyclic_core(edges).agg((F.count("*") > 0).alias("is_cyclic"))


class _Distances:
    """(start, last, left): how far nodes are from the starts, through nodes larger than the start; grown by need."""

    def __init__(self, inner: DataFrame):
        self.inner, self.reach = inner, 1
        self.front = self.known = materialize(inner.where("src > dst").select(F.col("dst").alias("start"), F.col("src").alias("last"), F.lit(1).alias("left")), "distances")

    def grow(self, reach: int) -> None:
        while self.reach < reach and not self.front.isEmpty():
            back = self.inner.select(F.col("src").alias("before"), F.col("dst").alias("last"))
            step = self.front.join(back, "last").where("before > start").select("start", F.col("before").alias("last")).distinct()
            self.reach += 1
            self.front = materialize(step.join(self.known, ["start", "last"], "left_anti").withColumn("left", F.lit(self.reach)), "distances")
            self.known = materialize(self.known.unionByName(self.front), "distances") if self.reach % 8 == 0 else self.known.unionByName(self.front)


def simple_cycles(edges: DataFrame, labels: DataFrame | None = None, max_length: int | None = None, limit: int = 20) -> DataFrame:
    """The first ``limit`` elementary cycles by (length, path): (cycle_length, cycle_path).

    A cycle is written from its smallest node, so each is found once: paths lead through larger nodes of the start's
    strongly connected component. A path is extended only when no shorter cycle can come: what it has and what it
    still needs at least to get back is within the length looked at; others wait, those that lead nowhere go. The
    next length is the least that waits. The loop ends when a length has filled the report or nothing waits;
    ``max_length``, none by default, bounds the cycles that are looked for.
    """
    strong = materialize(cyclic_nodes(edges), "strong")
    ends = edges.select("src", "dst").distinct().join(strong.select(F.col("node").alias("src"), F.col("component").alias("a")), "src").join(strong.select(F.col("node").alias("dst"), F.col("component").alias("b")), "dst")
    core = materialize(ends.where("a = b").select("src", "dst"), "core")
    closed = [materialize(core.where("src = dst").select(F.array("src").alias("path")), "cycles")]
    inner = materialize(core.where("src <> dst"), "core")
    found = closed[0].count()
    distances = _Distances(inner)
    open_ = inner.where("dst > src").select(F.col("src").alias("start"), F.col("dst").alias("last"), F.array("src", "dst").alias("path"))
    waiting = materialize(open_, "paths")

    def needing(paths: DataFrame) -> DataFrame:
        """Adds ``left`` and ``need``, the nodes of the shortest cycle that a path can still become, or a bound for it."""
        far = F.lit(None) if distances.front.isEmpty() else F.lit(distances.reach + 1)
        need = F.size("path") + F.coalesce("left", far) - 1
        return paths.drop("need", "left").join(distances.known, ["start", "last"], "left").withColumn("need", need).where("need is not null")

    while found < limit:
        waiting = materialize(needing(waiting), "paths")
        length = waiting.agg(F.min("need")).first()[0]
        if length is None or max_length is not None and length > max_length:
            break
        if length > distances.reach and not distances.front.isEmpty():  # only a bound yet
            distances.grow(max(length, distances.reach + distances.reach // 2))
            continue
        active, later = waiting.where(F.col("need") <= length), [waiting.where(F.col("need") > length)]
        while not active.isEmpty():
            closed.append(materialize(active.where("left = 1").select("path"), "cycles"))
            found += closed[-1].count()
            step = inner.select(F.col("src").alias("last"), F.col("dst").alias("next"))
            longer = active.join(step, "last").where((F.col("next") > F.col("start")) & ~F.array_contains("path", F.col("next")))
            grown = materialize(needing(longer.select("start", F.col("next").alias("last"), F.concat("path", F.array("next")).alias("path"))), "paths")
            later.append(grown.where(F.col("need") > length))
            active = grown.where(F.col("need") <= length)
        waiting = later[0]
        for part in later[1:]:
            waiting = waiting.unionByName(part)
    every = closed[0]
    for c in closed[1:]:
        every = every.unionByName(c)
    if labels is None:
        named = every.select("path", F.array_join(F.transform("path", lambda n: n.cast("string")), " -> ").alias("cycle_path"))
    else:
        steps = every.select("path", F.posexplode("path").alias("pos", "node")).join(labels, "node", "left").withColumn("label", F.coalesce("label", F.col("node").cast("string")))
        named = steps.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "label"))), lambda x: x["label"]), " -> ").alias("cycle_path"))
    ranked = named.select(F.size("path").cast("long").alias("cycle_length"), "cycle_path")
    return ranked.orderBy("cycle_length", "cycle_path").limit(limit)


def project_components(edges: DataFrame, bridges: DataFrame) -> DataFrame:
    """One row: components now, with candidate bridges as edges, and how many those would merge."""
    before = components(edges).agg(F.countDistinct("component").alias("components_before"))
    both = edges.select("src", "dst").unionByName(bridges.select("src", "dst"))
    after = components(both).agg(F.countDistinct("component").alias("components_after"))
    added = bridges.agg(F.count("*").alias("bridge_edges_count"))
    return before.join(after).join(added).select("components_before", "components_after", "bridge_edges_count", F.greatest(F.col("components_before") - F.col("components_after"), F.lit(0)).cast("long").alias("components_merged"))
