"""Articulation points, bridges, and what breaks when a node is removed.

One low-link search per connected component finds all three in linear time: the sizes of the pieces that a
node's removal leaves follow from the search tree. Components of up to TASK_EDGES edges are a task's work each;
larger ones are searched by joins (:mod:`blocks`), with the same result.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, written
from .blocks import low_link_by_joins
from .components import star_components
from .graph import degrees

TASK_EDGES = 300_000  # of a component that one task searches (under 350 MB of its Python worker)

FOUND = "kind string, node string, other string, pieces long, largest_piece long, size long"


def search_component(pairs: list[tuple[str, str]]) -> tuple[dict[str, tuple[int, int]], list[tuple[str, str]]]:
    """For an undirected component: by node (pieces, largest piece) after its removal; and the bridges."""
    near: dict[str, list[str]] = {}
    for a, b in sorted(pairs):
        near.setdefault(a, [])
        near.setdefault(b, [])
        if a != b:
            near[a].append(b)
            near[b].append(a)
    total = len(near)
    root = min(near)
    entry, low, size, parent = {root: 0}, {root: 0}, {root: 1}, {root: None}
    cut: dict[str, list[int]] = {n: [] for n in near}
    bridges: list[tuple[str, str]] = []
    walk = [(root, iter(near[root]))]
    while walk:
        node, ahead = walk[-1]
        for other in ahead:
            if other not in entry:
                entry[other] = low[other] = len(entry)
                size[other], parent[other] = 1, node
                walk.append((other, iter(near[other])))
                break
            if other != parent[node]:
                low[node] = min(low[node], entry[other])
        else:
            walk.pop()
            above = parent[node]
            if above is not None:
                size[above] += size[node]
                low[above] = min(low[above], low[node])
                if low[node] >= entry[above]:
                    cut[above].append(size[node])
                if low[node] > entry[above]:
                    bridges.append((min(node, above), max(node, above)))
    pieces = {}
    for node, cuts in cut.items():
        rest = total - 1 - sum(cuts)
        left = [*cuts, rest] if rest > 0 else cuts
        pieces[node] = (len(left), max(left, default=0))
    return pieces, bridges


def low_link(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """Rows of kind ``node`` (pieces, largest_piece after removal, size of the component) and ``bridge``.

    Components of more than ``task_edges`` edges never meet in one task.
    """
    pairs = edges.select(F.least("src", "dst").cast("string").alias("a"), F.greatest("src", "dst").cast("string").alias("b")).distinct()
    members = star_components(pairs, "a", "b")
    placed = materialize(pairs.join(members.withColumnRenamed("node", "a"), "a").select("component", "a", "b"), "placed")
    large = placed.groupBy("component").count().where(F.col("count") > task_edges).select("component")

    def search(group: pd.DataFrame) -> pd.DataFrame:
        pieces, bridges = search_component(list(zip(group["a"], group["b"], strict=True)))
        rows = [("node", n, None, p, most, len(pieces)) for n, (p, most) in pieces.items()]
        rows += [("bridge", a, b, 0, 0, len(pieces)) for a, b in bridges]
        return pd.DataFrame(rows, columns=["kind", "node", "other", "pieces", "largest_piece", "size"])

    if large.isEmpty():
        return placed.groupBy("component").applyInPandas(search, FOUND)
    large = materialize(large, "large")
    small = placed.join(large, "component", "left_anti").groupBy("component").applyInPandas(search, FOUND)
    return small.unionByName(written(lambda: low_link_by_joins(placed.join(large, "component", "left_semi")), "low_link"))


def articulation_points(edges: DataFrame, found: DataFrame | None = None) -> DataFrame:
    found = found if found is not None else low_link(edges)
    return found.where("kind = 'node' and pieces > 1").select("node")


def bridge_edges(edges: DataFrame, found: DataFrame | None = None) -> DataFrame:
    found = found if found is not None else low_link(edges)
    return found.where("kind = 'bridge'").select(F.col("node").alias("a"), F.col("other").alias("b"))


def removal_impact(edges: DataFrame, ranks: DataFrame | None = None, found: DataFrame | None = None) -> DataFrame:
    """One row per node: what its removal does, and the impact score.

    ``0.45 min(gain / components, 1) + 0.35 loss of the largest component + 0.20 min(degree / (n - 1), 1)``.
    The largest other component follows from the two largest ones.
    """
    found = found if found is not None else materialize(low_link(edges), "low_link")
    nodes = found.where("kind = 'node'")
    # One size per component; a component appears as often as it has nodes, so its share counts it once.
    base = nodes.agg(F.count("*").alias("n"), F.round(F.sum(1.0 / F.col("size"))).cast("long").alias("comps"), F.max("size").alias("largest"))
    sizes = nodes.groupBy("size").agg((F.count("*") / F.col("size")).cast("long").alias("times"))
    second = sizes.agg(F.max_by("times", "size").alias("top_times"), F.array_sort(F.collect_set("size")).alias("s")).select(
        "top_times", F.coalesce(F.try_element_at("s", F.lit(-2)), F.lit(0).cast("long")).alias("runner_up"))
    d = degrees(edges.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst")).distinct())
    all_in = nodes.join(d, "node").join(base).join(second)
    others = F.when((F.col("size") == F.col("largest")) & (F.col("top_times") == 1), F.col("runner_up")).otherwise(F.col("largest"))
    after = F.greatest(F.col("largest_piece"), others)
    gain = F.greatest(F.col("pieces") - 1, F.lit(0))
    loss = (F.col("largest") - after) / F.col("largest")
    share = F.when(F.col("n") > 1, F.least(F.col("total_degree") / F.greatest(F.col("n") - 1, F.lit(1)), F.lit(1.0))).otherwise(F.least(F.col("total_degree").cast("double"), F.lit(1.0)))
    score = 0.45 * F.least(gain / F.greatest(F.col("comps"), F.lit(1)), F.lit(1.0)) + 0.35 * loss + 0.20 * share
    out = all_in.select("node", (F.col("pieces") > 1).alias("is_articulation_point"), gain.alias("component_gain"), F.round(loss, 6).alias("largest_component_loss"), "total_degree", F.round(score, 6).alias("impact_score"))
    return out if ranks is None else out.join(ranks.select(F.col("node").cast("string").alias("node"), F.round("pagerank", 6).alias("pagerank")), "node", "left")


def fragility_report(impact: DataFrame, limit: int = 50) -> DataFrame:
    """The nodes whose removal hurts most."""
    return impact.orderBy(F.desc("impact_score"), F.desc("is_articulation_point"), F.desc("component_gain"), F.desc("largest_component_loss"), F.desc("total_degree"), "node").limit(limit)


def fragility(edges: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """One row: shares of articulation points and bridges, largest effects, and the fragility score.

    ``0.35 articulation share + 0.25 bridge share + 0.40 top impact``; zeros for an empty graph.
    """
    found = found if found is not None else materialize(low_link(edges), "low_link")
    impact = removal_impact(edges, found=found)
    undirected = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct().agg(F.count("*").alias("edge_count"))
    bridges = bridge_edges(edges, found).agg(F.count("*").alias("bridges"))
    top = impact.agg(
        F.count("*").alias("n"), F.count_if("is_articulation_point").alias("points"), F.coalesce(F.max("component_gain"), F.lit(0)).alias("gain"), F.coalesce(F.max("largest_component_loss"), F.lit(0.0)).alias("loss"), F.coalesce(F.max("impact_score"), F.lit(0.0)).alias("impact"))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.greatest(F.col(b), F.lit(1))).otherwise(F.lit(0.0))
    points, cut = share("points", "n"), share("bridges", "edge_count")
    return top.join(undirected).join(bridges).select(
        F.round(0.35 * points + 0.25 * cut + 0.40 * F.col("impact"), 6).alias("fragility_score"), F.col("points").alias("articulation_points_count"), F.round(points, 6).alias("articulation_points_share"),
        F.col("bridges").alias("bridge_edges_count"), F.round(cut, 6).alias("bridge_edges_share"), F.col("gain").alias("max_component_gain"), F.col("loss").alias("max_largest_component_loss"),
    )
