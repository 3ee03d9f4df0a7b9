"""Strongly connected components and what follows from them: cyclic parts, sources, descendants of the best roots.

Everything is joins on edge tables. Long chains do not take a round per node: what hangs under nodes without incoming
edges by single links, and what passes single links on, is followed by pointer doubling. What is left is coloured:
the largest node spreads along the edges, and those nodes of its colour that reach it back are its component.
Rounds of colouring grow with the diameter of the part that is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import drop_materialized, materialize

#: Peeling steps before single links are followed by doubling.
PLAIN_STEPS = 3
#: Nodes that pass single links on, up to which coloring goes through them one by one.
FEW_PASSING = 64
#: Entries of a reach sketch, and how far below the best estimate a node may be that is still counted exactly.
SKETCH, MARGIN = 64, 8


def _next(df: DataFrame, old: DataFrame | None, label: str) -> DataFrame:
    out = materialize(df, label)
    if old is not None:
        drop_materialized(old)
    return out


def spread(edges: DataFrame, seeds: DataFrame, inside: bool = False) -> DataFrame:
    """(label, node): what each label's seeds reach, themselves included. ``inside``: edges carry the label they are for.

    Semi-naive: only rows found in the last round are extended.
    """
    on = ["label", "node"] if inside else ["node"]
    e = edges.withColumnRenamed("src", "node")
    front = seen = materialize(seeds.select("label", "node").distinct(), "reach")
    parts = 1
    while True:
        grown = front.join(e, on).select("label", F.col("dst").alias("node")).distinct()
        front = materialize(grown.join(seen, ["label", "node"], "left_anti"), "reach")
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)
        parts += 1
        if parts > 16:  # keep plans short
            seen, parts = materialize(seen, "reach"), 1


def _ends(pointers: DataFrame) -> DataFrame:
    """(node, end, least): following (node, to) from each node to the first node without a pointer; null on a ring.

    Pointer doubling; ``least`` is the smallest node that was passed, on a ring the ring's smallest.
    """
    now = materialize(pointers.select("node", "to", F.least("node", "to").alias("least")), "pointers")
    rows = now.count()
    for _ in range(max(1, rows).bit_length() + 1):
        ahead = now.select(F.col("node").alias("to"), F.col("to").alias("then"), F.col("least").alias("other"))
        step = now.join(ahead, "to", "left")
        now = _next(step.select("node", F.coalesce("then", "to").alias("to"), F.least("least", "other").alias("least")), now, "pointers")
    holders = now.select(F.col("node").alias("to"), F.lit(True).alias("ring"))
    return now.join(holders, "to", "left").select("node", F.when(F.col("ring").isNull(), F.col("to")).alias("end"), "least")


def _single(edges: DataFrame, at: str, other: str) -> DataFrame:
    """(node, to): nodes with one edge at their ``at`` end, and where it leads."""
    return edges.groupBy(F.col(at).alias("node")).agg(F.count("*").alias("n"), F.min(other).alias("to")).where("n = 1").select("node", "to")


def _hanging(edges: DataFrame, at: str, other: str) -> DataFrame:
    """Nodes that single links lead back to a node without an edge at its ``at`` end."""
    ended = _ends(_single(edges, at, other))
    free = edges.select(F.col(other).alias("end")).distinct().join(edges.select(F.col(at).alias("end")).distinct(), "end", "left_anti")
    return ended.join(free, "end", "left_semi").select("node")


def trimmed(edges: DataFrame) -> DataFrame:
    """The edges that remain after peeling nodes without incoming or without outgoing edges, again and again.

    Empty if and only if the graph has no cycle.
    """
    core = materialize(edges.select("src", "dst").distinct(), "core")
    size, step = core.count(), 0
    while size:
        step += 1
        if step % (PLAIN_STEPS + 1):
            fed = core.select(F.col("dst").alias("src")).distinct()
            feeding = core.select(F.col("src").alias("dst")).distinct()
            after = core.join(fed, "src", "left_semi").join(feeding, "dst", "left_semi")
        else:
            down, up = _hanging(core, "dst", "src"), _hanging(core, "src", "dst")
            after = core.join(down.select(F.col("node").alias("src")), "src", "left_anti").join(up.select(F.col("node").alias("dst")), "dst", "left_anti")
            after = after.join(down.select(F.col("node").alias("dst")), "dst", "left_anti").join(up.select(F.col("node").alias("src")), "src", "left_anti")
        core = _next(after.select("src", "dst"), core, "core")
        left = core.count()
        if left == size and step % (PLAIN_STEPS + 1):
            break
        size = left
    return core


def _coloured(edges: DataFrame) -> DataFrame:
    """(node, colour): the largest node that reaches a node, itself included."""
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    now = materialize(nodes.select("node", F.col("node").alias("colour"), F.lit(True).alias("new")), "colours")
    while True:
        front = now.where("new").select(F.col("node").alias("src"), "colour")
        offered = edges.join(front, "src").groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("offer"))
        better = F.coalesce(F.col("offer") > F.col("colour"), F.lit(False))
        now = _next(now.join(offered, "node", "left").select("node", F.when(better, F.col("offer")).otherwise(F.col("colour")).alias("colour"), better.alias("new")), now, "colours")
        if now.where("new").isEmpty():
            return now.select("node", "colour")


def _cyclic_components(core: DataFrame) -> DataFrame:
    """(node, mark): nodes on cycles of a trimmed graph, components marked alike."""
    found: DataFrame | None = None
    while not core.isEmpty():
        colours = _coloured(core)
        inner = core.join(colours.withColumnRenamed("node", "src"), "src").join(colours.select(F.col("node").alias("dst"), F.col("colour").alias("other")), "dst").where("colour = other").select("src", "dst", F.col("colour").alias("label"))
        inner = materialize(inner, "inner")
        back = inner.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "label")
        # A colour is a component of at least an edge only if its node is reached back.
        roots = inner.select("label").distinct().select("label", F.col("label").alias("node"))
        mine = materialize(spread(back, roots, inside=True), "marked")
        found = mine if found is None else found.unionByName(mine)
        gone = mine.select("node")
        rest = inner.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti")
        core = trimmed(rest)
    if found is None:
        return core.select(F.col("src").alias("node"), F.col("src").alias("mark"))
    return found.select("node", F.col("label").alias("mark"))


def cyclic_nodes(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes on cycles; a component is named by its smallest node."""
    core = trimmed(edges)
    # Nodes with one link in and one out pass on what reaches them: only the ends of such chains are coloured.
    ins, outs = _single(core, "dst", "src"), _single(core, "src", "dst")
    passing = materialize(outs.join(ins.select("node", F.col("to").alias("from")), "node").where("to <> node"), "passing")
    if passing.count() <= FEW_PASSING:
        marked = _cyclic_components(core)
    else:
        on, back = _ends(passing.select("node", "to")), _ends(passing.select("node", F.col("from").alias("to")))
        chains = materialize(on.join(back.select("node", F.col("end").alias("begin")), "node"), "chains")
        rings = chains.where("end is null").select("node", F.col("least").alias("mark"))
        names = passing.select("node")
        direct = core.join(names.withColumnRenamed("node", "src"), "src", "left_anti").join(names.withColumnRenamed("node", "dst"), "dst", "left_anti")
        short = chains.where("end is not null").select(F.col("begin").alias("src"), F.col("end").alias("dst"))
        marked = materialize(_cyclic_components(materialize(direct.unionByName(short).distinct(), "core")), "marked")
        a, b = (marked.select(F.col("node").alias(c), F.col("mark").alias(m)) for c, m in (("begin", "mark"), ("end", "other")))
        between = chains.where("end is not null").join(a, "begin").join(b, "end").where("mark = other").select("node", "mark")
        marked = marked.unionByName(between).unionByName(rings)
    marked = materialize(marked, "marked")
    named = marked.groupBy("mark").agg(F.min("node").alias("component"))
    return marked.join(named, "mark").select("node", "component")


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of an edge, components named by their smallest node."""
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return nodes.join(cyclic_nodes(edges), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def reach_sketches(edges: DataFrame, own: DataFrame, size: int = SKETCH) -> DataFrame:
    """(node, h): the ``size`` smallest hashes of what a node reaches, from those of each node's own (node, h).

    Fewer than ``size`` are all of them. Only entries that are new are passed on; no table is larger than the
    edges times ``size``. Rounds grow with the depth of the graph.
    """
    least = Window.partitionBy("node").orderBy("h")
    smallest = lambda rows: rows.withColumn("rank", F.row_number().over(least)).where(F.col("rank") <= size).drop("rank")
    kept = materialize(smallest(own.select("node", "h").distinct().withColumn("new", F.lit(True))), "sketch")
    back = materialize(edges.select(F.col("dst").alias("node"), F.col("src").alias("to")).distinct(), "back")
    while True:
        offered = kept.where("new").join(back, "node").select(F.col("to").alias("node"), "h").distinct()
        merged = kept.select("node", "h", F.lit(False).alias("new")).unionByName(offered.select("node", "h", F.lit(True).alias("new")))
        once = merged.groupBy("node", "h").agg(F.min("new").alias("new"))  # known wins
        kept = _next(smallest(once), kept, "sketch")
        if kept.where("new").isEmpty():
            return kept.select("node", "h")


def _estimate(size: int) -> Column:
    """Nodes reached, from the largest of ``size`` smallest hashes (uniform over all 64-bit numbers)."""
    share = (F.col("top").cast("double") + 2.0**63) / 2.0**64
    return (size - 1) / share


def best_reach(edges: DataFrame, members: DataFrame, candidates: DataFrame) -> DataFrame:
    """(node, descendants) of candidates (node, component), for all that can be first in their component.

    A node of a source component reaches more than any node behind it; all nodes of a component reach alike. So with
    one source, its nodes reach everything. With several, sketches say which reach least: those with less than a
    ``MARGIN``-th of the best estimate are dropped (an error of that size has a chance under 1e-10), and what is left is
    counted exactly. What the largest cyclic component reaches is counted once for all that reach that component.
    """
    strong = materialize(strong_components(edges).withColumnRenamed("component", "strong"), "strong")
    across = edges.join(strong.select(F.col("node").alias("src"), F.col("strong").alias("a")), "src").join(strong.select(F.col("node").alias("dst"), F.col("strong").alias("strong")), "dst").where("a <> strong")
    sources = strong.join(across.select("strong").distinct(), "strong", "left_anti").join(members, "node")
    sizes = members.groupBy("component").agg(F.count("*").alias("n"))
    one = sources.groupBy("component").agg(F.countDistinct("strong").alias("sources")).join(sizes, "component")
    # Without a node that nothing leads to, every node is a candidate; those behind a source cannot be first.
    asked = materialize(candidates.select("node", "component").join(sources.select("node", "strong"), "node").join(one, "component"), "asked")
    clear = asked.where("sources = 1").select("node", (F.col("n") - 1).alias("descendants"))
    several = asked.where("sources > 1")
    if several.isEmpty():
        return clear
    # From here on nodes are strong components, with the number of nodes they hold.
    held = strong.groupBy("strong").agg(F.count("*").alias("size"))
    there = members.join(one.where("sources > 1").select("component"), "component", "left_semi").join(strong, "node")
    dag = materialize(across.select(F.col("a").alias("src"), F.col("strong").alias("dst")).distinct().join(there.select(F.col("strong").alias("src")).distinct(), "src", "left_semi"), "dag")
    sketches = reach_sketches(dag, there.select(F.col("strong").alias("node"), F.xxhash64("node").alias("h")), SKETCH)
    counts = sketches.groupBy(F.col("node").alias("strong")).agg(F.count("*").alias("k"), F.max("h").alias("top"))
    full = F.col("k") >= SKETCH
    known = several.join(counts, "strong").withColumn("estimate", F.when(full, _estimate(SKETCH)).otherwise(F.col("k").cast("double")))
    known = materialize(known.select("node", "component", "strong", "k", "estimate"), "estimates")
    most = known.groupBy("component").agg(F.max("estimate").alias("best"), F.max(full).alias("any_full"))
    judged = known.join(most, "component")
    exact = judged.where("not any_full").select("node", (F.col("k") - 1).alias("descendants"))
    left = materialize(judged.where(full & (F.col("estimate") * MARGIN >= F.col("best"))).select("node", "component", "strong"), "left")
    if left.isEmpty():
        return clear.unionByName(exact)
    first = Window.partitionBy("component").orderBy(F.desc("size"), "strong")
    large = there.select("component", "strong").distinct().join(held.where("size > 1"), "strong").withColumn("r", F.row_number().over(first)).where("r = 1")
    hubs = materialize(large.join(left.select("component").distinct(), "component", "left_semi").select(F.col("component").alias("label"), F.col("strong").alias("node")), "hubs")
    reached = lambda rows, as_: rows.join(held.withColumnRenamed("strong", "node"), "node").groupBy("label").agg(F.sum("size").alias(as_))
    behind = spread(dag, hubs)
    before = spread(dag.select(F.col("dst").alias("src"), F.col("src").alias("dst")), hubs)
    over = before.join(reached(behind, "shared"), "label").select("node", "shared")
    seeds = left.select(F.col("strong").alias("node")).distinct().join(over, "node", "left").withColumn("label", F.col("node"))
    apart = behind.select("node")  # a source may be the hub itself
    outside = seeds.where("shared is not null").join(apart, "node", "left_anti")
    beside = reached(spread(dag.join(apart.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"), outside), "own")
    hubbed = seeds.where("shared is not null").join(beside, "label", "left").select("label", (F.col("shared") + F.coalesce("own", F.lit(0)) - 1).alias("descendants"))
    every = reached(spread(dag, seeds.where("shared is null")), "own").select("label", (F.col("own") - 1).alias("descendants"))
    counted = every.unionByName(hubbed).withColumnRenamed("label", "strong")
    return clear.unionByName(exact).unionByName(left.join(counted, "strong").select("node", "descendants"))
