"""Blocks (biconnected components) of components of any size, by joins and aggregations alone.

1. A spanning forest: each round every part takes its least leaving edge, and parts that meet become one.
2. An Euler tour of the forest, each arc pointing to its successor; places in it come from pointer doubling.
   A node's subtree is an interval of places, and its size follows from the interval's length.
3. The least and largest place that a non-tree edge reaches from each subtree, by windows of doubled length.
4. Tree edges, named by their lower node, are linked where a non-tree edge closes a cycle over both; the components
   of these links are the blocks.

Every loop takes logarithmically many rounds in the number of nodes, long chains included, and no step gathers a
component. The neighbours of one node are put in order by a window, which spills, so a hub is sorted by one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import drop_materialized, materialize
from .components import star_components
from .store import numbered


def both_ways(edges: DataFrame) -> DataFrame:
    """Edges (a, b) as arcs (u, v) in both directions."""
    ends = F.inline(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v"))))
    return edges.select("component", ends)


def spanning_forest(links: DataFrame) -> DataFrame:
    """(component, a, b) of distinct links a < b, to those of a spanning forest."""
    # p and q: the parts in which the ends lie. Of the links between two parts only the least can be taken.
    left = materialize(links.select("component", "a", "b", F.col("a").alias("p"), F.col("b").alias("q")), "left")
    taken = []
    while not left.isEmpty():  # each round at least halves the parts that have a leaving link
        link = F.struct("a", "b", "component", "p", "q").alias("link")
        by_part = left.select(F.explode(F.array("p", "q")).alias("part"), link)
        taken.append(materialize(by_part.groupBy("part").agg(F.min("link").alias("link")).select("link.*").distinct(), "taken"))
        names = materialize(star_components(taken[-1], "p", "q"), "parts")
        moved = left.join(names.select(F.col("node").alias("p"), F.col("component").alias("x")), "p").join(names.select(F.col("node").alias("q"), F.col("component").alias("y")), "q")
        between = moved.where("x <> y").groupBy(F.least("x", "y").alias("p"), F.greatest("x", "y").alias("q"))
        fewer = materialize(between.agg(F.min(F.struct("a", "b", "component")).alias("link")).select("link.*", "p", "q"), "left")
        drop_materialized(left)
        left = fewer
    return reduce(DataFrame.unionByName, taken, left).select("component", "a", "b")


def ranked_tour(forest: DataFrame, roots: DataFrame) -> DataFrame:
    """Arcs (component, u, v, place) of an Euler tour of each tree; places are consecutive and end at 0.

    The tour of a tree starts and ends at its root.
    """
    around = Window.partitionBy("u").orderBy("v")
    last = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("v"))) == 1
    arcs = both_ways(forest).withColumns({"after": F.lead("v").over(around), "first": F.first("v").over(around), "last": last})
    # After the arc v -> u comes the arc from u to its next neighbour after v, around u; at the root the circle is cut.
    turned = arcs.join(roots.select(F.col("root").alias("u"), F.lit(True).alias("top")), "u", "left")
    follow = F.when(~F.col("last"), F.col("after")).when(F.col("top").isNull(), F.col("first"))
    now = materialize(turned.select("component", F.col("v").alias("u"), F.col("u").alias("v"), F.when(follow.isNotNull(), F.col("u")).alias("nu"), follow.alias("nv"), follow.isNotNull().cast("long").alias("d")), "tour")
    while not now.where("nv is not null").isEmpty():  # each round doubles how far an arc sees
        seen = now.select(F.col("u").alias("nu"), F.col("v").alias("nv"), F.col("nu").alias("mu"), F.col("nv").alias("mv"), F.col("d").alias("more"))
        jumped = now.where("nv is not null").join(seen, ["nu", "nv"]).select("component", "u", "v", F.col("mu").alias("nu"), F.col("mv").alias("nv"), (F.col("d") + F.col("more")).alias("d"))
        further = materialize(now.where("nv is null").unionByName(jumped), "tour")
        drop_materialized(now)
        now = further
    return now.select("component", "u", "v", (-F.col("d")).alias("place"))


def power(length: Column) -> Column:
    """The exponent of the largest power of two that is no larger."""
    return F.length(F.bin(length)) - 1


def subtree_reach(tree: DataFrame, reach: DataFrame) -> DataFrame:
    """(node, low, high): least and largest of ``reach`` (component, place, low, high) in each node's interval.

    A node's interval is covered by two windows whose length is a power of two.
    """
    asked = materialize(tree.select("component", "node", "first", "last", power(F.col("last") - F.col("first") + 1).alias("k")), "asked")
    top = asked.agg(F.max("k")).first()[0]
    now = materialize(reach, "windows")
    found = []
    for k in range((-1 if top is None else top) + 1):
        mine = asked.where(F.col("k") == k).select("component", "node", F.explode(F.array("first", F.col("last") - (1 << k) + 1)).alias("place"))
        found.append(materialize(mine.join(now, ["component", "place"]).groupBy("node").agg(F.min("low").alias("low"), F.max("high").alias("high")), "reach"))
        wider = now.unionByName(now.withColumn("place", F.col("place") - (1 << k)))
        now = materialize(wider.groupBy("component", "place").agg(F.min("low").alias("low"), F.max("high").alias("high")), "windows")
    return reduce(DataFrame.unionByName, found) if found else asked.select("node", F.col("first").alias("low"), F.col("last").alias("high"))


def blocks(links: DataFrame, roots: DataFrame) -> DataFrame:
    """(component, node, parent, below, block): each node but the roots, the nodes of its subtree, the block of its tree edge.

    ``links``: distinct (component, a, b) with a < b; ``roots``: (component, root), a node of each component.
    """
    forest = materialize(spanning_forest(links), "forest")
    tour = materialize(ranked_tour(forest, roots), "tour")
    ends = tour.groupBy("component", F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).agg(F.min("place").alias("first0"), F.max("place").alias("last0"), F.min_by(F.struct("u", "v"), "place").alias("down"))
    # A subtree is what is toured between the arc down to its root and the arc back up.
    tree = materialize(ends.select("component", F.col("down.v").alias("node"), F.col("down.u").alias("parent"), F.col("first0").alias("first"), F.col("last0").alias("last")), "tree")
    lowest = tour.groupBy("component").agg((F.min("place") - 1).alias("first")).join(roots, "component").select("component", F.col("root").alias("node"), "first", F.lit(1).cast("long").alias("last"))
    spans = materialize(tree.select("component", "node", "first", "last").unionByName(lowest), "spans")
    of = lambda name, prefix: spans.select(F.col("node").alias(name), F.col("first").alias(f"{prefix}_first"), F.col("last").alias(f"{prefix}_last"))
    other = materialize(links.join(forest, ["component", "a", "b"], "left_anti").join(of("a", "a"), "a").join(of("b", "b"), "b"), "other")
    near = F.inline(F.array(F.struct(F.col("a_first").alias("place"), F.col("b_first").alias("at")), F.struct(F.col("b_first").alias("place"), F.col("a_first").alias("at"))))
    reach = other.select("component", near).groupBy("component", "place").agg(F.min("at").alias("low"), F.max("at").alias("high"))
    above = tree.join(subtree_reach(tree, reach), "node").join(of("parent", "p"), "parent").join(roots.select(F.col("root").alias("parent")), "parent", "left_anti")
    leaves = above.where("low < p_first or high > p_last").select(F.col("node").alias("x"), F.col("parent").alias("y"))
    apart = other.where("a_last < b_first or b_last < a_first").select(F.col("a").alias("x"), F.col("b").alias("y"))
    named = materialize(star_components(leaves.unionByName(apart), "x", "y"), "blocks").select("node", F.col("component").alias("block"))
    return tree.join(named, "node", "left").select("component", "node", "parent", ((F.col("last") - F.col("first") + 1) / 2).cast("long").alias("below"), F.coalesce("block", "node").alias("block"))


def low_link_by_joins(pairs: DataFrame) -> DataFrame:
    """(kind, node, other, pieces, largest_piece, size) of components (component, a, b), like the search in one task.

    Removing a node leaves a piece for each of its blocks. The piece of a block that hangs below the node has the
    nodes of its subtrees there; what is left over is the piece above.
    """
    members = pairs.select("component", F.explode(F.array("a", "b")).alias("name")).distinct()
    nodes = materialize(numbered(members, ["name"]), "nodes")
    ids = lambda c: nodes.select(F.col("name").alias(c), F.col("id").alias(f"{c}_id"))
    linked = pairs.where("a <> b").join(ids("a"), "a").join(ids("b"), "b")
    links = materialize(linked.select("component", F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b")).distinct(), "links")
    per = materialize(nodes.groupBy("component").agg(F.min("id").alias("root"), F.count("*").alias("size")), "roots")
    tree = materialize(blocks(links, per.select("component", "root")), "blocks")
    own = tree.select(F.col("node").alias("parent"), F.col("block").alias("own"))
    hanging = tree.groupBy("parent", "block").agg(F.sum("below").alias("piece")).join(own, "parent", "left").where("own is null or block <> own")
    cuts = hanging.groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("cuts"), F.sum("piece").alias("cut"), F.max("piece").alias("most"))
    none = F.lit(0).cast("long")
    rest = F.col("size") - 1 - F.coalesce("cut", none)
    found = nodes.join(per, "component").join(cuts, "id", "left").select(
        F.lit("node").alias("kind"), F.col("name").alias("node"), F.lit(None).cast("string").alias("other"), (F.coalesce("cuts", none) + (rest > 0).cast("long")).alias("pieces"), F.greatest(F.coalesce("most", none), rest).alias("largest_piece"), "size")
    single = tree.groupBy("component", "block").agg(F.count("*").alias("n"), F.min(F.struct("node", "parent")).alias("edge")).where("n = 1")
    text = lambda c: nodes.select(F.col("id").alias(c), F.col("name").alias(f"{c}_name"))
    cut = single.select("component", "edge.*").join(text("node"), "node").join(text("parent"), "parent").join(per, "component")
    return found.unionByName(cut.select(F.lit("bridge").alias("kind"), F.least("node_name", "parent_name").alias("node"), F.greatest("node_name", "parent_name").alias("other"), none.alias("pieces"), none.alias("largest_piece"), "size"))
