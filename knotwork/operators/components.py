"""Connected components by alternating large-star and small-star steps.

Both steps replace edges by edges to smaller vertices until the graph is a set of stars. The number of rounds
grows with the logarithm of the graph, whatever the length of its chains, and no step gathers a component in
one task: they are joins on a per-vertex minimum, aggregated map-side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop_materialized, materialize, unsent


def _star(edges: DataFrame, large: bool, rows: int) -> DataFrame:
    """One star step over some ``rows`` edges (a, b) with a > b."""
    if large:
        both = edges.select(F.col("a").alias("v"), F.col("b").alias("n")).unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("n")))
    else:
        both = edges.select(F.col("a").alias("v"), F.col("b").alias("n"))
    low = both.groupBy("v").agg(F.min("n").alias("m")).select("v", F.least("v", "m").alias("m"))
    joined = both.join(unsent(low, rows), "v")
    if large:
        out = joined.where(F.col("n") > F.col("v")).select(F.col("n").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("n").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("v").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def star_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component): each vertex of an edge and the smallest vertex that it is connected with.

    Null ends and self-loops link nothing (a vertex with only self-loops is its own component). Rounds grow with
    the logarithm of the graph; ``max_rounds`` is an error, never an early end.
    """
    kind = dict(edges.dtypes)[src]
    ends = materialize(edges.select(F.col(src).alias("x"), F.col(dst).cast(kind).alias("y")).where("x is not null and y is not null").distinct(), "links")
    now = materialize(ends.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "edges")
    before, rows = None, now.count()
    for _ in range(max_rounds):
        step = materialize(_star(_star(now, True, rows), False, rows), "edges")
        drop_materialized(now)
        now = step
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark == before:
            break
        before, rows = mark, mark["n"]
    else:
        raise RuntimeError(f"components are not done after {max_rounds} rounds")
    loops = ends.where("x = y").select(F.col("x").alias("node")).distinct()
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
    alone = loops.join(stars, "node", "left_anti").select("node", F.col("node").alias("component"))
    return stars.unionByName(alone)
