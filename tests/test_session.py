"""Stored tables in joins."""

import pytest
from pyspark.sql import functions as F

from knotwork import session
from knotwork.operators.components import star_components
from knotwork.session import materialize


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("rows,sent", [(100, True), (session.BROADCAST_ROWS + 1, False)])
def test_large_stored_tables_are_not_broadcast(spark, rows, sent):
    """Repeated values make a Parquet file that is far smaller than its rows."""
    stored = materialize(spark.range(rows).select("id", F.lit("the same long text in every row").alias("text")))
    for side in (stored, stored.where("id >= 0"), stored.select(F.col("id"), "text").groupBy("id").agg(F.min("text"))):
        joined = spark.range(0, 10 * rows, 10).join(side, "id")
        assert ("BroadcastHashJoin" in plan(joined)) == sent
        assert joined.count() == -(-rows // 10)


def test_components_of_many_edges(spark, monkeypatch):
    monkeypatch.setattr(session, "BROADCAST_ROWS", 3)
    edges = spark.range(40).select(F.col("id").alias("src"), (F.col("id") + 2).alias("dst"))
    assert {(r.node, r.component) for r in star_components(edges).collect()} == {(k, k % 2) for k in range(42)}
