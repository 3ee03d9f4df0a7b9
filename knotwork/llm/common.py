"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize

#: A-Z to a-z, everything else as it is.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """The two columns that text operators work on; other columns never reach them."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def per_text(fn: Callable[[bytes | None], tuple], schema: pa.Schema, rows: int = 512) -> Callable:
    """A mapInArrow body: (doc_id, text) in, doc_id and the fields of ``fn(utf-8 text)`` out.

    Output batches are small, so that memory stays at one input batch and a few hundred results.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, text = batch.column(0), batch.column(1).cast(pa.binary())
            for a in range(0, batch.num_rows, rows):
                out = [fn(x) for x in text.slice(a, rows).to_pylist()]
                cols = [ids.slice(a, rows), *(pa.array(c, type=f.type) for c, f in zip(zip(*out), list(schema)[1:], strict=True))]
                yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return run


def ragged(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each i, starts[i], starts[i]+1, ... (counts[i] of them); and the i each belongs to."""
    owner = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    return np.arange(len(owner)) - np.repeat(first, counts) + np.repeat(starts, counts), owner


def group_key(column: Column, nulls_last: bool = False) -> Column:
    """A text that is never null, sorts as the column does bytewise, and tells null from every value."""
    return F.when(column.isNull(), F.lit("2" if nulls_last else "0")).otherwise(F.concat(F.lit("1"), column))


def sequenced(rows: DataFrame, group: str, order: Sequence[str], weight: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Places of rows within their group, without a task that holds a group; and the groups with their totals.

    Rows are range-sorted by group and order (ties by where they were read, so equal rows do not meet in one task
    either) and stored; a row per partition and group carries the totals over. Rows get ``row`` (unique), ``place``
    (from 0) and, with a ``weight``, ``first``: the sum of it over the rows before. Groups: ``group``, ``n``, ``total``.
    """
    kept = materialize(rows.withColumn("_tie", F.monotonically_increasing_id()), "rows")
    keys = [group, *order, "_tie"]
    placed = kept.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id())
    placed = materialize(placed.drop("_tie"), "sequence")
    of = F.coalesce(F.col(weight), F.lit(0)) if weight else F.lit(0)
    parts = placed.groupBy(group, "_part").agg(F.count("*").alias("_n"), F.sum(of.cast("long")).alias("_sum"), F.min("row").alias("_row"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select(group, "_part", "_row", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("_n", "_sum")))
    joined = placed.join(carried, [group, "_part"])
    out = joined.withColumn("place", F.col("row") - F.col("_row") + F.col("_n_before"))
    if weight:
        inside = Window.partitionBy(group, "_part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumn("first", F.coalesce(F.sum(of.cast("long")).over(inside), F.lit(0)) + F.col("_sum_before"))
    groups = parts.groupBy(group).agg(F.sum("_n").alias("n"), F.sum("_sum").alias("total"))
    return out.drop("_part", "_row", "_n_before", "_sum_before"), groups
