"""Session defaults and shared-storage helpers."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; an own one where it is unset and all runs in one process.

    On a cluster a folder of this machine would split tables over machines, so there it has to be set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that all executors share")
        folder = "/tmp/checkpoints/knotwork"
        os.makedirs(folder, exist_ok=True)
    return folder


#: Joins broadcast no stored table of more rows: Spark judges it by its Parquet files, which can be a hundredth of it.
BROADCAST_ROWS = 50_000


def unsent(df: DataFrame, rows: int) -> DataFrame:
    """``df`` as a side of a join that is sorted, not broadcast, if it has many ``rows``."""
    return df.hint("merge") if rows > BROADCAST_ROWS else df


#: Paths written inside the open :func:`written` call of this thread (or task, or copied context).
_scope: ContextVar[list[str] | None] = ContextVar("written", default=None)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(make: Callable[[], DataFrame], label: str = "table") -> DataFrame:
    """``make()`` materialized; the tables that it materialized on the way are deleted, as nothing reads them any more."""
    made: list[str] = []
    token = _scope.set(made)
    try:
        return _write(make(), label, outer=token.old_value)
    finally:
        _scope.reset(token)
        for path in made:
            _delete(SparkSession.active(), path)


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back, which cuts its lineage.

    Unlike a local checkpoint the files survive the loss of an executor. Large tables are not broadcast (see :func:`unsent`).
    """
    return _write(df, label, outer=_scope.get())


def _write(df: DataFrame, label: str, outer: object) -> DataFrame:
    """``outer``: the list of the open call that deletes the table when it ends, if there is one."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if isinstance(outer, list):
        outer.append(path)
    df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    return unsent(stored, stored.count())


def drop_materialized(df: DataFrame) -> None:
    """Delete the files behind a table made by :func:`materialize`."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, folder)
