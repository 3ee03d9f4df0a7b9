"""Streaming ingestion: payload files as they arrive go through the same idempotent upserts as a batch.

The store is a folder of Parquet tables with a version per batch; a batch reads the last version and writes
the tables that it changes into the next, so a repeated or failed batch leaves the readers' version as it was
and concepts, aliases and links stay where they were written.

With ``bucketed`` the saved tables are kept in buckets under a manifest: a batch reads and writes what it touches, so
its cost does not grow with the batches before it, and a batch that comes again changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.bucketed import save_payload
from ..operators.store import SAVED, SCHEMAS, empty_store, save_triplets
from ..sources.readers import explode_payload, payload_rows


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def save_store(store: dict[str, DataFrame], folder: str, version: int, tables: tuple[str, ...] = tuple(SCHEMAS)) -> None:
    """Write tables as a version; those not written stay as the versions before have them."""
    for t in tables:
        store[t].write.mode("overwrite").parquet(f"{folder}/v{version}/{t}")
    store[tables[0]].sparkSession.range(1).write.mode("overwrite").parquet(f"{folder}/v{version}/_DONE")


def load_store(spark: SparkSession, folder: str, version: int) -> dict[str, DataFrame]:
    """Each table as the newest complete version up to the given one has it; empty where none does."""
    out = empty_store(spark)
    missing = set(out)
    for v in range(version, -1, -1):
        if not missing:
            break
        if _exists(spark, f"{folder}/v{v}/_DONE"):
            for t in sorted(missing):
                if _exists(spark, f"{folder}/v{v}/{t}"):
                    out[t] = spark.read.schema(SCHEMAS[t]).parquet(f"{folder}/v{v}/{t}")
                    missing.discard(t)
    return out


def ingest_batch(batch: DataFrame, batch_id: int, folder: str) -> None:
    """One micro-batch of (source_name, text) into version ``batch_id`` of the store."""
    spark = batch.sparkSession
    payload = batch.select("source_name", F.try_parse_json("text").alias("payload"))
    saved, _ = save_triplets(load_store(spark, folder, batch_id - 1), payload_rows(explode_payload(payload)), F.current_timestamp(), empty_frames=True)
    save_store(saved, folder, batch_id, SAVED)


def ingest_bucketed(batch: DataFrame, batch_id: int, folder: str) -> dict[str, int]:
    """One micro-batch into a bucketed store; says how many buckets of each table were written."""
    payload = batch.select("source_name", F.try_parse_json("text").alias("payload"))
    return save_payload(batch.sparkSession, folder, payload_rows(explode_payload(payload)), F.current_timestamp(), batch_id, empty_frames=True)


def start_ingest(spark: SparkSession, source: str, folder: str, checkpoint: str, bucketed: bool = False) -> StreamingQuery:
    """Watch a folder of payload files; the checkpoint folder remembers which were taken."""
    files = spark.readStream.format("text").option("wholetext", "true").load(source)
    named = files.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("source_name"), F.col("value").alias("text"))

    def save(df: DataFrame, batch_id: int) -> None:
        (ingest_bucketed if bucketed else ingest_batch)(df, batch_id, folder)

    return named.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
