"""The saved tables in buckets under a manifest: a save reads and writes the buckets that it touches, nothing else.

Layout of a store's folder::

    data/TABLE/WRITE/bucket=N/*.parquet     never changed once written
    manifest/vVERSION/                      one JSON line: which folder holds each bucket, by table

Documents are in buckets by hash of their content hash, triplets by range of document id, frames and their occurrences
by range of triplet id, frame nodes by range of occurrence id: what belongs to one document lies in few buckets, and new
rows, whose ids follow the largest, in the last ones. The manifest knows the largest ids, so nothing is scanned for them.

A save writes new folders for the touched buckets and then renames its manifest into place, which commits all tables
at once: before that, readers have the version before, and what a crashed save has written is only garbage for
:func:`vacuum`. A version is written once: of two savers that started from the same one the later fails and has to
run again. A manifest lists changes; every ``COMPLETE``-th lists all buckets, and older ones are dropped, so reading one
takes a bounded number of files. Hash buckets are split when they hold more than ``rows`` rows on average.

Defined results: those of :func:`store.save_triplets`; an empty payload commits a version without changes; a store
without any version is empty.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from .store import SAVED, SCHEMAS, empty_store, save_triplets

#: Every so many versions a manifest lists all buckets.
COMPLETE = 16
FIRST_HASH_BUCKETS = 8
#: Rows of a bucket, about; and documents whose triplets share one.
BUCKET_ROWS, BUCKET_DOCUMENTS = 1 << 16, 1 << 10


@dataclass
class Manifest:
    version: int = 0
    batch: int | None = None
    hash_buckets: int = FIRST_HASH_BUCKETS
    rows: int = BUCKET_ROWS
    documents: int = BUCKET_DOCUMENTS
    tops: dict[str, int] = field(default_factory=lambda: dict.fromkeys(SAVED, 0))
    tables: dict[str, dict[int, str]] = field(default_factory=lambda: {t: {} for t in SAVED})

    def bucket(self, table: str) -> Column:
        """Bucket of a row of a table."""
        by_range = {"triplets": ("document_id", self.documents), "triplet_frames": ("triplet_id", self.rows), "frame_instances": ("triplet_id", self.rows), "frame_nodes": ("frame_instance_id", self.rows)}
        if table == "documents":
            return F.pmod(F.xxhash64("content_hash"), F.lit(self.hash_buckets)).cast("long")
        column, width = by_range[table]
        return F.floor(F.col(column) / width).cast("long")


def _fs(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, at = _fs(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []


def _versions(spark: SparkSession, folder: str) -> list[int]:
    return sorted(int(n[1:]) for n in _names(spark, f"{folder}/manifest") if n.startswith("v"))


def load_manifest(spark: SparkSession, folder: str, version: int | None = None) -> Manifest:
    """The newest version, or a given one that is still kept; an empty one for a new store."""
    there = _versions(spark, folder)
    if not there and version is None:
        return Manifest()
    at = there[-1] if version is None else version
    if at not in there:
        raise ValueError(f"version {at} of {folder} is not kept")
    changes = []
    while True:
        held = json.loads(spark.read.text(f"{folder}/manifest/v{at}").first()[0])
        changes.append(held)
        if held["complete"]:
            break
        at -= 1
        if at not in there:
            raise ValueError(f"version {changes[0]['version']} of {folder} is not kept whole")
    new = changes[0]
    out = Manifest(new["version"], new["batch"], new["hash_buckets"], new["rows"], new["documents"], new["tops"])
    for held in reversed(changes):
        for table, buckets in held["tables"].items():
            for bucket, path in buckets.items():
                if path is None:
                    out.tables[table].pop(int(bucket), None)
                else:
                    out.tables[table][int(bucket)] = path
    return out


def _commit(spark: SparkSession, folder: str, old: Manifest, new: Manifest) -> None:
    complete = new.version % COMPLETE == 1
    changed = {t: new.tables[t] if complete else {b: new.tables[t].get(b) for b in old.tables[t].keys() | new.tables[t].keys() if new.tables[t].get(b) != old.tables[t].get(b)} for t in SAVED}
    line = json.dumps({"version": new.version, "batch": new.batch, "hash_buckets": new.hash_buckets, "rows": new.rows, "documents": new.documents, "tops": new.tops, "complete": complete, "tables": changed})
    draft = f"{folder}/manifest/draft-{uuid.uuid4().hex}"
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.text(draft)
    fs, target = _fs(spark, f"{folder}/manifest/v{new.version}")
    if fs.exists(target) or not fs.rename(_fs(spark, draft)[1], target):
        fs.delete(_fs(spark, draft)[1], True)
        raise RuntimeError(f"version {new.version} of {folder} was written by another save")
    if complete:
        for v in _versions(spark, folder):
            if v < new.version - COMPLETE:
                fs.delete(_fs(spark, f"{folder}/manifest/v{v}")[1], True)


def read_table(spark: SparkSession, folder: str, table: str, manifest: Manifest | None = None, buckets: set[int] | None = None) -> DataFrame:
    """A table as a version has it, or some of its buckets."""
    held = (manifest or load_manifest(spark, folder)).tables[table]
    paths = [f"{folder}/{held[b]}" for b in sorted(held if buckets is None else held.keys() & buckets)]
    return spark.read.schema(SCHEMAS[table]).parquet(*paths) if paths else spark.createDataFrame([], SCHEMAS[table])


def read_store(spark: SparkSession, folder: str, version: int | None = None) -> dict[str, DataFrame]:
    """The saved tables of a version, the others empty."""
    manifest = load_manifest(spark, folder, version)
    return empty_store(spark) | {t: read_table(spark, folder, t, manifest) for t in SAVED}


def _of(rows: DataFrame, bucket: Column) -> set[int]:
    return {r[0] for r in rows.select(bucket).distinct().collect()}


def _touched(spark: SparkSession, folder: str, m: Manifest, payload: DataFrame) -> tuple[dict[str, set[int]], dict[str, DataFrame]]:
    """The buckets that a payload can change, by table, and their rows. A table's last bucket takes new rows."""
    part = empty_store(spark)
    split = m.hash_buckets != hash_buckets(m)  # then all documents are dealt anew
    touched = {"documents": set(m.tables["documents"]) if split else _of(payload, m.bucket("documents"))}
    part["documents"] = read_table(spark, folder, "documents", m, touched["documents"])
    known = part["documents"].join(payload.select("content_hash").distinct(), "content_hash", "left_semi").select(F.col("id").alias("document_id"))
    touched["triplets"] = _of(known, m.bucket("triplets")) | {m.tops["documents"] // m.documents}
    part["triplets"] = read_table(spark, folder, "triplets", m, touched["triplets"])
    mine = part["triplets"].join(known, "document_id", "left_semi").select(F.col("id").alias("triplet_id"))
    touched["triplet_frames"] = touched["frame_instances"] = _of(mine, m.bucket("triplet_frames")) | {m.tops["triplets"] // m.rows}
    for t in ("triplet_frames", "frame_instances"):
        part[t] = read_table(spark, folder, t, m, touched[t])
    theirs = part["frame_instances"].join(mine, "triplet_id", "left_semi").select(F.col("id").alias("frame_instance_id"))
    touched["frame_nodes"] = _of(theirs, m.bucket("frame_nodes")) | {m.tops["frame_instances"] // m.rows}
    part["frame_nodes"] = read_table(spark, folder, "frame_nodes", m, touched["frame_nodes"])
    return touched, part


def hash_buckets(m: Manifest) -> int:
    """Hash buckets for as many documents as there are: doubled until they hold at most ``rows`` on average."""
    n = m.hash_buckets
    while m.tops["documents"] > n * m.rows:
        n *= 2
    return n


def save_payload(spark: SparkSession, folder: str, payload: DataFrame, now: Column, batch: int | None = None, empty_frames: bool = False, rows: int = BUCKET_ROWS, documents: int = BUCKET_DOCUMENTS) -> dict[str, int]:
    """Save a payload (see :func:`store.save_triplets`) as the next version; says how many buckets of each table were written.

    A ``batch`` that is not after the last one saved was saved before and changes nothing. ``rows`` and ``documents``
    size the buckets of a new store.
    """
    old = load_manifest(spark, folder)
    if batch is not None and old.batch is not None and batch <= old.batch:
        return dict.fromkeys(SAVED, 0)
    if not old.version:
        old.rows, old.documents = rows, documents
    payload = materialize(payload, "payload")
    touched, part = _touched(spark, folder, old, payload)
    saved, _ = save_triplets(part, payload, now, empty_frames=empty_frames, tops=old.tops)
    new = Manifest(old.version + 1, old.batch if batch is None else batch, hash_buckets(old), old.rows, old.documents, dict(old.tops), {t: {b: p for b, p in old.tables[t].items() if b not in touched[t]} for t in SAVED})
    written = {}
    for t in SAVED:
        at = f"data/{t}/{uuid.uuid4().hex}"
        placed = saved[t].withColumn("bucket", new.bucket(t))
        placed.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{folder}/{at}")
        found = [int(n.split("=")[1]) for n in _names(spark, f"{folder}/{at}") if n.startswith("bucket=")]
        new.tables[t] |= {b: f"{at}/bucket={b}" for b in found}
        written[t] = len(found)
        if found:
            top = read_table(spark, folder, t, new, set(found)).agg(F.max("id")).first()[0]
            new.tops[t] = max(new.tops[t], top or 0)
    _commit(spark, folder, old, new)
    return written


def vacuum(spark: SparkSession, folder: str) -> int:
    """Delete the bucket folders and drafts that no kept version names; not while a save runs. Says how many folders went."""
    kept = set()
    for v in _versions(spark, folder):
        try:
            kept |= {p for t in load_manifest(spark, folder, v).tables.values() for p in t.values()}
        except ValueError:  # its complete version is gone: no reader can open it
            continue
    gone = [f"manifest/{n}" for n in _names(spark, f"{folder}/manifest") if n.startswith("draft-")]
    for t in SAVED:
        for write in _names(spark, f"{folder}/data/{t}"):
            gone += [p for n in _names(spark, f"{folder}/data/{t}/{write}") if n.startswith("bucket=") and (p := f"data/{t}/{write}/{n}") not in kept]
    for path in gone:
        fs, at = _fs(spark, f"{folder}/{path}")
        fs.delete(at, True)
    return len(gone)
