"""The relational store as DataFrames: schemas, upserts, cascading deletes, concept and alias review.

Parquet has no MERGE, so an upsert is a full outer join of the stored and the new rows on the key; the result
is written to a new place, never over the path that is being read. New ids follow the largest old one in order
of the key, by a range sort and per-partition counts rather than one global window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import entity_name
from ..session import materialize
from .frames import flatten, fold, node_rows

_SCHEMAS = {
    "documents": "id long, source_name string, content_hash string, created_at timestamp",
    "triplets": "id long, document_id long, row_idx int, extraction_stage string, subject_text string, predicate_text string, object_text string, sentence_text string, confidence double, created_at timestamp",
    "triplet_frames": "id long, triplet_id long, role string, frame_json string, created_at timestamp",
    "frame_instances": "id long, triplet_id long, role string, root_text string, root_norm string, sentence_text string, created_at timestamp",
    "frame_nodes": "id long, frame_instance_id long, parent_node_id long, node_text string, node_norm string, node_lemma string, edge_label string, depth int, path string, ord int, is_root boolean, created_at timestamp",
    "concepts": "id long, canonical_name string, canonical_norm string, concept_type string, created_at timestamp",
    "concept_aliases": "id long, concept_id long, alias_text string, alias_norm string, source string, confidence double, status string, approved_at timestamp, review_note string",
    "node_concept_links": "id long, node_id long, concept_id long, link_type string, score double, method string, created_at timestamp",
}
_TYPES = {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType()}
# Spark's own DDL parser needs a running session, and these are wanted at import.
SCHEMAS: dict[str, T.StructType] = {name: T.StructType([T.StructField(c.split()[0], _TYPES[c.split()[1]]) for c in ddl.split(", ")]) for name, ddl in _SCHEMAS.items()}
KEYS = {
    "documents": ("content_hash",),
    "triplets": ("document_id", "row_idx", "extraction_stage", "subject_text", "predicate_text", "object_text"),
    "triplet_frames": ("triplet_id", "role"),
    "frame_instances": ("triplet_id", "role"),
    "frame_nodes": ("frame_instance_id", "path"),
    "concepts": ("canonical_norm",),
    "concept_aliases": ("concept_id", "alias_norm"),
    "node_concept_links": ("node_id", "concept_id", "link_type"),
}


def empty_store(spark: SparkSession) -> dict[str, DataFrame]:
    return {name: spark.createDataFrame([], schema) for name, schema in SCHEMAS.items()}


def evolve(table: str, stored: DataFrame) -> DataFrame:
    """A stored table with the columns of its schema, added as nulls where an older version lacks them."""
    return stored.sparkSession.createDataFrame([], SCHEMAS[table]).unionByName(stored, allowMissingColumns=True)


def numbered(rows: DataFrame, order: Sequence[str], column: str = "id", start: int | Column = 0) -> DataFrame:
    """Dense numbers from ``start + 1`` in order of columns, without one global window.

    Rows are range-sorted; a partition's offset is the count of the partitions before it (a row each).
    """
    placed = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    total, shifts = 0, []
    for part, rows_in, first in sorted(map(tuple, placed.groupBy("_part").agg(F.count("*"), F.min("_at")).collect())):
        shifts.append((part, total - first))
        total += rows_in
    shift = rows.sparkSession.createDataFrame(shifts, "_part int, _shift long")
    base = start if isinstance(start, Column) else F.lit(start)
    return placed.join(F.broadcast(shift), "_part").withColumn(column, (F.col("_at") + F.col("_shift") + 1 + base).cast("long")).drop("_part", "_at", "_shift")


def upsert(stored: DataFrame, fresh: DataFrame, key: Sequence[str], merge: dict[str, Column] | None = None) -> DataFrame:
    """Stored rows, with the fresh ones merged in by key.

    ``merge`` gives a column as an expression over ``old.x`` and ``new.x``; other columns take the fresh value
    where there is one. Fresh rows must be unique by key. A ``_created`` flag marks keys that were not stored.
    """
    columns = [c for c in stored.columns if c in fresh.columns or c not in key]
    old = stored.select(*key, F.struct(*stored.columns).alias("old"))
    new = fresh.select(*key, F.struct(*fresh.columns).alias("new"))
    joined = old.join(new, list(key), "full_outer")
    merge = merge or {}

    def value(c: str) -> Column:
        if c in merge:
            return F.when(F.col("new").isNull(), F.col(f"old.{c}")).otherwise(merge[c]).alias(c)
        if c not in fresh.columns:
            return F.col(f"old.{c}").alias(c)
        return F.when(F.col("new").isNull(), F.col(f"old.{c}")).otherwise(F.col(f"new.{c}")).alias(c)

    return joined.select(*(F.col(c) if c in key else value(c) for c in columns), (F.col("old").isNull()).alias("_created"))


def assign_ids(merged: DataFrame, key: Sequence[str], stored: DataFrame, top: int | None = None) -> DataFrame:
    """Ids for rows that an upsert created, after the largest stored id (``top``, if it is known), in order of the key."""
    top = stored.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0] if top is None else top
    created = merged.where("_created").drop("id", "_created")
    kept = merged.where("not _created").drop("_created")
    return kept.unionByName(numbered(created, list(key), "id", top))


def upsert_documents(stored: DataFrame, fresh: DataFrame, now: Column, top: int | None = None) -> DataFrame:
    """By content hash: a known document takes the new source name and keeps its id and time."""
    one = fresh.groupBy("content_hash").agg(F.max("source_name").alias("source_name")).withColumn("created_at", now)
    merged = upsert(stored, one, ["content_hash"], {"created_at": F.coalesce("old.created_at", "new.created_at")})
    return assign_ids(merged, ["content_hash"], stored, top).select(*SCHEMAS["documents"].names)


def upsert_triplets(stored: DataFrame, fresh: DataFrame, now: Column, top: int | None = None) -> DataFrame:
    """By the six-column key: a known triplet takes the new sentence only; a missing sentence is null."""
    key = KEYS["triplets"]
    one = fresh.groupBy(*key).agg(F.max(F.nullif(F.col("sentence_text"), F.lit(""))).alias("sentence_text")).withColumn("created_at", now)
    merged = upsert(stored, one, key, {"created_at": F.coalesce("old.created_at", "new.created_at"), "confidence": F.col("old.confidence")})
    return assign_ids(merged, key, stored, top).select(*SCHEMAS["triplets"].names)


def replace_by_key(stored: DataFrame, fresh: DataFrame, key: Sequence[str], owners: DataFrame | None = None) -> DataFrame:
    """All stored rows of the given owners go, the fresh ones come. Owners default to the keys of ``fresh``."""
    gone = (owners if owners is not None else fresh).select(*key).distinct()
    return stored.join(gone, list(key), "left_anti").unionByName(fresh, allowMissingColumns=True)


ROLES = ("subject", "predicate", "object")
#: Tables that saving triplets writes.
SAVED = ("documents", "triplets", "triplet_frames", "frame_instances", "frame_nodes")


def payload_frames(placed: DataFrame, triplets: DataFrame) -> DataFrame:
    """(triplet_id, sentence_text, role, root_text, frame_json): the frame of each role of the payload's triplets.

    Payloads without frame columns get a frame of the text alone.
    """
    key = list(KEYS["triplets"])
    text_only = lambda r: F.to_json(F.struct(F.array().cast("array<string>").alias("frame"), F.coalesce(f"{r}_text", F.lit("")).alias("text")))
    frame = lambda r: F.col(f"{r}_frame") if f"{r}_frame" in placed.columns else text_only(r)
    held = placed.groupBy(*key).agg(F.max(F.struct(*(frame(r).alias(r) for r in ROLES))).alias("frames"))
    rows = triplets.select("id", "sentence_text", *key).join(held, key)
    roles = F.inline(F.array(*(F.struct(F.lit(r).alias("role"), F.col(f"{r}_text").alias("root_text"), F.col(f"frames.{r}").alias("frame_json")) for r in ROLES)))
    return rows.select(F.col("id").alias("triplet_id"), "sentence_text", roles)


def save_frame_nodes(stored: DataFrame, nodes: DataFrame, instances: DataFrame, now: Column, top: int | None = None) -> DataFrame:
    """The node table with flattened frames (triplet_id, role, ...) in place of those their instances had.

    A node that stays at its path keeps its id; new ones are numbered; paths that are gone go.
    """
    key = ["frame_instance_id", "path"]
    fresh = materialize(node_rows(nodes, instances).withColumn("created_at", now), "nodes")
    owners = fresh.select("frame_instance_id").distinct()
    known = stored.join(owners, "frame_instance_id", "left_semi").select(*key, "id", F.col("created_at").alias("since"))
    merged = fresh.join(known, key, "left").withColumn("created_at", F.coalesce("since", "created_at")).withColumn("_created", F.col("id").isNull()).drop("since")
    placed = materialize(assign_ids(merged, key, stored, top), "placed")
    parents = placed.select("frame_instance_id", F.col("path").alias("parent_path"), F.col("id").alias("parent_node_id"))
    linked = placed.join(parents, ["frame_instance_id", "parent_path"], "left")
    names = SCHEMAS["frame_nodes"].names
    return stored.join(owners, "frame_instance_id", "left_anti").select(*names).unionByName(linked.select(*names))


def save_triplets(store: dict[str, DataFrame], payload: DataFrame, now: Column, stage: str = "llm", empty_frames: bool = False, tops: dict[str, int] | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """Save payload rows (source_name, content_hash, row_idx, *_text, sentence_text, and *_frame if there are any) and say how many.

    Idempotent: saving the same payload again changes source names at most. Each role's frame is kept as JSON
    (triplet_frames), as an occurrence (frame_instances) and as a tree of nodes with parents (frame_nodes).
    Frames without any text are left out unless ``empty_frames`` asks for one in every role. ``tops`` are the largest
    ids by table where the store holds a part of the rows only (see :mod:`bucketed`).
    """
    tops = tops or {}
    documents = materialize(upsert_documents(store["documents"], payload.select("source_name", "content_hash"), now, tops.get("documents")), "documents")
    placed = payload.join(documents.select("content_hash", F.col("id").alias("document_id")), "content_hash").withColumns({"row_idx": F.col("row_idx").cast("int"), "extraction_stage": F.lit(stage)})
    placed = materialize(placed, "placed")
    fresh = placed.select(*KEYS["triplets"], "sentence_text")
    triplets = materialize(upsert_triplets(store["triplets"], fresh, now, tops.get("triplets")), "triplets")
    mine = triplets.join(placed.select("document_id").distinct(), "document_id", "left_semi")
    key = ["triplet_id", "role"]
    flat = materialize(payload_frames(placed, triplets), "payload_frames")
    nodes = materialize(flatten(flat.select(*key, F.try_parse_json("frame_json").alias("frame")), key), "flat_nodes")
    if not empty_frames:
        full = fold(nodes, key).where("has_content").select(*key)
        flat, nodes = materialize(flat.join(full, key, "left_semi"), "payload_frames"), nodes.join(full, key, "left_semi")
    frames = flat.select("triplet_id", "role", "frame_json", now.alias("created_at"))
    instances = flat.select("triplet_id", "role", "root_text", entity_name(F.col("root_text")).alias("root_norm"), "sentence_text", now.alias("created_at"))
    keep = {"created_at": F.coalesce("old.created_at", "new.created_at")}
    placed_instances = materialize(assign_ids(upsert(store["frame_instances"], instances, key, keep), key, store["frame_instances"], tops.get("frame_instances")).select(*SCHEMAS["frame_instances"].names), "instances")
    out = dict(store) | {
        "documents": documents,
        "triplets": triplets,
        "triplet_frames": assign_ids(upsert(store["triplet_frames"], frames, key, keep), key, store["triplet_frames"], tops.get("triplet_frames")).select(*SCHEMAS["triplet_frames"].names),
        "frame_instances": placed_instances,
        "frame_nodes": save_frame_nodes(store["frame_nodes"], nodes, placed_instances, now, tops.get("frame_nodes")),
    }
    counts = placed.agg(F.countDistinct("document_id").alias("documents")).join(mine.agg(F.count("*").alias("triplets"))).join(frames.agg(F.count("*").alias("frames")))
    return out, counts


def cascade_delete(store: dict[str, DataFrame], documents: DataFrame) -> dict[str, DataFrame]:
    """The store without the given documents (id) and all that hangs on them."""
    out = dict(store)
    gone_docs = documents.select(F.col("id"))
    out["documents"] = store["documents"].join(gone_docs, "id", "left_anti")
    gone_triplets = store["triplets"].join(gone_docs.withColumnRenamed("id", "document_id"), "document_id", "left_semi").select(F.col("id").alias("triplet_id"))
    out["triplets"] = store["triplets"].join(gone_docs.withColumnRenamed("id", "document_id"), "document_id", "left_anti").select(*store["triplets"].columns)
    out["triplet_frames"] = store["triplet_frames"].join(gone_triplets, "triplet_id", "left_anti").select(*store["triplet_frames"].columns)
    gone_instances = store["frame_instances"].join(gone_triplets, "triplet_id", "left_semi").select(F.col("id").alias("frame_instance_id"))
    out["frame_instances"] = store["frame_instances"].join(gone_triplets, "triplet_id", "left_anti").select(*store["frame_instances"].columns)
    gone_nodes = store["frame_nodes"].join(gone_instances, "frame_instance_id", "left_semi").select(F.col("id").alias("node_id"))
    out["frame_nodes"] = store["frame_nodes"].join(gone_instances, "frame_instance_id", "left_anti").select(*store["frame_nodes"].columns)
    out["node_concept_links"] = store["node_concept_links"].join(gone_nodes, "node_id", "left_anti").select(*store["node_concept_links"].columns)
    return out


def deletion_counts(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    """(table_name, deleted)."""
    rows = [before[t].agg(F.count("*").alias("b")).join(after[t].agg(F.count("*").alias("a"))).select(F.lit(t).alias("table_name"), (F.col("b") - F.col("a")).alias("deleted")) for t in before]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def table_counts(store: dict[str, DataFrame]) -> DataFrame:
    rows = [df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count") for name, df in store.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def orphans(nodes: DataFrame, edges: DataFrame, node: str = "node") -> DataFrame:
    """Nodes that no edge (src, dst) touches."""
    touched = edges.select(F.explode(F.array("src", "dst")).alias(node)).distinct()
    return nodes.join(touched, node, "left_anti")


# Property graph


def concept_nodes(triplets: DataFrame) -> DataFrame:
    """(norm, name): concepts of subjects and objects; the first spelling, by (triplet id, role), stays.

    Equal spellings are counted together by hash first: choosing a name sorts its rows, and a task would sort all of its own.
    """
    ends = triplets.select("id", F.inline(F.array(F.struct(F.lit(0).alias("side"), F.col("subject_text").alias("name")), F.struct(F.lit(1).alias("side"), F.col("object_text").alias("name")))))
    return ends.withColumn("norm", entity_name(F.col("name"))).where("norm <> ''").groupBy("norm", "name", "side").agg(F.min("id").alias("id")).groupBy("norm").agg(F.min_by("name", F.struct("id", "side")).alias("name"))


def relation_edges(triplets: DataFrame) -> DataFrame:
    """RELATION_INSTANCE edges: only triplets whose subject and object both hold text."""
    src, dst = entity_name(F.col("subject_text")), entity_name(F.col("object_text"))
    return triplets.select(
        src.alias("src"), F.col("subject_text").alias("src_name"), dst.alias("dst"), F.col("object_text").alias("dst_name"), F.col("predicate_text").alias("predicate"), entity_name(F.col("predicate_text")).alias("predicate_norm"),
        F.col("id").alias("triplet_id"), "document_id", F.col("sentence_text").alias("sentence"),
    ).where("src <> '' and dst <> ''")


def role_edges(triplets: DataFrame) -> DataFrame:
    """Triplet-to-concept edges of type SUBJECT, PREDICATE and OBJECT, and IN_DOCUMENT edges."""
    roles = F.inline(F.array(*(F.struct(F.lit(r.upper()).alias("type"), entity_name(F.col(f"{r}_text")).alias("target")) for r in ("subject", "predicate", "object")), F.struct(F.lit("IN_DOCUMENT").alias("type"), F.col("document_id").cast("string").alias("target"))))
    return triplets.select(F.col("id").alias("triplet_id"), roles).where("target <> ''")


def write_graph(stored: DataFrame, triplets: DataFrame) -> DataFrame:
    """Relation edges with those of the given triplets replaced."""
    return replace_by_key(stored, relation_edges(triplets), ["triplet_id"], triplets.select(F.col("id").alias("triplet_id")))


def delete_from_graph(edges: DataFrame, nodes: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges of the documents (document_id) and all derived edges (null document) go, then orphaned nodes."""
    kept = edges.where("document_id is not null").join(documents.select("document_id"), "document_id", "left_anti").select(*edges.columns)
    touched = kept.select(F.explode(F.array("src", "dst")).alias("norm")).distinct()
    return kept, nodes.join(touched, "norm", "left_semi")


#: Kinds of approved links.
LINK_TYPES = {"alias": "APPROVED_ALIAS_OF", "broader": "APPROVED_BROADER_THAN", "context": "APPROVED_CONTEXT_LINK", "manual": "MANUAL_CONTEXT_LINK"}
DERIVED_TYPES = ("SYNONYM_CANDIDATE", "CONTEXT_BRIDGE", "CONTEXT_PARENT", "HAS_COMPONENT_ROOT")


def approved_links(requests: DataFrame, nodes: DataFrame) -> DataFrame:
    """Requests (src, dst, kind, relation_text, note) as edges; unknown kinds are manual, unknown ends give none."""
    kinds = F.create_map(*(F.lit(x) for kv in LINK_TYPES.items() for x in kv))
    known = nodes.select("norm").distinct()
    ends = requests.join(known.withColumnRenamed("norm", "src"), "src", "left_semi").join(known.withColumnRenamed("norm", "dst"), "dst", "left_semi").where("src <> dst")
    return ends.select("src", "dst", F.coalesce(F.try_element_at(kinds, F.col("kind")), F.lit(LINK_TYPES["manual"])).alias("type"), "relation_text", "note").dropDuplicates(["src", "dst", "type"])


def synonym_component(root_name: Column, children: DataFrame) -> DataFrame:
    """Edges from a root to its children (ord, name): empty names, the root itself and repeats are left out."""
    named = children.select("ord", "name", entity_name(F.col("name")).alias("norm"), entity_name(root_name).alias("root_norm")).where("norm <> '' and norm <> root_norm")
    first = named.groupBy("root_norm", "norm").agg(F.min_by("name", "ord").alias("name"), F.min("ord").alias("ord"))
    return first.select(F.col("root_norm").alias("src"), F.col("norm").alias("dst"), "name", "ord", F.lit("APPROVED_BROADER_THAN").alias("type"))


def connector(spark: SparkSession, left: str, right: str, relation_text: str, name: str | None = None, note: str = "") -> tuple[DataFrame, DataFrame]:
    """A connector node between two components and its two edges; without a name the relation text names it."""
    label = name or relation_text.strip() or f"{left} ~ {right}"
    node = spark.range(1).select(entity_name(F.lit(label)).alias("norm"), F.lit(label).alias("name"), F.lit(name is None).alias("auto_name"))
    edges = node.select(F.inline(F.array(F.struct(F.lit(left).alias("src"), F.col("norm").alias("dst")), F.struct(F.col("norm").alias("src"), F.lit(right).alias("dst")))), F.lit("MANUAL_COMPONENT_LINK").alias("type"), F.lit(relation_text).alias("relation_text"), F.lit(note).alias("note"))
    return node, edges


def rebuild_derived(edges: DataFrame, fresh: DataFrame, kind: str) -> DataFrame:
    """Derived edges of one type replaced by fresh ones (write with the type as partition)."""
    if kind not in DERIVED_TYPES:
        raise ValueError(f"not a derived type: {kind}")
    return edges.where(F.col("type") != kind).unionByName(fresh.withColumn("type", F.lit(kind)), allowMissingColumns=True)


# Concepts and aliases


def ensure_concepts(stored: DataFrame, fresh: DataFrame, now: Column) -> DataFrame:
    """Concepts by norm: the name is overwritten, an approved type stays, new ones are candidates."""
    one = fresh.groupBy("canonical_norm").agg(F.max("canonical_name").alias("canonical_name")).withColumns({"concept_type": F.lit("candidate"), "created_at": now})
    keep = F.when(F.col("old.concept_type") == "approved", F.lit("approved")).otherwise(F.lit("candidate"))
    merged = upsert(stored, one, ["canonical_norm"], {"concept_type": keep, "created_at": F.coalesce("old.created_at", "new.created_at")})
    return assign_ids(merged, ["canonical_norm"], stored).select(*SCHEMAS["concepts"].names)


def upsert_aliases(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Aliases by (concept, norm): the larger confidence, the stored status."""
    key = ["concept_id", "alias_norm"]
    one = fresh.groupBy(*key).agg(F.max("alias_text").alias("alias_text"), F.max("source").alias("source"), F.max("confidence").alias("confidence"), F.max("status").alias("status"))
    zero = F.lit(0.0)
    merged = upsert(stored, one, key, {"confidence": F.greatest(F.coalesce("old.confidence", zero), F.coalesce("new.confidence", zero)), "status": F.coalesce("old.status", "new.status")})
    return assign_ids(merged, key, stored).select(*SCHEMAS["concept_aliases"].names)


def review_aliases(aliases: DataFrame, concepts: DataFrame, decisions: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Decisions (id, new_status, note) applied: approval keeps its first time and approves the concept."""
    joined = aliases.join(decisions.select("id", "new_status", "note"), "id", "left")
    said, ok = F.col("new_status").isNotNull(), F.col("new_status") == "approved"
    reviewed = joined.select(
        "id", "concept_id", "alias_text", "alias_norm", F.when(ok, "manual_review").otherwise(F.col("source")).alias("source"), "confidence", F.coalesce("new_status", "status").alias("status"),
        F.when(ok, F.coalesce("approved_at", now)).when(~said, F.col("approved_at")).alias("approved_at"), F.when(said, F.nullif(F.trim("note"), F.lit(""))).otherwise(F.col("review_note")).alias("review_note"))
    approved = aliases.join(decisions.where("new_status = 'approved'").select("id"), "id", "left_semi").select(F.col("concept_id").alias("id")).distinct()
    touched = concepts.join(approved.withColumn("_ok", F.lit(True)), "id", "left").withColumn("concept_type", F.when(F.col("_ok"), "approved").otherwise(F.col("concept_type"))).drop("_ok")
    return reviewed, touched.select(*concepts.columns)


def merge_concepts(concepts: DataFrame, aliases: DataFrame, links: DataFrame, merges: DataFrame, now: Column, note: str = "") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Merges (source_id, target_id) applied to concepts, aliases and links.

    The source's name becomes an approved alias of the target unless the norms are equal; its aliases move
    (rejected ones as candidates) and its links too; of equal keys the larger confidence or score stays, and
    approved beats candidate beats rejected. Equal ids are an error of the caller and are left out.
    """
    pairs = merges.where("source_id <> target_id")
    source = pairs.join(concepts.select(F.col("id").alias("source_id"), F.col("canonical_name"), F.col("canonical_norm")), "source_id")
    both = source.join(concepts.select(F.col("id").alias("target_id"), F.col("canonical_norm").alias("target_norm")), "target_id")
    named = both.where("canonical_norm <> target_norm").select(
        F.col("target_id").alias("concept_id"), F.col("canonical_name").alias("alias_text"), F.col("canonical_norm").alias("alias_norm"), F.lit("merge_manual").alias("source"), F.lit(1.0).alias("confidence"), F.lit("approved").alias("status"),
        now.alias("approved_at"), F.lit(note.strip() or None).cast("string").alias("review_note"), F.lit(1).alias("wave"))
    moved = aliases.join(both.select(F.col("source_id").alias("concept_id"), "target_id"), "concept_id").select(
        F.col("target_id").alias("concept_id"), "alias_text", "alias_norm", "source", "confidence", F.when(F.col("status") == "rejected", "candidate").otherwise(F.col("status")).alias("status"), "approved_at", "review_note", F.lit(2).alias("wave"))
    gone = both.select(F.col("source_id").alias("concept_id")).distinct()
    stay = aliases.join(gone, "concept_id", "left_anti").select("concept_id", "alias_text", "alias_norm", "source", "confidence", "status", "approved_at", "review_note", F.lit(0).alias("wave"))
    every = stay.unionByName(named).unionByName(moved)
    rank = F.max(F.when(F.col("status") == "approved", 2).when(F.col("status") == "candidate", 1).otherwise(0))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("wave")))
    merged = every.groupBy("concept_id", "alias_norm").agg(
        F.max_by("alias_text", "wave").alias("alias_text"), F.max_by("source", F.when(F.col("wave") < 2, F.col("wave")).otherwise(-1)).alias("source"), F.max(F.coalesce("confidence", F.lit(0.0))).alias("confidence"),
        F.element_at(F.array(F.lit("rejected"), F.lit("candidate"), F.lit("approved")), rank + 1).alias("status"), first("approved_at").alias("approved_at"), first("review_note").alias("review_note"))
    relinked = links.join(both.select(F.col("source_id").alias("concept_id"), "target_id"), "concept_id", "left").select("node_id", F.coalesce("target_id", "concept_id").alias("concept_id"), "link_type", "score", "method")
    new_links = relinked.groupBy("node_id", "concept_id", "link_type").agg(F.max(F.coalesce("score", F.lit(0.0))).alias("score"), F.min("method").alias("method"))
    targets = both.select(F.col("target_id").alias("id")).distinct().withColumn("_hit", F.lit(True))
    kept = concepts.join(gone.withColumnRenamed("concept_id", "id"), "id", "left_anti").join(targets, "id", "left")
    typed = kept.withColumn("concept_type", F.when(F.col("_hit") & (F.coalesce("concept_type", F.lit("")) == ""), "approved").otherwise(F.col("concept_type"))).select(*concepts.columns)
    return typed, merged, new_links
