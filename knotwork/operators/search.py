"""Browsing and search over the store and the graph. Limits here are the feature: lists for people."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize

# The columns that a text search of each table looks at.
BROWSE = {
    "documents": ("source_name", "content_hash"),
    "triplets": ("subject_text", "predicate_text", "object_text", "sentence_text", "extraction_stage"),
    "triplet_frames": ("role", "frame_json"),
    "frame_instances": ("role", "root_text", "root_norm", "sentence_text"),
    "frame_nodes": ("node_text", "node_norm", "node_lemma", "edge_label", "path"),
    "concepts": ("canonical_name", "canonical_norm", "concept_type"),
    "concept_aliases": ("alias_text", "alias_norm", "source", "status", "review_note"),
    "node_concept_links": ("link_type", "method"),
}
# Types of links between concepts that people made or approved.
CONCEPT_LINKS = ("APPROVED_ALIAS_OF", "APPROVED_BROADER_THAN", "APPROVED_CONTEXT_LINK", "MANUAL_CONTEXT_LINK", "MANUAL_COMPONENT_LINK")


def any_contains(columns: list[str] | tuple[str, ...], text: str) -> Column:
    """Case-insensitive containment in any of the columns."""
    pattern = "%" + text.strip().replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"
    return reduce(lambda a, b: a | b, (F.coalesce(F.col(c).cast("string").ilike(pattern), F.lit(False)) for c in columns))


def browse(df: DataFrame, columns: list[str] | tuple[str, ...], contains: str = "", order: str = "id", limit: int = 100) -> DataFrame:
    """Rows that hold a text in any of the columns, latest first."""
    found = df.where(any_contains(columns, contains)) if contains.strip() else df
    return found.orderBy(F.desc(order)).limit(limit)


def browse_table(store: dict[str, DataFrame], table: str, contains: str = "", document_id: int | None = None, limit: int = 100) -> DataFrame:
    """Browse a table of the store; a document filter follows the keys to the document."""
    if table not in BROWSE:
        raise ValueError(f"unsupported table: {table}")
    df = store[table]
    if document_id is not None:
        mine = store["triplets"].where(F.col("document_id") == document_id).select(F.col("id").alias("triplet_id"))
        if table == "documents":
            df = df.where(F.col("id") == document_id)
        elif table == "triplets":
            df = df.where(F.col("document_id") == document_id)
        elif table in ("triplet_frames", "frame_instances"):
            df = df.join(mine, "triplet_id", "left_semi")
        elif table == "frame_nodes":
            instances = store["frame_instances"].join(mine, "triplet_id", "left_semi").select(F.col("id").alias("frame_instance_id"))
            df = df.join(instances, "frame_instance_id", "left_semi")
    return browse(df, BROWSE[table], contains, "id", limit)


def documents_with_counts(documents: DataFrame, triplets: DataFrame) -> DataFrame:
    """Documents with their number of triplets, 0 for those without; triplets are counted before the join."""
    counts = triplets.groupBy("document_id").agg(F.count("*").alias("triplets_count"))
    return documents.join(counts, documents["id"] == counts["document_id"], "left").select(*(documents[c] for c in documents.columns), F.coalesce("triplets_count", F.lit(0).cast("long")).alias("triplets_count"))


def concept_alias_counts(concepts: DataFrame, aliases: DataFrame) -> DataFrame:
    """Concepts with the number of their aliases, and of the approved ones."""
    counts = aliases.groupBy("concept_id").agg(F.count("*").alias("aliases"), F.count_if(F.col("status") == "approved").alias("approved"))
    zero = F.lit(0).cast("long")
    return concepts.join(counts, concepts["id"] == counts["concept_id"], "left").select(*(concepts[c] for c in concepts.columns), F.coalesce("aliases", zero).alias("alias_count"), F.coalesce("approved", zero).alias("approved_alias_count"))


def alias_list(aliases: DataFrame, concepts: DataFrame, status: str = "all", limit: int = 200) -> DataFrame:
    """Aliases with their concept: candidates first, then approved, then rejected; by confidence."""
    joined = aliases.join(concepts.select(F.col("id").alias("concept_id"), "canonical_name", "canonical_norm"), "concept_id")
    kept = joined if status == "all" else joined.where(F.col("status") == status)
    rank = F.when(F.col("status") == "candidate", 0).when(F.col("status") == "approved", 1).otherwise(2)
    return kept.orderBy(rank, F.desc_nulls_last("confidence"), "canonical_name", "alias_text").limit(limit)


def graph_documents(triplets: DataFrame) -> DataFrame:
    """(document_id, triplets): distinct triplets per document."""
    return triplets.groupBy("document_id").agg(F.countDistinct("id").alias("triplets"))


def concept_options(nodes: DataFrame, edges: DataFrame, frames: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Concepts with out- and in-degree and frame count; each side is aggregated before the joins."""
    out = edges.groupBy(F.col("src").alias("norm")).agg(F.count("*").alias("out_count"))
    inn = edges.groupBy(F.col("dst").alias("norm")).agg(F.count("*").alias("in_count"))
    zero = F.lit(0).cast("long")
    joined = nodes.join(out, "norm", "left").join(inn, "norm", "left")
    if frames is not None:
        joined = joined.join(frames.groupBy("norm").agg(F.countDistinct("occurrence").alias("frame_count")), "norm", "left")
    else:
        joined = joined.withColumn("frame_count", zero)
    counted = joined.select(*nodes.columns, *(F.coalesce(c, zero).alias(c) for c in ("out_count", "in_count", "frame_count")))
    ranked = counted.orderBy(F.desc(F.col("out_count") + F.col("in_count")), F.desc("frame_count"), "norm")
    return ranked.limit(limit) if limit else counted


def analytic_relations(relations: DataFrame, links: DataFrame) -> DataFrame:
    """Relation instances, and approved or manual links without triplet and document, in one table."""
    linked = links.where(F.col("type").isin(*CONCEPT_LINKS)).select(
        "src", F.coalesce("src_name", "src").alias("src_name"), "dst", F.coalesce("dst_name", "dst").alias("dst_name"), F.coalesce("relation_text", "type").alias("predicate"), F.col("type").alias("predicate_norm"),
        F.lit(None).cast("long").alias("triplet_id"), F.lit(None).cast("long").alias("document_id"))
    return relations.select(*linked.columns).unionByName(linked)


def entity_relations(relations: DataFrame, parents: DataFrame, contains: str = "", document_id: int | None = None, limit: int = 200) -> DataFrame:
    """Relations of entities whose name holds a text at either end; context parents only without a document."""
    columns = ["src_name", "predicate", "dst_name", "triplet_id", "document_id"]
    found = relations.select(*columns)
    if document_id is not None:
        found = found.where(F.col("document_id") == document_id)
    else:
        up = parents.select(F.col("child_name").alias("src_name"), F.lit("CONTEXT_PARENT").alias("predicate"), F.col("root_name").alias("dst_name"), F.lit(None).cast("long").alias("triplet_id"), F.lit(None).cast("long").alias("document_id"))
        found = found.unionByName(up)
    if contains.strip():
        found = found.where(any_contains(["src_name", "dst_name"], contains))
    return found.orderBy(F.asc_nulls_last("triplet_id"), "src_name", "dst_name", "predicate").limit(limit)


def concept_relations(relations: DataFrame, contains: str = "", document_id: int | None = None, limit: int = 200) -> DataFrame:
    found = relations if document_id is None else relations.where(F.col("document_id") == document_id)
    found = found.where(any_contains(["src_name", "dst_name", "src", "dst"], contains)) if contains.strip() else found
    return found.orderBy(F.asc_nulls_last("triplet_id"), "src", "dst").limit(limit)


def bridge_list(bridges: DataFrame, contains: str = "", limit: int = 200) -> DataFrame:
    """Context bridges with a display label, best first."""
    found = bridges.where(any_contains(["l_name", "r_name", "shared_predicates", "shared_children"], contains)) if contains.strip() else bridges
    labelled = found.withColumn("label", F.concat(F.lit("bridge "), F.round("bridge_score", 2).cast("string")))
    return labelled.orderBy(F.desc("bridge_score"), F.desc("structural_score"), F.desc("embedding_score"), "l_norm", "r_norm").limit(limit)


def approved_list(links: DataFrame, contains: str = "", limit: int = 200) -> DataFrame:
    found = links.where(F.col("type").isin(*CONCEPT_LINKS))
    found = found.where(any_contains(["src_name", "dst_name", "relation_text", "note"], contains)) if contains.strip() else found
    return found.orderBy("type", "src_name", "dst_name").limit(limit)


def triplet_list(triplets: DataFrame, names: DataFrame | None = None, contains: str = "", document_id: int | None = None, limit: int = 200) -> DataFrame:
    """Triplets with stored or canonical names; a text filter really filters."""
    found = triplets if document_id is None else triplets.where(F.col("document_id") == document_id)
    if names is not None:
        for role in ("subject", "object"):
            lookup = names.select(F.col("norm").alias(f"{role}_norm"), F.col("name").alias(f"{role}_name"))
            found = found.withColumn(f"{role}_norm", normalize(F.col(f"{role}_text"))).join(lookup, f"{role}_norm", "left")
    show = lambda role: F.coalesce(F.nullif(F.col(f"{role}_text"), F.lit("")), F.col(f"{role}_name") if names is not None and role != "predicate" else F.lit(None), F.lit("")).alias(role)
    rows = found.select(F.col("id").alias("triplet_id"), "document_id", show("subject"), show("predicate"), show("object"), F.coalesce("sentence_text", F.lit("")).alias("sentence"))
    if contains.strip():
        rows = rows.where(any_contains(["subject", "predicate", "object", "sentence"], contains))
    return rows.orderBy("triplet_id").limit(limit)


def triplet_by_id(triplets: DataFrame, triplet_id: int) -> DataFrame:
    return triplet_list(triplets.where(F.col("id") == triplet_id), limit=1)


def search_rows(triplets: DataFrame, frame_terms: DataFrame | None = None) -> DataFrame:
    """Triplets with norms and the frame terms of each role, as a map: two levels of aggregation, then a join."""
    base = triplets.select(F.col("id").alias("triplet_id"), "document_id", *(F.coalesce(f"{r}_text", F.lit("")).alias(r) for r in ("subject", "predicate", "object")), *(normalize(F.col(f"{r}_text")).alias(f"{r}_norm") for r in ("subject", "predicate", "object")))
    none = F.create_map().cast("map<string,array<string>>")
    if frame_terms is None:
        return base.withColumn("frame_terms", none)
    by_role = frame_terms.where("term <> ''").groupBy("triplet_id", "role").agg(F.array_sort(F.collect_set("term")).alias("terms"))
    maps = by_role.groupBy("triplet_id").agg(F.map_from_entries(F.collect_list(F.struct("role", "terms"))).alias("frame_terms"))
    # Triplets and maps are equally many, so neither is broadcast.
    return base.join(maps.hint("merge"), "triplet_id", "left").withColumn("frame_terms", F.coalesce("frame_terms", none))


def display_dedupe(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with equal keys the first in order."""
    first = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")


def payload_graph(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and one edge per triplet of payload rows; empty slots are labelled."""
    shown = lambda c: F.when(F.coalesce(c, F.lit("")) == "", "∅").otherwise(F.col(c))
    edges = rows.select("row_idx", shown("subject_text").alias("src"), shown("predicate_text").alias("label"), shown("object_text").alias("dst"))
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), edges


def hub_view(rows: DataFrame, frame_edges: DataFrame) -> DataFrame:
    """A triplet as a hub: edges to its three roles, a dashed edge to each frame root, and the child edges.

    ``frame_edges``: triplet_id, role, parent_path, path, text.
    """
    hub = F.concat(F.lit("t"), F.col("triplet_id").cast("string"))
    roles = F.inline(F.array(*(F.struct(F.lit(r).alias("role"), F.col(f"{r}_text").alias("text")) for r in ("subject", "predicate", "object"))))
    spokes = rows.select("triplet_id", roles).select(hub.alias("src"), F.concat_ws(":", hub, "role").alias("dst"), F.col("role").alias("label"), F.col("text"), F.lit("solid").alias("style"))
    node = lambda path: F.concat_ws(":", hub, F.col("role"), F.col(path))
    roots = frame_edges.where("parent_path is null").select(F.concat_ws(":", hub, "role").alias("src"), node("path").alias("dst"), F.lit("frame").alias("label"), "text", F.lit("dashed").alias("style"))
    children = frame_edges.where("parent_path is not null").select(node("parent_path").alias("src"), node("path").alias("dst"), F.lit("child").alias("label"), "text", F.lit("solid").alias("style"))
    return spokes.unionByName(roots).unionByName(children)
