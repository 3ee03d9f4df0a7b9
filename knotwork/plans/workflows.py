"""The whole jobs: load payloads, analyse a graph, mine aliases. Each returns named DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.similarity import encode_texts
from ..functions.text import context_text, entity_context_text, normalize
from ..operators import evaluate, graph, mining, search, store, structure
from ..session import materialize
from ..sources.readers import payload_rows, read_triplet_json

Encoder = Callable[[list[str]], list[list[float]]]


def load_payloads(spark: SparkSession, path: str, stored: dict[str, DataFrame], now: Column) -> tuple[dict[str, DataFrame], DataFrame]:
    """Triplet payload files into the store, by the idempotent upserts; also counts of what came."""
    return store.save_triplets(stored, payload_rows(read_triplet_json(spark, path)), now, "file", empty_frames=True)


def analyze_graph(
    relations: DataFrame,
    table_triplets: DataFrame | None = None,
    search_rows: DataFrame | None = None,
    frames: DataFrame | None = None,
    include_frames: bool = True,
    backend: str = "auto",
    encoder: Encoder | None = None,
    least_combined: float = 0.45,
    least_bridge: float = 0.35,
    least_structural: float = 0.10,
    least_group: float = 0.45,
    limit: int = 200,
) -> dict[str, DataFrame]:
    """All analytics of a graph of relations.

    ``relations``: src, src_name, dst, dst_name, predicate, predicate_norm, triplet_id, document_id.
    ``frames``: occurrence, norm, child. Contexts and their embeddings are computed once and used by both
    rankers. Results: metrics, degrees, fragility, cycles, components, global_root, contexts, synonyms, bridges,
    projection, clusters and, if table triplets are given, table_detail and table_recall.
    """
    edges = materialize(graph.simple_digraph(relations.select("src", "dst")), "digraph")
    labels = graph.node_labels(relations.withColumn("_n", F.coalesce("triplet_id", F.lit(1 << 60))), "_n")
    ranks = materialize(graph.pagerank(edges), "pagerank")
    found = materialize(structure.low_link(edges), "low_link")
    members = materialize(graph.components(edges), "members")
    numbers = graph.component_sizes(edges, members)
    impact = structure.removal_impact(edges, ranks, found)
    roots = materialize(graph.component_roots(edges, ranks, labels, members), "roots")
    degrees = graph.degrees(edges).join(ranks, "node").join(labels, "node").select("node", "label", "in_degree", "out_degree", "total_degree", F.round("pagerank", 6).alias("pagerank"))
    cyclic = graph.is_cyclic(edges)
    by_node = members.join(numbers.select("component", "component_id"), "component").select("node", F.col("component_id").alias("component"))
    contexts = mining.attach_metadata(mining.concept_contexts(relations, frames), by_node, graph.node_documents(relations))
    described = context_text(F.col("name"), F.col("norm"), F.col("out_preds"), F.col("in_preds"), F.col("child_terms") if include_frames else None, F.col("occ_count"))
    embedded, _ = encode_texts(contexts, described, backend, encoder)
    embedded = materialize(embedded, "contexts")
    bridges = materialize(mining.context_bridges(embedded, include_frames, least_bridge, least_structural, limit), "bridges")
    entities = mining.entity_contexts(relations)
    told = entity_context_text(F.col("name"), F.col("norm"), F.col("out_preds"), F.col("in_preds"), F.col("out_neighbors"), F.col("in_neighbors"))
    entities, _ = encode_texts(entities, told, backend, encoder)
    out = {
        "metrics": graph.degree_metrics(edges).join(cyclic).join(structure.fragility(edges, found)).join(numbers.agg(F.count("*").alias("components_count"))),
        "degrees": degrees.orderBy(F.desc("total_degree"), F.desc("pagerank"), "label"),
        "fragility": structure.fragility_report(impact),
        "cycles": graph.simple_cycles(edges, labels),
        "components": roots,
        "global_root": graph.global_root(roots),
        "contexts": embedded,
        "synonyms": mining.synonyms(embedded, include_frames, least_combined, least_structural, limit),
        "bridges": bridges,
        "projection": graph.project_components(edges, bridges.select(F.col("l_norm").alias("src"), F.col("r_norm").alias("dst"))),
        "clusters": mining.entity_clusters(materialize(entities, "entities"), least_group, least_structural, limit),
    }
    if table_triplets is not None:
        detail = materialize(evaluate.evaluate(table_triplets, search_rows, relations), "detail")
        out |= {"table_detail": detail, "table_recall": evaluate.recall(detail)}
    return out


def derived_edges(results: dict[str, DataFrame]) -> DataFrame:
    """Synonym, bridge, parent and root edges of an analysis, as rows that replace the stored ones by type."""
    synonyms = results["synonyms"].select(F.col("l_norm").alias("src"), F.col("r_norm").alias("dst"), F.lit("SYNONYM_CANDIDATE").alias("type"), F.col("combined_score").alias("score"))
    bridges = results["bridges"].select(F.col("l_norm").alias("src"), F.col("r_norm").alias("dst"), F.lit("CONTEXT_BRIDGE").alias("type"), F.col("bridge_score").alias("score"))
    parents = results["clusters"].select(F.col("child_norm").alias("src"), F.col("root_norm").alias("dst"), F.lit("CONTEXT_PARENT").alias("type"), F.col("cluster_score").alias("score"))
    roots = results["components"].select(F.lit(graph.VIRTUAL_ROOT).alias("src"), F.col("root_norm").alias("dst"), F.lit("HAS_COMPONENT_ROOT").alias("type"), F.col("component_id").cast("double").alias("score"))
    return synonyms.unionByName(bridges).unionByName(parents).unionByName(roots)


def mine_aliases(stored: dict[str, DataFrame], now: Column, least_support: int = 1, least_cosine: float = 0.82, limit: int = 1000, backend: str = "auto", encoder: Encoder | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """Alias candidates among the concepts of the stored triplets, upserted as concepts and aliases."""
    triplets = stored["triplets"]
    names = store.concept_nodes(triplets)
    ends = triplets.select(F.explode(F.array("subject_text", "object_text")).alias("t")).select(normalize(F.col("t")).alias("norm")).where("norm <> ''")
    vertices = names.join(ends.groupBy("norm").agg(F.count("*").alias("support")), "norm")
    embedded, _ = encode_texts(vertices, F.trim(F.coalesce(F.nullif("name", F.lit("")), "norm")), backend, encoder)
    found = materialize(mining.alias_candidates(materialize(embedded, "vertices"), least_support, least_cosine, limit), "candidates")
    concepts = materialize(store.ensure_concepts(stored["concepts"], found.select("canonical_norm", "canonical_name"), now), "concepts")
    fresh = found.join(concepts.select("canonical_norm", F.col("id").alias("concept_id")), "canonical_norm").select("concept_id", "alias_text", "alias_norm", F.lit("embedding").alias("source"), "confidence", F.lit("candidate").alias("status"))
    return dict(stored) | {"concepts": concepts, "concept_aliases": store.upsert_aliases(stored["concept_aliases"], fresh)}, found


def search_index(triplets: DataFrame, frame_terms: DataFrame | None = None) -> DataFrame:
    """What an evaluation searches in: triplets with norms and frame terms."""
    return search.search_rows(triplets, frame_terms)
