"""Similarity mining over concept contexts: synonyms, context bridges, legacy clusters, aliases.

Scores are column expressions over pairs. Pairs come from lossless candidate generation where the thresholds
allow it (see :func:`candidate_pairs`), else from the i < j join that the scores are defined on. Reports of the best
pairs of many rows are first looked for among pairs of high scores, which only similar vectors reach.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import cosine, jaccard
from ..functions.text import normalize, shorter_variant, tokens
from ..session import materialize
from .components import star_components
from .cosine_join import cosine_pairs, cosine_scores

EMPTY = "array<string>"


def concept_contexts(relations: DataFrame, frames: DataFrame | None = None) -> DataFrame:
    """(norm, name, out_preds, in_preds, child_terms, occ_count) from (src, src_name, dst, dst_name, predicate_norm).

    ``frames`` (occurrence, norm, child) adds frame children and occurrence counts. Each side is aggregated
    before it is joined, so nothing fans out.
    """
    ends = relations.select(F.explode(F.array(
        F.struct(F.col("src").alias("norm"), F.col("src_name").alias("name"), F.col("predicate_norm").alias("out"), F.lit(None).cast("string").alias("inn")),
        F.struct(F.col("dst").alias("norm"), F.col("dst_name").alias("name"), F.lit(None).cast("string").alias("out"), F.col("predicate_norm").alias("inn")))).alias("e")).select("e.*")
    named = lambda c: F.array_sort(F.collect_set(F.nullif(F.col(c), F.lit(""))))
    base = ends.groupBy("norm").agg(F.min("name").alias("name"), named("out").alias("out_preds"), named("inn").alias("in_preds"))
    if frames is None:
        return base.withColumns({"child_terms": F.array().cast(EMPTY), "occ_count": F.lit(0).cast("long")})
    seen = frames.groupBy("norm").agg(named("child").alias("child_terms"), F.countDistinct("occurrence").alias("occ_count"))
    return base.join(seen, "norm", "left").withColumns({"child_terms": F.coalesce("child_terms", F.array().cast(EMPTY)), "occ_count": F.coalesce("occ_count", F.lit(0).cast("long"))})


def entity_contexts(relations: DataFrame) -> DataFrame:
    """(norm, name, out_preds, in_preds, out_neighbors, in_neighbors, preds, neighbors) from the same relations.

    Both ends of a relation are aggregated at once; empty predicates and names are left out.
    """
    side = lambda me, my_name, other, out: F.struct(
        F.col(me).alias("norm"), F.col(my_name).alias("name"), F.col("predicate").alias("p"), F.col(other).alias("n"), F.lit(out).alias("out"))
    ends = relations.select(F.explode(F.array(side("src", "src_name", "dst_name", True), side("dst", "dst_name", "src_name", False))).alias("e")).select("e.*")
    named = lambda c, out: F.array_sort(F.collect_set(F.when(F.col("out") if out else ~F.col("out"), F.nullif(F.col(c), F.lit("")))))
    g = ends.groupBy("norm").agg(F.min("name").alias("name"), named("p", True).alias("out_preds"), named("p", False).alias("in_preds"), named("n", True).alias("out_neighbors"), named("n", False).alias("in_neighbors"))
    return g.withColumns({"preds": F.array_sort(F.array_union("out_preds", "in_preds")), "neighbors": F.array_sort(F.array_union("out_neighbors", "in_neighbors"))})


def attach_metadata(contexts: DataFrame, members: DataFrame, documents: DataFrame) -> DataFrame:
    """Adds component_id, document_ids and document_count by norm."""
    joined = contexts.join(members.select(F.col("node").alias("norm"), F.col("component").alias("component_id")), "norm", "left").join(documents.select(F.col("node").alias("norm"), "document_ids"), "norm", "left")
    ids = F.coalesce("document_ids", F.array().cast("array<long>"))
    return joined.withColumns({"document_ids": ids, "document_count": F.size(ids).cast("long")})


def _sides(contexts: DataFrame) -> tuple[DataFrame, DataFrame]:
    return (contexts.select(*(F.col(c).alias(f"{s}_{c}") for c in contexts.columns)) for s in ("l", "r"))


#: Rows of one item that a side of a cell holds.
CELL_ROWS = 1024


def pairs_within(flat: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Pairs (l_norm, r_norm) of the rows (norm, item) that share an item, once each.

    The rows of an item are dealt into a grid of cells, so a frequent item is many tasks' work instead of one's.
    """
    size = flat.groupBy("item").agg(F.ceil(F.count("*") / cell_rows).cast("int").alias("k"), F.count("*").alias("n")).where("n > 1")
    placed = flat.join(size, "item").select("item", "norm", "k", F.pmod(F.xxhash64("norm"), F.col("k")).cast("int").alias("b"))
    every = F.explode(F.sequence(F.lit(0), F.col("k") - 1))
    left = placed.select("item", F.col("norm").alias("l_norm"), F.col("b").alias("i"), every.alias("j"))
    right = placed.select("item", F.col("norm").alias("r_norm"), F.col("b").alias("j"), every.alias("i"))
    return left.join(right, ["item", "i", "j"]).where("l_norm < r_norm").select("l_norm", "r_norm").distinct()


#: The most that a pair without a common predicate or child scores structurally: equal counts alone. With and without frames.
UNSHARED = {True: 0.10, False: 0.15}


def candidate_pairs(contexts: DataFrame, least_structural: float = 0.10, frames: bool = True, least_cosine: float = 0.0) -> DataFrame:
    """Pairs (l_norm, r_norm) that can pass the thresholds; ``contexts`` needs an ``embedding`` if there is a least cosine.

    ``least_cosine`` binds pairs without a common predicate or child: what those need, as they score at most
    ``UNSHARED`` structurally, and that only if both occur equally often. So an equi-join on common items finds what
    scores more, and a cosine join the rest. Without a least cosine the rest is every pair; with frames and a
    structural threshold of exactly 0.10, every pair of equal counts.
    """
    items = [F.transform(F.array_union("out_preds", "in_preds"), lambda p: F.concat(F.lit("p:"), p))]
    if frames:
        items.append(F.transform("child_terms", lambda c: F.concat(F.lit("c:"), c)))
    counts = F.array(F.concat(F.lit("o:"), F.greatest(F.coalesce("occ_count", F.lit(0)), F.lit(1)).cast("string")))
    within = lambda parts: pairs_within(contexts.select("norm", F.explode(F.array_distinct(F.concat(*parts))).alias("item")))
    if least_structural > UNSHARED[frames]:
        return within(items)
    if least_cosine > 0:
        return within(items).unionByName(cosine_pairs(contexts, least_cosine)).distinct()
    if frames and least_structural == UNSHARED[frames]:
        return within([*items, counts])
    left, right = (contexts.select(F.col("norm").alias(f"{s}_norm")) for s in ("l", "r"))
    return left.join(right, F.col("l_norm") < F.col("r_norm"))


def context_pair_scores(contexts: DataFrame, frames: bool = True, least_structural: float = 0.0, least_cosine: float = 0.0, candidates: DataFrame | None = None) -> DataFrame:
    """Scores of all candidate pairs (see :func:`candidate_pairs`), or of those given; ``contexts`` needs an ``embedding``.

    Given pairs with a ``cosine`` keep it, and no vector is moved for them.
    """
    scored = candidates is not None and "cosine" in candidates.columns
    left, right = _sides(contexts.drop("embedding") if scored else contexts)
    if candidates is None and (least_structural > UNSHARED[frames] or least_cosine > 0 or frames and least_structural == UNSHARED[frames]):
        candidates = candidate_pairs(contexts, least_structural, frames, least_cosine)
    if candidates is not None:
        pairs = candidates.join(left, "l_norm").join(right, "r_norm")
    else:
        pairs = left.join(right, F.col("l_norm") < F.col("r_norm"))
    preds = lambda s: F.array_union(f"{s}_out_preds", f"{s}_in_preds")
    occ = lambda s: F.greatest(F.coalesce(f"{s}_occ_count", F.lit(0)), F.lit(1))
    p, c = jaccard(preds("l"), preds("r")), jaccard(F.col("l_child_terms"), F.col("r_child_terms"))
    o = F.least(occ("l"), occ("r")) / F.greatest(occ("l"), occ("r"))
    structural = 0.45 * p + 0.45 * c + 0.10 * o if frames else 0.85 * p + 0.15 * o
    no_docs = (F.size("l_document_ids") == 0) & (F.size("r_document_ids") == 0)
    shared_p = F.array_sort(F.array_intersect(preds("l"), preds("r")))
    shared_c = F.array_sort(F.array_intersect("l_child_terms", "r_child_terms"))
    rated = pairs.withColumns({
        "structural": structural,
        "embedding": F.col("cosine") if scored else cosine(F.col("l_embedding"), F.col("r_embedding")),
        "doc_separation": F.when(no_docs, F.lit(0.0)).otherwise(1.0 - jaccard(F.col("l_document_ids"), F.col("r_document_ids"))),
        "shared_predicates": shared_p,
        "shared_children": shared_c,
        "support": (F.size(shared_p) + (F.size(shared_c) if frames else F.lit(0))).cast("long"),
    })
    return rated.withColumns({"combined": 0.55 * F.col("structural") + 0.45 * F.col("embedding"), "bridge": 0.40 * F.col("structural") + 0.40 * F.col("embedding") + 0.20 * F.col("doc_separation")})


def _first_ten(items: str) -> Column:
    """The first ten items of a sorted list, as a report shows them."""
    return F.array_join(F.slice(F.col(items).cast("array<string>"), 1, 10), ", ").alias(items)


#: Scores from which a report is tried to be filled first, where there are more rows than this.
LEVELS, MANY_ROWS = (0.9, 0.8), 20_000


def best_pairs(contexts: DataFrame, frames: bool, score: str, weights: tuple[float, float, float], least: float, least_structural: float, limit: int, condition: Column) -> DataFrame:
    """Scored pairs that hold all of the ``limit`` highest by ``score`` (at six digits) with at least ``least``.

    ``score`` weighs structural score, cosine and the rest by ``weights``. With many rows, pairs of a high score are
    tried first: those need a cosine of (score - other weights) / weight. A level that fills the report holds its best.
    """
    structural, vector, rest = weights
    passed = lambda pairs, at: pairs.where(condition & (F.round(score, 12) >= at) & (F.round("structural", 12) >= least_structural))
    for level in LEVELS if contexts.count() > MANY_ROWS else ():
        bound = (level - structural - rest) / vector
        if level > least and bound > 0:
            found = materialize(passed(context_pair_scores(contexts, frames, candidates=cosine_scores(contexts, bound)), level), "pairs")
            if found.where(F.round(score, 6) > level).count() >= limit:
                return found
    bound = (least - structural * UNSHARED[frames] - rest) / vector
    return passed(context_pair_scores(contexts, frames, least_structural, max(bound - 1e-9, 0.0)), least)


def synonyms(contexts: DataFrame, frames: bool = True, least_combined: float = 0.45, least_structural: float = 0.10, limit: int = 200) -> DataFrame:
    """The best pairs by combined score."""
    found = best_pairs(contexts, frames, "combined", (0.55, 0.45, 0.0), least_combined, least_structural, limit, F.lit(True))
    rows = found.select("l_norm", "r_norm", "l_name", "r_name", "support", *(F.round(c, 6).alias(f"{c}_score") for c in ("structural", "embedding", "combined")), *(_first_ten(c) for c in ("shared_predicates", "shared_children")))
    return rows.orderBy(F.desc("combined_score"), F.desc("structural_score"), F.desc("embedding_score"), F.desc("support"), "l_name", "r_name", "l_norm", "r_norm").limit(limit)


def context_bridges(contexts: DataFrame, frames: bool = True, least_bridge: float = 0.35, least_structural: float = 0.10, limit: int = 200) -> DataFrame:
    """The best pairs across components by bridge score."""
    apart = F.col("l_component_id").isNotNull() & F.col("r_component_id").isNotNull() & (F.col("l_component_id") != F.col("r_component_id"))
    found = best_pairs(contexts, frames, "bridge", (0.40, 0.40, 0.20), least_bridge, least_structural, limit, apart)
    shared = found.withColumn("shared_documents", F.array_sort(F.array_intersect("l_document_ids", "r_document_ids")))
    lists = ("l_document_ids", "r_document_ids", "shared_documents", "shared_predicates", "shared_children")
    rows = shared.select(
        "l_norm", "r_norm", "l_name", "r_name", "l_component_id", "r_component_id", "support", F.round("doc_separation", 6).alias("doc_separation"), *(F.round(c, 6).alias(f"{c}_score") for c in ("structural", "embedding", "combined", "bridge")), *(_first_ten(c) for c in lists))
    return rows.orderBy(F.desc("bridge_score"), F.desc("combined_score"), F.desc("structural_score"), F.desc("embedding_score"), F.desc("support"), "l_name", "r_name", "l_norm", "r_norm").limit(limit)


def entity_pair_scores(entities: DataFrame, least_combined: float = 0.45, least_structural: float = 0.10) -> DataFrame:
    """Pairs of entities that share a name token, with scores: an equi-join on tokens, so no pair is missed.

    ``entities``: norm, name, preds, neighbors (arrays), embedding.
    """
    known = entities.withColumn("tokens", F.array_distinct(tokens(F.col("name"))))
    flat = known.select("norm", F.explode("tokens").alias("token"))
    pairs = pairs_within(flat.withColumnRenamed("token", "item"))
    left, right = _sides(known)
    s = 0.45 * jaccard(F.col("l_preds"), F.col("r_preds")) + 0.35 * jaccard(F.col("l_neighbors"), F.col("r_neighbors")) + 0.20 * jaccard(F.col("l_tokens"), F.col("r_tokens"))
    scored = pairs.join(left, "l_norm").join(right, "r_norm").select("l_norm", "r_norm", s.alias("structural"), cosine(F.col("l_embedding"), F.col("r_embedding")).alias("embedding"))
    scored = scored.withColumn("combined", 0.60 * F.col("structural") + 0.40 * F.col("embedding"))
    return scored.where((F.round("combined", 12) >= least_combined) & (F.round("structural", 12) >= least_structural))


def cluster_root_names(members: DataFrame) -> DataFrame:
    """(component, root_name): tokens that all members' names share, in the order of the shortest name.

    ``members``: component, norm, name. Members without tokens count for nothing; no shared token, no row.
    """
    t = members.withColumn("tokens", tokens(F.col("name")))
    full = t.where(F.size("tokens") > 0)
    size = full.groupBy("component").agg(F.count("*").alias("n"))
    shared = full.select("component", F.explode(F.array_distinct("tokens")).alias("token")).groupBy("component", "token").agg(F.count("*").alias("k")).join(size, "component").where("k = n")
    common = shared.groupBy("component").agg(F.collect_set("token").alias("shared"))
    words = F.size(F.filter(F.split("name", " "), lambda w: w != ""))
    shortest = t.where(F.coalesce("name", F.lit("")) != "").groupBy("component").agg(F.min(F.struct(words.alias("w"), F.length("name").alias("l"), F.col("name"))).alias("s"))
    in_order = F.filter(tokens(F.col("s.name")), lambda x: F.array_contains("shared", x))
    by_size = F.transform(F.array_sort(F.transform("shared", lambda x: F.struct(F.length(x).alias("l"), x.alias("x")))), lambda p: p["x"])
    return common.join(shortest, "component").select("component", F.array_join(F.when(F.size(in_order) > 0, in_order).otherwise(by_size), " ").alias("root_name"))


def entity_clusters(entities: DataFrame, least_combined: float = 0.45, least_structural: float = 0.10, limit: int = 200) -> DataFrame:
    """Clusters of entities by pair score: a row per child of a cluster's root."""
    pairs = materialize(entity_pair_scores(entities, least_combined, least_structural), "pairs")
    members = materialize(star_components(pairs, "l_norm", "r_norm").select(F.col("node").alias("norm"), "component").join(entities.select("norm", "name"), "norm"), "clusters")
    score = pairs.join(members.select(F.col("norm").alias("l_norm"), "component"), "l_norm").groupBy("component").agg(F.round(F.avg("combined"), 6).alias("cluster_score"))
    names = members.groupBy("component").agg(F.count("*").alias("cluster_size"), F.array_join(F.slice(F.array_sort(F.collect_list("name")), 1, 5), ", ").alias("shared_examples"))
    root = cluster_root_names(members).where("root_name <> ''").withColumn("root_norm", normalize(F.col("root_name")))
    rows = members.join(root, "component").where("norm <> root_norm").join(score, "component").join(names, "component")
    return rows.select(F.col("norm").alias("child_norm"), F.col("name").alias("child_name"), "root_norm", "root_name", "cluster_size", "cluster_score", "shared_examples").orderBy(F.desc("cluster_score"), F.desc("cluster_size"), "root_name", "child_name").limit(limit)


def clusters_by_root(rows: DataFrame) -> DataFrame:
    """Cluster rows (a row per child) to one row per root: largest score and size, the children in order."""
    children = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("child_name"))), lambda x: x["child_name"]), ", ")
    return rows.groupBy("root_norm", "root_name").agg(F.max("cluster_score").alias("cluster_score"), F.max("cluster_size").alias("cluster_size"), F.count("*").alias("children_count"), children.alias("children"))


def _first(rows: DataFrame, order: list, limit: int) -> DataFrame:
    """The first ``limit`` stored rows in order; all of them without the one task that a limit ends in."""
    ordered = rows.orderBy(*order)
    return ordered if rows.count() <= limit else ordered.limit(limit)


def alias_candidates(vertices: DataFrame, least_support: int = 1, least_cosine: float = 0.82, limit: int = 1000) -> DataFrame:
    """Pairs of similar vertices, the canonical spelling first.

    ``vertices``: norm, name, support, embedding. The most supported ``limit`` vertices are compared, which the
    limit is for; pairs of equal norms are none. Pairs come from a cosine join; a threshold of 0 or less compares all.
    """
    kept = _first(materialize(vertices.where(F.col("support") >= least_support), "vertices"), [F.desc("support"), "norm"], limit)
    if least_cosine > 0:
        left, right = _sides(kept.drop("embedding"))
        pairs = cosine_scores(kept, least_cosine).join(left, "l_norm").join(right, "r_norm")
    else:
        left, right = _sides(kept)
        pairs = left.join(right, F.col("l_norm") < F.col("r_norm")).withColumn("cosine", cosine(F.col("l_embedding"), F.col("r_embedding")))
    scored = pairs.where(F.round("cosine", 12) >= least_cosine)
    best = shorter_variant(F.col("l_norm"), F.col("l_name"), F.col("r_norm"), F.col("r_name"))
    first = scored.withColumn("c", best)
    other = F.when(F.col("c.norm") == F.col("l_norm"), F.struct(F.col("r_norm").alias("norm"), F.col("r_name").alias("text"))).otherwise(F.struct(F.col("l_norm").alias("norm"), F.col("l_name").alias("text")))
    rows = first.withColumn("a", other).select(
        F.col("c.norm").alias("canonical_norm"), F.col("c.text").alias("canonical_name"), F.col("a.norm").alias("alias_norm"), F.col("a.text").alias("alias_text"), F.round("cosine", 6).alias("confidence"), F.greatest("l_support", "r_support", F.lit(1)).alias("support"), "l_name", "r_name", F.round("cosine", 12).alias("_c"))
    return _first(materialize(rows, "aliases"), [F.desc("_c"), F.desc("support"), "l_name", "r_name", "canonical_norm", "alias_norm"], limit).drop("_c", "l_name", "r_name")


#: Rows of a cell of the exact search: vectors, queries, and queries at once.
NEIGHBOUR_CELL, QUERY_CELL, QUERIES_AT_ONCE = 1 << 15, 1 << 13, 64


def _nearest(k: int):
    """applyInArrow body: the queries (side 1) and vectors (side 0) of a cell to each query's ``k`` nearest in it."""

    def run(table: pa.Table) -> pa.Table:
        side, lists = table.column("side").to_numpy(), table.column("embedding").combine_chunks()
        start, length = lists.offsets.to_numpy()[:-1], np.diff(lists.offsets.to_numpy())
        values = np.asarray(lists.values.to_numpy(zero_copy_only=False), np.float64)
        full = np.zeros((table.num_rows, max(1, int(length.max(initial=0)))))
        row = np.repeat(np.arange(table.num_rows), length)
        at = np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)
        full[row, at] = values[np.repeat(start, length) + at]
        size = np.sqrt((full * full).sum(1))
        ids = table.column("id").combine_chunks()
        rank = np.unique(ids.to_numpy(zero_copy_only=False), return_inverse=True)[1]
        mine, asked = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        n, found = min(k + 1, len(mine)), []
        for a in range(0, len(asked), QUERIES_AT_ONCE):
            q = asked[a : a + QUERIES_AT_ONCE]
            scale = size[q][:, None] * size[mine]
            cosine = np.divide(full[q] @ full[mine].T, scale, out=np.zeros(scale.shape), where=scale > 0)
            # Order by cosine at six digits, then id; a query itself comes last.
            order = np.floor(cosine * 1e6 + 0.5) * len(rank) - rank[mine]
            order[rank[q][:, None] == rank[mine]] = -np.inf
            best = np.argpartition(-order, n - 1, axis=1)[:, :n] if n else np.zeros((len(q), 0), np.int64)
            owner = np.repeat(np.arange(len(q)), n)
            keep = np.isfinite(order[owner, best.ravel()])
            found.append((q[owner[keep]], mine[best.ravel()[keep]], cosine[owner[keep], best.ravel()[keep]]))
        q, v, cosine = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (mine[:0], mine[:0], size[:0])
        return pa.table({"query_id": ids.take(pa.array(q)), "id": ids.take(pa.array(v)), "cosine": pa.array(cosine, pa.float64())})

    return run


def top_neighbours(vectors: DataFrame, queries: Column, k: int = 5) -> DataFrame:
    """The ``k`` most similar vectors of each query row (id, embedding); a query is not its own neighbour.

    Every query meets every vector, in cells of bounded size, each a matrix product that keeps the best of each query.
    """
    known = vectors.select("id", F.coalesce(F.transform("embedding", lambda x: F.coalesce(x.cast("double"), F.lit(0.0))), F.array().cast("array<double>")).alias("embedding"), F.coalesce(queries, F.lit(False)).alias("asks")).where("id is not null")
    rows, asked = known.agg(F.count("*"), F.count_if("asks")).first()
    across, down = max(1, -(-rows // NEIGHBOUR_CELL)), max(1, -(-asked // QUERY_CELL))
    deal = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    sides = known.select("id", "embedding", F.lit(0).alias("side"), deal(across).alias("i"), every(down).alias("j"))
    sides = sides.unionByName(known.where("asks").select("id", "embedding", F.lit(1).alias("side"), deal(down).alias("j"), every(across).alias("i")))
    kind = dict(vectors.dtypes)["id"]
    scored = sides.groupBy("i", "j").applyInArrow(_nearest(k), f"query_id {kind}, id {kind}, cosine double").withColumn("cosine", F.round("cosine", 6))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), "id"))).where(F.col("rank") <= k)
