"""Projections of the driver's tables onto triplets, graphs and contexts, with the same projections as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.tables import unpivot_triplets
from ..session import materialize

PART_COLUMNS = ("p_brand", "p_type", "p_size")


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(triplet_id, document_id, subject, predicate, object): ``part`` unpivoted."""
    part = load(spark, sf_dir, "part").select("p_partkey", "p_name", *PART_COLUMNS)
    long = unpivot_triplets(part, "p_name", list(PART_COLUMNS), ["p_partkey"])
    column = F.array_position(F.array(*map(F.lit, PART_COLUMNS)), F.col("object")) - 1
    return long.select((F.col("p_partkey") * 3 + column).alias("triplet_id"), (F.col("p_partkey") % 7).alias("document_id"), "subject", "predicate", "object")


MATRIX = """matrix AS (
  SELECT p_partkey*3 AS triplet_id, p_partkey%7 AS document_id, p_name AS subject, p_brand AS predicate, 'p_brand' AS object FROM part
  UNION ALL SELECT p_partkey*3+1, p_partkey%7, p_name, p_type, 'p_type' FROM part
  UNION ALL SELECT p_partkey*3+2, p_partkey%7, p_name, CAST(p_size AS VARCHAR), 'p_size' FROM part)"""


def store_triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrix as rows of the store's triplet table."""
    m = matrix(spark, sf_dir)
    return m.select(F.col("triplet_id").alias("id"), "document_id", F.lit(1).alias("row_idx"), F.lit("rules").alias("extraction_stage"), F.col("subject").alias("subject_text"), F.col("predicate").alias("predicate_text"), F.col("object").alias("object_text"), F.lit(None).cast("string").alias("sentence_text"))


def geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges region to nation to supplier: a forest."""
    nation = load(spark, sf_dir, "nation").select(F.concat(F.lit("r:"), F.col("n_regionkey").cast("string")).alias("src"), F.concat(F.lit("n:"), F.col("n_nationkey").cast("string")).alias("dst"))
    supplier = load(spark, sf_dir, "supplier").select(F.concat(F.lit("n:"), F.col("s_nationkey").cast("string")).alias("src"), F.concat(F.lit("s:"), F.col("s_suppkey").cast("string")).alias("dst"))
    return nation.unionByName(supplier)


GEO = """geo AS (
  SELECT 'r:' || n_regionkey AS src, 'n:' || n_nationkey AS dst FROM nation
  UNION ALL SELECT 'n:' || s_nationkey, 's:' || s_suppkey FROM supplier)"""


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, event_id): consecutive event types of each user."""
    e = load(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(F.col("event_type").alias("src"), F.lead("event_type").over(w).alias("dst"), "event_id").where("dst is not null")


def flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transitions(spark, sf_dir).select("src", "dst").distinct()


TRANSITIONS = """transitions AS (
  SELECT * FROM (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst, event_id FROM events) WHERE dst IS NOT NULL),
flow AS (SELECT DISTINCT src, dst FROM transitions)"""


def supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct edges supplier to part."""
    line = load(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()
    return line.select(F.concat(F.lit("s:"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("p:"), F.col("l_partkey").cast("string")).alias("dst"))


SUPPLY = """supply AS (SELECT DISTINCT 's:' || l_suppkey AS src, 'p:' || l_partkey AS dst FROM lineitem)"""


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): distinct anchors of pages."""
    pages = load(spark, sf_dir, "pages").select("page_id", "html")
    target = F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1)))
    return pages.select(F.concat(F.lit("page:"), F.col("page_id").cast("string")).alias("src"), target.alias("dst")).distinct()


LINKS = """links AS (
  SELECT DISTINCT 'page:' || page_id AS src, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS dst FROM pages)"""
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def letter_vector(name: str) -> Column:
    """Counts of the letters of a name: a vector that SQL can compute too."""
    return F.array(*(F.length(name) - F.length(F.replace(F.col(name), F.lit(c), F.lit(""))) for c in LETTERS)).cast("array<double>")


def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One context per part name: brands as children, types and sizes as predicates."""
    p = load(spark, sf_dir, "part")
    g = p.groupBy(F.col("p_name").alias("norm")).agg(
        F.min("p_name").alias("name"), F.array_sort(F.collect_set("p_type")).alias("out_preds"), F.array_sort(F.collect_set(F.when(F.col("p_size") <= 10, F.col("p_size").cast("string")))).alias("in_preds"),
        F.array_sort(F.collect_set(F.when(F.col("p_size") > 25, F.col("p_brand")))).alias("child_terms"), F.count("*").alias("occ_count"), F.array_sort(F.collect_set(F.col("p_partkey") % 97)).alias("document_ids"))
    return g.withColumn("component_id", (F.length("norm") % 3).cast("long")).withColumn("embedding", letter_vector("name"))


CONTEXTS = f"""contexts AS (
  SELECT p_name AS norm, p_name AS name, list_distinct(list(p_type)) AS preds_out,
    coalesce(list_distinct(list(CAST(p_size AS VARCHAR)) FILTER (p_size <= 10)), []::VARCHAR[]) AS preds_in,
    coalesce(list_distinct(list(p_brand) FILTER (p_size > 25)), []::VARCHAR[]) AS child_terms,
    count(*) AS occ_count, list_distinct(list(p_partkey % 97)) AS document_ids, length(p_name) % 3 AS component_id,
    [{", ".join(f"length(p_name) - length(replace(p_name, '{c}', ''))" for c in LETTERS)}]::DOUBLE[] AS embedding
  FROM part GROUP BY p_name),
pairs AS (
  SELECT l.norm AS l_norm, r.norm AS r_norm, l.component_id AS l_component_id, r.component_id AS r_component_id,
    list_distinct(list_concat(l.preds_out, l.preds_in)) AS lp, list_distinct(list_concat(r.preds_out, r.preds_in)) AS rp,
    l.child_terms AS lc, r.child_terms AS rc, least(l.occ_count, r.occ_count) / greatest(l.occ_count, r.occ_count)::DOUBLE AS occ,
    l.document_ids AS ld, r.document_ids AS rd, list_cosine_similarity(l.embedding, r.embedding) AS embedding
  FROM contexts l JOIN contexts r ON l.norm < r.norm),
parts AS (
  SELECT *, len(list_intersect(lp, rp)) AS ip, len(list_intersect(lc, rc)) AS ic, len(list_intersect(ld, rd)) AS idoc FROM pairs),
scored AS (
  SELECT *, 0.45 * (CASE WHEN len(lp) + len(rp) = 0 THEN 0 ELSE ip::DOUBLE / (len(lp) + len(rp) - ip) END)
    + 0.45 * (CASE WHEN len(lc) + len(rc) = 0 THEN 0 ELSE ic::DOUBLE / (len(lc) + len(rc) - ic) END) + 0.10 * occ AS structural,
    1.0 - idoc::DOUBLE / (len(ld) + len(rd) - idoc) AS doc_separation, (ip + ic)::BIGINT AS support FROM parts),
ctx AS (
  SELECT *, 0.55 * structural + 0.45 * embedding AS combined, 0.40 * structural + 0.40 * embedding + 0.20 * doc_separation AS bridge FROM scored)"""


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as entities: types and small sizes as predicates, brands of small parts as neighbours."""
    p = load(spark, sf_dir, "part")
    g = p.groupBy(F.col("p_name").alias("norm")).agg(
        F.min("p_name").alias("name"), F.array_sort(F.collect_set(F.when(F.col("p_size") <= 10, F.col("p_type")))).alias("preds"), F.array_sort(F.collect_set(F.when(F.col("p_size") <= 10, F.col("p_brand")))).alias("neighbors"))
    return g.withColumn("embedding", letter_vector("name"))


ENTITIES = f"""entities AS (
  SELECT p_name AS norm, p_name AS name, string_split(p_name, ' ') AS tokens,
    coalesce(list_distinct(list(p_type) FILTER (p_size <= 10)), []::VARCHAR[]) AS preds,
    coalesce(list_distinct(list(p_brand) FILTER (p_size <= 10)), []::VARCHAR[]) AS near,
    [{", ".join(f"length(p_name) - length(replace(p_name, '{c}', ''))" for c in LETTERS)}]::DOUBLE[] AS embedding
  FROM part GROUP BY p_name),
epairs AS (
  SELECT l.norm AS l_norm, r.norm AS r_norm, list_cosine_similarity(l.embedding, r.embedding) AS embedding,
    0.45 * (CASE WHEN len(l.preds) + len(r.preds) = 0 THEN 0 ELSE len(list_intersect(l.preds, r.preds))::DOUBLE / (len(l.preds) + len(r.preds) - len(list_intersect(l.preds, r.preds))) END)
    + 0.35 * (CASE WHEN len(l.near) + len(r.near) = 0 THEN 0 ELSE len(list_intersect(l.near, r.near))::DOUBLE / (len(l.near) + len(r.near) - len(list_intersect(l.near, r.near))) END)
    + 0.20 * (len(list_intersect(l.tokens, r.tokens))::DOUBLE / (len(l.tokens) + len(r.tokens) - len(list_intersect(l.tokens, r.tokens)))) AS structural
  FROM entities l JOIN entities r ON l.norm < r.norm AND list_has_any(l.tokens, r.tokens)),
escored AS (SELECT *, 0.60 * structural + 0.40 * embedding AS combined FROM epairs)"""


SLOTS = 768


def pair_slots(name: str) -> Column:
    padded = F.concat(F.lit(" "), F.col(name), F.lit(" "))
    code = lambda i: F.ascii(F.substring(padded, i, F.lit(1)))
    return F.transform(F.sequence(F.lit(1), F.length(padded) - 1), lambda i: (code(i) * 31 + code(i + 1)) % SLOTS)


def with_vectors(rows: DataFrame) -> DataFrame:
    """Adds ``embedding``: counts of the norm's letter pairs, hashed to 768 slots, a sparse vector that SQL can compute too.

    Slots and counts are stored on the way: inside a lambda their expressions would be computed for every slot.
    """
    counted = materialize(rows.withColumn("_slots", pair_slots("norm")), "slots")
    once = F.array_distinct("_slots")
    counted = materialize(counted.withColumn("_counts", F.map_from_arrays(once, F.transform(once, lambda k: F.size(F.filter("_slots", lambda s: s == k)).cast("double")))), "slots")
    return counted.withColumn("embedding", F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda k: F.coalesce(F.element_at("_counts", k), F.lit(0.0)))).drop("_slots", "_counts")


def slots_sql(names: str) -> str:
    """CTEs over a table (norm): its slots with counts, and cosines of pairs that share a slot."""
    return f"""grams AS (SELECT norm, (unicode(substr(p, i, 1)) * 31 + unicode(substr(p, i + 1, 1))) % {SLOTS} AS slot, count(*) AS c
    FROM (SELECT norm, ' ' || norm || ' ' AS p, unnest(range(1, length(norm) + 2)) AS i FROM {names}) GROUP BY 1, 2),
  lengths AS (SELECT norm, sqrt(sum(c * c)) AS len FROM grams GROUP BY 1),
  cosines AS (SELECT a.norm AS l_norm, b.norm AS r_norm, sum(a.c * b.c) / (any_value(x.len) * any_value(y.len)) AS cosine
    FROM grams a JOIN grams b ON a.slot = b.slot AND a.norm < b.norm JOIN lengths x ON x.norm = a.norm JOIN lengths y ON y.norm = b.norm GROUP BY 1, 2)"""


def said_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(norm, name, support, embedding): the words of all conversations."""
    words = load(spark, sf_dir, "conversations").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-zà-ÿ]+"), F.lit(0))).alias("norm"))
    return with_vectors(words.groupBy("norm").agg(F.count("*").alias("support")).select("norm", F.col("norm").alias("name"), "support"))


SAID_WORDS = """words AS (SELECT norm, count(*) AS support FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-zà-ÿ]+')) AS norm FROM conversations) GROUP BY 1)"""


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One context per page title: anchors as predicates, words of the title as children."""
    one = load(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("norm"), F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1)).alias("out"))
    g = one.where("norm <> ''").groupBy("norm").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("out")))).alias("out_preds"), F.count("*").alias("occ_count"), F.array_sort(F.collect_set("page_id")).alias("document_ids"))
    return with_vectors(g.select(
        "norm", F.col("norm").alias("name"), "out_preds", F.array().cast("array<string>").alias("in_preds"), F.array_sort(F.array_distinct(F.split("norm", " "))).alias("child_terms"), "occ_count", "document_ids",
        (F.length("norm") % 3).cast("long").alias("component_id")))


TITLES = f"""pg AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS norm, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS o FROM pages),
  titles AS (SELECT norm, list_distinct(flatten(list(o))) AS p, list_distinct(string_split(norm, ' ')) AS c, count(*) AS occ, length(norm) % 3 AS comp, list_distinct(list(page_id)) AS d FROM pg WHERE norm <> '' GROUP BY 1),
  {slots_sql("titles")},
  tp AS (SELECT l.norm AS l_norm, r.norm AS r_norm, l.comp <> r.comp AS apart, len(list_intersect(l.p, r.p)) AS ip, len(l.p) + len(r.p) AS sp, len(list_intersect(l.c, r.c)) AS ic, len(l.c) + len(r.c) AS sc,
    least(l.occ, r.occ)::DOUBLE / greatest(l.occ, r.occ) AS occ, len(list_intersect(l.d, r.d)) AS shared, len(l.d) + len(r.d) AS sd FROM titles l JOIN titles r ON l.norm < r.norm),
  ts AS (SELECT tp.l_norm, tp.r_norm, apart, (ip + ic)::BIGINT AS support, coalesce(cosine, 0) AS embedding, 1.0 - shared::DOUBLE / (sd - shared) AS doc_separation,
    0.45 * (CASE WHEN sp = 0 THEN 0 ELSE ip::DOUBLE / (sp - ip) END) + 0.45 * (CASE WHEN sc = 0 THEN 0 ELSE ic::DOUBLE / (sc - ic) END) + 0.10 * occ AS structural FROM tp LEFT JOIN cosines USING (l_norm, r_norm)),
  titled AS (SELECT *, 0.55 * structural + 0.45 * embedding AS combined, 0.40 * structural + 0.40 * embedding + 0.20 * doc_separation AS bridge FROM ts)"""
