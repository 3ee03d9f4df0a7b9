"""Catalogue of queries over the driver's tables, each with an equivalent SQL text where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import similarity, text
from ..operators import evaluate, frames, grammar, graph, mining, search, store, structure, tables
from ..session import materialize
from ..sources import interchange, readers
from .projections import CONTEXTS, ENTITIES, GEO, LINKS, MATRIX, SAID_WORDS, SUPPLY, TITLES, TRANSITIONS, contexts, entities, flow, geo, links, load, matrix, said_words, slots_sql, store_triplets, supply, titles, transitions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return register


# Tables to triplets


@query(f"""WITH {MATRIX}
    SELECT lower(trim(subject)) AS subject, count(*) AS triplets, count(DISTINCT predicate) AS predicates FROM matrix
    GROUP BY 1 ORDER BY predicates DESC, triplets DESC, subject LIMIT 20""")
def matrix_top_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matrix(spark, sf_dir).select(text.canonical(text.cell_text(F.col("subject"))).alias("subject"), "predicate")
    return m.groupBy("subject").agg(F.count("*").alias("triplets"), F.countDistinct("predicate").alias("predicates")).orderBy(F.desc("predicates"), F.desc("triplets"), "subject").limit(20)


@query(f"WITH {MATRIX} SELECT * FROM matrix")
def matrix_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix(spark, sf_dir)


def _raw_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``part`` as five raw tables with a header row each."""
    p = load(spark, sf_dir, "part")
    body = p.select(F.concat(F.lit("t"), (F.col("p_partkey") % 5).cast("string"), F.lit(".csv")).alias("table_file"), (F.col("p_partkey") + 2).alias("row_idx"), F.array("p_name", "p_brand", "p_type", F.col("p_size").cast("string")).alias("cells"))
    head = spark.range(5).select(F.concat(F.lit("t"), F.col("id").cast("string"), F.lit(".csv")).alias("table_file"), F.lit(1).cast("long").alias("row_idx"), F.array(*map(F.lit, ("name", "brand", "type", "size"))).alias("cells"))
    return head.unionByName(body)


_RAW = """raw AS (
  SELECT 't' || p_partkey % 5 || '.csv' AS table_file, 1 + row_number() OVER (PARTITION BY p_partkey % 5 ORDER BY p_partkey) AS row_idx, p_name, p_brand, p_type, CAST(p_size AS VARCHAR) AS p_size FROM part)"""


@query(f"""WITH {_RAW}
    SELECT table_file, row_idx, p_name AS subject, p_brand AS predicate, 'brand' AS object FROM raw
    UNION ALL SELECT table_file, row_idx, p_name, p_type, 'type' FROM raw
    UNION ALL SELECT table_file, row_idx, p_name, p_size, 'size' FROM raw""")
def ordinary_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table_triplets(_raw_parts(spark, sf_dir)).select("table_file", F.col("row_idx").cast("long").alias("row_idx"), "subject", "predicate", "object")


@query("""SELECT r_name AS subject, CAST(r_regionkey AS VARCHAR) AS predicate, '' AS object FROM region""")
def name_value_horizontal(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = load(spark, sf_dir, "region").agg(F.array_sort(F.collect_list(F.struct("r_regionkey", "r_name"))).alias("r"))
    rows = F.array(F.transform("r", lambda x: x["r_name"]), F.transform("r", lambda x: x["r_regionkey"].cast("string")))
    raw = r.select(F.lit("table 1.7.csv").alias("table_file"), F.posexplode(rows).alias("row_idx", "cells"))
    return tables.table_triplets(raw).select("subject", "predicate", "object")


@query("""SELECT n_name AS subject, CAST(n_nationkey AS VARCHAR) AS predicate, '' AS object FROM nation""")
def name_value_vertical(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = load(spark, sf_dir, "nation").select(F.lit("v.csv").alias("table_file"), F.col("n_nationkey").alias("row_idx"), F.array("n_name", F.col("n_nationkey").cast("string")).alias("cells"))
    return tables.vertical_triplets(raw).select("subject", "predicate", "object")


@query("""WITH d AS (SELECT conv_id, turn, last_value(CASE WHEN turn % 3 = 0 THEN role END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS top FROM conversations)
    SELECT CAST(conv_id AS VARCHAR) AS table_file, turn AS col_idx, concat_ws(' ', 'turn', top) AS name FROM d""")
def header_forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("table_file"), F.col("turn").alias("col_idx"), F.when(F.col("turn") % 3 == 0, F.col("role")).otherwise(F.concat(F.lit("Unnamed: "), F.col("turn").cast("string"))).alias("top"), F.lit("turn").alias("bottom"))
    return tables.flatten_header(d)


@query("""WITH d AS (SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN '' ELSE role END AS first, text FROM conversations),
    m AS (SELECT *, sum(CASE WHEN first <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM d)
    SELECT conv_id, min(turn) AS turn, arg_min(first, turn) AS first, sha256(string_agg(text, '' ORDER BY turn)) AS joined_sha256 FROM m GROUP BY conv_id, run""")
def row_continuation_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("role") == "assistant", "").otherwise(F.col("role")).alias("first"), "text")
    return tables.continue_rows(d, "turn", "turn", "first", ["text"], "conv_id").select("conv_id", "turn", "first", F.sha2("text", 256).alias("joined_sha256"))


@query(f"""WITH {MATRIX}, m AS (SELECT triplet_id, CASE triplet_id % 4 WHEN 0 THEN '-' WHEN 1 THEN ' NaN ' WHEN 2 THEN 'Unnamed: 3' ELSE predicate END AS cell FROM matrix)
    SELECT triplet_id, cell FROM m WHERE lower(trim(cell)) NOT IN ('', '-', '—', '–', 'null', 'nan', 'none', '.') AND NOT starts_with(lower(trim(cell)), 'unnamed')""")
def null_like_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("triplet_id") % 4
    m = matrix(spark, sf_dir).select("triplet_id", F.when(k == 0, "-").when(k == 1, " NaN ").when(k == 2, "Unnamed: 3").otherwise(F.col("predicate")).alias("cell"))
    return m.where(~text.null_like(F.col("cell")))


@query(f"""WITH {MATRIX} SELECT triplet_id, CASE WHEN regexp_full_match(predicate, '[0-9]+') THEN object || ' ' || predicate ELSE predicate END AS label FROM matrix""")
def numeric_label_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix(spark, sf_dir).select("triplet_id", text.prefix_numeric(F.col("predicate"), F.col("object")).alias("label"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 3 THEN p_type || ' 12' ELSE p_type || ' ' || p_size END AS label FROM part""")
def strip_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    base = F.concat("p_type", F.lit(" "), F.col("p_size").cast("string"))
    raw = F.when(k == 0, F.concat(base, F.lit(" мм"))).when(k == 1, F.concat(base, F.lit(", КГ/м3 "))).when(k == 2, F.concat(base, F.lit(", шт."))).otherwise(F.concat("p_type", F.lit(" 12%")))
    return load(spark, sf_dir, "part").select("p_partkey", text.strip_units(raw).alias("label"))


@query(f"""WITH {_RAW}, l AS (SELECT table_file, row_idx AS n, p_name || ';' || p_brand || ';' || p_type || ';' || p_size AS line FROM raw
      UNION ALL SELECT DISTINCT table_file, 1, 'name;brand;type;size' FROM raw)
    SELECT table_file, sha256(string_agg(line, chr(10) ORDER BY n)) AS prompt_sha256, sum(length(line))::BIGINT AS chars FROM l GROUP BY table_file""")
def prompt_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tables.prompt_tables(_raw_parts(spark, sf_dir))
    return p.select("table_file", F.sha2("prompt", 256).alias("prompt_sha256"), F.length(F.replace("prompt", F.lit("\n"), F.lit(""))).cast("long").alias("chars"))


@query(f"""WITH {_RAW}
    SELECT table_file, CASE WHEN regexp_full_match(p_name, '[0-9]+') THEN 'name ' || p_name ELSE p_name END AS subject, count(*) AS triplets FROM raw, (SELECT unnest([1, 2, 3])) GROUP BY 1, 2""")
def rule_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.extract_triplets(_raw_parts(spark, sf_dir)).groupBy("table_file", "subject").agg(F.count("*").alias("triplets"))


def _raw_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw tables of all shapes: a matrix of parts, headers of two rows over nations, two columns for each supplier,
    names over values for each customer, a comparison with a continued row for each order."""

    def rows(df: DataFrame, file, *lines) -> DataFrame:
        cells = F.array(*(F.array(*(c if not isinstance(c, str) else F.lit(c) for c in line)) for line in lines))
        return df.select(file.alias("table_file"), F.posexplode(cells).alias("row_idx", "cells")).withColumn("row_idx", F.col("row_idx").cast("long"))

    name = lambda mark, key: F.concat(F.lit(mark), F.col(key).cast("string"), F.lit(".csv"))
    word = lambda c: F.col(c).cast("string")
    nation, supplier, customer, orders = (load(spark, sf_dir, x) for x in ("nation", "supplier", "customer", "orders"))
    heads = rows(nation.select("n_regionkey").distinct(), name("n", "n_regionkey"), ("nation", "ids", ""), ("", "key", "region"))
    body = nation.select(name("n", "n_regionkey").alias("table_file"), (F.col("n_nationkey") + 2).cast("long").alias("row_idx"), F.array("n_name", word("n_nationkey"), word("n_regionkey")).alias("cells"))
    upright = rows(supplier, name("s", "s_suppkey"), ("nation", word("s_nationkey")), ("supplier", F.col("s_name")))
    level = rows(customer, name("c", "c_custkey"), ("key", "segment"), (word("c_custkey"), F.col("c_mktsegment")))
    compared = rows(
        orders, name("o", "o_orderkey"), ("order", "customer", "priority"), ("code", F.concat(word("o_custkey"), F.lit("-")), F.col("o_orderstatus")), ("", (F.col("o_custkey") + 1).cast("string"), F.col("o_orderpriority"))
    )
    parts = _raw_parts(spark, sf_dir)
    return parts.unionByName(heads).unionByName(body).unionByName(upright).unionByName(level).unionByName(compared)


@query(f"""WITH {_RAW},
    n AS (SELECT 'n' || n_regionkey || '.csv' AS table_file, 1 + row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS row_idx, n_name, n_nationkey, n_regionkey FROM nation)
    SELECT table_file, row_idx, col_idx, CASE WHEN regexp_full_match(p_name, '[0-9]+') THEN 'name ' || p_name ELSE p_name END AS subject,
      [p_brand, p_type, p_size][col_idx] AS predicate, ['brand', 'type', 'size'][col_idx] AS object FROM raw, (SELECT unnest([1, 2, 3]) AS col_idx)
    UNION ALL SELECT table_file, row_idx, col_idx, n_name, CAST([n_nationkey, n_regionkey][col_idx] AS VARCHAR), ['key ids', 'region ids'][col_idx] FROM n, (SELECT unnest([1, 2]) AS col_idx)
    UNION ALL SELECT 's' || s_suppkey || '.csv', 1, 1, 'nation', CAST(s_nationkey AS VARCHAR), '' FROM supplier
    UNION ALL SELECT 's' || s_suppkey || '.csv', 2, 1, 'supplier', s_name, '' FROM supplier
    UNION ALL SELECT 'c' || c_custkey || '.csv', 2, 0, 'key', CAST(c_custkey AS VARCHAR), '' FROM customer
    UNION ALL SELECT 'c' || c_custkey || '.csv', 2, 1, 'segment', c_mktsegment, '' FROM customer
    UNION ALL SELECT 'o' || o_orderkey || '.csv', 2, 1, 'code', o_custkey || '-' || (o_custkey + 1), 'customer' FROM orders
    UNION ALL SELECT 'o' || o_orderkey || '.csv', 2, 2, 'code', o_orderstatus || o_orderpriority, 'priority' FROM orders""")
def shape_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.extract_triplets(_raw_shapes(spark, sf_dir))


# Text functions


@query(r"""SELECT doc_id, sha256(trim(regexp_replace(lower(text), '[\t\n\v\f\r ]+', ' ', 'g'))) AS norm_sha256 FROM documents""")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", F.sha2(text.normalize(F.col("text")), 256).alias("norm_sha256"))


@query(r"""WITH n AS (SELECT doc_id, replace(trim(regexp_replace(lower(replace(replace(text, '"', ''), chr(65279), '')), '[\t\n\v\f\r ]+', ' ', 'g')), 'ё', 'е') AS t FROM documents)
    SELECT doc_id, sha256(regexp_replace(regexp_replace(t, '([0-9]),([0-9])', '\1.\2', 'g'), '([0-9]),([0-9])', '\1.\2', 'g')) AS canonical_sha256 FROM n""")
def canonical_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", F.sha2(text.canonical(F.col("text")), 256).alias("canonical_sha256"))


@query("""SELECT DISTINCT p_name, array_to_string(list_filter(regexp_extract_all(lower(p_name), '[0-9A-Za-zА-Яа-яЁё-]+'), lambda x: length(x) > 1), ',') AS tokens FROM part""")
def entity_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select("p_name", F.array_join(text.tokens(F.col("p_name")), ",").alias("tokens")).distinct()


@query("""WITH p AS (SELECT DISTINCT p_name, ' ' || lower(p_name) || ' ' AS t FROM part),
    g AS (SELECT p_name, substr(t, i, n) AS gram FROM p, (SELECT unnest([2, 3, 4]) AS n), (SELECT unnest(range(1, 200)) AS i) WHERE i + n - 1 <= length(t))
    SELECT p_name, gram, count(*) AS tf FROM g GROUP BY ALL""")
def char_ngrams_tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = load(spark, sf_dir, "part").select("p_name").distinct()
    return names.select("p_name", F.explode(text.char_ngrams(F.col("p_name"))).alias("gram")).groupBy("p_name", "gram").agg(F.count("*").alias("tf"))


@query("""SELECT sha256(text) AS content_hash, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY 1""")
def content_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))


@query("""SELECT event_id, CASE WHEN length(event_type || ' ' || props) > 12 THEN rtrim(left(event_type || ' ' || props, 11)) || '…' ELSE event_type || ' ' || props END AS label,
      replace(replace(props, '\\', '\\\\'), '"', '\\"') AS dot, upper(regexp_replace(event_type, '[^0-9A-Za-z_]', '_', 'g')) AS rel_type FROM events""")
def labels_and_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    return e.select("event_id", text.shorten(F.concat_ws(" ", "event_type", "props"), 12).alias("label"), text.escape_dot(F.col("props")).alias("dot"), text.relation_type(F.col("event_type")).alias("rel_type"))


ORACLES["labels_and_identifiers"] = ORACLES["labels_and_identifiers"].replace("\\\\", "\\")


# Store


@query(f"""WITH {MATRIX}, e AS (SELECT triplet_id, 0 AS side, subject AS name FROM matrix UNION ALL SELECT triplet_id, 1, object FROM matrix)
    SELECT lower(name) AS norm, arg_min(name, triplet_id * 2 + side) AS name FROM e GROUP BY 1""")
def first_writer_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.concept_nodes(store_triplets(spark, sf_dir))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("content_hash"))


@query("""WITH d AS (SELECT doc_id, source, sha256(text) AS content_hash FROM documents),
    o AS (SELECT content_hash, max(source) AS source_name FROM d WHERE doc_id % 3 <> 0 GROUP BY 1), f AS (SELECT content_hash, max(source || ' again') AS source_name FROM d WHERE doc_id % 2 = 0 GROUP BY 1),
    j AS (SELECT coalesce(f.content_hash, o.content_hash) AS content_hash, coalesce(f.source_name, o.source_name) AS source_name, o.content_hash IS NULL AS created FROM o FULL JOIN f ON o.content_hash = f.content_hash),
    t AS (SELECT count(*) AS top FROM o)
    SELECT content_hash, source_name, CASE WHEN created THEN top + row_number() OVER (PARTITION BY created ORDER BY content_hash) ELSE row_number() OVER (PARTITION BY created ORDER BY content_hash) END AS id
    FROM (SELECT * FROM j), t WHERE created
    UNION ALL SELECT j.content_hash, j.source_name, o2.rn FROM j JOIN (SELECT content_hash, row_number() OVER (ORDER BY content_hash) AS rn FROM o) o2 ON j.content_hash = o2.content_hash""")
def upsert_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _documents(spark, sf_dir)
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    empty = spark.createDataFrame([], store.SCHEMAS["documents"])
    stored = materialize(store.upsert_documents(empty, d.where("doc_id % 3 <> 0").select(F.col("source").alias("source_name"), "content_hash"), now), "stored")
    fresh = d.where("doc_id % 2 = 0").select(F.concat("source", F.lit(" again")).alias("source_name"), "content_hash")
    return store.upsert_documents(stored, fresh, now).select("content_hash", "source_name", "id")


def _matrix_store(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    t = store_triplets(spark, sf_dir)
    docs = t.select(F.col("document_id").alias("id")).distinct()
    instances = t.select(F.col("id"), F.col("id").alias("triplet_id"), F.lit("subject").alias("role"), F.col("subject_text").alias("root_text"), text.entity_name(F.col("subject_text")).alias("root_norm"))
    nodes = instances.select(F.col("id"), F.col("id").alias("frame_instance_id"), F.col("root_text").alias("node_text"))
    return store.empty_store(spark) | {"documents": docs, "triplets": t, "frame_instances": instances, "frame_nodes": nodes, "node_concept_links": nodes.select(F.col("id").alias("node_id"), F.lit(1).alias("concept_id"))}


@query(f"""WITH {MATRIX}, d AS (SELECT count(*) AS n FROM matrix WHERE document_id IN (1, 3))
    SELECT 'documents' AS table_name, 2::BIGINT AS deleted UNION ALL SELECT t, n FROM d, (SELECT unnest(['triplets', 'frame_instances', 'frame_nodes', 'node_concept_links']) AS t)
    UNION ALL SELECT unnest(['triplet_frames', 'concepts', 'concept_aliases']), 0""")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = _matrix_store(spark, sf_dir)
    after = store.cascade_delete(before, before["documents"].where("id in (1, 3)"))
    return store.deletion_counts(before, after)


@query(f"""WITH {MATRIX} SELECT 'documents' AS table_name, count(DISTINCT document_id) AS row_count FROM matrix
    UNION ALL SELECT unnest(['triplets', 'frame_instances', 'frame_nodes', 'node_concept_links']), (SELECT count(*) FROM matrix)
    UNION ALL SELECT unnest(['triplet_frames', 'concepts', 'concept_aliases']), 0""")
def store_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.table_counts(_matrix_store(spark, sf_dir))


@query("""WITH n AS (SELECT 's:' || s_suppkey AS node FROM supplier UNION ALL SELECT 'p:' || p_partkey FROM part),
    e AS (SELECT DISTINCT 's:' || l_suppkey AS src, 'p:' || l_partkey AS dst FROM lineitem WHERE l_quantity > 48)
    SELECT node FROM n WHERE node NOT IN (SELECT src FROM e) AND node NOT IN (SELECT dst FROM e)""")
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = load(spark, sf_dir, "supplier").select(F.concat(F.lit("s:"), F.col("s_suppkey").cast("string")).alias("node")).unionByName(load(spark, sf_dir, "part").select(F.concat(F.lit("p:"), F.col("p_partkey").cast("string")).alias("node")))
    line = load(spark, sf_dir, "lineitem").where("l_quantity > 48")
    edges = line.select(F.concat(F.lit("s:"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("p:"), F.col("l_partkey").cast("string")).alias("dst"))
    return store.orphans(nodes, edges)


def _aliases(spark: SparkSession, sf_dir: str, low: int, high: int) -> DataFrame:
    """Part names as aliases of their size: id, concept_id, alias_norm, confidence, status."""
    p = load(spark, sf_dir, "part").where(f"p_partkey % 10 between {low} and {high}")
    g = p.groupBy(F.col("p_size").cast("long").alias("concept_id"), F.col("p_name").alias("alias_norm")).agg(F.max(F.col("p_retailprice") / 4096).alias("confidence"), F.min("p_partkey").alias("id"))
    status = F.element_at(F.array(F.lit("candidate"), F.lit("approved"), F.lit("rejected")), (F.col("id") % 3 + 1).cast("int"))
    return g.select("id", "concept_id", F.col("alias_norm").alias("alias_text"), "alias_norm", F.lit("mined").alias("source"), "confidence", status.alias("status"), F.lit(None).cast("timestamp").alias("approved_at"), F.lit(None).cast("string").alias("review_note"))


def _alias_sql(name: str, low: int, high: int) -> str:
    return f"""{name} AS (SELECT CAST(p_size AS BIGINT) AS concept_id, p_name AS alias_norm, max(p_retailprice / 4096) AS confidence, min(p_partkey) AS id,
      ['candidate', 'approved', 'rejected'][min(p_partkey) % 3 + 1] AS status FROM part WHERE p_partkey % 10 BETWEEN {low} AND {high} GROUP BY 1, 2)"""


@query(f"""WITH {_alias_sql("o", 0, 5)}, {_alias_sql("f", 4, 9)}
    SELECT coalesce(o.concept_id, f.concept_id) AS concept_id, coalesce(o.alias_norm, f.alias_norm) AS alias_norm, greatest(coalesce(o.confidence, 0), coalesce(f.confidence, 0)) AS confidence, coalesce(o.status, f.status) AS status
    FROM o FULL JOIN f ON o.concept_id = f.concept_id AND o.alias_norm = f.alias_norm""")
def alias_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = store.upsert_aliases(_aliases(spark, sf_dir, 0, 5), _aliases(spark, sf_dir, 4, 9))
    return merged.select("concept_id", "alias_norm", "confidence", "status")


@query(f"""WITH {_alias_sql("a", 0, 9)}
    SELECT id, CASE WHEN id % 5 = 0 THEN 'approved' WHEN id % 5 = 1 THEN 'rejected' ELSE status END AS status, CASE WHEN id % 5 = 0 THEN 'manual_review' ELSE 'mined' END AS source,
      id % 5 = 0 AS has_time, CASE WHEN id % 5 = 0 THEN 'fine' END AS review_note FROM a""")
def alias_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _aliases(spark, sf_dir, 0, 9)
    concepts = spark.range(0, 51).select("id", F.lit("candidate").alias("concept_type"))
    decisions = a.where("id % 5 < 2").select("id", F.when(F.col("id") % 5 == 0, "approved").otherwise("rejected").alias("new_status"), F.when(F.col("id") % 5 == 0, " fine ").otherwise(" ").alias("note"))
    reviewed, _ = store.review_aliases(a, concepts, decisions, F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return reviewed.select("id", "status", "source", F.col("approved_at").isNotNull().alias("has_time"), "review_note")


@query(f"""WITH {_alias_sql("a", 0, 9)}, m AS (SELECT k AS source_id, k - 1 AS target_id FROM (SELECT unnest(range(2, 51, 2)) AS k)),
    x AS (SELECT coalesce(target_id, concept_id) AS concept_id, alias_norm, confidence, CASE WHEN target_id IS NOT NULL AND status = 'rejected' THEN 'candidate' ELSE status END AS status FROM a LEFT JOIN m ON concept_id = source_id
      UNION ALL SELECT target_id, 'size ' || source_id, 1.0, 'approved' FROM m)
    SELECT concept_id, alias_norm, max(confidence) AS confidence, ['rejected', 'candidate', 'approved'][max(CASE status WHEN 'approved' THEN 3 WHEN 'candidate' THEN 2 ELSE 1 END)] AS status FROM x GROUP BY 1, 2""")
def concept_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    concepts = spark.range(1, 51).select("id", F.concat(F.lit("size "), F.col("id").cast("string")).alias("canonical_name"), F.concat(F.lit("size "), F.col("id").cast("string")).alias("canonical_norm"), F.lit("").alias("concept_type"))
    merges = spark.range(2, 51, 2).select(F.col("id").alias("source_id"), (F.col("id") - 1).alias("target_id"))
    no_links = spark.createDataFrame([], "node_id long, concept_id long, link_type string, score double, method string")
    _, merged, _ = store.merge_concepts(concepts, _aliases(spark, sf_dir, 0, 9), no_links, merges, F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return merged.select("concept_id", "alias_norm", "confidence", "status")


# Search and aggregation


@query("""SELECT c_custkey AS id, count(o_orderkey) AS triplets_count FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1""")
def documents_with_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return search.documents_with_counts(docs, load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("document_id")))


@query(f"""WITH {_alias_sql("a", 0, 9)} SELECT k AS id, count(concept_id) AS alias_count, count(concept_id) FILTER (status = 'approved') AS approved_alias_count
    FROM (SELECT unnest(range(0, 60)) AS k) LEFT JOIN a ON k = concept_id GROUP BY 1""")
def concept_alias_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.concept_alias_counts(spark.range(0, 60), _aliases(spark, sf_dir, 0, 9))


@query(f"""WITH {_alias_sql("a", 0, 9)} SELECT id, status, confidence, 'size ' || concept_id AS canonical_name FROM a
    ORDER BY CASE status WHEN 'candidate' THEN 0 WHEN 'approved' THEN 1 ELSE 2 END, confidence DESC, canonical_name, alias_norm LIMIT 200""")
def alias_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    concepts = spark.range(0, 60).select("id", F.concat(F.lit("size "), F.col("id").cast("string")).alias("canonical_name"), F.lit("").alias("canonical_norm"))
    return search.alias_list(_aliases(spark, sf_dir, 0, 9), concepts).select("id", "status", "confidence", "canonical_name")


@query(f"""WITH {SUPPLY}, n AS (SELECT src AS norm FROM supply UNION SELECT dst FROM supply)
    SELECT norm, count(*) FILTER (side = 0) AS out_count, count(*) FILTER (side = 1) AS in_count, 0::BIGINT AS frame_count
    FROM n JOIN (SELECT src AS v, 0 AS side FROM supply UNION ALL SELECT dst, 1 FROM supply) ON v = norm GROUP BY 1""")
def concept_degree_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = supply(spark, sf_dir)
    return search.concept_options(graph.edge_nodes(e).withColumnRenamed("node", "norm"), e)


@query("""SELECT o_orderkey, o_orderpriority FROM orders WHERE (o_orderpriority ILIKE '%urgent%' OR o_orderstatus ILIKE '%urgent%') AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
    ORDER BY o_orderkey DESC LIMIT 100""")
def table_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    mine = load(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    o = load(spark, sf_dir, "orders").join(mine, "o_custkey", "left_semi")
    return search.browse(o, ["o_orderpriority", "o_orderstatus"], "urgent", "o_orderkey").select("o_orderkey", "o_orderpriority")


@query(f"""WITH {MATRIX} SELECT triplet_id AS id, subject AS subject_text, predicate AS predicate_text FROM matrix WHERE document_id = 2 AND (subject ILIKE '%bolt%' OR predicate ILIKE '%bolt%' OR object ILIKE '%bolt%') ORDER BY triplet_id DESC LIMIT 100""")
def browse_triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.browse_table(_matrix_store(spark, sf_dir), "triplets", "bolt", 2).select("id", "subject_text", "predicate_text")


@query(f"""WITH {MATRIX} SELECT triplet_id, subject, predicate, object FROM matrix WHERE subject ILIKE '%gear%' OR predicate ILIKE '%gear%' OR object ILIKE '%gear%' ORDER BY triplet_id LIMIT 200""")
def triplet_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = store_triplets(spark, sf_dir)
    return search.triplet_list(t, store.concept_nodes(t), "gear").select("triplet_id", "subject", "predicate", "object")


@query(f"""WITH {GEO} SELECT src, dst, 'in' AS predicate, 1::BIGINT AS triplet_id FROM geo UNION ALL SELECT 'n:' || n_nationkey, 'n:' || (n_nationkey + 1) % 25, 'MANUAL_CONTEXT_LINK', NULL FROM nation""")
def relations_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    relations = geo(spark, sf_dir).select("src", F.col("src").alias("src_name"), "dst", F.col("dst").alias("dst_name"), F.lit("in").alias("predicate"), F.lit("in").alias("predicate_norm"), F.lit(1).cast("long").alias("triplet_id"), F.lit(1).cast("long").alias("document_id"))
    n = load(spark, sf_dir, "nation")
    manual = n.select(F.concat(F.lit("n:"), F.col("n_nationkey").cast("string")).alias("src"), none.alias("src_name"), F.concat(F.lit("n:"), ((F.col("n_nationkey") + 1) % 25).cast("string")).alias("dst"), none.alias("dst_name"), none.alias("relation_text"), F.lit("MANUAL_CONTEXT_LINK").alias("type"))
    return search.analytic_relations(relations, manual).select("src", "dst", "predicate", "triplet_id")


@query(f"""WITH {GEO} SELECT src AS src_name, 'in' AS predicate, dst AS dst_name FROM geo WHERE src ILIKE '%n:1%' OR dst ILIKE '%n:1%' ORDER BY src, dst LIMIT 200""")
def entity_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    relations = geo(spark, sf_dir).select(F.col("src").alias("src_name"), F.lit("in").alias("predicate"), F.col("dst").alias("dst_name"), F.lit(1).cast("long").alias("triplet_id"), F.lit(1).cast("long").alias("document_id"))
    parents = spark.createDataFrame([], "child_name string, root_name string")
    return search.entity_relations(relations, parents, "n:1").select("src_name", "predicate", "dst_name")


@query(f"WITH {TRANSITIONS} SELECT src, dst, min(event_id) AS event_id FROM transitions GROUP BY 1, 2")
def edge_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.display_dedupe(transitions(spark, sf_dir), ["src", "dst"], "event_id")


@query(f"""WITH {MATRIX} SELECT document_id, count(DISTINCT triplet_id) AS triplets FROM matrix GROUP BY 1""")
def graph_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.graph_documents(store_triplets(spark, sf_dir))


# Interchange


def _link_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = links(spark, sf_dir)
    nodes = graph.edge_nodes(e).select(F.col("node").alias("id"), F.array(F.lit("Page")).alias("labels"), F.create_map(F.lit("name"), F.col("node")).alias("properties"))
    edges = e.select(F.concat_ws("->", "src", "dst").alias("id"), F.col("src").alias("source"), F.col("dst").alias("target"), F.lit("links to").alias("type"), F.create_map().cast("map<string,string>").alias("properties"))
    return nodes, edges


@query(f"""WITH {LINKS}, n AS (SELECT src AS id FROM links UNION SELECT dst FROM links), k AS (SELECT id FROM n WHERE contains(lower(id), 'th') ORDER BY id LIMIT 300)
    SELECT 'n' || (row_number() OVER (ORDER BY id) - 1) AS xml_id, id, id AS label FROM k""")
def graph_export_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _link_graph(spark, sf_dir)
    kept, _, _ = interchange.export_subgraph(nodes, edges, "th", 300)
    return interchange.graphml_nodes(kept).select("xml_id", "id", "label")


@query(f"""WITH {LINKS}, n AS (SELECT src AS id FROM links UNION SELECT dst FROM links), k AS (SELECT id FROM n ORDER BY id LIMIT 300),
    i AS (SELECT src || '->' || dst AS id FROM links WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k))
    SELECT (SELECT count(*) FROM k) AS node_count, (SELECT count(*) FROM i) AS edge_count, (SELECT count(*) FROM links) - (SELECT count(*) FROM i) AS skipped_edges_outside_node_limit""")
def graph_export_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _link_graph(spark, sf_dir)
    return interchange.export_subgraph(nodes, edges, "", 300, 10_000_000)[2].select("node_count", "edge_count", "skipped_edges_outside_node_limit")


@query(f"""WITH {LINKS}, n AS (SELECT src AS id FROM links UNION SELECT dst FROM links), k AS (SELECT id FROM n WHERE contains(lower(id), 'th') ORDER BY id LIMIT 50000),
    e AS (SELECT src || '->' || dst AS id, src AS source, dst AS target FROM links WHERE contains(lower(src), 'th') OR contains(lower(dst), 'th') ORDER BY 1 LIMIT 100)
    SELECT e.*, source IN (SELECT id FROM k) AND target IN (SELECT id FROM k) AS inside FROM e""")
def graph_export_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edge limit that bites: of the edges that hold the text, the first, and which of them the export has."""
    nodes, edges = _link_graph(spark, sf_dir)
    kept, inside, _ = interchange.export_subgraph(nodes, edges, "TH", edge_limit=100)
    held = edges.where(F.contains(F.lower("source"), F.lit("th")) | F.contains(F.lower("target"), F.lit("th"))).orderBy("id").limit(100)
    return held.join(inside.select("id", F.lit(True).alias("inside")), "id", "left").select("id", "source", "target", F.coalesce("inside", F.lit(False)).alias("inside"))


@query(f"""WITH {LINKS}, n AS (SELECT src AS id FROM links UNION SELECT dst FROM links)
    SELECT (SELECT count(*) FROM n) AS created_nodes, 0::BIGINT AS updated_nodes, (SELECT count(*) FROM links) AS created_edges, 0::BIGINT AS skipped_edges""")
def graph_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _link_graph(spark, sf_dir)
    return interchange.import_graph(nodes, edges, "Links")[2]


# Graph metrics


@query(f"""WITH {SUPPLY}, v AS (SELECT src AS node, 1 AS o, 0 AS i FROM supply UNION ALL SELECT dst, 0, 1 FROM supply)
    SELECT node, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree, count(*) AS total_degree FROM v GROUP BY 1""")
def degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(supply(spark, sf_dir))


@query(f"""WITH {SUPPLY}, v AS (SELECT src AS node, 1 AS o, 0 AS i FROM supply UNION ALL SELECT dst, 0, 1 FROM supply), d AS (SELECT node, sum(i) AS i, sum(o) AS o FROM v GROUP BY 1)
    SELECT count(*) AS nodes_count, sum(o)::BIGINT AS edges_count, max(i)::BIGINT AS max_in_degree, max(o)::BIGINT AS max_out_degree, round(avg(i), 4) AS avg_in_degree, round(avg(o), 4) AS avg_out_degree FROM d""")
def graph_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degree_metrics(supply(spark, sf_dir))


_PAGERANK = """nodes AS (SELECT src AS node FROM {e} UNION SELECT dst FROM {e}), n AS (SELECT count(*)::DOUBLE AS n FROM nodes), deg AS (SELECT src, count(*) AS d FROM {e} GROUP BY 1)"""


def _pagerank_sql(e: str, steps: int) -> str:
    out = [_PAGERANK.format(e=e), "r0 AS (SELECT node, 1.0 / n.n AS r FROM nodes, n)"]
    for k in range(steps):
        out.append(
            f"u{k} AS (SELECT nodes.node, 0.15 / max(n.n) + 0.85 * max(coalesce(l.s, 0)) / max(n.n) + coalesce(sum(0.85 * p.r / deg.d), 0) AS r FROM nodes CROSS JOIN n CROSS JOIN (SELECT sum(r) AS s FROM r{k} WHERE node NOT IN (SELECT src FROM deg)) l "
            f"LEFT JOIN {e} x ON x.dst = nodes.node LEFT JOIN r{k} p ON p.node = x.src LEFT JOIN deg ON deg.src = x.src GROUP BY nodes.node)")
        out.append(f"r{k + 1} AS MATERIALIZED (SELECT node, r / (SELECT sum(r) FROM u{k}) AS r FROM u{k})")
    return ", ".join(out)


@query(f"WITH {TRANSITIONS}, {_pagerank_sql('flow', 10)} SELECT node, round(r, 6) AS pagerank FROM r10")
def pagerank_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.pagerank(flow(spark, sf_dir), max_iter=10, tol=0).select("node", F.round("pagerank", 6).alias("pagerank"))


@query(f"WITH {GEO}, {_pagerank_sql('geo', 20)} SELECT node, round(r, 4) AS pagerank FROM r20")
def pagerank_converged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.pagerank(geo(spark, sf_dir)).select("node", F.round("pagerank", 4).alias("pagerank"))


_CLOSURE = """und AS (SELECT src AS a, dst AS b FROM {e} UNION SELECT dst, src FROM {e}),
walk AS (SELECT a AS node, a AS other FROM und UNION SELECT walk.node, und.b FROM walk JOIN und ON und.a = walk.other),
comp AS (SELECT node, min(other) AS component FROM walk GROUP BY 1),
reach AS (SELECT src AS start, dst AS node FROM {e} UNION SELECT reach.start, x.dst FROM reach JOIN {e} x ON x.src = reach.node)"""


@query(f"""WITH RECURSIVE {GEO}, {_CLOSURE.format(e='geo')} SELECT node, component FROM comp""")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.components(geo(spark, sf_dir))


@query(f"""WITH RECURSIVE {GEO}, {_CLOSURE.format(e='geo')}
    SELECT row_number() OVER (ORDER BY component) AS component_id, component, count(*) AS nodes_count, (SELECT count(*) FROM geo JOIN comp c2 ON c2.node = geo.src WHERE c2.component = comp.component) AS edges_count FROM comp GROUP BY component""")
def component_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.component_sizes(geo(spark, sf_dir))


_ROOTS = f"""{GEO}, {_CLOSURE.format(e='geo')}, zero AS (SELECT node, component FROM comp WHERE node NOT IN (SELECT dst FROM geo)),
ranked AS (SELECT z.component, z.node, (SELECT count(DISTINCT node) FROM reach WHERE start = z.node AND node <> z.node) AS descendants FROM zero z),
roots AS (SELECT component, arg_max(node, descendants) AS root_norm, max(descendants) AS root_descendants, count(*) AS zero_in_degree_nodes FROM ranked GROUP BY 1)"""


@query(f"WITH RECURSIVE {_ROOTS} SELECT component, root_norm, root_descendants, zero_in_degree_nodes FROM roots")
def component_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.component_roots(geo(spark, sf_dir)).select("component", "root_norm", "root_descendants", "zero_in_degree_nodes")


@query(f"""WITH RECURSIVE {_ROOTS} SELECT 'virtual' AS root_type, '__graph_root__' AS root_norm, count(*) AS components_count, string_agg(root_norm, ', ' ORDER BY component) AS children FROM roots""")
def global_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.global_root(graph.component_roots(geo(spark, sf_dir))).select("root_type", "root_norm", "components_count", "children")


@query(f"""WITH RECURSIVE {GEO}, {_CLOSURE.format(e='geo')} SELECT start, node FROM reach WHERE start <> node""")
def reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.reachable(geo(spark, sf_dir))


@query(f"""WITH RECURSIVE {TRANSITIONS}, reach AS (SELECT src AS start, dst AS node FROM flow UNION SELECT start, x.dst FROM reach JOIN flow x ON x.src = node)
    SELECT 'flow' AS graph, count(*) > 0 AS is_cyclic FROM reach WHERE start = node UNION ALL SELECT 'geo', false""")
def is_cyclic(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = lambda e, n: graph.is_cyclic(e).select(F.lit(n).alias("graph"), "is_cyclic")
    return named(flow(spark, sf_dir), "flow").unionByName(named(geo(spark, sf_dir), "geo"))


@query(f"""WITH RECURSIVE {TRANSITIONS}, p AS (SELECT src AS start, dst AS last, CASE WHEN src = dst THEN [src] ELSE [src, dst] END AS path, src = dst AS done FROM flow WHERE dst >= src
      UNION ALL SELECT p.start, x.dst, CASE WHEN x.dst = p.start THEN path ELSE list_append(path, x.dst) END, x.dst = p.start FROM p JOIN flow x ON x.src = p.last WHERE NOT p.done AND x.dst >= p.start AND (x.dst = p.start OR NOT list_contains(path, x.dst)))
    SELECT len(path) AS cycle_length, array_to_string(path, ' -> ') AS cycle_path FROM p WHERE done ORDER BY 1, 2 LIMIT 20""")
def simple_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.simple_cycles(flow(spark, sf_dir))


@query(f"WITH {GEO} SELECT least(src, dst) AS a, greatest(src, dst) AS b FROM geo")
def bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.bridge_edges(geo(spark, sf_dir))


@query(f"WITH {GEO}, v AS (SELECT src AS node FROM geo UNION ALL SELECT dst FROM geo) SELECT node FROM v GROUP BY 1 HAVING count(*) > 1")
def articulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.articulation_points(geo(spark, sf_dir))


_IMPACT = f"""{GEO}, und AS (SELECT src AS a, dst AS b FROM geo UNION SELECT dst, src FROM geo), nodes AS (SELECT DISTINCT a AS node FROM und),
walk AS (SELECT r.node AS gone, n.node, n.node AS other FROM nodes r, nodes n WHERE r.node <> n.node UNION SELECT w.gone, w.node, und.b FROM walk w JOIN und ON und.a = w.other WHERE und.b <> w.gone),
left_ AS (SELECT gone, node, min(other) AS c FROM walk GROUP BY 1, 2), after AS (SELECT gone, count(DISTINCT c) AS comps, max(size) AS largest FROM (SELECT gone, c, count(*) AS size FROM left_ GROUP BY 1, 2) GROUP BY 1),
bw AS (SELECT node, node AS other FROM nodes UNION SELECT bw.node, und.b FROM bw JOIN und ON und.a = bw.other), bc AS (SELECT node, min(other) AS c FROM bw GROUP BY 1),
base AS (SELECT count(DISTINCT c) AS comps, max(size) AS largest, (SELECT count(*) FROM nodes) AS n FROM (SELECT c, count(*) AS size FROM bc GROUP BY 1)), deg AS (SELECT a AS node, count(*) AS d FROM und GROUP BY 1),
impact AS (SELECT gone AS node, greatest(after.comps - base.comps, 0)::BIGINT AS component_gain, round((base.largest - after.largest) / base.largest::DOUBLE, 6) AS largest_component_loss, d AS total_degree,
  round(0.45 * least(greatest(after.comps - base.comps, 0) / base.comps::DOUBLE, 1.0) + 0.35 * ((base.largest - after.largest) / base.largest::DOUBLE) + 0.20 * least(d / (n - 1)::DOUBLE, 1.0), 6) AS impact_score
  FROM after JOIN deg ON deg.node = gone, base)"""


@query(f"WITH RECURSIVE {_IMPACT} SELECT * FROM impact")
def removal_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.removal_impact(geo(spark, sf_dir)).select("node", "component_gain", "largest_component_loss", "total_degree", "impact_score")


@query(f"WITH RECURSIVE {_IMPACT} SELECT * FROM impact")
def removal_impact_by_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = geo(spark, sf_dir)
    return structure.removal_impact(edges, found=structure.low_link(edges, task_edges=0)).select("node", "component_gain", "largest_component_loss", "total_degree", "impact_score")


@query(f"""WITH RECURSIVE {_IMPACT}, m AS (SELECT count(*) FILTER (d > 1) AS points, count(*) AS n FROM deg), t AS (SELECT max(impact_score) AS top, max(component_gain) AS gain, max(largest_component_loss) AS loss FROM impact)
    SELECT round(0.35 * (points / n::DOUBLE) + 0.25 * 1.0 + 0.40 * top, 6) AS fragility_score, points AS articulation_points_count, round(points / n::DOUBLE, 6) AS articulation_points_share, (SELECT count(*) FROM geo) AS bridge_edges_count,
      1.0::DOUBLE AS bridge_edges_share, gain AS max_component_gain, loss AS max_largest_component_loss FROM m, t""")
def fragility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.fragility(geo(spark, sf_dir))


@query("""SELECT 5::BIGINT AS components_before, 3::BIGINT AS components_after, 3::BIGINT AS bridge_edges_count, 2::BIGINT AS components_merged""")
def component_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates = spark.createDataFrame([("r:0", "r:1"), ("r:1", "r:2"), ("r:0", "r:2")], "src string, dst string")
    return graph.project_components(geo(spark, sf_dir), candidates)


# Similarity mining


@query(f"""WITH {CONTEXTS}
    SELECT norm, name, array_to_string(list_sort(preds_out), ',') AS out_preds, array_to_string(list_sort(preds_in), ',') AS in_preds, array_to_string(list_sort(child_terms), ',') AS children, occ_count, len(document_ids)::BIGINT AS documents FROM contexts""")
def concept_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    join = lambda c: F.array_join(c, ",")
    return contexts(spark, sf_dir).select("norm", "name", join("out_preds").alias("out_preds"), join("in_preds").alias("in_preds"), join("child_terms").alias("children"), "occ_count", F.size("document_ids").cast("long").alias("documents"))


@query(f"""WITH {MATRIX}, r AS (SELECT lower(subject) AS src, lower(object) AS dst, lower(predicate) AS p FROM matrix)
    SELECT norm, string_agg(DISTINCT o, ',' ORDER BY o) AS out_preds, string_agg(DISTINCT i, ',' ORDER BY i) AS in_preds
    FROM (SELECT src AS norm, p AS o, NULL AS i FROM r UNION ALL SELECT dst, NULL, p FROM r) GROUP BY 1""")
def relation_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mining.concept_contexts(store.relation_edges(store_triplets(spark, sf_dir)))
    join = lambda c: F.when(F.size(c) > 0, F.array_join(c, ","))
    return found.select("norm", join("out_preds").alias("out_preds"), join("in_preds").alias("in_preds"))


@query(f"""WITH {MATRIX}, r AS (SELECT lower(subject) AS src, subject AS src_name, lower(object) AS dst, object AS dst_name, predicate AS p FROM matrix)
    SELECT norm, string_agg(DISTINCT p, ',' ORDER BY p) AS preds, string_agg(DISTINCT n, ',' ORDER BY n) AS neighbors
    FROM (SELECT src AS norm, p, dst_name AS n FROM r UNION ALL SELECT dst, p, src_name FROM r) GROUP BY 1""")
def entity_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mining.entity_contexts(store.relation_edges(store_triplets(spark, sf_dir)))
    return found.select("norm", F.array_join("preds", ",").alias("preds"), F.array_join("neighbors", ",").alias("neighbors"))


@query(f"""WITH {CONTEXTS}
    SELECT norm, 'concept: ' || name || chr(10) || 'outgoing predicates: ' || array_to_string(list_sort(preds_out), ', ') || chr(10) || 'incoming predicates: ' || coalesce(nullif(array_to_string(list_sort(preds_in), ', '), ''), 'none')
      || chr(10) || 'frame children: ' || coalesce(nullif(array_to_string(list_sort(child_terms), ', '), ''), 'none') || chr(10) || 'occurrence count: ' || occ_count AS described FROM contexts""")
def context_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = contexts(spark, sf_dir)
    return c.select("norm", text.context_text(F.col("name"), F.col("norm"), F.col("out_preds"), F.col("in_preds"), F.col("child_terms"), F.col("occ_count")).alias("described"))


@query(f"""WITH {CONTEXTS}
    SELECT l_norm, r_norm, support, round(structural, 9) AS structural, round(embedding, 9) AS embedding, round(combined, 9) AS combined, round(bridge, 9) AS bridge, round(doc_separation, 9) AS doc_separation FROM ctx""")
def context_pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = mining.context_pair_scores(contexts(spark, sf_dir))
    return s.select("l_norm", "r_norm", "support", *(F.round(c, 9).alias(c) for c in ("structural", "embedding", "combined", "bridge", "doc_separation")))


@query(f"""WITH {CONTEXTS}
    SELECT l_norm, r_norm, support, round(combined, 6) AS combined_score FROM ctx WHERE round(combined, 12) >= 0.45 AND round(structural, 12) >= 0.3
    ORDER BY round(combined, 6) DESC, round(structural, 6) DESC, round(embedding, 6) DESC, support DESC, l_norm, r_norm LIMIT 200""")
def synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.synonyms(contexts(spark, sf_dir), least_structural=0.3).select("l_norm", "r_norm", "support", "combined_score")


@query(f"""WITH {CONTEXTS}
    SELECT l_norm, r_norm, l_component_id, r_component_id, round(bridge, 6) AS bridge_score FROM ctx WHERE l_component_id <> r_component_id AND round(bridge, 12) >= 0.35 AND round(structural, 12) >= 0.10
    ORDER BY round(bridge, 6) DESC, round(combined, 6) DESC, round(structural, 6) DESC, round(embedding, 6) DESC, support DESC, l_norm, r_norm LIMIT 200""")
def bridges_ctx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.context_bridges(contexts(spark, sf_dir)).select("l_norm", "r_norm", "l_component_id", "r_component_id", "bridge_score")


@query(f"""WITH {ENTITIES} SELECT l_norm, r_norm, round(structural, 6) AS structural, round(embedding, 6) AS embedding, round(combined, 6) AS combined FROM escored WHERE round(combined, 12) >= 0.45 AND round(structural, 12) >= 0.10""")
def entity_pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = mining.entity_pair_scores(entities(spark, sf_dir))
    return s.select("l_norm", "r_norm", *(F.round(c, 6).alias(c) for c in ("structural", "embedding", "combined")))


@query(f"""WITH RECURSIVE {ENTITIES}, e AS (SELECT l_norm AS a, r_norm AS b FROM escored WHERE round(combined, 12) >= 0.64 AND round(structural, 12) >= 0.10 UNION SELECT r_norm, l_norm FROM escored WHERE round(combined, 12) >= 0.64 AND round(structural, 12) >= 0.10),
    w AS (SELECT a AS node, a AS other FROM e UNION SELECT w.node, e.b FROM w JOIN e ON e.a = w.other) SELECT node, min(other) AS component FROM w GROUP BY 1""")
def legacy_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = mining.entity_pair_scores(entities(spark, sf_dir), 0.64)
    return mining.star_components(pairs, "l_norm", "r_norm")


@query("""WITH p AS (SELECT DISTINCT p_name, string_split(p_name, ' ')[2] AS root FROM part)
    SELECT root AS root_norm, count(*) AS children_count, string_agg(p_name, ', ' ORDER BY p_name) AS children FROM p GROUP BY 1""")
def clusters_by_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = load(spark, sf_dir, "part").select(F.col("p_name").alias("child_name"), F.get(F.split("p_name", " "), F.lit(1)).alias("root_norm")).distinct()
    rows = names.select("root_norm", F.col("root_norm").alias("root_name"), F.lit(0.5).alias("cluster_score"), F.lit(2).alias("cluster_size"), "child_name")
    return mining.clusters_by_root(rows).select("root_norm", "children_count", "children")


@query("""WITH p AS (SELECT DISTINCT p_name, string_split(p_name, ' ')[2] AS component FROM part) SELECT component, component AS root_name FROM p GROUP BY 1 HAVING count(*) > 1""")
def cluster_root_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = load(spark, sf_dir, "part").select(F.col("p_name").alias("norm"), F.col("p_name").alias("name"), F.get(F.split("p_name", " "), F.lit(1)).alias("component")).distinct()
    return mining.cluster_root_names(names)


@query("""WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 100 = 0),
    s AS (SELECT query_id, vec_id AS id, round(list_cosine_similarity(v, embedding::DOUBLE[]), 6) AS cosine FROM q, embeddings WHERE vec_id <> query_id)
    SELECT query_id, id, cosine, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, id) AS rank FROM s QUALIFY rank <= 5""")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return mining.top_neighbours(v, F.col("id") % 100 == 0).withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH {CONTEXTS}, v AS (SELECT norm, occ_count AS support, embedding FROM contexts ORDER BY occ_count DESC, norm LIMIT 1000),
    s AS (SELECT l.norm AS a, r.norm AS b, list_cosine_similarity(l.embedding, r.embedding) AS c, greatest(l.support, r.support, 1) AS support FROM v l JOIN v r ON l.norm < r.norm)
    SELECT CASE WHEN length(a) < length(b) OR (length(a) = length(b) AND a < b) THEN a ELSE b END AS canonical_norm, CASE WHEN length(a) < length(b) OR (length(a) = length(b) AND a < b) THEN b ELSE a END AS alias_norm, round(c, 6) AS confidence, support
    FROM s WHERE round(c, 12) >= 0.82 ORDER BY round(c, 12) DESC, support DESC, a, b LIMIT 1000""")
def alias_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = contexts(spark, sf_dir).select("norm", "name", F.col("occ_count").alias("support"), "embedding")
    return mining.alias_candidates(v).select("canonical_norm", "alias_norm", "confidence", "support")


@query()
def hashed_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = load(spark, sf_dir, "part").select("p_name").distinct()
    rows, _ = similarity.encode_texts(names, F.col("p_name"))
    return rows.select("p_name", F.round(similarity.norm(F.col("embedding")), 9).alias("norm"), F.size(F.filter("embedding", lambda x: x != 0)).alias("filled"))


# Evaluation


def _evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrix as table triplets; a third is stored, a third is held by relations, of the rest a frame holds some."""
    m = matrix(spark, sf_dir)
    table = m.select(F.col("triplet_id").alias("row_key"), F.concat("subject", F.lit(" "), F.col("triplet_id").cast("string")).alias("subject"), "predicate", "object", "triplet_id", "document_id")
    stored = table.where("triplet_id % 3 = 0").select(F.col("triplet_id").alias("id"), "document_id", F.upper("subject").alias("subject_text"), F.col("predicate").alias("predicate_text"), F.col("object").alias("object_text"))
    rel = table.where("triplet_id % 3 = 1").select(
        F.lower("subject").alias("src"), F.col("subject").alias("src_name"), F.col("object").alias("dst"), F.col("object").alias("dst_name"), F.col("predicate"), F.lower("predicate").alias("predicate_norm"), "triplet_id", "document_id")
    return evaluate.evaluate(table.select("row_key", "subject", "predicate", "object"), search.search_rows(stored), rel)


@query(f"""WITH {MATRIX} SELECT triplet_id AS row_key, CASE WHEN triplet_id % 3 = 2 THEN 'FN' ELSE 'TP' END AS status, CASE triplet_id % 3 WHEN 0 THEN 'direct_triplet' WHEN 1 THEN 'direct_relation' ELSE '' END AS match_type,
      CASE WHEN triplet_id % 3 < 2 THEN triplet_id END AS matched_triplet_id FROM matrix""")
def table_match_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluation(spark, sf_dir).select("row_key", "status", "match_type", "matched_triplet_id")


@query(f"""WITH {MATRIX} SELECT count(*) AS total, count(*) FILTER (triplet_id % 3 < 2) AS tp, count(*) FILTER (triplet_id % 3 = 2) AS fn, round(count(*) FILTER (triplet_id % 3 < 2) / count(*)::DOUBLE, 6) AS recall FROM matrix""")
def table_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.recall(_evaluation(spark, sf_dir))


# Frames, payloads and grammar


def _props_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as frames: the event type above its value and its properties."""
    e = load(spark, sf_dir, "events")
    leaf = lambda c: F.to_json(F.struct(c.alias("text")))
    tree = F.concat(F.lit('{"text":"'), "event_type", F.lit('","frame":['), leaf(F.col("value").cast("string")), F.lit(',{"text":"props","frame":['), leaf(F.get_json_object("props", "$.k")), F.lit("]}]}"))
    return e.select(F.col("event_id").alias("triplet_id"), F.lit("subject").alias("role"), F.parse_json(tree).alias("frame"))


@query("""SELECT event_id AS triplet_id, '0' AS path, NULL AS parent_path, 0 AS depth, event_type AS text FROM events
    UNION ALL SELECT event_id, '0.1', '0', 1, 'props' FROM events UNION ALL SELECT event_id, '0.1.0', '0.1', 2, props->>'$.k' FROM events""")
def frame_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.flatten(_props_frames(spark, sf_dir), ["triplet_id", "role"]).where("path <> '0.0'").select("triplet_id", "path", "parent_path", "depth", "text")


@query("""SELECT event_id AS triplet_id, 4::BIGINT AS nodes, true AS has_content FROM events""")
def frame_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.fold(frames.flatten(_props_frames(spark, sf_dir), ["triplet_id", "role"]), ["triplet_id", "role"]).select("triplet_id", "nodes", "has_content")


@query("""SELECT event_id AS triplet_id, '0.1' AS path, 'props' AS text, event_type AS parent_text FROM events UNION ALL SELECT event_id, '0.1.0', props->>'$.k', 'props' FROM events UNION ALL SELECT event_id, '0', event_type, NULL FROM events""")
def frame_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = frames.flatten(_props_frames(spark, sf_dir), ["triplet_id", "role"])
    return frames.frame_tree(nodes, ["triplet_id", "role"]).where("path <> '0.0'").select("triplet_id", "path", "text", "parent_text")


@query("""SELECT 'c' || conv_id AS source_name, turn + 1 AS row_idx, role AS subject_text, 'says' AS predicate_text, sha256(text) AS object_sha256 FROM conversations""")
def payload_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "conversations")
    item = F.struct(F.struct(F.col("role").alias("text")).alias("subject"), F.lit("says").alias("predicate"), F.col("text").alias("object"))
    docs = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", item.alias("t")))).alias("ts"))
    payload = docs.select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("source_name"), F.parse_json(F.to_json(F.struct(F.transform("ts", lambda x: x["t"]).alias("triplets")))).alias("payload"))
    return readers.payload_rows(readers.explode_payload(payload)).select("source_name", F.col("row_idx").cast("long").alias("row_idx"), "subject_text", "predicate_text", F.sha2("object_text", 256).alias("object_sha256"))


@query("""SELECT p_partkey AS sentence_id, string_split(p_name, ' ')[2] AS subject, 'weighs' AS predicate, p_brand AS object FROM part""")
def grammar_spo(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "part")
    none = F.create_map().cast("map<string,string>")
    word = lambda i, t, tag, head, rel: F.struct(F.lit(i).alias("id"), t.alias("text"), F.lower(t).alias("lemma"), F.lit(tag).alias("upos"), none.alias("feats"), F.lit(head).alias("head"), F.lit(rel).alias("deprel"))
    name = F.split("p_name", " ")
    tokens = p.select(F.col("p_partkey").alias("sentence_id"), F.inline(F.array(word(1, F.get(name, F.lit(0)), "ADJ", 2, "amod"), word(2, F.get(name, F.lit(1)), "NOUN", 3, "nsubj"), word(3, F.lit("weighs"), "VERB", 0, "root"), word(4, F.col("p_brand"), "PROPN", 3, "obj"))))
    return grammar.extract(tokens).select("sentence_id", "subject", "predicate", "object")


# Saving, concept links and views


def _part_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``part`` as one payload of triplets: the name as a frame above brand and type, a verb, and no object."""
    p = load(spark, sf_dir, "part")
    leaf = lambda c: F.to_json(F.struct(c.alias("text")))
    name = F.to_json(F.struct(F.col("p_name").alias("text")))
    tree = F.concat(F.left(name, F.length(name) - 1), F.lit(',"frame":['), leaf(F.col("p_brand")), F.lit(',{"text":"type","edge_label":"kind","frame":['), leaf(F.col("p_type")), F.lit("]}]}"))
    return p.select(F.lit("part").alias("source_name"), F.lit("p").alias("content_hash"), F.col("p_partkey").cast("int").alias("position"), F.parse_json(F.concat(F.lit('{"subject":'), tree, F.lit(',"predicate":"has","object":null}'))).alias("triplet"))


@query("""WITH n AS (SELECT p_partkey AS row_idx, 'subject' AS role, '0' AS path, NULL AS parent, 0 AS depth, p_name AS node_text, NULL AS edge_label FROM part
      UNION ALL SELECT p_partkey, 'subject', '0.0', '0', 1, p_brand, NULL FROM part UNION ALL SELECT p_partkey, 'subject', '0.1', '0', 1, 'type', 'kind' FROM part
      UNION ALL SELECT p_partkey, 'subject', '0.1.0', '0.1', 2, p_type, NULL FROM part UNION ALL SELECT p_partkey, 'predicate', '0', NULL, 0, 'has', NULL FROM part UNION ALL SELECT p_partkey, 'object', '0', NULL, 0, '', NULL FROM part)
    SELECT n.row_idx, n.role, n.path, n.depth, n.node_text, n.edge_label, q.node_text AS parent_text FROM n LEFT JOIN n q ON q.row_idx = n.row_idx AND q.role = n.role AND q.path = n.parent""")
def save_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = readers.payload_rows(_part_payload(spark, sf_dir))
    saved, _ = store.save_triplets(store.empty_store(spark), rows, F.lit("2024-01-01 00:00:00").cast("timestamp"), empty_frames=True)
    nodes, instances, triplets = saved["frame_nodes"], saved["frame_instances"], saved["triplets"]
    parents = nodes.select(F.col("id").alias("parent_node_id"), F.col("node_text").alias("parent_text"))
    placed = nodes.join(instances.select(F.col("id").alias("frame_instance_id"), "triplet_id", "role"), "frame_instance_id").join(triplets.select(F.col("id").alias("triplet_id"), "row_idx"), "triplet_id")
    return placed.join(parents, "parent_node_id", "left").select(F.col("row_idx").cast("long").alias("row_idx"), "role", "path", "depth", "node_text", "edge_label", "parent_text")


@query(f"""WITH {MATRIX}, t AS (SELECT *, triplet_id // 3 AS row_idx FROM matrix WHERE triplet_id % 2 = 0 OR triplet_id % 3 = 0)
    SELECT row_idx, object AS object_text, CASE WHEN triplet_id % 3 = 0 THEN 'new' ELSE 'old' END AS sentence_text, CASE WHEN triplet_id % 2 = 0 THEN triplet_id END AS kept_id FROM t""")
def upsert_triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = store_triplets(spark, sf_dir).withColumns({"row_idx": F.floor(F.col("id") / 3).cast("int"), "confidence": F.lit(None).cast("double"), "created_at": F.lit("2024-01-01 00:00:00").cast("timestamp")})
    stored = rows.where("id % 2 = 0").withColumn("sentence_text", F.lit("old")).select(*store.SCHEMAS["triplets"].names)
    fresh = rows.where("id % 3 = 0").withColumn("sentence_text", F.lit("new")).select(*store.KEYS["triplets"], "sentence_text")
    known = materialize(stored, "stored")
    merged = store.upsert_triplets(known, fresh, F.lit("2024-01-02 00:00:00").cast("timestamp"))
    top = known.agg(F.max("id")).first()[0]
    return merged.select(F.col("row_idx").cast("long").alias("row_idx"), "object_text", "sentence_text", F.when(F.col("id") <= top, F.col("id")).alias("kept_id"))


@query("""WITH s AS (SELECT DISTINCT p_name AS n, p_size % 2 = 0 AS even FROM part), k AS (SELECT n, bool_or(even) AS old, bool_or(NOT even) AS fresh FROM s GROUP BY 1)
    SELECT n AS canonical_norm, CASE WHEN fresh THEN upper(n) ELSE n END AS canonical_name, CASE WHEN old AND length(n) % 2 = 0 THEN 'approved' ELSE 'candidate' END AS concept_type FROM k""")
def ensure_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of even sizes are stored, some approved; those of odd sizes come, spelt in capitals."""
    p = load(spark, sf_dir, "part").select(F.col("p_name").alias("n"), (F.col("p_size") % 2).alias("odd")).distinct()
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    first = store.ensure_concepts(spark.createDataFrame([], store.SCHEMAS["concepts"]), p.where("odd = 0").select(F.col("n").alias("canonical_norm"), F.col("n").alias("canonical_name")), now)
    stored = materialize(first.withColumn("concept_type", F.when(F.length("canonical_norm") % 2 == 0, "approved").otherwise(F.col("concept_type"))), "concepts")
    fresh = p.where("odd = 1").select(F.col("n").alias("canonical_norm"), F.upper("n").alias("canonical_name"))
    return store.ensure_concepts(stored, fresh, now).select("canonical_norm", "canonical_name", "concept_type")


def _asked_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests to link each nation to its region, of all kinds, some to places that do not exist."""
    n = load(spark, sf_dir, "nation")
    kind = F.element_at(F.array(*map(F.lit, ("alias", "broader", "context", "odd"))), (F.col("n_nationkey") % 4 + 1).cast("int"))
    return n.select(F.concat(F.lit("n:"), F.col("n_nationkey").cast("string")).alias("src"), F.concat(F.lit("r:"), F.when(F.col("n_nationkey") % 6 == 5, F.lit("none")).otherwise(F.col("n_regionkey").cast("string"))).alias("dst"), kind.alias("kind"), F.lit("in").alias("relation_text"), F.col("n_name").alias("note"))


@query("""SELECT 'n:' || n_nationkey AS src, 'r:' || n_regionkey AS dst, ['APPROVED_ALIAS_OF', 'APPROVED_BROADER_THAN', 'APPROVED_CONTEXT_LINK', 'MANUAL_CONTEXT_LINK'][n_nationkey % 4 + 1] AS type, n_name AS note FROM nation WHERE n_nationkey % 6 <> 5""")
def approved_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.approved_links(_asked_links(spark, sf_dir), graph.edge_nodes(geo(spark, sf_dir)).withColumnRenamed("node", "norm")).select("src", "dst", "type", "note")


@query("""SELECT 'n:' || n_nationkey AS src_name, ['APPROVED_ALIAS_OF', 'APPROVED_BROADER_THAN', 'APPROVED_CONTEXT_LINK', 'MANUAL_CONTEXT_LINK'][n_nationkey % 4 + 1] AS type, n_name AS note FROM nation WHERE n_nationkey % 6 <> 5 AND concat_ws(' ', 'n:' || n_nationkey, 'r:' || n_regionkey, n_name) ILIKE '%1%' ORDER BY type, src_name LIMIT 200""")
def approved_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = store.approved_links(_asked_links(spark, sf_dir), graph.edge_nodes(geo(spark, sf_dir)).withColumnRenamed("node", "norm"))
    return search.approved_list(found.withColumns({"src_name": F.col("src"), "dst_name": F.col("dst")}), contains="1").select("src_name", "type", "note")


@query("""SELECT DISTINCT lower(string_split(p_name, ' ')[2]) AS src, lower(p_name) AS dst FROM part""")
def synonym_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second word of part names as the root of all names that end in it; the root itself and blanks are no children."""
    p = load(spark, sf_dir, "part").select("p_partkey", "p_name", F.get(F.split("p_name", " "), F.lit(1)).alias("root"))
    children = p.select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("name"), "root").unionByName(p.select(F.lit(-1).cast("long").alias("ord"), F.upper("root").alias("name"), "root")).unionByName(p.select(F.lit(-2).cast("long").alias("ord"), F.lit(" ").alias("name"), "root"))
    return store.synonym_component(F.col("root"), children).select("src", "dst")


@query(f"""WITH {GEO} SELECT src, dst, 'CONTEXT_BRIDGE' AS type FROM geo WHERE src LIKE 'r:%' UNION ALL SELECT dst, src, 'SYNONYM_CANDIDATE' FROM geo WHERE src LIKE 'n:%'""")
def rebuild_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = geo(spark, sf_dir)
    stored = g.withColumn("type", F.when(F.col("src").startswith("r:"), "CONTEXT_BRIDGE").otherwise("SYNONYM_CANDIDATE"))
    fresh = g.where("src like 'n:%'").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return store.rebuild_derived(stored, fresh, "SYNONYM_CANDIDATE")


@query(f"""WITH {MATRIX} SELECT triplet_id, lower(subject) AS src, predicate, lower(object) AS dst FROM matrix WHERE document_id = 3 AND subject ILIKE '%bolt%' ORDER BY triplet_id, src, dst LIMIT 200""")
def concept_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matrix(spark, sf_dir).select("triplet_id", "document_id", F.lower("subject").alias("src"), F.col("subject").alias("src_name"), "predicate", F.lower("object").alias("dst"), F.col("object").alias("dst_name"))
    return search.concept_relations(m, "BOLT", 3).select("triplet_id", "src", "predicate", "dst")


@query(f"""WITH {MATRIX} SELECT triplet_id, document_id, subject, predicate, object, '' AS sentence FROM matrix WHERE triplet_id = 31""")
def triplet_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.triplet_by_id(store_triplets(spark, sf_dir), 31)


@query("""SELECT 'bridge ' || round(s_acctbal, 2) AS label, s_name AS l_name FROM (SELECT s_name, s_suppkey, round(0.25 + s_suppkey % 40 / 80.0, 2) AS s_acctbal FROM supplier) WHERE s_name ILIKE '%1%' ORDER BY s_acctbal DESC, s_name LIMIT 200""")
def bridge_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = load(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("l_norm"), F.col("s_name").alias("l_name"), F.lit("r").alias("r_norm"), F.lit("r").alias("r_name"), F.lit("").alias("shared_predicates"), F.lit("").alias("shared_children"),
        F.round(0.25 + F.col("s_suppkey") % 40 / 80.0, 2).alias("bridge_score"), F.lit(0.5).alias("structural_score"), F.lit(0.5).alias("embedding_score"))
    return search.bridge_list(s, "1").select("label", "l_name")


@query("""SELECT conv_id, turn AS row_idx, role AS src, CASE WHEN turn % 2 = 0 THEN 'says' ELSE '∅' END AS label, CASE WHEN turn % 3 = 0 THEN '∅' ELSE 'x' END AS dst FROM conversations""")
def payload_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("row_idx"), F.col("role").alias("subject_text"), F.when(F.col("turn") % 2 == 0, "says").alias("predicate_text"), F.when(F.col("turn") % 3 == 0, "").otherwise("x").alias("object_text"))
    _, edges = search.payload_graph(rows)
    return edges.select("row_idx.conv_id", F.col("row_idx.turn").alias("row_idx"), "src", "label", "dst")


@query("""WITH e AS (SELECT 't' || event_id AS h, event_type, props->>'$.k' AS k FROM events)
    SELECT h AS src, h || ':subject' AS dst, 'subject' AS label, 'solid' AS style FROM e UNION ALL SELECT h, h || ':predicate', 'predicate', 'solid' FROM e UNION ALL SELECT h, h || ':object', 'object', 'solid' FROM e
    UNION ALL SELECT h || ':subject', h || ':subject:0', 'frame', 'dashed' FROM e UNION ALL SELECT h || ':subject:0', h || ':subject:0.0', 'child', 'solid' FROM e
    UNION ALL SELECT h || ':subject:0', h || ':subject:0.1', 'child', 'solid' FROM e UNION ALL SELECT h || ':subject:0.1', h || ':subject:0.1.0', 'child', 'solid' FROM e""")
def hub_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").select(F.col("event_id").alias("triplet_id"), F.col("event_type").alias("subject_text"), F.lit("p").alias("predicate_text"), F.lit("o").alias("object_text"))
    nodes = frames.flatten(_props_frames(spark, sf_dir), ["triplet_id", "role"])
    return search.hub_view(rows, nodes.select("triplet_id", "role", "parent_path", "path", "text")).select("src", "dst", "label", "style")


@query(f"""WITH {SUPPLY} SELECT src AS node, count(*) AS documents, min(CAST(substr(dst, 3) AS BIGINT)) AS first FROM supply GROUP BY 1
    UNION ALL SELECT dst, 1, CAST(substr(dst, 3) AS BIGINT) FROM (SELECT DISTINCT dst FROM supply)""")
def node_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rel = supply(spark, sf_dir).withColumn("document_id", F.substring("dst", 3, 20).cast("long"))
    found = graph.node_documents(rel)
    return found.select("node", F.size("document_ids").cast("long").alias("documents"), F.get("document_ids", F.lit(0)).alias("first"))


@query("""SELECT p_partkey AS triplet_id, list_sort(list_distinct([p_brand, p_type])) AS terms, p_partkey % 2 = 0 AS has_object FROM part""")
def search_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search rows carry the frame terms of each role."""
    p = load(spark, sf_dir, "part")
    triplets = p.select(F.col("p_partkey").alias("id"), F.lit(1).cast("long").alias("document_id"), F.col("p_name").alias("subject_text"), F.lit("p").alias("predicate_text"), F.lit("o").alias("object_text"))
    terms = p.select(F.col("p_partkey").alias("triplet_id"), F.lit("subject").alias("role"), F.explode(F.array("p_brand", "p_type", F.lit(""))).alias("term")).unionByName(p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("triplet_id"), F.lit("object").alias("role"), F.lit("x").alias("term")))
    rows = search.search_rows(triplets, terms)
    return rows.select("triplet_id", F.try_element_at("frame_terms", F.lit("subject")).alias("terms"), F.array_contains(F.map_keys("frame_terms"), "object").alias("has_object"))


@query("""SELECT p_partkey AS row_key, CASE p_partkey % 4 WHEN 0 THEN 'direct_triplet' WHEN 3 THEN '' ELSE 'frame_fallback' END AS match_type, CASE WHEN p_partkey % 4 < 3 THEN p_partkey END AS matched_triplet_id FROM part""")
def containment_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By key mod 4: equal; the stored subject holds the asked one; a frame term does; nothing does."""
    p = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.concat(F.lit("item-"), F.lpad(F.col("p_partkey").cast("string"), 9, "0"), F.lit("x")).alias("own"))
    kind = F.col("k") % 4
    table = p.select(F.col("k").alias("row_key"), "own", F.lit("is").alias("predicate"), F.lit("part").alias("object")).withColumnRenamed("own", "subject")
    stored = p.where(kind < 3).select(F.col("k").alias("id"), F.lit(1).cast("long").alias("document_id"), F.when(kind == 0, F.col("own")).when(kind == 1, F.concat(F.lit("the "), "own", F.lit(" of steel"))).otherwise(F.lit("?")).alias("subject_text"), F.lit("is").alias("predicate_text"), F.lit("part").alias("object_text"))
    terms = p.where(kind == 2).select(F.col("k").alias("triplet_id"), F.lit("subject").alias("role"), F.concat(F.lit("so-called "), "own").alias("term"))
    none = spark.createDataFrame([], "src string, src_name string, dst string, dst_name string, predicate string, predicate_norm string, triplet_id long, document_id long")
    return evaluate.evaluate(table, search.search_rows(stored, terms), none).select("row_key", "match_type", "matched_triplet_id")


# Rankers and export with the operators' own defaults


@query(f"""WITH {CONTEXTS}
    SELECT l_norm, r_norm, support, round(combined, 6) AS combined_score FROM ctx WHERE round(combined, 12) >= 0.45 AND round(structural, 12) >= 0.10
    ORDER BY round(combined, 6) DESC, round(structural, 6) DESC, round(embedding, 6) DESC, support DESC, l_norm, r_norm LIMIT 200""")
def synonyms_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.synonyms(contexts(spark, sf_dir)).select("l_norm", "r_norm", "support", "combined_score")


@query(f"""WITH RECURSIVE {ENTITIES}, e AS (SELECT l_norm AS a, r_norm AS b FROM escored WHERE round(combined, 12) >= 0.45 AND round(structural, 12) >= 0.10 UNION SELECT r_norm, l_norm FROM escored WHERE round(combined, 12) >= 0.45 AND round(structural, 12) >= 0.10),
    w AS (SELECT a AS node, a AS other FROM e UNION SELECT w.node, e.b FROM w JOIN e ON e.a = w.other) SELECT node, min(other) AS component FROM w GROUP BY 1""")
def legacy_clusters_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.star_components(mining.entity_pair_scores(entities(spark, sf_dir)), "l_norm", "r_norm")


@query(f"""WITH {LINKS}, n AS (SELECT src AS id FROM links UNION SELECT dst FROM links), k AS (SELECT id FROM n ORDER BY id LIMIT 50000)
    SELECT 'n' || (row_number() OVER (ORDER BY id) - 1) AS xml_id, id, id AS label FROM k""")
def graph_export_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _link_graph(spark, sf_dir)
    kept, _, _ = interchange.export_subgraph(nodes, edges)
    return interchange.graphml_nodes(kept).select("xml_id", "id", "label")


@query(f"""WITH RECURSIVE {LINKS}, b AS (SELECT src AS a, dst AS b FROM links UNION SELECT dst, src FROM links), w AS (SELECT a AS node, a AS other FROM b UNION SELECT w.node, b.b FROM w JOIN b ON b.a = w.other),
    m AS (SELECT node, min(other) AS component FROM w GROUP BY 1), s AS (SELECT src AS node, count(*) AS n FROM links WHERE src <> dst GROUP BY 1)
    SELECT component, max(n) AS root_descendants, count(*) AS zero_in_degree_nodes, max(size) AS nodes_count FROM s JOIN m USING (node) JOIN (SELECT component, count(*) AS size FROM m GROUP BY 1) USING (component) GROUP BY 1""")
def component_roots_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = links(spark, sf_dir)
    ranks = graph.edge_nodes(e).select("node", F.lit(0.0).alias("pagerank"))
    return graph.component_roots(e, ranks).select("component", "root_descendants", "zero_in_degree_nodes", "nodes_count")


# Mining on names that grow with the tables


@query(f"""WITH {SAID_WORDS}, {slots_sql("words")},
    s AS (SELECT l_norm AS a, r_norm AS b, cosine AS c FROM cosines WHERE round(cosine, 12) >= 0.82)
    SELECT CASE WHEN length(a) < length(b) OR (length(a) = length(b) AND a < b) THEN a ELSE b END AS canonical_norm, CASE WHEN length(a) < length(b) OR (length(a) = length(b) AND a < b) THEN b ELSE a END AS alias_norm, round(c, 6) AS confidence, greatest(x.support, y.support) AS support
    FROM s JOIN words x ON x.norm = a JOIN words y ON y.norm = b""")
def alias_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.alias_candidates(said_words(spark, sf_dir), limit=1 << 30).select("canonical_norm", "alias_norm", "confidence", "support")


@query(f"""WITH {TITLES}
    SELECT l_norm, r_norm, support, round(combined, 6) AS combined_score FROM titled WHERE round(combined, 12) >= 0.45 AND round(structural, 12) >= 0.10
    ORDER BY round(combined, 6) DESC, round(structural, 6) DESC, round(embedding, 6) DESC, support DESC, l_norm, r_norm LIMIT 200""")
def synonyms_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.synonyms(titles(spark, sf_dir)).select("l_norm", "r_norm", "support", "combined_score")


@query(f"""WITH {TITLES}
    SELECT l_norm, r_norm, round(bridge, 6) AS bridge_score FROM titled WHERE apart AND round(bridge, 12) >= 0.35 AND round(structural, 12) >= 0.10
    ORDER BY round(bridge, 6) DESC, round(combined, 6) DESC, round(structural, 6) DESC, round(embedding, 6) DESC, support DESC, l_norm, r_norm LIMIT 200""")
def bridges_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.context_bridges(titles(spark, sf_dir)).select("l_norm", "r_norm", "bridge_score")
