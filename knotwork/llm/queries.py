"""The queries of this subpackage: thin wrappers that apply an operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written
from . import bpe, chat_format, decontaminate, language_id, lexical_search, media, merkle, mixing, secret_scan, simhash, suffix_dedup, token_count, toxicity
from .common import read


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.find_contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), near=decontaminate.NEAR))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(read(spark, sf_dir, "documents")))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(read(spark, sf_dir, "documents"))


def op4_token_count(spark: SparkSession, sf_dir: str, model: str = "piece_bpe_32k.model") -> DataFrame:
    return token_count.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path(model))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return media.fingerprint_takes(vectors).withColumnRenamed("id", "vec_id")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text")
    )
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat_format.digest(chat_format.format_conversations(rows))


def op7_bpe(spark: SparkSession, sf_dir: str, tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    return bpe.round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path(tokenizer))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.dedup(read(spark, sf_dir, "documents")))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(read(spark, sf_dir, "documents")))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(lambda: mixing.digest(mixing.mix(read(spark, sf_dir, "documents"))), "mixed")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(lambda: lexical_search.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")), "ranked")


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return written(lambda: merkle.digest(merkle.verify(docs, merkle.tampered(docs))), "verified")


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_simhash": op2_simhash,
    "op3_language_id": op3_language_id,
    "op4_token_count": op4_token_count,
    "op5_media": op5_media,
    "op6_chat_format": op6_chat_format,
    "op7_bpe": op7_bpe,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_secret_scan": op9_secret_scan,
    "op10_toxicity": op10_toxicity,
    "op11_mixing": op11_mixing,
    "op12_lexical_search": op12_lexical_search,
    "op13_merkle": op13_merkle,
}

_WORDS = r"coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []::VARCHAR[])"

NEAR = decontaminate.NEAR


def _merkle_sql(depth: int = 5, upper: int = 3) -> str:
    """SQL of op13 for up to 16**depth documents of a source and 16**upper sources: a step per level."""
    field = lambda c: f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || {c}, '-')"
    leaf = lambda text: "sha256(" + " || ".join([*map(field, ("doc_id", "source", "lang", "n_chars")), field(text)]) + ")"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    ctes = [
        "tab AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY i) AS tab FROM (SELECT unnest(range(0, 256)) AS i))",
        "crc AS (SELECT doc_id, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) AS crc FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL), tab)",
        f"lv AS (SELECT doc_id, source, {leaf('text')} AS leaf, CASE WHEN crc % 5 = 0 THEN {leaf(low)} ELSE {leaf('text')} END AS bent FROM documents LEFT JOIN crc USING (doc_id))",
        "d AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, dense_rank() OVER (ORDER BY source IS NOT NULL, source) - 1 AS s FROM lv)",
        "n0 AS (SELECT s, p, leaf AS h FROM d)",
    ]
    for k in range(depth):
        ctes += [f"r{k} AS (SELECT s, p // 16 AS p, list(h ORDER BY p) AS run, max(c) AS c FROM (SELECT *, count(*) OVER (PARTITION BY s) AS c FROM n{k}) GROUP BY 1, 2)"]
        ctes += [f"n{k + 1} AS (SELECT s, p, CASE WHEN c = 1 THEN run[1] ELSE sha256(array_to_string(run, '')) END AS h FROM r{k})"]
    ctes += [f"u0 AS (SELECT 0 AS s, s AS p, h FROM n{depth})"]
    for k in range(upper):
        ctes += [f"q{k} AS (SELECT s, p // 16 AS p, list(h ORDER BY p) AS run, max(c) AS c FROM (SELECT *, count(*) OVER () AS c FROM u{k}) GROUP BY 1, 2)"]
        ctes += [f"u{k + 1} AS (SELECT s, p, CASE WHEN c = 1 THEN run[1] ELSE sha256(array_to_string(run, '')) END AS h FROM q{k})"]
    ctes += ["f0 AS (SELECT doc_id, leaf, s, p, p AS at, bent AS fold, '' AS seen FROM d)"]
    steps = [(f"r{k}", "t.s = f.s", "f.at") for k in range(depth)] + [(f"q{k}", "true", "f.at") for k in range(upper)]
    for k, (table, on, at) in enumerate(steps):
        start = "f.s" if k == depth else at  # from its source's subroot on, a row's place is the source's
        left, right = f"array_to_string(run[1:{start} % 16], '')", f"array_to_string(run[{start} % 16 + 2:], '')"
        ctes += [f"f{k + 1} AS (SELECT doc_id, leaf, f.s, f.p, {start} // 16 AS at, CASE WHEN c = 1 THEN fold ELSE sha256({left} || fold || {right}) END AS fold, CASE WHEN c = 1 THEN seen ELSE seen || {left} || {right} END AS seen FROM f{k} f JOIN {table} t ON {on} AND t.p = {start} // 16)"]
    return f"WITH {', '.join(ctes)} SELECT doc_id, leaf, n.h AS subroot, u.h AS root, sha256(seen) AS proof_sha256, fold AS folded_root, fold = u.h AS verified FROM f{len(steps)} f JOIN n{depth} n USING (s) CROSS JOIN u{upper} u"


ORACLES: dict[str, str] = {
    "op1_decontaminate": f"""
        WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
        win AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(list_slice(w, a, a + 9), ' ') AS k
          FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS a FROM b WHERE len(w) > 0)),
        dw AS (SELECT doc_id, a, n, array_to_string(list_slice(w, a, a + n - 1), ' ') AS k
          FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS a FROM w, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
        hit AS (SELECT doc_id, a, n, item FROM dw JOIN win USING (n, k)),
        h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(a, a + n)) AS p FROM (SELECT DISTINCT doc_id, a, n FROM hit)) GROUP BY 1),
        i AS (SELECT doc_id, count(DISTINCT item) AS n_items, sha256(string_agg(DISTINCT item, ',' ORDER BY item)) AS s FROM hit GROUP BY 1),
        tok AS (SELECT doc_id, p, w[p] AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM w)),
        df AS (SELECT t, count(DISTINCT doc_id) AS df FROM tok GROUP BY 1),
        k AS (SELECT DISTINCT k, n, string_split(k, ' ') AS v FROM win),
        r AS (SELECT k, t, least(n, {NEAR[0]}) AS need, row_number() OVER (PARTITION BY k ORDER BY df, o) AS rk FROM (SELECT k, n, o, v[o] AS t FROM (SELECT k, n, v, unnest(range(1, n + 1)) AS o FROM k)) JOIN df USING (t)),
        lead AS (SELECT r.k, need, doc_id, p FROM r JOIN tok USING (t) WHERE rk = 1),
        near AS (SELECT f.k, f.doc_id, f.p FROM lead f LEFT JOIN r ON r.k = f.k AND rk BETWEEN 2 AND f.need LEFT JOIN tok ON tok.doc_id = f.doc_id AND tok.t = r.t AND tok.p BETWEEN f.p - {NEAR[1]} AND f.p + {NEAR[1]}
          GROUP BY 1, 2, 3, f.need HAVING count(DISTINCT rk) FILTER (tok.p IS NOT NULL) = f.need - 1),
        c AS (SELECT doc_id, count(DISTINCT item) AS n_near FROM near JOIN win USING (k) GROUP BY 1)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(s, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated, coalesce(n_near, 0) AS n_near
        FROM w LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id) LEFT JOIN c USING (doc_id)
    """,
    "op8_suffix_dedup": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        w AS (SELECT doc_id, a, md5(substr(h, 2 * a + 1, 200)) AS k FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS a FROM d WHERE length(h) >= 200)),
        r AS (SELECT doc_id, a FROM w QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, a) > 1),
        b AS (SELECT doc_id, p, substr(h, 2 * p + 1, 2) AS x FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2)) AS p FROM d)),
        g AS (SELECT b.doc_id, p, x, count(r.a) OVER (PARTITION BY b.doc_id ORDER BY p ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) > 0 AS gone FROM b LEFT JOIN r ON r.doc_id = b.doc_id AND r.a = b.p),
        e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS first FROM g),
        o AS (SELECT doc_id, count(*) AS n_bytes, count(*) FILTER (gone) AS n_removed, count(*) FILTER (first) AS n_spans, sha256(unhex(coalesce(string_agg(x, '' ORDER BY p) FILTER (NOT gone), ''))) AS s FROM e GROUP BY 1)
        SELECT doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, coalesce(s, sha256('')) AS kept_sha256 FROM documents LEFT JOIN o USING (doc_id)
    """,
    "op12_lexical_search": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
        t AS (SELECT r, doc_id, unnest(w) AS t FROM d),
        tf AS (SELECT r, doc_id, t, count(*) AS tf FROM t GROUP BY ALL),
        n AS (SELECT r, sum(tf)::BIGINT AS n FROM tf GROUP BY 1),
        g AS (SELECT count(*) AS cn, sum(n)::BIGINT AS cl FROM n),
        df AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * max(cn) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf, g GROUP BY 1),
        b AS (SELECT row_number() OVER () AS q, item_id, {_WORDS} AS w FROM benchmark),
        a AS (SELECT q, item_id, t, count(*) AS c FROM (SELECT q, item_id, unnest(w) AS t FROM b) GROUP BY ALL),
        s AS (SELECT q, item_id, r, doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * cn) // cl))))::BIGINT AS score FROM a JOIN df USING (t) JOIN tf USING (t) JOIN n USING (r), g GROUP BY 1, 2, 3, 4),
        k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS FIRST, r) AS rank FROM s WHERE score > 0)
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= 20
    """,
    "op13_merkle": _merkle_sql(),
    "op6_chat_format": """
        WITH c AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
          UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
        ), e AS (
          SELECT *, coalesce(lag(role) OVER w = role, false) AS same,
            length(regexp_replace(replace(role, '\\', '\\\\'), '<\\||<s>|</s>|<<SYS>>|<</SYS>>|\\[INST\\]|\\[/INST\\]', '\\0+', 'g')) AS n_role,
            length(regexp_replace(replace(text, '\\', '\\\\'), '<\\||<s>|</s>|<<SYS>>|<</SYS>>|\\[INST\\]|\\[/INST\\]', '\\0+', 'g')) AS n_text
          FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
        )
        SELECT conv_id, count(*)::BIGINT AS n_turns,
          sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
          coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
          sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
          sum(n_text + CASE WHEN same THEN 11 ELSE n_role + 32 END)::BIGINT AS formatted_chars
        FROM e GROUP BY conv_id
    """,
}
