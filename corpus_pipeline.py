"""A corpus pipeline: language ID, near-dedup, decontamination, secret redaction, token encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. Verdicts hold for rows, not
for ids: a null or repeated doc_id never decides for another row. An empty table passes through every stage empty,
and columns other than those of ``documents`` are dropped.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.llm import bpe, decontaminate, language_id, secret_scan, simhash
from knotwork.llm.common import read
from knotwork.session import drop_materialized, written

DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")
TOKENIZER = "word_bpe_49k.json"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model rejects go: null texts, texts without a letter, or too far from every language.

    The verdict travels with its row, so null and repeated ids need no join; repeated rows stay or go together.
    """
    return language_id.accepted(docs, DOCUMENT)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates one row stays: that of the smallest doc_id, null ids last.

    Among texts of one id the one with the smallest hash stays; of equal rows one. Different texts under one id that
    are not near each other all stay. Null and empty texts are one component.
    """
    return simhash.survivors(docs, DOCUMENT)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; null and empty texts hold none.

    The verdict follows from the text alone and is joined by its hash, so ids may be null or repeated.
    """
    key = F.xxhash64(F.col("text"))
    found = decontaminate.find_contamination(docs.select(key.alias("doc_id"), "text"), read(spark, sf_dir, "benchmark"))
    leaks = found.where(F.size("hit_spans") > 0).select(F.col("doc_id").alias("_key")).distinct()
    return docs.select(*DOCUMENT, key.alias("_key")).join(leaks, "_key", "left_anti").select(*DOCUMENT)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span that the scan finds becomes ``[SECRET]`` and n_chars follows the new text; every row stays, null texts as they are."""
    return secret_scan.redacted_documents(docs, DOCUMENT)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens of every row left; null and empty texts have no ids.

    Workers are shared with the other stages, so tables stay small.
    """
    encoded = bpe.encode(docs, public_tokenizers.path(TOKENIZER), max_states=50_000, max_words=50_000, keep_tables=False)
    return encoded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"))


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", near_dedup),
    ("decontaminate", drop_contaminated),
    ("secret_scan", redact_secrets),
    ("bpe", encode_tokens),
]

#: SimHash components, learned language models and tokenization are not expressible in SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn, each written and read again; what a stage and its predecessor wrote is deleted after it."""
    docs = first = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(lambda: stage(spark, docs, sf_dir), name)  # noqa: B023
        if before is not first:
            drop_materialized(before)
    return STAGES[-1][1](spark, docs, sf_dir)
