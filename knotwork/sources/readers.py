"""Reading tables and triplet payloads. Files are read by Spark's own readers, so any store it knows will do."""

from __future__ import annotations

import csv
import io
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import canonical_json, slot_text
from ..operators.frames import role_frame

DELIMITERS = (";", ",", "\t")
SAMPLE = 4096
ENCODINGS = ("utf-8-sig", "cp1251", "latin-1")
NOT_IN_CP1251 = b"\x98"


def csv_encoding(spark: SparkSession, path: str) -> str:
    """utf-8 if every line is valid, else cp1251, else (if a byte occurs that cp1251 lacks) latin-1. Reads all lines once."""
    line = F.col("value")
    valid, lacking = spark.read.text(path).agg(F.bool_and(F.is_valid_utf8(line)), F.bool_or(F.contains(line.cast("binary"), F.lit(NOT_IN_CP1251)))).first()
    return "utf-8" if valid is None or valid else "latin-1" if lacking else "cp1251"


def read_csv(spark: SparkSession, path: str, sep: str = ";", encoding: str | None = None) -> DataFrame:
    """A well-formed CSV file with a header, all columns as strings, in the encoding given or found by :func:`csv_encoding`.

    Files read together have one encoding. An empty file has no columns.
    """
    encoding = encoding or csv_encoding(spark, path)
    if encoding == "utf-8":
        return spark.read.csv(path, header=True, sep=sep, inferSchema=False)
    raw = spark.read.csv(path, header=True, sep=sep, inferSchema=False, encoding="ISO-8859-1")
    if encoding == "latin-1":
        return raw
    # Spark's reader does not know cp1251: latin-1 keeps every byte as a character, which is then replaced.
    upper = bytes(b for b in range(128, 256) if b != NOT_IN_CP1251[0])
    shown = [F.translate(F.col(f"`{c}`"), upper.decode("latin-1"), upper.decode("cp1251")).alias(c.encode("latin-1").decode("cp1251")) for c in raw.columns]
    return raw.select(*shown)


def decoded(raw: bytes | None) -> str | None:
    for encoding in ENCODINGS if raw is not None else ():
        try:
            return raw.decode(encoding)
        except UnicodeDecodeError:
            continue
    return None


def decode_bytes(content: Column) -> Column:
    """Bytes as text: utf-8 if they are valid, else cp1251, else latin-1."""

    @F.pandas_udf("string")
    def decode(batch: pd.Series) -> pd.Series:
        return batch.map(decoded)

    return decode(content)


def sniff_delimiter(text: Column) -> Column:
    """The delimiter that cuts the first lines most evenly, by counts over the first 4096 characters.

    A delimiter that occurs equally often in the first two lines is preferred to one that does not; among
    those the most frequent wins, ``;`` if there is none.
    """
    head = F.left(F.regexp_replace(text, '"[^"]*"', ""), F.lit(SAMPLE))
    lines = F.split(head, "\r?\n")
    count = lambda t, d: F.length(t) - F.length(F.replace(t, F.lit(d), F.lit("")))
    ranks = []
    for k, d in enumerate(DELIMITERS):
        first, second = count(F.get(lines, F.lit(0)), d), count(F.coalesce(F.get(lines, F.lit(1)), F.get(lines, F.lit(0))), d)
        even = ((first > 0) & (first == second)).cast("int")
        ranks.append(F.struct(even.alias("even"), F.coalesce(count(head, d), F.lit(0)).alias("n"), F.lit(-k).alias("order"), F.lit(d).alias("delimiter")))
    best = F.greatest(*ranks)
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, ";").otherwise(best["delimiter"])


def parse_rows(text: Column, delimiter: Column) -> Column:
    """Quoted CSV text as an array of rows of cells; spaces after a delimiter are skipped."""

    @F.pandas_udf("array<array<string>>")
    def parse(texts: pd.Series, delimiters: pd.Series) -> pd.Series:
        csv.field_size_limit(1 << 30)
        return pd.Series([list(csv.reader(io.StringIO(t.removeprefix("﻿"), newline=""), delimiter=d, quotechar='"', skipinitialspace=True)) if t else [] for t, d in zip(texts, delimiters, strict=True)])

    return parse(text, delimiter)


def read_tables(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """All ``.csv`` files of a folder as (table_file, row_idx, cells); ragged rows keep all their cells.

    A table is one file and one task; files are read whole, which suits tables made for people.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").option("recursiveFileLookup", "true").load(path)
    text = files.select(F.element_at(F.split("path", "/"), -1).alias("table_file"), decode_bytes(F.col("content")).alias("text"))
    delimiter = F.lit(sep) if sep else sniff_delimiter(F.col("text"))
    return text.select("table_file", F.posexplode(parse_rows(F.col("text"), delimiter)).alias("row", "cells")).select("table_file", (F.col("row") + 1).alias("row_idx"), "cells")


def tables_from_rows(spark: SparkSession, tables: dict[str, list[list[str]]]) -> DataFrame:
    """Literal tables, mostly for tests."""
    rows = [(name, i, list(map(str, cells))) for name, table in tables.items() for i, cells in enumerate(table, 1)]
    return spark.createDataFrame(rows, "table_file string, row_idx int, cells array<string>")


def read_triplet_json(spark: SparkSession, path: str) -> DataFrame:
    """Triplet payloads, flat or with frames, one file each: (source_name, content_hash, position, triplet).

    A payload must be an object with a list ``triplets``; others are returned by :func:`malformed_payloads`.
    ``triplet`` is a VARIANT; items that are no objects are left out.
    """
    payload = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("source_name"), F.try_parse_json("value").alias("payload"))
    return explode_payload(payload)


def explode_payload(payload: DataFrame) -> DataFrame:
    """(source_name, payload VARIANT) to a row per triplet, positions from 1."""
    kept = payload.where(F.schema_of_variant(F.col("payload")).startswith("OBJECT") & F.schema_of_variant(F.variant_get("payload", "$.triplets", "variant")).startswith("ARRAY"))
    hashed = kept.withColumn("content_hash", F.sha2(canonical_json(F.to_json("payload")), 256))
    items = hashed.select("source_name", "content_hash", F.posexplode(F.variant_get("payload", "$.triplets", "array<variant>")).alias("pos", "triplet"))
    return items.where(F.schema_of_variant("triplet").startswith("OBJECT")).select("source_name", "content_hash", (F.col("pos") + 1).alias("position"), "triplet")


def malformed_payloads(payload: DataFrame) -> DataFrame:
    """Payloads that are no object with a list of triplets, with the reason."""
    shape = F.schema_of_variant(F.col("payload"))
    inner = F.schema_of_variant(F.variant_get("payload", "$.triplets", "variant"))
    reason = F.when(F.col("payload").isNull(), "not JSON").when(~shape.startswith("OBJECT"), "not an object").when(inner.isNull(), "no triplets").when(~inner.startswith("ARRAY"), "triplets is no list")
    return payload.select("source_name", reason.alias("reason")).where("reason is not null")


ROLES = ("subject", "predicate", "object")


def payload_rows(items: DataFrame) -> DataFrame:
    """Triplet rows of exploded payloads: slots as text, and as frames in JSON."""
    slot = lambda name: F.try_variant_get("triplet", f"$.{name}", "variant")
    return items.select(
        "source_name", "content_hash", F.col("position").alias("row_idx"), *(slot_text(slot(c)).alias(f"{c}_text") for c in ROLES),
        F.nullif(slot_text(slot("sentence")), F.lit("")).alias("sentence_text"), *(role_frame(slot(c)).alias(f"{c}_frame") for c in ROLES))


def read_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A relational table; the driver jar has to be on the cluster's class path."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def sanitize(df: DataFrame) -> DataFrame:
    """Bytes anywhere in the rows as text, by :func:`decode_bytes`, and map keys as strings, so that all can be written as JSON."""

    def typed(kind: T.DataType) -> T.DataType:
        if isinstance(kind, T.BinaryType):
            return T.StringType()
        if isinstance(kind, T.ArrayType):
            return T.ArrayType(typed(kind.elementType), kind.containsNull)
        if isinstance(kind, T.MapType):
            return T.MapType(T.StringType(), typed(kind.valueType), kind.valueContainsNull)
        if isinstance(kind, T.StructType):
            return T.StructType([T.StructField(f.name, typed(f.dataType), f.nullable) for f in kind.fields])
        return kind

    out: list[Column] = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.BinaryType):
            out.append(decode_bytes(F.col(f"`{f.name}`")).alias(f.name))
        elif typed(f.dataType) != f.dataType:
            out.append(_sanitized(typed(f.dataType))(F.col(f"`{f.name}`")).alias(f.name))
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)


def _sanitized(kind: T.DataType):
    """A function of nested values; Python sees them, since built-ins cannot decode bytes by trial."""

    def clean(value: Any, kind: T.DataType) -> Any:
        if isinstance(value, (bytes, bytearray)):
            return decoded(bytes(value))
        if value is None:
            return None
        if isinstance(kind, T.ArrayType):
            return [clean(v, kind.elementType) for v in value]
        if isinstance(kind, T.MapType):
            return {str(k): clean(v, kind.valueType) for k, v in value.items()}
        if isinstance(kind, T.StructType):
            return tuple(clean(v, f.dataType) for v, f in zip(value, kind.fields, strict=True))
        return value

    return F.udf(lambda value: clean(value, kind), kind, useArrow=True)
