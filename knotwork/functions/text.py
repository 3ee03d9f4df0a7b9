"""Text functions as Column expressions; only :func:`canonical_json` leaves the JVM."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode defines it, plus the four ASCII separators.
SPACE = "(?U)[\\s\\x1c-\\x1f\\x85]+"
# Fixed value: what counts as a token of a name.
TOKEN = "[0-9A-Za-zА-Яа-яЁё-]+"

# Measurement units that are stripped from the end of a label, as regular expressions.
UNITS = (
    "мкм/год|мм/год|м/с|км/ч|мм/мин"
    "|г/м[23²³]?|кг/м[23²³]?|т/м[23²³]?|Н/мм[23²³]?|Дж/см[23²³]?"
    "|кг|мг|г|т|мкм|нм|км|мм|см|дм|м"
    "|м[23²³]|см[23²³]|мм[23²³]|км[23²³]|м³|см³|мм³|дм³|мл|л"
    "|кПа|МПа|ГПа|Па|кВт|МВт|ГВт|Вт|кДж|МДж|ГДж|Дж"
    "|°\\s*|℃|К|K|мс|мин|ч|сут|%|‰|×10[-−]?\\d+"
)
UNIT_TAIL = f"(?iu)(?:(?<=\\d)\\s*|[,;]\\s*)(?:{UNITS})\\s*$"
#: Longest part after the last comma that is taken for an unknown unit.
UNKNOWN_UNIT = 10
# Cells that stand for nothing, lower-cased, and markers of an enumeration column.
NULL_LIKE = ("", "-", "—", "–", "null", "nan", "none", ".")
MARKER = "(?iu)^(?:[а-яёa-z]\\)|\\d+[).]|№.*|\\d+)$"


def squash(text: Column) -> Column:
    """White space of any kind to single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def entity_name(text: Column) -> Column:
    return F.lower(squash(text))


def normalize(text: Column) -> Column:
    """Null-safe lower case with squashed white space."""
    return squash(F.lower(F.coalesce(text, F.lit(""))))


def canonical(text: Column) -> Column:
    """Comparison form: no quotes or BOM, ``ё`` as ``е``, decimal commas as points."""
    bare = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit('"'), F.lit("")), F.lit("﻿"), F.lit(""))
    return F.regexp_replace(F.replace(normalize(bare), F.lit("ё"), F.lit("е")), "(?<=\\d),(?=\\d)", ".")


def holds(haystack: Column, needle: Column) -> Column:
    """Containment that an empty needle never passes."""
    return (needle != "") & F.contains(haystack, needle)


def cell_text(text: Column) -> Column:
    return squash(F.replace(F.coalesce(text, F.lit("")), F.lit('"'), F.lit("")))


def tokens(name: Column) -> Column:
    """Lower-cased tokens of a name that have more than one character, in order."""
    return F.filter(F.regexp_extract_all(normalize(name), F.lit(f"({TOKEN})"), F.lit(1)), lambda t: F.length(t) > 1)


def char_ngrams(text: Column, low: int = 2, high: int = 4) -> Column:
    """Character n-grams of the normalised text with a space on each side; an empty text has none."""
    line = F.concat(F.lit(" "), normalize(text), F.lit(" "))

    def of(n: int) -> Column:
        last = F.length(line) - n + 1
        return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(line, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    return F.when(normalize(text) == "", F.array().cast("array<string>")).otherwise(F.concat(*(of(n) for n in range(low, high + 1))))


def strip_known_unit(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, UNIT_TAIL, ""))


def strip_units(text: Column) -> Column:
    """A known unit at the end goes; if that changed nothing, a short part after the last comma goes."""
    known = strip_known_unit(text)
    parts = F.split(known, ",")
    last = F.element_at(parts, -1)
    short = (F.size(parts) > 1) & (F.length(last) <= UNKNOWN_UNIT)
    return F.when(known != text, known).when(short, F.left(known, F.length(known) - F.length(last) - 1)).otherwise(known)


def null_like(text: Column) -> Column:
    """True for cells that stand for nothing, and for generated ``Unnamed`` headers."""
    t = F.lower(squash(F.coalesce(text, F.lit(""))))
    return t.isin(*NULL_LIKE) | t.startswith("unnamed")


def is_marker(text: Column) -> Column:
    """True for cells of an enumeration column: ``a)``, ``1)``, ``№``, a bare index."""
    return F.coalesce(text, F.lit("")).rlike(MARKER)


def prefix_numeric(text: Column, header: Column) -> Column:
    """A bare number gets its column's name in front."""
    return F.when(text.rlike("^\\d+$") & (F.coalesce(header, F.lit("")) != ""), F.concat_ws(" ", header, text)).otherwise(text)


def slot_text(slot: Column) -> Column:
    """Text of a VARIANT slot: its ``text``, else the string itself, else its JSON; an object without text is empty."""
    kind = F.schema_of_variant(slot)
    return F.coalesce(
        F.try_variant_get(slot, "$.text", "string"),
        F.when(kind.startswith("OBJECT"), F.lit("")).otherwise(F.try_variant_get(slot, "$", "string")),
        F.lit(""),
    )


def shorter_variant(left_norm: Column, left_text: Column, right_norm: Column, right_text: Column) -> Column:
    """Of two spellings ``struct<len, norm, text>`` the canonical one: the shorter norm, then the smaller."""
    form = lambda n, t: F.struct(F.length(n).alias("len"), n.alias("norm"), t.alias("text"))
    return F.least(form(left_norm, left_text), form(right_norm, right_text))


def shorten(text: Column, size: int = 48) -> Column:
    """A label cut to ``size`` characters with an ellipsis."""
    t = squash(F.coalesce(text, F.lit("")))
    return F.when(F.length(t) > size, F.concat(F.rtrim(F.left(t, F.lit(size - 1))), F.lit("…"))).otherwise(t)


# What lists show for an empty slot.
EMPTY_SLOTS = {"subject": "[пустой субъект]", "predicate": "[пустой предикат]", "object": "[пустой объект]"}


def triplet_label(triplet_id: Column, subject: Column, predicate: Column, obj: Column, sentence: Column | None = None, size: int = 96) -> Column:
    """``id | subject -[predicate]-> object``, and the sentence if there is one."""
    slot = lambda c, role, n: shorten(F.when(F.coalesce(c, F.lit("")) == "", EMPTY_SLOTS[role]).otherwise(c), n)
    base = F.concat(triplet_id.cast("string"), F.lit(" | "), slot(subject, "subject", 28), F.lit(" -["), slot(predicate, "predicate", 24), F.lit("]-> "), slot(obj, "object", 28))
    if sentence is None:
        return base
    shown = shorten(sentence, size)
    return F.when(shown == "", base).otherwise(F.concat(base, F.lit(" | "), shown))


def concept_label(name: Column, norm: Column, in_degree: Column, out_degree: Column, frames: Column) -> Column:
    """A concept as a list of options shows it."""
    text = lambda c: c.cast("string")
    return F.concat(name, F.lit(" | norm="), norm, F.lit(" | in="), text(in_degree), F.lit(" out="), text(out_degree), F.lit(" frame="), text(frames))


def identifier(text: Column, fallback: str) -> Column:
    """A name of letters, digits and ``_`` only: no ``_`` at the ends, the fallback before a first digit, 120 characters at most."""
    t = F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), "[^0-9A-Za-z_]", "_"), F.lit("_"))
    t = F.when(t == "", F.lit(fallback)).otherwise(t)
    return F.left(F.when(t.rlike("^\\d"), F.concat(F.lit(fallback + "_"), t)).otherwise(t), F.lit(120))


def relation_type(text: Column, fallback: str = "IMPORTED_RELATION") -> Column:
    return F.upper(identifier(text, fallback))


def escape_dot(text: Column) -> Column:
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def content_hash(*columns: Column) -> Column:
    """SHA-256 of a canonical JSON object of the columns."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def canonical_json(text: Column, indent: int | None = None) -> Column:
    """JSON text in one spelling: keys sorted, ``, `` and ``: `` between, no escapes but the needed; or indented, keys as they come.

    Spark writes JSON without spaces and cannot sort what is nested, and hashes depend on every byte.
    """

    @F.pandas_udf("string")
    def spell(batch: pd.Series) -> pd.Series:
        return batch.map(lambda t: None if t is None else json.dumps(json.loads(t), ensure_ascii=False, sort_keys=indent is None, indent=indent))

    return spell(text)


def listing(items: Column) -> Column:
    """Sorted distinct items, comma-joined, or ``none``."""
    joined = F.array_join(F.array_sort(F.array_distinct(items)), ", ")
    return F.when(joined == "", "none").otherwise(joined)


# The labels of the lines below.


def context_text(name: Column, norm: Column, out_preds: Column, in_preds: Column, children: Column | None, occurrences: Column) -> Column:
    """Description of a concept, a labelled line each; ``children`` None leaves the frame line out."""
    lines = [
        F.concat(F.lit("concept: "), F.coalesce(F.nullif(name, F.lit("")), norm, F.lit(""))),
        F.concat(F.lit("outgoing predicates: "), listing(out_preds)),
        F.concat(F.lit("incoming predicates: "), listing(in_preds)),
        *([] if children is None else [F.concat(F.lit("frame children: "), listing(children))]),
        F.concat(F.lit("occurrence count: "), F.greatest(F.coalesce(occurrences, F.lit(0)), F.lit(0)).cast("string")),
    ]
    return F.concat_ws("\n", *lines)


def entity_context_text(name: Column, norm: Column, out_preds: Column, in_preds: Column, out_near: Column, in_near: Column) -> Column:
    """Description of an entity by predicates and neighbours."""
    lines = [("outgoing predicates: ", out_preds), ("incoming predicates: ", in_preds), ("outgoing neighbors: ", out_near), ("incoming neighbors: ", in_near)]
    return F.concat_ws("\n", F.concat(F.lit("entity: "), F.coalesce(F.nullif(name, F.lit("")), norm, F.lit(""))), *(F.concat(F.lit(k), listing(v)) for k, v in lines))
