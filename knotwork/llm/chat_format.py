"""Chat formatting with Spark expressions only.

Turns of a conversation are collected as structs, sorted by turn, adjacent turns of one role are merged
with array functions, and the pieces are concatenated. Template of one (merged) turn::

    <|im_start|>ROLE<|im_sep|>TEXT<|im_join|>TEXT...<|im_end|>

``<|im_join|>`` stands between texts of merged turns, so the original turns can be read back. In roles and
texts a backslash is doubled and every control string gets a backslash after its first character; removing
one backslash before any character undoes both.

Defined results: a null text or role counts as empty; a null turn sorts first; rows with equal turns follow
in order of role, then text, and repeated rows stay repeated; rows with a null conversation id form one
conversation; an empty table gives no row; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, JOIN, END = "<|im_start|>", "<|im_sep|>", "<|im_join|>", "<|im_end|>"
#: ``<|`` opens every mark of the template; the others are marks of other common templates.
CONTROL = "(<)(\\||s>|/s>|<SYS>>|</SYS>>)|(\\[)(INST\\]|/INST\\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "\\\\", "\\\\\\\\"), CONTROL, "$1$3\\\\$2$4")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, "(?s)\\\\(.)", "$1")


def format_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) to one row per conversation.

    Columns: conv_id; formatted, the whole string; segments, the same string cut into
    ``{text, loss}`` pieces, where ``loss`` marks the texts that training loss falls on (assistant turns);
    n_merged, turns after merging.
    """
    turns = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(
            F.col("turn").cast("long").alias("turn"),
            F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    sorted_turns = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))

    def pieces(t: Column, i: Column) -> Column:
        prev, nxt = F.get("ts", i - 1)["role"], F.get("ts", i + 1)["role"]
        opens, closes = ~F.coalesce(prev == t["role"], F.lit(False)), ~F.coalesce(nxt == t["role"], F.lit(False))
        return F.array(
            F.struct(F.when(opens, F.concat(F.lit(START), escape(t["role"]), F.lit(SEP))).otherwise(F.lit(JOIN)).alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(t["text"]).alias("text"), (t["role"] == "assistant").alias("loss")),
            F.struct(F.when(closes, F.lit(END)).otherwise(F.lit("")).alias("text"), F.lit(False).alias("loss")),
        )

    cut = sorted_turns.select("conv_id", F.filter(F.flatten(F.transform("ts", pieces)), lambda s: (s["text"] != "") | s["loss"]).alias("segments"))
    whole = cut.select("conv_id", "segments", F.array_join(F.col("segments.text"), "").alias("formatted"))
    return whole.select("conv_id", "formatted", "segments", (F.size(F.split("formatted", "<\\|im_start\\|>", -1)) - 1).alias("n_merged"))


def parse_formatted(formatted: Column) -> Column:
    """The original turns as ``array<struct<role, text>>``, read back from a formatted string."""
    merged = F.filter(F.split(formatted, "<\\|im_start\\|>", -1), lambda s: s != "")
    split = F.transform(merged, lambda s: F.split(s, "<\\|im_sep\\|>", 2))

    def turns(p: Column) -> Column:
        body = F.substring_index(p[1], END, 1)
        return F.transform(F.split(body, "<\\|im_join\\|>", -1), lambda t: F.struct(unescape(p[0]).alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(split, turns))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def digest(formatted: DataFrame) -> DataFrame:
    """The columns of the query, read back from the output of :func:`format_conversations`."""
    back = formatted.select("conv_id", "n_merged", "formatted", parse_formatted(F.col("formatted")).alias("ts"), loss_text(F.col("segments")).alias("loss"))
    flat = F.array_join(F.transform("ts", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("ts").cast("long").alias("n_turns"),
        F.sha2(flat.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
