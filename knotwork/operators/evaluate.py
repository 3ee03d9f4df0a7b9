"""Recall of table triplets against a graph: equi-joins first, containment only for what they leave.

Containment gets an equi-key too. If one string holds another, it holds all its n-grams, so it is enough to look
up the rarest one: the value's rarest gram among the grams of all keys, and each key's rarest gram among the
grams of all values. Grams are as long as the shorter string allows, by steps (``GRAMS``): over half of it, up to the
longest step, so that few other strings hold the rarest one however many there are. Only lengths that are looked up
are listed, as hashes. The pairs found that way are then checked in full.

Match kinds in order: an equal triplet, an equal relation (an empty object matches any), containment either
way in the triplet's texts and frame terms. The first match by (kind, index order) counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import canonical
from ..session import materialize
from .store import numbered

ROLES = ("subject", "predicate", "object")


def triplet_index(rows: DataFrame) -> DataFrame:
    """Canonical key sets by role, from search rows (see ``search.search_rows``)."""
    none = F.array().cast("array<string>")
    keys = lambda r: F.array_distinct(F.array(canonical(F.col(r)), canonical(F.col(f"{r}_norm"))))
    terms = lambda r: F.array_distinct(F.filter(F.transform(F.coalesce(F.try_element_at("frame_terms", F.lit(r)), none), canonical), lambda t: t != ""))
    return rows.select("triplet_id", "document_id", *(F.col(r).alias(f"g_{r}") for r in ROLES), *(keys(r).alias(f"k_{r}") for r in ROLES), *(F.array_union(keys(r), terms(r)).alias(f"f_{r}") for r in ROLES))


def relation_index(relations: DataFrame) -> DataFrame:
    """Canonical key sets of relations; those without a triplet are left out."""
    both = lambda a, b: F.array_distinct(F.array(canonical(F.col(a)), canonical(F.col(b))))
    name = lambda a, b: F.coalesce(F.nullif(F.col(a), F.lit("")), F.col(b), F.lit(""))
    return relations.where("triplet_id is not null").select(
        "triplet_id", "document_id", name("src_name", "src").alias("g_subject"), name("predicate", "predicate_norm").alias("g_predicate"), name("dst_name", "dst").alias("g_object"),
        both("src", "src_name").alias("k_subject"), both("predicate", "predicate_norm").alias("k_predicate"), both("dst", "dst_name").alias("k_object"))


def _first(matches: DataFrame, kind: str) -> DataFrame:
    """Of each table triplet's matches the first in index order."""
    first = matches.groupBy("row_key").agg(F.min(F.struct("triplet_id", "document_id", *(f"g_{r}" for r in ROLES))).alias("m"))
    return first.select("row_key", F.lit(kind).alias("match_type"), "m.*")


def _contains(value: Column, keys: Column) -> Column:
    """Equal, or contained either way; an empty value needs an empty key."""
    return F.when(value == "", F.array_contains(keys, "")).otherwise(F.exists(keys, lambda k: (k == value) | ((k != "") & (F.contains(k, value) | F.contains(value, k)))))


#: Lengths of grams. A string is looked up by grams of the longest of them that it has.
GRAMS = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64)


def _gram_length(text: Column) -> Column:
    return F.array_max(F.filter(F.array(*map(F.lit, GRAMS)), lambda n: n <= F.length(text)))


def _hashed_grams(text: Column, n: Column) -> Column:
    """Distinct hashes of a string's grams of ``n`` characters; none if it is shorter."""
    last = F.length(text) - n + 1
    return F.when(last > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.xxhash64(n, F.substring(text, i, n))))).otherwise(F.array().cast("array<long>"))


def _held(small: DataFrame, large: DataFrame, small_id: str, large_id: str) -> DataFrame:
    """Candidate pairs of ids where a string of ``large`` may hold one of ``small``, both (id, role, text)."""
    sized = small.withColumn("n", _gram_length(F.col("text")))
    looked_up = sized.groupBy("role").agg(F.collect_set("n").alias("lengths"))
    listed = large.join(F.broadcast(looked_up), "role").select(large_id, "role", F.explode(F.flatten(F.transform("lengths", lambda n: _hashed_grams(F.col("text"), n)))).alias("gram"))
    probes = sized.select(small_id, "role", "text", F.explode(_hashed_grams(F.col("text"), F.col("n"))).alias("gram"))
    every = materialize(listed.join(probes.select("role", "gram").distinct(), ["role", "gram"], "left_semi"), "grams")
    seen = every.groupBy("role", "gram").agg(F.count("*").alias("k"))
    # A gram that no text of the other side holds ends the search for its string.
    rarest = probes.join(seen, ["role", "gram"], "left").groupBy(small_id, "role", "text").agg(F.min(F.struct(F.coalesce("k", F.lit(0)).alias("k"), F.col("gram"))).alias("r"))
    return rarest.where("r.k > 0").select(small_id, "role", F.col("r.gram").alias("gram")).join(every, ["role", "gram"]).select("row_key", "entry").distinct()


def containment_candidates(rest: DataFrame, index: DataFrame) -> DataFrame:
    """(row_key, entry): index entries that may match a triplet by containment; none that does is missed.

    A triplet is looked up by its first slot that holds text; one without any meets the entries with empty keys.
    """
    first = F.coalesce(*(F.when(F.col(f"c_{r}") != "", F.struct(F.lit(r).alias("role"), F.col(f"c_{r}").alias("text"))) for r in ROLES))
    asked = materialize(rest.select("row_key", first.alias("f")).where("f is not null").select("row_key", "f.role", "f.text"), "asked_slots")
    keys = materialize(index.select("entry", F.explode(F.array(*(F.struct(F.lit(r).alias("role"), F.col(f"f_{r}").alias("texts")) for r in ROLES))).alias("x")).select("entry", "x.role", F.explode("x.texts").alias("text")).where("text <> ''"), "keys")
    roles = asked.select("role").distinct()
    keys = keys.join(roles, "role", "left_semi")
    value_in_key = _held(asked, keys, "row_key", "entry")
    key_in_value = _held(keys, asked, "entry", "row_key")
    blank = rest.where(" and ".join(f"c_{r} = ''" for r in ROLES)).select("row_key")
    empty = index.where(F.array_contains("f_subject", "") & F.array_contains("f_predicate", "") & F.array_contains("f_object", "")).agg(F.min("entry").alias("entry")).where("entry is not null")
    return value_in_key.unionByName(key_in_value).unionByName(blank.join(empty)).distinct()


def evaluate(table: DataFrame, triplets: DataFrame, relations: DataFrame) -> DataFrame:
    """A row per table triplet (row_key, subject, predicate, object) with status, match type and match.

    Both sides of the joins are of the size of the input, so none is broadcast, however small its files.
    """
    asked = materialize(table.select("row_key", *ROLES, *(canonical(F.col(r)).alias(f"c_{r}") for r in ROLES)), "asked")
    index = materialize(triplet_index(triplets).withColumn("entry", F.monotonically_increasing_id()), "index")
    flat = index
    for r in ROLES:
        flat = flat.withColumn(f"c_{r}", F.explode(f"k_{r}"))
    direct = materialize(_first(asked.join(flat, [f"c_{r}" for r in ROLES]), "direct_triplet"), "direct")
    left = asked.join(direct, "row_key", "left_anti")
    rel = relation_index(relations)
    flat_rel = rel.withColumn("c_subject", F.explode("k_subject")).withColumn("c_predicate", F.explode("k_predicate"))
    by_relation = left.where("c_subject <> '' and c_predicate <> ''").join(flat_rel.hint("merge"), ["c_subject", "c_predicate"]).where((F.col("c_object") == "") | F.array_contains("k_object", F.col("c_object")))
    related = materialize(_first(by_relation, "direct_relation"), "related")
    rest = left.join(related, "row_key", "left_anti")
    rest = materialize(rest, "rest")
    near = containment_candidates(rest, index).join(rest, "row_key").join(index, "entry")
    held = near.where(_contains(F.col("c_subject"), F.col("f_subject")) & _contains(F.col("c_predicate"), F.col("f_predicate")) & _contains(F.col("c_object"), F.col("f_object")))
    framed = _first(held, "frame_fallback")
    matched = direct.unionByName(related).unionByName(framed)
    joined = table.select("row_key", *ROLES).join(matched.hint("merge"), "row_key", "left")
    return joined.select(
        "row_key", *ROLES, F.when(F.col("match_type").isNull(), "FN").otherwise("TP").alias("status"), F.coalesce("match_type", F.lit("")).alias("match_type"), F.col("triplet_id").alias("matched_triplet_id"), F.col("document_id").alias("matched_document_id"),
        *(F.coalesce(f"g_{r}", F.lit("")).alias(f"matched_{r}") for r in ROLES))


def recall(detail: DataFrame) -> DataFrame:
    """One row: totals and recall; 0 without any table triplet."""
    return detail.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "TP").alias("tp"), F.count_if(F.col("status") == "FN").alias("fn")).withColumn("recall", F.when(F.col("total") == 0, F.lit(0.0)).otherwise(F.round(F.col("tp") / F.greatest(F.col("total"), F.lit(1)), 6)))


def match_order(detail: DataFrame) -> DataFrame:
    """Detail rows numbered in order of their key."""
    return numbered(detail, ["row_key"], "n")
