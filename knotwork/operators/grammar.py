"""Subject-predicate-object extraction from dependency-parsed sentences.

Input is a token table (sentence_id, id, text, lemma, upos, feats map, head, deprel); a parser is plugged in
front of it. Rules are filters and self-joins on (sentence_id, head); closures are short loops, since parse
trees are shallow. Both sides of such a join follow the sentences, so neither is broadcast, however small its files are.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

TOKENS = "sentence_id long, id int, text string, lemma string, upos string, feats map<string,string>, head int, deprel string"
# Fixed values of the grammar.
NOUNS = ("NOUN", "PRON", "PROPN")
SUBJECT_RELATIONS = ("subj", "nsubj", "nsubj:pass", "csubj")
RELATIVE_PRONOUNS = ("который", "которая", "которое", "которые")
OBLIQUE_PREPOSITIONS = ("на",)
MODALS = ("мочь", "могут", "может", "можно", "должна", "должны", "должен")
SKIPPED_RELATIONS = ("punct", "cc", "case", "cop", "aux", "mark")
SKIPPED_TAGS = ("PUNCT", "CCONJ", "SCONJ", "ADP", "AUX", "PART")
SUCH_AS = " таки(?:е|ми|м|й|ая|ое) как"


def feature(name: str, value: str, prefix: str = "") -> Column:
    return F.coalesce(F.try_element_at(F.col(f"{prefix}feats"), F.lit(name)) == value, F.lit(False))


def is_predicate() -> Column:
    """Finite verbs and the like, and short adjectives: no converbs, no participles that modify a noun."""
    verb = (F.col("upos") == "VERB") & ~feature("VerbForm", "Conv") & ~(feature("VerbForm", "Part") & F.col("deprel").isin("amod", "acl"))
    return verb | short_adjective()


def short_adjective(prefix: str = "") -> Column:
    return (F.col(f"{prefix}upos") == "ADJ") & feature("Variant", "Short", prefix)


def prepare(text: Column) -> Column:
    """A sentence as it is handed to a parser: ``such as`` phrases become a colon."""
    return F.regexp_replace(text, SUCH_AS, ":")


def parse_sentences(sentences: DataFrame, parser) -> DataFrame:
    """(sentence_id, text) to tokens by a pluggable parser: a function of a text that gives token dicts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["sentence_id", "id", "text", "lemma", "upos", "feats", "head", "deprel"]
        for pdf in batches:
            rows = [{"sentence_id": s, **t} for s, text in zip(pdf["sentence_id"], pdf["text"], strict=True) for t in parser(text)]
            yield pd.DataFrame(rows, columns=names)

    return sentences.select("sentence_id", prepare(F.col("text")).alias("text")).mapInPandas(run, TOKENS)


def _core(tokens: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Predicates; subjects (sentence_id, pred, word, ord); objects likewise."""
    preds = tokens.where(is_predicate()).select("sentence_id", F.col("id").alias("pred"), F.col("head").alias("pred_head"), F.col("deprel").alias("pred_deprel"), F.col("text").alias("pred_text"), short_adjective().alias("pred_short"))
    markers = tokens.where("deprel = 'case'").groupBy("sentence_id", F.col("head").alias("id")).agg(F.min_by(F.lower("text"), "id").alias("prep"))
    nouns = tokens.where(F.col("upos").isin(*NOUNS)).join(markers.hint("merge"), ["sentence_id", "id"], "left")
    near = nouns.join(preds.select("sentence_id", F.col("pred")).hint("merge"), (nouns["head"] == F.col("pred")) & (nouns["sentence_id"] == preds["sentence_id"])).select(nouns["*"], "pred")
    accusative = feature("Case", "Acc")
    subject = F.col("deprel").isin(*SUBJECT_RELATIONS) & ~accusative
    obj = (
        F.col("deprel").isin("obj", "iobj") | (F.col("upos") == "PROPN") | ((F.col("deprel") == "obl") & (F.col("prep").isNull() | F.col("prep").isin(*OBLIQUE_PREPOSITIONS))) | ((F.col("deprel") == "nsubj") & accusative)
    )
    return preds, near.where(subject).select("sentence_id", "pred", F.col("id").alias("word")), near.where(~subject & obj).select("sentence_id", "pred", F.col("id").alias("word"))


def _coordinated(tokens: DataFrame, words: DataFrame, flat_names: bool) -> DataFrame:
    """Words and what is coordinated with them: conj and parataxis nouns, and foreign name parts if asked for."""
    nouns = tokens.where(F.col("upos").isin(*NOUNS))
    linked = F.col("deprel").isin("conj", "parataxis")
    if flat_names:
        linked = linked | ((F.col("deprel") == "flat:foreign") & (F.col("upos") == "PROPN"))
    step = materialize(nouns.where(linked).select("sentence_id", F.col("head").alias("word"), F.col("id").alias("next")), "step")
    every = materialize(words.distinct(), "words")
    frontier = every
    while True:  # each round adds words or is the last
        grown = frontier.join(step, ["sentence_id", "word"]).select("sentence_id", "pred", F.col("next").alias("word")).distinct()
        frontier = materialize(grown.join(every, ["sentence_id", "pred", "word"], "left_anti"), "words")
        if frontier.isEmpty():
            break
        every = materialize(every.unionByName(frontier), "words")
    return every


def replace_pronouns(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """Relative pronouns give way to the nearest noun before them that agrees in gender and number."""
    pron = tokens.where(F.col("text").isin(*RELATIVE_PRONOUNS)).select("sentence_id", F.col("id").alias("word"), F.col("text").alias("form"))
    nouns = tokens.where("upos = 'NOUN'").select("sentence_id", F.col("id").alias("noun"), "feats")
    gender = F.when(F.col("form").endswith("ый"), "Masc").when(F.col("form").endswith("ая"), "Fem").when(F.col("form").endswith("ое"), "Neut")
    number = F.when(F.col("form").endswith("ые"), "Plur").otherwise("Sing")
    fits = (F.try_element_at("feats", F.lit("Number")) == number) & (gender.isNull() | (F.try_element_at("feats", F.lit("Gender")) == gender))
    found = pron.join(nouns.hint("merge"), "sentence_id").where((F.col("noun") < F.col("word")) & F.coalesce(fits, F.lit(False))).groupBy("sentence_id", "word").agg(F.max("noun").alias("noun"))
    return words.join(found.hint("merge"), ["sentence_id", "word"], "left").select("sentence_id", "pred", F.coalesce("noun", "word").alias("word"), F.col("word").alias("was")).distinct()


def arguments(tokens: DataFrame, share_objects: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Predicates, subjects and objects with inheritance, coordination and pronouns resolved.

    A predicate without a subject takes those of the predicate it depends on. ``share_objects`` lets a
    coordinated predicate of the same kind without an object take its head's; it is off by default.
    """
    preds, subjects, objects = _core(tokens)
    preds, subjects, objects = (materialize(x, "args") for x in (preds, subjects, objects))
    heads = preds.select("sentence_id", F.col("pred").alias("pred_head"), F.col("pred_short").alias("head_short"))
    dependent = preds.join(heads, ["sentence_id", "pred_head"])
    # In order of predicates: a head before its dependent has inherited already, one after it has not.
    while True:  # each round gives a subject to a predicate without one or is the last
        lacking = dependent.join(subjects, ["sentence_id", "pred"], "left_anti")
        inherited = lacking.join(subjects.withColumnsRenamed({"pred": "pred_head"}), ["sentence_id", "pred_head"]).select("sentence_id", "pred", "pred_head", "word")
        new = materialize(inherited.select("sentence_id", "pred", "word"), "args")
        if new.isEmpty():
            break
        subjects = materialize(subjects.unionByName(new), "args")
    if share_objects:
        lacking = dependent.where("pred_deprel = 'conj' and pred_short = head_short").join(objects, ["sentence_id", "pred"], "left_anti")
        direct = objects.join(tokens.where(F.col("deprel").isin("obj", "iobj", "conj")).select("sentence_id", F.col("id").alias("word")), ["sentence_id", "word"], "left_semi")
        objects = objects.unionByName(lacking.join(direct.withColumnRenamed("pred", "pred_head"), ["sentence_id", "pred_head"]).select("sentence_id", "pred", "word"))
    return preds, replace_pronouns(tokens, _coordinated(tokens, subjects, True)), replace_pronouns(tokens, _coordinated(tokens, objects, False))


def sentence_triplets(tokens: DataFrame, separate: bool = True, share_objects: bool = False) -> DataFrame:
    """(sentence_id, subject, predicate, object, *_id): every subject with every object of a predicate.

    Missing sides are empty; modal verbs give nothing; ``separate`` also keeps predicates with neither side.
    Equal rows of a sentence count once.
    """
    preds, subjects, objects = arguments(tokens, share_objects)
    s = subjects.select("sentence_id", "pred", F.col("word").alias("subject_id"))
    o = objects.select("sentence_id", "pred", F.col("word").alias("object_id"))
    joined = preds.where(~F.lower("pred_text").isin(*MODALS)).join(s.hint("merge"), ["sentence_id", "pred"], "left").join(o.hint("merge"), ["sentence_id", "pred"], "left")
    if not separate:
        joined = joined.where("subject_id is not null or object_id is not null")
    word = lambda role: tokens.select("sentence_id", F.col("id").alias(f"{role}_id"), F.col("text").alias(role))
    named = joined.join(word("subject").hint("merge"), ["sentence_id", "subject_id"], "left").join(word("object").hint("merge"), ["sentence_id", "object_id"], "left")
    rows = named.select("sentence_id", F.coalesce("subject", F.lit("")).alias("subject"), F.col("pred_text").alias("predicate"), F.coalesce("object", F.lit("")).alias("object"), "subject_id", F.col("pred").alias("predicate_id"), "object_id")
    first = Window.partitionBy("sentence_id", "subject", "predicate", "object").orderBy("predicate_id", "subject_id", "object_id")
    return rows.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")


def root_triplets(tokens: DataFrame) -> DataFrame:
    """Sentences whose root is a noun: the root and its coordinated nouns, with empty predicate and object."""
    root = tokens.where((F.col("deprel") == "root") & F.col("upos").isin(*NOUNS)).groupBy("sentence_id").agg(F.min("id").alias("root"))
    with_root = tokens.join(root.hint("merge"), "sentence_id")
    mine = (F.col("id") == F.col("root")) | ((F.col("head") == F.col("root")) & (F.col("deprel") == "conj") & F.col("upos").isin(*NOUNS))
    return with_root.where(mine).select("sentence_id", F.col("text").alias("subject"), F.lit("").alias("predicate"), F.lit("").alias("object"), F.col("id").alias("subject_id"), F.lit(None).cast("int").alias("predicate_id"), F.lit(None).cast("int").alias("object_id"))


def extract(tokens: DataFrame, separate: bool = True, share_objects: bool = False) -> DataFrame:
    """Triplets by sentence; in ``separate`` mode a noun root comes first and then stands alone."""
    if not separate:
        return sentence_triplets(tokens, False, share_objects)
    roots = root_triplets(tokens)
    rest = tokens.join(roots.select("sentence_id").distinct().hint("merge"), "sentence_id", "left_anti")
    return roots.unionByName(sentence_triplets(rest, True, share_objects))


def node_text() -> Column:
    """Lower-cased form of adjectives and participles, lemma of all others."""
    return F.when((F.col("upos") == "ADJ") | ((F.col("upos") == "VERB") & feature("VerbForm", "Part")), F.lower("text")).otherwise(F.col("lemma"))


def frame_rows(tokens: DataFrame, triplets: DataFrame, max_depth: int = 1000) -> DataFrame:
    """Frames of a triplet's words: the parse tree below each, without function words and the other core words.

    (triplet_key, role, depth, path, text); ``triplets`` needs triplet_key, sentence_id and the three ids.
    """
    roles = F.inline(F.array(*(F.struct(F.lit(r).alias("role"), F.col(f"{r}_id").alias("id")) for r in ("subject", "predicate", "object"))))
    core = triplets.select("triplet_key", "sentence_id", F.array_compact(F.array("subject_id", "predicate_id", "object_id")).alias("blocked"), roles).where("id is not null")
    texts = tokens.select("sentence_id", "id", node_text().alias("text"))
    kept = tokens.where(~F.col("deprel").isin(*SKIPPED_RELATIONS) & ~F.col("upos").isin(*SKIPPED_TAGS)).select("sentence_id", F.col("head").alias("id"), F.col("id").alias("child"))
    order = Window.partitionBy("triplet_key", "role", "parent").orderBy("child")
    level = core.withColumns({"depth": F.lit(0), "path": F.lit("0")})
    levels = []
    for depth in range(max_depth):
        level = materialize(level, "frames")
        if level.isEmpty():
            break
        levels.append(level)
        below = level.join(kept, ["sentence_id", "id"]).where(~F.array_contains("blocked", F.col("child"))).withColumn("parent", F.col("path"))
        level = below.select("triplet_key", "sentence_id", "blocked", "role", F.col("child").alias("id"), F.lit(depth + 1).alias("depth"), F.concat("path", F.lit("."), (F.row_number().over(order) - 1).cast("string")).alias("path"))
    else:
        raise RuntimeError(f"a parse deeper than {max_depth}: heads that lead back to themselves are no tree")
    every = levels[0] if levels else level
    for x in levels[1:]:
        every = every.unionByName(x)
    return every.join(texts, ["sentence_id", "id"]).select("triplet_key", "role", "depth", "path", "text")


def expand_slots(slots: DataFrame, tokens: DataFrame, separate: bool = True) -> DataFrame:
    """Slots (triplet_key, role, sentence_id, text) with two words or more as the best inner reading.

    The reading of a role with the most frame nodes wins; slots of one word stay as they are; triplets whose
    predicate ends up empty go.
    """
    inner = extract(tokens, separate)
    ranked = inner.withColumn("text", F.coalesce(F.nullif("predicate", F.lit("")), "subject"))
    best = ranked.groupBy("sentence_id").agg(F.min_by(F.struct("subject", "predicate", "object"), F.coalesce("predicate_id", F.lit(0))).alias("b"))
    words = F.size(F.filter(F.split("text", "\\s+"), lambda w: w != ""))
    joined = slots.join(best, "sentence_id", "left")
    chosen = F.when(F.col("role") == "subject", F.col("b.subject")).when(F.col("role") == "predicate", F.col("b.predicate")).otherwise(F.col("b.object"))
    whole = (F.col("b.predicate") == "") & (F.col("b.object") == "")
    text = F.when(words < 2, F.col("text")).when(F.col("b").isNull(), "").when(whole, F.col("b.subject")).otherwise(F.coalesce(chosen, F.lit("")))
    out = joined.select("triplet_key", "role", text.alias("text"))
    return out.join(out.where("role = 'predicate' and text <> ''").select("triplet_key"), "triplet_key", "left_semi")
