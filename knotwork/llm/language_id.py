"""Language identification by nearest centroid.

Texts become hashed character n-grams (1 to 3) weighted by TF-IDF and normalised to length one. Each language
is described by several centroids, found by spherical k-means over all of its labelled rows; a text takes the language
of the centroid with the largest cosine. If even that cosine is below the language's limit for texts of that length, the
text is rejected.

Every learnable row with a letter counts in all of it: document frequencies, seeds, clustering and limits. Its n-gram counts are stored
once (a bit for each n-gram and a byte for each that occurs); each step is a pass over them, in which tasks add up what
they assign. Sums are kept in integers, so that they do not depend on how rows are dealt out. A pass gives one vector
for each centroid, and the driver holds no more.

Limits. Short texts lie far from every centroid, so a limit holds for texts whose number of different n-grams lies
between the same two powers of the root of two. Each row is judged by its language's centroids without it: it is taken
out of the sum of the cluster that it is in, and a cluster of itself alone judges nothing. A limit is half the least
cosine of the rows of its length; the rule is the same at every size. A length with under ``BUCKET_ROWS`` rows borrows from the
nearest lengths, up to all there are. Cosines grow about with the root of the number of n-grams, so a shorter row that is
borrowed counts by what its cosine would be at that length, and below the shortest of them limits fall by that root. A
language with one row has no limit. Texts without a letter are never predicted: they count in document frequencies only.

The model has ``dims`` numbers per centroid and ``clusters`` centroids per language.

Defined results: null texts and texts without a letter are ``und`` with score 0; rows without a language, and
rows held out, teach nothing; without any learnable row every text is ``und``; texts of any length are used
whole; every row gives one row; an empty table gives none; further columns are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize

#: Letters only: numerals such as ² or Ⅷ are word characters, but no letters.
LETTER = regex.compile(r"\p{L}")
#: ASCII characters other than letters become a space.
ASCII = np.array([c if 97 <= c <= 122 else 32 for c in range(128)], np.uint32)
#: Lengths are told apart by the power of the root of two of their number of n-grams.
LENGTHS = 64
BUCKET_ROWS = 200
#: Log of one plus a count; weights are added up in units of 2 ** -32.
LOGS = np.log1p(np.arange(1 << 16))
UNIT = float(1 << 32)
MULTIPLIERS = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))


@dataclass
class CentroidModel:
    languages: list[str]  # by centroid
    centroids: np.ndarray  # (centroids, dims), length one
    limits: np.ndarray  # (centroids, LENGTHS): the least cosine that is not rejected
    idf: np.ndarray


def count_grams(text: str, dims: int) -> np.ndarray:
    """Counts of hashed 1-, 2- and 3-grams of a lower-cased text, runs of non-letters as one space."""
    c = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where(c < 128, ASCII[np.minimum(c, 127)], c)
    c = c[~np.concatenate([[False], (c[1:] == 32) & (c[:-1] == 32)])]
    shift = np.uint32(32 - (dims.bit_length() - 1))
    one = c * MULTIPLIERS[0]
    two = (one[:-1] ^ (c[1:] + np.uint32(0x165667B1))) * MULTIPLIERS[1]
    three = (two[:-1] ^ (c[2:] + np.uint32(0x27D4EB2F))) * MULTIPLIERS[2]
    return np.bincount(np.concatenate([one, two, three]) >> shift, minlength=dims)


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF rows of length one."""
    x = np.log1p(counts.astype(np.float32)) * idf.astype(np.float32)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def cluster(x: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from farthest-first seeds: (centroids, nearest centroid of each row)."""
    seeds = [int(np.argmax(x @ x.mean(0)))]
    while len(seeds) < min(k, len(x)):
        far = (x @ x[seeds].T).max(1)
        if far.min() > 1 - 1e-6:
            break
        seeds.append(int(np.argmin(far)))
    centers = x[seeds].copy()
    for _ in range(rounds):
        near = np.argmax(x @ centers.T, axis=1)
        for j in range(len(centers)):
            if (near == j).any():
                m = x[near == j].mean(0)
                centers[j] = m / max(np.linalg.norm(m), 1e-12)
    return centers, np.argmax(x @ centers.T, axis=1)


def length_of(counts: np.ndarray) -> np.ndarray:
    """The power of the root of two of the number of different n-grams in each row."""
    return (2 * np.log2(np.maximum((counts > 0).sum(1), 1))).astype(np.int64)


def length_limits(length: np.ndarray, cosine: np.ndarray) -> np.ndarray:
    """The limit of each length, from rows of one language and their cosines by centroids without them."""
    rows, least = np.bincount(length, minlength=LENGTHS), np.full(LENGTHS, np.inf)
    np.minimum.at(least, length, cosine)
    return limits_of(rows, least)


def limits_of(rows: np.ndarray, least: np.ndarray) -> np.ndarray:
    """The same from the number of rows and the least cosine of each length."""
    out, v = np.zeros(LENGTHS), np.arange(LENGTHS)
    if not rows.sum():
        return out
    enough = min(BUCKET_ROWS, rows.sum())
    shortest, longest = int(np.argmax(np.cumsum(rows) >= enough)), np.flatnonzero(rows)[-1]
    for at in range(LENGTHS):
        to = min(max(at, shortest), longest)
        away = abs(v - to)
        around = next(d for d in range(LENGTHS) if rows[away <= d].sum() >= enough)
        grown = least * 2.0 ** (np.maximum(to - v, 0) / 4)
        out[at] = grown[away <= around].min() / 2 * 2.0 ** (min(at - shortest, 0) / 4)
    return out


def held_out(doc_id: Column, folds: int = 5, fold: int = 0) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % folds == fold, F.lit(True))


@dataclass
class Stage:
    """What a pass over the stored counts needs: centroids by language and number, and which there are."""

    languages: list[str]
    idf: np.ndarray
    centers: np.ndarray  # (languages, clusters, dims)
    live: np.ndarray  # (languages, clusters)


@dataclass
class Rows:
    """Some stored rows as one list of weights."""

    lang: np.ndarray  # by row, like doc_id
    doc_id: np.ndarray
    owner: np.ndarray  # by weight: its row
    gram: np.ndarray
    weight: np.ndarray

    def cosines(self, centers: np.ndarray, live: np.ndarray) -> np.ndarray:
        at = self.lang[self.owner] * centers[0].size + self.gram
        found = [np.bincount(self.owner, centers.reshape(-1)[at + j * centers.shape[2]] * self.weight) for j in range(centers.shape[1])]
        return np.where(live[self.lang], np.stack(found, 1), -np.inf)


def _stored(batches: Iterator[pa.RecordBatch], stage: Stage) -> Iterator[Rows]:
    number = {lang: k for k, lang in enumerate(stage.languages)}
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            lang, doc_id, held, n, more = (c.slice(a, 256) for c in batch.columns)
            mask = np.unpackbits(np.frombuffer(b"".join(held.to_pylist()), np.uint8).reshape(len(held), -1), axis=1)
            owner, gram = np.nonzero(mask)
            count = np.frombuffer(b"".join(n.to_pylist()), np.uint8).astype(np.int64)
            count[count == 255] = np.frombuffer(b"".join(more.to_pylist()), np.int64)
            log = np.where(count < len(LOGS), LOGS[np.minimum(count, len(LOGS) - 1)], np.log1p(count))
            weight = log * stage.idf[gram]
            weight /= np.sqrt(np.bincount(owner, weight * weight))[owner]
            code = np.array([number[x] for x in lang.to_pylist()])
            ids = np.array([-1 if x is None else x for x in doc_id.to_pylist()])
            yield Rows(code, ids, owner, gram, weight)


def _sums(stored: DataFrame, stage: Stage, first: bool) -> dict[int, np.ndarray]:
    """By slot (language, number): the sum of the rows that are nearest to that centroid; at ``first`` of all rows."""
    shared = stored.sparkSession.sparkContext.broadcast(stage)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        st = shared.value
        _, k, dims = st.centers.shape
        total = {}
        for rows in _stored(batches, st):
            near = 0 if first else rows.cosines(st.centers, st.live).argmax(1)
            found, at = np.unique(rows.lang * k + near, return_inverse=True)
            part = np.zeros((len(found), dims), np.int64)
            np.add.at(part.reshape(-1), at[rows.owner] * dims + rows.gram, np.rint(rows.weight * UNIT).astype(np.int64))
            for x, v in zip(found.tolist(), part, strict=True):
                total[x] = total[x] + v if x in total else v
        yield vectors(total)

    def vectors(total: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["slot", "total"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {}
        for batch in batches:
            for x, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                v = np.frombuffer(v.as_buffer(), np.int64)
                total[x] = total[x] + v if x in total else v.copy()
        yield vectors(total)

    parts = stored.mapInArrow(run, "slot long, total binary").repartition("slot")
    out = {r.slot: np.frombuffer(r.total, np.int64) for r in parts.mapInArrow(add, "slot long, total binary").collect()}
    shared.unpersist()
    return out


def _farthest(stored: DataFrame, stage: Stage, nearest: bool) -> dict[int, tuple[float, np.ndarray]]:
    """By language: of its rows the one whose best cosine is least (``nearest``: most; ties by doc_id), and that cosine."""
    shared = stored.sparkSession.sparkContext.broadcast(stage)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        st = shared.value
        best = {}
        for rows in _stored(batches, st):
            value = rows.cosines(st.centers, st.live).max(1) * (1 if nearest else -1)
            order = np.lexsort((-rows.doc_id, value, rows.lang))
            for i in order[np.append(np.diff(rows.lang[order]) != 0, True)].tolist():
                key, lang = (float(value[i]), -int(rows.doc_id[i])), int(rows.lang[i])
                if lang not in best or key > best[lang][0]:
                    mine = rows.owner == i
                    best[lang] = key, np.bincount(rows.gram[mine], rows.weight[mine], st.centers.shape[2]).tobytes()
        cols = [list(best), [x[0][0] for x in best.values()], [x[0][1] for x in best.values()], [x[1] for x in best.values()]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.float64(), pa.int64(), pa.binary()), strict=True)], names=["lang", "value", "tie", "vector"])

    found = stored.mapInArrow(run, "lang long, value double, tie long, vector binary").groupBy("lang").agg(F.max("value").alias("value"), F.max_by("vector", F.struct("value", "tie")).alias("vector")).collect()
    shared.unpersist()
    return {r.lang: (r.value if nearest else -r.value, np.frombuffer(r.vector, np.float64)) for r in found}


def _limits(stored: DataFrame, stage: Stage, before: np.ndarray, size: np.ndarray) -> dict[str, np.ndarray]:
    """The limits of each language. Clusters: the rows nearest to the centroids ``before``; ``size``: the lengths of their sums."""
    shared = stored.sparkSession.sparkContext.broadcast((stage, before, size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        st, before, size = shared.value
        for rows in _stored(batches, st):
            each = np.arange(len(rows.lang))
            near, cosine = rows.cosines(before, st.live).argmax(1), rows.cosines(st.centers, st.live)
            whole = size[rows.lang, near]
            along = whole * cosine[each, near]
            rest = whole**2 - 2 * along + 1
            cosine[each, near] = np.where(rest > 1e-6, (along - 1) / np.sqrt(np.maximum(rest, 1e-6)), -np.inf)
            cosine, length = cosine.max(1), (2 * np.log2(np.bincount(rows.owner))).astype(np.int64)
            ok = np.isfinite(cosine)
            yield pa.RecordBatch.from_arrays([pa.array(rows.lang[ok]), pa.array(length[ok]), pa.array(cosine[ok])], names=["lang", "length", "cosine"])

    found = {lang: (np.zeros(LENGTHS, np.int64), np.full(LENGTHS, np.inf)) for lang in stage.languages}
    for r in stored.mapInArrow(run, "lang long, length long, cosine double").groupBy("lang", "length").agg(F.count("*").alias("n"), F.min("cosine").alias("least")).collect():
        rows, least = found[stage.languages[r.lang]]
        rows[r.length], least[r.length] = r.n, r.least
    shared.unpersist()
    return {lang: limits_of(*x) for lang, x in found.items()}


def fit(rows: DataFrame, clusters: int = 3, dims: int = 8192, rounds: int = 12) -> CentroidModel:
    """Learn from (doc_id, text, lang): ``rows`` must hold learnable rows only. All of them are counted, clustered and judged."""
    known = rows.where("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), F.col("doc_id").cast("long").alias("doc_id"), "text")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                held, count, more, letter = [], [], [], []
                for t in batch.column(2).slice(a, 256).to_pylist():
                    n = count_grams(t, dims)
                    letter.append(LETTER.search(t) is not None)
                    held.append(np.packbits(n > 0).tobytes())
                    n = n[n > 0]
                    count.append(np.minimum(n, 255).astype(np.uint8).tobytes())
                    more.append(n[n >= 255].astype(np.int64).tobytes())
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, 256) for k in range(2)), *(pa.array(x, pa.binary()) for x in (held, count, more)), pa.array(letter)], names=["lang", "doc_id", "held", "n", "more", "letter"])

    stored = materialize(known.mapInArrow(counted, "lang string, doc_id long, held binary, n binary, more binary, letter boolean"), "counts")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dims + 1, np.int64)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                held = batch.column(0).slice(a, 256).to_pylist()
                total[:dims] += np.unpackbits(np.frombuffer(b"".join(held), np.uint8).reshape(len(held), -1), axis=1).sum(0, dtype=np.int64)
                total[dims] += len(held)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["gram", "df"])

    df = np.zeros(dims + 1)
    for r in stored.select("held").mapInArrow(frequencies, "gram long, df long").groupBy("gram").agg(F.sum("df").alias("df")).collect():
        df[r.gram] = r.df
    idf = np.log((1 + df[dims]) / (1 + df[:dims])) + 1

    stored = stored.where("letter").drop("letter")
    languages = sorted(r.lang for r in stored.select("lang").distinct().collect())
    if not languages:
        return CentroidModel([], np.zeros((0, dims), np.float32), np.zeros((0, LENGTHS)), idf)
    stage = Stage(languages, idf, np.zeros((len(languages), clusters, dims)), np.zeros((len(languages), clusters), bool))
    size = np.zeros((len(languages), clusters))

    def move(totals: dict[int, np.ndarray]) -> None:
        for slot, total in totals.items():
            at, x = divmod(slot, clusters), total / UNIT
            size[at] = np.linalg.norm(x)
            stage.centers[at], stage.live[at] = x / max(size[at], 1e-12), True

    # The row nearest to the middle, then farthest first: rows that equal a seed are none.
    move(_sums(stored, stage, True))
    for k in range(clusters):
        for lang, (cosine, vector) in _farthest(stored, stage, k == 0).items():
            if k == 0 or (stage.live[lang, k - 1] and cosine <= 1 - 1e-6):
                stage.centers[lang, k], stage.live[lang, k] = vector, True
    last: dict[int, np.ndarray] = {}
    for _ in range(rounds):
        before, totals = stage.centers.copy(), _sums(stored, stage, False)
        if last.keys() == totals.keys() and all((last[x] == totals[x]).all() for x in totals):
            break  # the same rows as before: nothing moves any more
        last = totals
        size[:] = 0
        move(totals)
    limits = _limits(stored, stage, before, size)
    found = sorted(((lang, stage.centers[k, j].astype(np.float32)) for k, lang in enumerate(stage.languages) for j in np.flatnonzero(stage.live[k])), key=lambda x: (x[0], x[1].tobytes()))
    return CentroidModel([lang for lang, _ in found], np.stack([c for _, c in found]), np.stack([limits[lang] for lang, _ in found]), idf)


def predict(docs: DataFrame, model: CentroidModel, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred, score (cosine of the nearest centroid), rejected (too far from every centroid).

    Columns named in ``keep`` go along with their row; no prediction looks at them.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    chosen = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("_text"), *(F.col(c).alias(f"_keep{k}") for k, c in enumerate(keep)))
    names = [*(f.name for f in chosen.schema.fields if f.name != "_text"), "lang_pred", "score", "rejected"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        dims = m.centroids.shape[1]
        for batch in batches:
            for a in range(0, batch.num_rows, 128):
                part = batch.column(1).slice(a, 128).to_pylist()
                lang, score, rejected = ["und"] * len(part), [0.0] * len(part), [True] * len(part)
                ok = [k for k, t in enumerate(part) if t and LETTER.search(t)] if len(m.languages) else []
                if ok:
                    counts = np.stack([count_grams(part[k], dims) for k in ok])
                    near = weigh(counts, m.idf) @ m.centroids.T
                    for k, j, s, v in zip(ok, near.argmax(1).tolist(), near.max(1).tolist(), length_of(counts).tolist(), strict=True):
                        lang[k], score[k], rejected[k] = m.languages[j], min(1.0, max(0.0, s)), bool(s < m.limits[j, v])
                kept = [c.slice(a, 128) for k, c in enumerate(batch.columns) if k != 1]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=names)

    schema = T.StructType([f for f in chosen.schema.fields if f.name != "_text"]).add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    found = chosen.mapInArrow(run, schema)
    own = [F.col("_id").alias("doc_id")] if "doc_id" not in keep else []
    return found.select(*own, *(F.col(f"_keep{k}").alias(c) for k, c in enumerate(keep)), "lang_pred", "score", "rejected")


def identify(docs: DataFrame) -> DataFrame:
    """Learn from all rows not held out, then predict every row; adds held_out."""
    found = predict(docs, fit(docs.where(~held_out(F.col("doc_id")))))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def accepted(docs: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """``columns`` of the rows whose language is accepted, by a model learnt as for :func:`identify`. Verdicts stay with their rows."""
    return predict(docs, fit(docs.where(~held_out(F.col("doc_id")))), columns).where("not rejected").select(*columns)
