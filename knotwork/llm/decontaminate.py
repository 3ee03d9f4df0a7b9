"""Benchmark decontamination with a distributed positional inverted index.

The index is cut by document, as search engines cut theirs into segments: each row of the stored index is one
segment, the posting lists (word, sorted token positions) of all words of some megabytes of whole documents.
Positions count the words of the segment, with a gap between documents, so no phrase crosses one. It depends on
the documents alone: it is built once and serves any number of benchmarks.

Queries go to every segment. A window of consecutive benchmark words takes its rarest term (by document frequency
over all segments), shifts that term's positions by the term's offset in the window, and intersects them with the
next rarest terms' shifted lists, so that frequent words are looked up for few survivors. Proximity asks less: the
window's ``k`` rarest terms of those that occur at all have to lie within ``slop`` words of the rarest of them, in
any order. No shuffle and no hot key: a word that every document holds only makes its list longer in each segment.

The benchmark's vocabulary and windows are sent to all executors in blocks of ``block_bytes`` of item text; a
larger benchmark takes several passes over the stored index, whose hits are merged by row of the index.

Defined results: null and empty texts have no words and no hits; an item with fewer words than the window is one
window, one without words none; equal windows of several items count for each; an item without an id is searched
for, but not named; every row gives one row, repeated and null ids too; an empty benchmark leaves all clean;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import ragged, texts

#: Word bytes stay (A-Z lower-cased); every other ASCII byte becomes a space. Bytes over 0x7F are word bytes.
WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256)
)
SEGMENT_BYTES = 1 << 19  # of text; larger posting lists would be humongous objects of an executor
CANDIDATES_AT_ONCE = 1 << 20
GAP = 64  # positions between two documents: more than a window and the slop
NEAR = (5, 10)  # of a window's terms the five rarest, within ten words of the rarest
NO_ID = -(1 << 63)  # stands for a null doc_id within a segment


def words(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_BYTES).split() if text else []


@dataclass
class Windows:
    """One block of the benchmark: its vocabulary, and its windows as rows of term ids (-1 pads short ones)."""

    vocabulary: dict[bytes, int]
    terms: np.ndarray
    items: list[str]
    window_of: np.ndarray  # pairs: row of ``terms``
    item_of: np.ndarray  # and index into ``items``

    @classmethod
    def of(cls, items: list[tuple[object, bytes | None]], width: int) -> Windows:
        vocabulary: dict[bytes, int] = {}
        rows: dict[tuple[int, ...], int] = {}
        pairs: set[tuple[int, int]] = set()
        names = sorted({str(i) for i, _ in items if i is not None})
        place = {x: k for k, x in enumerate(names)}
        for item, text in items:
            ids = [vocabulary.setdefault(w, len(vocabulary)) for w in words(text)]
            for a in range(max(1, len(ids) - width + 1) if ids else 0):
                row = tuple(ids[a : a + width])
                at = rows.setdefault(row, len(rows))
                if item is not None:
                    pairs.add((at, place[str(item)]))
        terms = np.full((len(rows), width), -1, np.int32)
        for row, k in rows.items():
            terms[k, : len(row)] = row
        p = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        return cls(vocabulary, terms, names, p[:, 0], p[:, 1])


class Numbers(dict):
    """Words to numbers, in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def index_segments(gap: int):
    """mapInArrow body: documents to segments of posting lists."""

    def flush(ids: list[int], counts: list[int], tokens: list[np.ndarray], vocabulary: Numbers) -> pa.RecordBatch:
        lengths = np.array(counts, np.int64)
        starts = np.cumsum(lengths + gap) - (lengths + gap)
        flat = np.concatenate(tokens)
        position = np.arange(len(flat)) + np.repeat(np.arange(len(counts)) * gap, counts)
        order = np.argsort(flat, kind="stable")
        n = np.bincount(flat, minlength=len(vocabulary))
        owner = np.repeat(np.arange(len(counts)), counts)[order]
        term = flat[order]
        new = np.ones(len(flat), bool)
        new[1:] = (term[1:] != term[:-1]) | (owner[1:] != owner[:-1])
        df = np.bincount(term[new], minlength=len(vocabulary))
        blob = lambda a, t: pa.array([np.ascontiguousarray(a, t).tobytes()], pa.binary())
        return pa.RecordBatch.from_arrays(
            [blob(ids, np.int64), blob(lengths, np.int32), pa.array([b" ".join(vocabulary)], pa.binary()), blob(df, np.int32), blob(n, np.int32), blob(position[order], np.int32)],
            names=["doc_ids", "lengths", "words", "dfs", "counts", "positions"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Numbers()
        ids, counts, tokens, held = [], [], [], 0
        for batch in batches:
            text = batch.column(1).cast(pa.binary())
            for a in range(0, batch.num_rows, 256):
                for doc, t in zip(batch.column(0).slice(a, 256).to_pylist(), text.slice(a, 256).to_pylist(), strict=True):
                    found = words(t)
                    ids.append(NO_ID if doc is None else doc)
                    counts.append(len(found))
                    tokens.append(np.fromiter(map(vocabulary.__getitem__, found), np.int32, len(found)))
                    held += len(t or b"") + 16
                    if held >= SEGMENT_BYTES:
                        yield flush(ids, counts, tokens, vocabulary)
                        vocabulary = Numbers()
                        ids, counts, tokens, held = [], [], [], 0
        if ids:
            yield flush(ids, counts, tokens, vocabulary)

    return run


SEGMENT_DDL = "doc_ids binary, lengths binary, words binary, dfs binary, counts binary, positions binary"


def build_index(docs: DataFrame, gap: int = GAP) -> DataFrame:
    """Store the index of ``docs`` in the shared folder: one numbered row per segment."""
    segments = texts(docs).mapInArrow(index_segments(gap), SEGMENT_DDL)
    return materialize(segments.withColumn("segment", F.monotonically_increasing_id()), "postings")


def asked_terms(row_words: bytes, vocabulary: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """(place in the segment's word list, benchmark term) of the words that the benchmark holds."""
    get = vocabulary.get
    term = np.array([get(w, -1) for w in row_words.split(b" ")] if row_words else [], np.int64)
    place = np.flatnonzero(term >= 0)
    return place, term[place]


def document_frequency(index: DataFrame, vocabulary: dict[bytes, int]) -> np.ndarray:
    """Document frequency of each term of a vocabulary over all segments."""
    shared = index.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value), np.int64)
        for batch in batches:
            for held, dfs in zip(batch.column(0), batch.column(1), strict=True):
                place, term = asked_terms(held.as_py(), shared.value)
                total[term] += np.frombuffer(dfs.as_py(), np.int32)[place]
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["term", "df"])

    out = np.zeros(len(vocabulary), np.int64)
    for row in index.select("words", "dfs").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[row.term] = row.df
    return out


class Segment:
    """Posting lists of one segment, for the terms that a benchmark holds, with lookups by (term, position)."""

    def __init__(self, row: dict, vocabulary: dict[bytes, int]):
        self.number = row.get("segment", 0)
        self.doc_ids = np.frombuffer(row["doc_ids"], np.int64)
        self.lengths = np.frombuffer(row["lengths"], np.int32).astype(np.int64)
        counts = np.frombuffer(row["counts"], np.int32).astype(np.int64)
        place, term = asked_terms(row["words"], vocabulary)
        by = np.argsort(term)
        self.terms, place = term[by], place[by]
        self.counts = counts[place]
        at, _ = ragged((np.cumsum(counts) - counts)[place], self.counts)
        self.positions = np.frombuffer(row["positions"], np.int32)[at].astype(np.int64)
        self.first = np.cumsum(self.counts) - self.counts
        self.keys = (np.repeat(self.terms, self.counts) << 32) | self.positions

    def slot(self, term: np.ndarray) -> np.ndarray:
        """Place of each term's list, or -1."""
        at = np.searchsorted(self.terms, term)
        at[at == len(self.terms)] = 0
        return np.where(self.terms[at] == term, at, -1) if len(self.terms) else np.full(len(term), -1)

    def has(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        key = (term.astype(np.int64) << 32) | position
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return (self.keys[at] == key) & (position >= 0) if len(self.keys) else np.zeros(len(key), bool)


def exact_matches(segment: Segment, terms: np.ndarray, order: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(window, start position) of every occurrence. ``order``: each window's offsets, rarest term first."""
    rare = np.take_along_axis(terms, order[:, :1], 1)[:, 0] if len(terms) else np.zeros(0, np.int32)
    slot = segment.slot(rare)
    alive = np.flatnonzero(slot >= 0)
    size = segment.counts[slot[alive]]
    block = np.cumsum(size) // CANDIDATES_AT_ONCE
    for b in np.unique(block):
        part = block == b
        w, s = alive[part], slot[alive[part]]
        at, owner = ragged(segment.first[s], segment.counts[s])
        window = w[owner]
        start = segment.positions[at] - order[window, 0]
        for k in range(1, terms.shape[1]):
            offset = order[window, k]
            term = terms[window, offset]
            keep = (term < 0) | segment.has(term, start + offset)
            window, start = window[keep], start[keep]
            if not len(window):
                break
        keep = start >= 0
        if keep.any():
            yield window[keep], start[keep]


def near_matches(segment: Segment, terms: np.ndarray, order: np.ndarray, rarest: int, slop: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(window, position) where the window's ``rarest`` terms all lie within ``slop`` words of the rarest one.

    ``order``: each window's offsets, rarest term that occurs anywhere first.
    """
    slot = segment.slot(np.take_along_axis(terms, order[:, :1], 1)[:, 0]) if len(terms) else np.zeros(0, int)
    alive = np.flatnonzero(slot >= 0)
    block = np.cumsum(segment.counts[slot[alive]]) // CANDIDATES_AT_ONCE
    for b in np.unique(block):
        w = alive[block == b]
        at, owner = ragged(segment.first[slot[w]], segment.counts[slot[w]])
        window, position = w[owner], segment.positions[at]
        for k in range(1, min(rarest, terms.shape[1])):
            term = terms[window, order[window, k]].astype(np.int64)
            low = np.searchsorted(segment.keys, (term << 32) | np.maximum(position - slop, 0))
            low[low == len(segment.keys)] = 0
            found = segment.keys[low]
            keep = (term < 0) | ((found >> 32 == term) & (found & 0xFFFFFFFF >= np.maximum(position - slop, 0)) & (found & 0xFFFFFFFF <= position + slop))
            window, position = window[keep], position[keep]
        if len(window):
            yield window, position


def query_segments(windows: Windows, df: np.ndarray, gap: int, near: tuple[int, int] | None, hits_only: bool):
    """mapInArrow body: segments to a row per document (per hit document if asked) with its hit words and items."""
    width = windows.terms.shape[1]
    last = np.iinfo(np.int64).max
    seen = np.where(windows.terms >= 0, df[windows.terms] if len(df) else 0, last)
    # A window with a word that no document holds has no exact match; for proximity such words come last.
    possible = np.flatnonzero((seen > 0).all(1))
    order = np.argsort(seen[possible], axis=1, kind="stable")
    near_order = np.argsort(np.where(seen == 0, last - 1, seen), axis=1, kind="stable")
    length = (windows.terms >= 0).sum(1)
    close_enough = np.flatnonzero(((seen > 0) & (windows.terms >= 0)).sum(1) >= np.minimum(length, near[0])) if near else possible[:0]
    by_window = np.searchsorted(windows.window_of, np.arange(len(windows.terms) + 1))

    def items_of(window: np.ndarray, doc: np.ndarray, n: int) -> list[list[str]]:
        pair = np.unique(doc.astype(np.int64) * max(1, len(windows.terms)) + window)
        doc, window = pair // max(1, len(windows.terms)), pair % max(1, len(windows.terms))
        at, owner = ragged(by_window[window], by_window[window + 1] - by_window[window])
        pair = np.unique(doc[owner] * max(1, len(windows.items)) + windows.item_of[at])
        out: list[list[str]] = [[] for _ in range(n)]
        for d, i in zip((pair // max(1, len(windows.items))).tolist(), (pair % max(1, len(windows.items))).tolist(), strict=True):
            out[d].append(windows.items[i])
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                segment = Segment({c: batch.column(c)[k].as_py() for c in batch.schema.names}, windows.vocabulary)
                n = len(segment.doc_ids)
                starts = np.cumsum(segment.lengths + gap) - (segment.lengths + gap)
                of = lambda position: np.searchsorted(starts, position, side="right") - 1
                edge = np.zeros(int((segment.lengths + gap).sum()) + width + 1, np.int64)
                hits = list(exact_matches(segment, windows.terms[possible], order))
                window = possible[np.concatenate([h[0] for h in hits])] if hits else np.zeros(0, np.int64)
                start = np.concatenate([h[1] for h in hits]) if hits else np.zeros(0, np.int64)
                np.add.at(edge, start, 1)
                np.add.at(edge, start + length[window], -1)
                hit = np.cumsum(edge) > 0
                change = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
                a, b = change[::2], change[1::2]
                spans: list[list[list[int]]] = [[] for _ in range(n)]
                for d, x, y in zip(of(a).tolist(), a.tolist(), b.tolist(), strict=True):
                    spans[d].append([x - int(starts[d]), y - int(starts[d])])
                exact = items_of(window, of(start), n)
                close: list[list[str]] = [[] for _ in range(n)]
                if near:
                    found = list(near_matches(segment, windows.terms[close_enough], near_order[close_enough], *near))
                    if found:
                        close = items_of(close_enough[np.concatenate([f[0] for f in found])], of(np.concatenate([f[1] for f in found])), n)
                keep = np.array([bool(spans[d] or close[d]) for d in range(n)], bool) if hits_only else np.ones(n, bool)
                shown = np.flatnonzero(keep).tolist()
                ids = segment.doc_ids[keep]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(shown), segment.number)), pa.array(shown, pa.int64()), pa.array(ids, mask=ids == NO_ID), pa.array(segment.lengths[keep]),
                        pa.array([spans[d] for d in shown], pa.list_(pa.list_(pa.int64()))), pa.array([exact[d] for d in shown], pa.list_(pa.string())), pa.array([close[d] for d in shown], pa.list_(pa.string())),
                    ],
                    names=["segment", "place", "doc_id", "n_words", "hit_spans", "items", "near_items"],
                )

    return run


HIT_DDL = "segment long, place long, doc_id long, n_words long, hit_spans array<array<long>>, items array<string>, near_items array<string>"
HIT_COLUMNS = ("doc_id", "n_words", "hit_spans", "items", "near_items")


def query_index(index: DataFrame, benchmark: DataFrame, width: int = 10, near: tuple[int, int] | None = None, block_bytes: int = 2 << 20, gap: int = GAP) -> DataFrame:
    """One row per indexed document: doc_id, n_words, hit_spans (word ranges covered by windows), items, near_items.

    ``near=(k, slop)`` also reports items some window of which has its ``k`` rarest terms of those that occur in
    any document within ``slop`` words of the rarest of them (all its terms, if it has fewer than ``k``).
    ``block_bytes`` bounds the item text that is sent to the executors at a time.
    """
    if width + (near[1] if near else 0) >= gap:
        raise ValueError(f"window and slop do not fit in the gap of {gap} between documents")
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    out: list[DataFrame] = []
    for b in range(blocks):
        mine = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        windows = Windows.of([(r.item_id, (r.text or "").encode()) for r in mine.collect()], width)
        df = document_frequency(index, windows.vocabulary)
        shared = index.sparkSession.sparkContext.broadcast((windows, df))
        body = lambda it, shared=shared, b=b: query_segments(*shared.value, gap, near, b > 0)(it)
        out.append(index.mapInArrow(body, HIT_DDL))
    if blocks == 1:
        return out[0].select(*HIT_COLUMNS)
    # The first block gives every row, the others those with hits; a row is known by its place in the index.
    every = out[0]
    for o in out[1:]:
        every = every.union(o)
    lists = (F.flatten(F.collect_list(c)).alias(c) for c in ("hit_spans", "items", "near_items"))
    merged = every.groupBy("segment", "place").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), *lists)
    last = lambda acc: F.element_at(acc, -1)
    joined = F.aggregate(
        F.sort_array("hit_spans"),
        F.array().cast("array<array<long>>"),
        lambda acc, x: F.when((F.size(acc) > 0) & (F.get(F.get(acc, F.size(acc) - 1), F.lit(1)) >= x[0]), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.array(last(acc)[0], F.greatest(last(acc)[1], x[1]))))).otherwise(F.concat(acc, F.array(x))),
    )
    return merged.select("doc_id", "n_words", joined.alias("hit_spans"), F.array_sort(F.array_distinct("items")).alias("items"), F.array_sort(F.array_distinct("near_items")).alias("near_items"))


def find_contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, near: tuple[int, int] | None = None, block_bytes: int = 2 << 20) -> DataFrame:
    """Index ``docs`` and query the index for ``benchmark``: see :func:`query_index`."""
    return query_index(build_index(docs), benchmark, width, near, block_bytes)


def digest(found: DataFrame) -> DataFrame:
    """The columns of the query, from the rows of :func:`find_contamination`."""
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda acc, s: acc + s[1] - s[0])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("hit_spans") > 0).alias("contaminated"),
        F.size("near_items").cast("long").alias("n_near"),
    )


