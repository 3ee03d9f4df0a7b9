"""Removal of repeated byte strings by sharded suffix sorting.

A byte goes if a string of ``window`` bytes that covers it also starts earlier: in a smaller doc_id, or earlier
in the same document. Equal windows have to meet in one shard, whole shards far larger than memory included:

1. Every window has an anchor, the ``gram``-byte substring with the smallest hash in it (the leftmost of equal
   ones). It depends on the window's bytes alone, so equal windows have equal anchors at equal offsets.
   Consecutive windows with one anchor form a fragment, and each window lies in exactly one fragment.
2. Fragments go, as hashes and places, to their anchor's shard. Of equal fragments all but the first go whole.
   A task folds the equal fragments that it sees before it sends them, so a passage that a third of all
   documents share costs a shard one row per fold, not one per document.
3. Where one anchor has several different fragments, the first occurrence of each sends its bytes to the
   anchor's shard, which sorts all their suffixes by :mod:`induced_sort` with common-prefix values. Windows in
   one run of common prefixes of at least ``window`` bytes are equal; all but the first of them go.
   An anchor with more than ``hot`` different fragments would be one task's work; its windows are told apart
   one by one instead: each is folded like a fragment of its own, in a shard by its own hash.
4. The ranges of a document meet its text again, are merged, and cut out.

Nothing about a document is judged from what is left of another: all ranges come from the input.

Defined results: null and empty texts lose nothing; a document shorter than the window loses nothing; rows
with equal doc_ids count as the same place, so a repeated row is no earlier occurrence of itself, and the
ranges found for an id are cut from each of its rows as far as they fit; a null doc_id sorts before all others;
an empty table gives no row; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import texts
from .induced_sort import suffix_order

WINDOW, GRAM = 100, 32
NO_ID = -(1 << 63)
BLOCK_BYTES = 1 << 20  # of text whose fragments are found at once
SORT_BYTES = 2 << 20  # of fragments whose suffixes are sorted at once
FOLD_ROWS = 1 << 19  # fragments that are folded at once
POSITION_BITS = 24
CUT, SHOWN = 1, 0  # kinds of rows
HOT_FRAGMENTS = 100_000  # different fragments of one anchor (about 15 MB) that one task may sort


def mixed(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def gram_hashes(data: bytes, gram: int) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes (a multiple of 8) at each place."""
    n = len(data) - gram + 1
    load = lambda k: np.ndarray((n,), "<u8", data, k, (1,))
    h = mixed(load(0))
    for k in range(8, gram, 8):
        h = mixed(h + load(k) * np.uint64(0xC2B2AE3D27D4EB4F))
    return mixed(h ^ (h >> np.uint64(32)))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive numbers, by doubling."""
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (width - done)], x[width - done :]) if width > done else x


def fragments(data: bytes, ends: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window, last window) of the fragments of texts put together; ``ends`` of the texts."""
    if len(data) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes = gram_hashes(data, gram)
    mask = np.uint64((1 << POSITION_BITS) - 1)
    place = sliding_min((hashes & ~mask) | np.arange(len(hashes), dtype=np.uint64), window - gram + 1) & mask
    count = len(data) - window + 1
    inside = np.zeros(len(data) + 1, np.int8)  # whether a window that starts here ends within its text
    starts = np.concatenate([[0], ends[:-1]])
    whole = ends - starts >= window
    inside[starts[whole]] += 1
    inside[ends[whole] - window + 1] -= 1
    ok = np.cumsum(inside)[:count] > 0
    edge = np.concatenate([[True], (place[1:] != place[:-1]) | (ok[1:] != ok[:-1])])
    # Texts that follow each other without a gap cannot share an anchor, but may lie side by side.
    edge[starts[whole]] = True
    first = np.flatnonzero(edge)
    last = np.concatenate([first[1:], [count]]) - 1
    keep = ok[first]
    first, last = first[keep], last[keep]
    return hashes[place[first].astype(np.int64)].view(np.int64), first, last


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    change = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return change[::2], change[1::2]


def first_of_groups(*keys: np.ndarray) -> np.ndarray:
    """Where a new group begins in sorted key columns."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def fold(g: np.ndarray, f: np.ndarray, doc: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of equal fragments: indices of the first ones, and of those that start later."""
    order = np.lexsort((start, doc, f, g))
    new = first_of_groups(g[order], f[order])
    head = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    later = (doc[order] > doc[head]) | (start[order] > start[head])
    return order[new], order[~new & later]


ROW_DDL = "shard long, kind int, g long, f long, doc_id long, start long, size int"
ROW_NAMES = ["shard", "kind", "g", "f", "doc_id", "start", "size"]


def rows_of(kind: int, shard: np.ndarray, g: np.ndarray, f: np.ndarray, doc: np.ndarray, start: np.ndarray, size: np.ndarray) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(doc), 50_000):
        cut = slice(a, a + 50_000)
        yield pa.RecordBatch.from_arrays([pa.array(shard[cut]), pa.array(np.full(len(doc[cut]), kind, np.int32)), *(pa.array(x[cut]) for x in (g, f, doc, start)), pa.array(size[cut].astype(np.int32))], names=ROW_NAMES)


def find_fragments(window: int, gram: int):
    """mapInArrow body: (doc_id, text) to folded fragments, and ranges that go already."""

    def located(docs: list[int], parts: list[bytes], offsets: list[int]) -> tuple[np.ndarray, ...]:
        data = b"".join(parts)
        ends = np.cumsum([len(p) for p in parts])
        g, first, last = fragments(data, ends, window, gram)
        owner = np.searchsorted(ends, first, side="right")
        digest = xxhash.xxh3_64_intdigest
        view = memoryview(data)
        f = np.array([digest(view[a:b]) for a, b in zip(first.tolist(), (last + window).tolist(), strict=True)], np.uint64).view(np.int64)
        start = first - (ends - np.array([len(p) for p in parts]))[owner] + np.array(offsets, np.int64)[owner]
        return g, f, np.array(docs, np.int64)[owner], start, last - first + window

    def flush(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        g, f, doc, start, size = (np.concatenate([h[k] for h in held]) for k in range(5))
        kept, later = fold(g, f, doc, start, size)
        yield from rows_of(SHOWN, g[kept], g[kept], f[kept], doc[kept], start[kept], size[kept])
        zero = np.zeros(len(later), np.int64)
        yield from rows_of(CUT, f[later] ^ start[later], zero, zero, doc[later], start[later], size[later])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        docs, parts, offsets, size, n = [], [], [], 0, 0
        for batch in batches:
            text = batch.column(1).cast(pa.binary())
            for a in range(0, batch.num_rows, 256):
                for doc, t in zip(batch.column(0).slice(a, 256).to_pylist(), text.slice(a, 256).to_pylist(), strict=True):
                    if not t or len(t) < window:
                        continue
                    # A long text goes in overlapping pieces; each window lies in exactly one of them.
                    for b in range(0, len(t) - window + 1, 4 * BLOCK_BYTES):
                        piece = t[b : b + 4 * BLOCK_BYTES + window - 1]
                        docs.append(NO_ID if doc is None else doc)
                        parts.append(piece)
                        offsets.append(b)
                        size += len(piece)
                        if size >= BLOCK_BYTES:
                            held.append(located(docs, parts, offsets))
                            n += len(held[-1][0])
                            docs, parts, offsets, size = [], [], [], 0
                        if n >= FOLD_ROWS:
                            yield from flush(held)
                            held, n = [], 0
        if parts:
            held.append(located(docs, parts, offsets))
        if held:
            yield from flush(held)

    return run


def judge_fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow body: a shard's rows, sorted by shard, to ranges that go, and to fragments whose anchor has several texts.

    Works on pieces of FOLD_ROWS rows or more that end between two anchors, so memory does not grow with the shard.
    """

    def judged(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        g, f, doc, start, size = (np.concatenate([h[k] for h in held]) for k in range(5))
        kept, later = fold(g, f, doc, start, size)
        zero = np.zeros(len(later), np.int64)
        yield from rows_of(CUT, zero, zero, zero, doc[later], start[later], size[later])
        new = first_of_groups(g[kept])
        group = np.cumsum(new) - 1
        kept = kept[(np.bincount(group, minlength=1)[group] > 1)] if len(kept) else kept
        yield from rows_of(SHOWN, g[kept], g[kept], f[kept], doc[kept], start[kept], size[kept])

    held: list[list[np.ndarray]] = []
    n = 0
    for batch in batches:
        kind = batch.column(1).to_numpy(zero_copy_only=False)
        cut = batch.filter(pa.array(kind == CUT))
        if cut.num_rows:
            yield cut
        shown = kind == SHOWN
        rows = [batch.column(k).to_numpy(zero_copy_only=False)[shown] for k in range(2, 7)]
        if n >= FOLD_ROWS and len(rows[0]):
            # Rows of the anchor that was read last may go on; what follows the next change is a new piece.
            last = held[-1][0][-1]
            change = np.flatnonzero(rows[0] != last)
            if len(change):
                k = int(change[0])
                yield from judged([*held, [r[:k] for r in rows]])
                held, n, rows = [], 0, [r[k:] for r in rows]
        if len(rows[0]):
            held.append(rows)
            n += len(rows[0])
    if held:
        yield from judged(held)


def cut_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow body: (doc_id, text, places) to the bytes of the places."""
    names = ["g", "doc_id", "start", "bytes"]
    for batch in batches:
        g, doc, at, out = [], [], [], []
        for d, text, places in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
            for p in places if text else ():
                g.append(p["g"])
                doc.append(d)
                at.append(p["start"])
                out.append(text[p["start"] : p["start"] + p["size"]])
            if len(g) >= 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(doc, pa.int64()), pa.array(at, pa.int64()), pa.array(out, pa.binary())], names=names)
                g, doc, at, out = [], [], [], []
        if g:
            yield pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(doc, pa.int64()), pa.array(at, pa.int64()), pa.array(out, pa.binary())], names=names)


def split_windows(window: int):
    """mapInArrow body: bytes of hot anchors' fragments to their single windows, folded."""

    def flush(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        g, f, doc, start = (np.concatenate([h[k] for h in held]) for k in range(4))
        size = np.full(len(g), window, np.int64)
        kept, later = fold(g, f, doc, start, size)
        yield from rows_of(SHOWN, g[kept] ^ f[kept], g[kept], f[kept], doc[kept], start[kept], size[kept])
        zero = np.zeros(len(later), np.int64)
        yield from rows_of(CUT, f[later] ^ start[later], zero, zero, doc[later], start[later], size[later])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        held, n = [], 0
        for batch in batches:
            for g, d, a, t in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                count = len(t) - window + 1
                f = np.array([digest(t[k : k + window]) for k in range(count)], np.uint64).view(np.int64)
                held.append((np.full(count, g), f, np.full(count, d), np.arange(a, a + count)))
                n += count
                if n >= FOLD_ROWS:
                    yield from flush(held)
                    held, n = [], 0
        if held:
            yield from flush(held)

    return run


def repeated_windows(doc: np.ndarray, start: np.ndarray, parts: list[bytes], window: int, memory: int = 1 << 22) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges (doc, start, end) of windows in these fragments that also start earlier in one of them."""
    size = np.array([len(p) for p in parts], np.int64)
    text = np.empty(int(size.sum()) + len(parts) + 1, np.int16)
    ends = np.cumsum(size + 1)
    raw = np.frombuffer(b"\x00".join(parts) + b"\x00", np.uint8)
    text[:-1] = raw
    text[:-1] += 2
    text[ends - 1] = 1
    text[-1] = 0
    order, common = suffix_order(text, window, memory)
    owner_at = np.searchsorted(ends, order, side="right")
    ok = order < len(text) - 1
    owner = np.where(ok, owner_at, 0)
    ok &= ends[owner] - 1 - order >= window
    group = np.cumsum(common < window)[ok]
    place, owner = order[ok], owner[ok]
    d, s = doc[owner], start[owner] + place - (ends[owner] - 1 - size[owner])
    by = np.lexsort((s, d, group))
    new = first_of_groups(group[by])
    head = by[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(by) else by
    later = by[(d[by] > d[head]) | (s[by] > s[head])] if len(by) else by
    mark = np.zeros(len(text), bool)
    mark[place[later]] = True
    a, b = runs(mark)
    owner = np.searchsorted(ends, a, side="right")
    shift = start[owner] - (ends[owner] - 1 - size[owner])
    return doc[owner], a + shift, b + shift + window - 1


def sort_shard(window: int, memory: int):
    """mapInArrow body: a shard's fragments, sorted by anchor, to ranges that go.

    Only fragments of one anchor can hold equal windows, so the stream is sorted in pieces of about SORT_BYTES
    that end between two anchors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc: list[int] = []
        start: list[int] = []
        parts: list[bytes] = []
        size, last = 0, None

        def ranges() -> pa.RecordBatch:
            d, a, b = repeated_windows(np.array(doc, np.int64), np.array(start, np.int64), parts, window, memory)
            return pa.RecordBatch.from_arrays([pa.array(d), pa.array(a), pa.array(b - a)], names=["doc_id", "start", "size"])

        for batch in batches:
            for g, d, a, t in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if size >= SORT_BYTES and g != last:
                    yield ranges()
                    doc, start, parts, size = [], [], [], 0
                doc.append(d)
                start.append(a)
                parts.append(t)
                size += len(t)
                last = g
        if parts:
            yield ranges()

    return run


def repeated_ranges(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, memory: int = 1 << 22, hot: int = HOT_FRAGMENTS) -> DataFrame:
    """(doc_id, start, size): byte ranges that go; they may overlap. A null id is given as the least long."""
    text = texts(docs)
    found = text.mapInArrow(find_fragments(window, gram), ROW_DDL).repartition("shard").sortWithinPartitions("shard", "g").mapInArrow(judge_fragments, ROW_DDL)
    found = materialize(found, "fragments")
    shown = found.where(F.col("kind") == SHOWN)
    places = shown.groupBy("doc_id").agg(F.collect_list(F.struct("g", "start", "size")).alias("places"))
    named = text.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text")
    pieces = named.join(places, "doc_id").select("doc_id", "text", "places").mapInArrow(cut_bytes, "g long, doc_id long, start long, bytes binary")
    hot_anchors = shown.groupBy("g").count().where(F.col("count") > hot).select("g")
    split = None
    if not hot_anchors.isEmpty():
        pieces = materialize(pieces, "pieces")
        apart = pieces.join(hot_anchors, "g", "left_semi").select("g", "doc_id", "start", "bytes")
        split = apart.mapInArrow(split_windows(window), ROW_DDL).repartition("shard").sortWithinPartitions("shard", "g").mapInArrow(judge_fragments, ROW_DDL)
        pieces = pieces.join(hot_anchors, "g", "left_anti")
    whole = pieces.repartition("g").sortWithinPartitions("g").select("g", "doc_id", "start", "bytes").mapInArrow(sort_shard(window, memory), "doc_id long, start long, size long")
    ranges = [x.where(F.col("kind") == CUT).select("doc_id", "start", F.col("size").cast("long").alias("size")) for x in (found, split) if x is not None]
    for r in ranges:
        whole = whole.unionByName(r)
    return whole


def cut_ranges(text: bytes, ranges: list[tuple[int, int]]) -> tuple[bytes, int]:
    """The text without the ranges (start, size), and how many maximal runs went."""
    kept, at, n, end = [], 0, 0, -1
    for a, size in sorted(ranges):
        b = min(a + size, len(text))
        if a >= b:
            continue
        if a > end:
            kept.append(text[at:a])
            n += 1
        end = max(end, b)
        at = end
    kept.append(text[at:])
    return b"".join(kept), n


def dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT_FRAGMENTS) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes)."""
    ranges = repeated_ranges(docs, window, gram, hot=hot).groupBy("doc_id").agg(F.collect_list(F.struct("start", "size")).alias("ranges"))
    named = texts(docs).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text")
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                out = []
                for d, text, gone in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), part.column(2).to_pylist(), strict=True):
                    text = text or b""
                    kept, n = cut_ranges(text, [(r["start"], r["size"]) for r in gone or ()])
                    out.append((None if d == NO_ID else d, len(text), len(text) - len(kept), n, kept))
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), schema, strict=True)], schema=schema)

    return named.join(ranges, "doc_id", "left").select("doc_id", "text", "ranges").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def digest(deduped: DataFrame) -> DataFrame:
    return deduped.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


