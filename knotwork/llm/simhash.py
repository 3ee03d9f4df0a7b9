"""SimHash near-duplicates by anchor points of a covering code.

Anchors are the codewords of a product of two binary Golay codes [23, 12, 7] on the first 46 fingerprint
bits. The Golay code is perfect with covering radius 3, so every fingerprint has exactly one home anchor
within (3, 3). If two fingerprints differ in at most ``t`` bits, the second lies within (3 + e1, 3 + e2) of
the first one's home with e1 + e2 <= t. Each distinct fingerprint is therefore copied to every anchor with
that excess (61 of the 2^24 anchors on average for t = 2), and each anchor compares its home fingerprints
with all of its copies on all 64 bits. No pair can be missed, and none is emitted: a task keeps only a
spanning forest of the links it finds. Components of the forest are found by star steps.

Equal fingerprints are folded into one row before anything is copied, so a group of exact copies of any size
costs one fingerprint. Copies at anchors where no fingerprint is at home, or only one row meets, are dropped by
a join on the anchors' counts before they are dealt out. What an anchor has left is a grid of cells, each some
``HOMES`` of its home fingerprints against some ``COPIES`` of its copies, and every cell is dealt out on its
own: an anchor of any size is many tasks' work, all of one bound, and every home meets every copy in one cell.

Defined results: null, empty and blank texts have fingerprint zero, linked like any other; texts with fewer
than three words hash as one sequence; repeated doc_ids give a row each; a null doc_id counts in no minimum;
an empty table gives no row; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import star_components
from ..session import materialize
from .common import LOWER, per_text, ragged, texts

SHINGLE = 3
SEED = 42
#: Generator polynomial of the binary Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GOLAY = 0b110001110101
BLOCK, CHECK_BITS, RADIUS = 23, 11, 3
#: Sides of a cell: what an anchor's home fingerprints and its copies are cut into.
HOMES, COPIES = 1 << 10, 1 << 13
PAIRS_AT_ONCE = 1 << 19
ROWS_AT_ONCE = 1 << 17
NO_ID = -(1 << 63)  # stands for a null doc_id where rows are joined
NONE = np.zeros(0, np.int64)


def fingerprint(text: bytes | None) -> int:
    """The 64-bit SimHash of a text's word shingles, as a signed number."""
    words = text.translate(LOWER).split() if text else []
    if not words:
        return 0
    line = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda a, n: a + n + 1))
    starts = [0, *(e + 1 for e in ends[:-1])]
    digest = xxhash.xxh64_digest
    hashes = [digest(line[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :])] if len(words) > SHINGLE else [digest(line, SEED)]
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 14):
        bits = np.unpackbits(np.frombuffer(b"".join(hashes[a : a + (1 << 14)]), np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, mark): fp is the fingerprint as a signed 64-bit number, mark a hash that tells texts of one id apart."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), ("mark", pa.int64())])
    one = lambda t: (fingerprint(t), text_mark(t))
    return texts(docs).mapInArrow(per_text(one, schema), "doc_id long, fp long, mark long")


def text_mark(text: bytes | None) -> int:
    """A signed 64-bit hash of a whole text; 0 for none."""
    return 0 if text is None else int.from_bytes(xxhash.xxh3_64_digest(text), "big", signed=True)


def remainder(x: int) -> int:
    """Remainder of a 23-bit word modulo the generator: its syndrome."""
    for bit in range(BLOCK - 1, CHECK_BITS - 1, -1):
        if x >> bit & 1:
            x ^= GOLAY << (bit - CHECK_BITS)
    return x


#: Syndromes are linear: that of a word is that of its high part and that of its low part, added bit by bit.
HALF = 12
LOW_SYNDROMES = np.array([remainder(x) for x in range(1 << HALF)], np.int64)
HIGH_SYNDROMES = np.array([remainder(x << HALF) for x in range(1 << (BLOCK - HALF))], np.int64)


def syndrome(x: np.ndarray) -> np.ndarray:
    return HIGH_SYNDROMES[x >> HALF] ^ LOW_SYNDROMES[x & ((1 << HALF) - 1)]


@cache
def coset_patterns(excess: int) -> tuple[np.ndarray, np.ndarray]:
    """Error patterns of weight RADIUS + excess (at most RADIUS for none), sorted by syndrome; each syndrome's first place."""
    weights = range(RADIUS + 1) if excess == 0 else [RADIUS + excess]
    p = np.array([sum(1 << b for b in c) for w in weights for c in combinations(range(BLOCK), w)], np.int64)
    s = syndrome(p)
    order = np.argsort(s, kind="stable")
    return p[order], np.searchsorted(s[order], np.arange((1 << CHECK_BITS) + 1))


def blocks(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two 23-bit words of fingerprints that the code covers."""
    u = fp.astype(np.uint64)
    return (u & np.uint64(0x7FFFFF)).astype(np.int64), ((u >> np.uint64(BLOCK)) & np.uint64(0x7FFFFF)).astype(np.int64)


def home(fp: np.ndarray) -> np.ndarray:
    """The anchor within (RADIUS, RADIUS) of each fingerprint, as a 46-bit number."""
    patterns, _ = coset_patterns(0)
    x, y = blocks(fp)
    return (x ^ patterns[syndrome(x)]) << BLOCK | (y ^ patterns[syndrome(y)])


def anchors_of(fp: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, index into fp) of every copy that the threshold asks for."""
    x, y = blocks(fp)
    sx, sy = syndrome(x), syndrome(y)
    anchors, owners = [], []
    for e1 in range(threshold + 1):
        patterns, first = coset_patterns(e1)
        at, owner = ragged(first[sx], first[sx + 1] - first[sx])
        c1 = x[owner] ^ patterns[at]
        for e2 in range(threshold + 1 - e1):
            patterns2, first2 = coset_patterns(e2)
            at2, owner2 = ragged(first2[sy[owner]], first2[sy[owner] + 1] - first2[sy[owner]])
            anchors.append(c1[owner2] << BLOCK | (y[owner][owner2] ^ patterns2[at2]))
            owners.append(owner[owner2])
    return np.concatenate(anchors), np.concatenate(owners)


def copies(threshold: int):
    """mapInArrow body: distinct fingerprints to (anchor, fp, at_home)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for a in range(0, len(fp), 2048):
                part = fp[a : a + 2048]
                anchor, owner = anchors_of(part, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(part[owner]), pa.array(home(part)[owner] == anchor)], names=["anchor", "fp", "at_home"])

    return run


def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow body: distinct fingerprints to their home anchors."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(home(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)))], names=["anchor"])


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning star for each component of the edges (a, b): (vertex, smallest vertex of its component)."""
    node, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(node))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while (jump := new[new]).tolist() != new.tolist():
            new = jump
        if (new == label).all():
            break
        label = new
    keep = label != np.arange(len(node))
    return node[keep], node[label[keep]]


def links_in(cell: np.ndarray, side: np.ndarray, fp: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between homes (side 1) and copies (side 0) of each cell; rows come in any order."""
    order = np.lexsort((side, cell))
    cell, side, fp = cell[order], side[order], fp[order]
    first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else NONE
    group = np.repeat(np.arange(len(first)), np.diff(np.concatenate([first, [len(cell)]])))
    others = np.bincount(group[side == 0], minlength=len(first))  # copies come first in each cell
    mine = np.flatnonzero((side == 1) & (others[group] > 0)) if len(cell) else NONE
    out: list[tuple[np.ndarray, np.ndarray]] = []
    pairs = np.cumsum(others[group[mine]])
    for part in np.split(mine, np.flatnonzero(np.diff(pairs // PAIRS_AT_ONCE)) + 1) if len(mine) else []:
        other, owner = ragged(first[group[part]], others[group[part]])
        x, y = fp[part][owner], fp[other]
        near = (np.bitwise_count((x ^ y).view(np.uint64)) <= threshold) & (x != y)
        if near.any():
            out.append(forest(x[near], y[near]))
    if not out:
        return NONE, NONE
    return forest(np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out]))


def compare(threshold: int):
    """mapInArrow body: rows (cell, side, fp) sorted by cell to links (a, b).

    Works on pieces of ROWS_AT_ONCE rows or more that end between two cells; a cell is bounded, so memory does
    not grow with an anchor or a partition.
    """

    def links(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        a, b = links_in(*(np.concatenate([h[k] for h in held]) for k in range(3)), threshold)
        for k in range(0, len(a), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(a[k : k + 10_000]), pa.array(b[k : k + 10_000])], names=["src", "dst"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            rows = tuple(batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            if n >= ROWS_AT_ONCE:
                change = np.flatnonzero(rows[0] != held[-1][0][-1])
                if len(change):
                    k = int(change[0])
                    yield from links([*held, tuple(r[:k] for r in rows)])
                    held, n, rows = [], 0, tuple(r[k:] for r in rows)
            if len(rows[0]):
                held.append(rows)
                n += len(rows[0])
        if held:
            yield from links(held)

    return run


def cells(distinct: DataFrame, threshold: int) -> DataFrame:
    """(cell, side, fp): side 1 for a home fingerprint of the cell's anchor, 0 for a copy it is compared with.

    A cell is named by a hash of its anchor and its place in the anchor's grid. Two cells of one name, should
    that ever happen, are compared as one, which adds no link that is not there.
    """
    fps = distinct.select("fp")
    at_home = fps.mapInArrow(homes, "anchor long").groupBy("anchor").agg(F.count("*").alias("n_homes"))
    met = materialize(fps.mapInArrow(copies(threshold), "anchor long, fp long, at_home boolean").join(at_home, "anchor"), "met")
    size = met.groupBy("anchor").agg(F.count("*").alias("n_copies")).where("n_copies > 1")
    part = lambda n, bound: F.ceil(F.col(n) / bound).cast("int")
    pick = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "fp"), F.col(n)).cast("int")
    grid = met.join(size, "anchor").select("anchor", "fp", "at_home", part("n_homes", HOMES).alias("rows"), part("n_copies", COPIES).alias("cols"))
    name = lambda r, c: F.xxhash64("anchor", r, c).alias("cell")
    copied = grid.select("anchor", "fp", pick(1, "cols").alias("c"), F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("r")).select(name("r", "c"), F.lit(0).alias("side"), "fp")
    owned = grid.where("at_home").select("anchor", "fp", pick(2, "rows").alias("r"), F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("c")).select(name("r", "c"), F.lit(1).alias("side"), "fp")
    return copied.unionByName(owned)


def link_components(distinct: DataFrame, threshold: int = 2) -> DataFrame:
    """(fp, root) of every fingerprint that links to another; ``distinct`` has one row per fingerprint."""
    links = cells(distinct, threshold).repartition("cell").sortWithinPartitions("cell").mapInArrow(compare(threshold), "src long, dst long")
    return star_components(links).withColumnsRenamed({"node": "fp", "component": "root"})


def near_duplicates(docs: DataFrame, threshold: int = 2) -> DataFrame:
    """One row per document: doc_id, fp, component_id (the smallest doc_id that links reach), root (a fingerprint of it), mark."""
    fps = materialize(fingerprints(docs), "fingerprints")
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    linked = distinct.join(link_components(distinct, threshold), "fp")
    roots = linked.groupBy("root").agg(F.min("low").alias("component_id"))
    of = linked.join(roots, "root").select("fp", "root", "component_id")
    # Written out, so that both sides of the last join are shuffles, whose hot partitions Spark can split.
    every = materialize(distinct.join(of, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "low").alias("component_id")), "classes")
    return fps.join(every, "fp").select("doc_id", "fp", "component_id", "root", "mark")


def survivors(docs: DataFrame, columns: tuple[str, ...], threshold: int = 2) -> DataFrame:
    """``columns`` of one row of each group of near-duplicates: the one with the smallest doc_id, null ids last.

    Of several texts under that id the one with the smallest hash stays, of equal rows any one.
    """
    low = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "mark")).alias("s")
    stays = near_duplicates(docs, threshold).groupBy("root").agg(low).select(F.coalesce("s.doc_id", F.lit(NO_ID)).alias("_id"), F.col("s.mark").alias("_mark"))
    schema = docs.select(*columns).schema
    at = columns.index("text")

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(at).cast(pa.binary())
            for a in range(0, batch.num_rows, 512):
                marks = [text_mark(t) for t in text.slice(a, 512).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(c.slice(a, 512) for c in batch.columns), pa.array(marks, pa.int64())], names=[*columns, "_mark"])

    rows = docs.select(*columns).mapInArrow(marked, T.StructType(list(schema.fields)).add("_mark", "long")).withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)))
    return rows.join(stays.hint("merge"), ["_id", "_mark"], "left_semi").dropDuplicates(["_id", "_mark"]).select(*columns)


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
