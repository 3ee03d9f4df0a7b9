"""Mixing sources to target weights.

The words of a source, its documents in order of doc_id, are one stream that is packed into blocks of ``BLOCK``
words (the last one shorter). Targets are quotas in words; a quota is a number of whole passes over the source's
blocks and a part of one more, its last block cut so that the quota is met to the word. Output shards have
``SHARD`` slots each. How many slots of a shard a source gets is a multinomial draw given that all shards together
meet the quotas: the slots are split over halves of the shards, again and again, and each half's counts are drawn
without replacement, by a generator seeded with the half. So every task draws its own shards, alike in every run.
The i-th slot of a pass takes the block that the pass's pseudorandom permutation (a Feistel network, walked until it
falls within the source) puts there; slots and blocks are then joined by source and block index.

Only sizes are sorted and joined: texts are read once to count words, and moved once where :func:`shard_texts` asks for
them. What the driver holds is a row per source, at most ``MAX_SOURCES``; more raise an error.

Defined results: null, empty and blank texts have no words and are never taken; documents without an id come first
in their source, repeated ids follow each other in order of their texts' hashes; equal rows are told apart and may
be taken differently; a null source is a source of its own, the last; sources without words have the target 0; an
empty table gives no row; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import group_key, sequenced

BLOCK = 1024  # words
SHARD = 4096  # slots
REPEATS = 3  # passes over a source at most
WEIGHTS = (1, 2, 3)  # of the sources by code point, again and again
SEED = 11
MAX_SOURCES = 100_000
SPACE = " \t\n\x0b\x0c\r"
EXACT_DRAWS = 10**9  # the generator draws without replacement from fewer; beyond, its normal limit is drawn
ROUNDS = 6

SLOTS_DDL = "shard long, slot int, source_index int, pass int, block long, words int"


def count_words(text):
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text column: each becomes one character, and those are counted."""
    return F.length(F.regexp_replace(F.ltrim(F.coalesce(text, F.lit("")), F.lit(SPACE)), "[^\\x20\\x09-\\x0D]++[\\x20\\x09-\\x0D]*+", ".")).cast("long")


def share_out(sizes: np.ndarray, weights: np.ndarray, repeats: int = REPEATS) -> np.ndarray:
    """Targets: all sizes shared by weight; what is above ``repeats`` times a source's size goes to the others, until none is above."""
    target, capped = np.zeros(len(sizes)), sizes <= 0
    while not capped.all():
        rest = int(sizes.sum()) - repeats * int(sizes[capped].sum())
        target = np.where(capped, repeats * sizes, weights * rest / weights[~capped].sum())
        above = ~capped & (target > repeats * sizes)
        if not above.any():
            break
        capped |= above
    return np.minimum(target, repeats * sizes)


def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    x = (x + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def permuted(index: np.ndarray, n: int, keys: tuple[int, ...], inverse: bool = False) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1, or its inverse, at some places."""
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = np.asarray(index).astype(np.uint64)
    walking = np.arange(len(out))
    while len(walking):
        left, right = out[walking] >> half, out[walking] & mask
        for key in reversed(keys) if inverse else keys:
            if inverse:
                left, right = right ^ (_mixed(left, key) & mask), left
            else:
                left, right = right, left ^ (_mixed(right, key) & mask)
        out[walking] = (left << half) | right
        walking = walking[out[walking] >= n]
    return out.astype(np.int64)


def round_keys(source: str, turn: int, seed: int) -> tuple[int, ...]:
    digest = hashlib.blake2b(f"{seed}:{turn}:{source}".encode(), digest_size=8 * ROUNDS).digest()
    return tuple(int.from_bytes(digest[i : i + 8], "little") for i in range(0, 8 * ROUNDS, 8))


@dataclass
class Source:
    """A source's blocks and slots; ``last`` is the number of words of its last slot."""

    name: str
    size: int
    quota: int
    block: int
    seed: int

    def __post_init__(self):
        self.blocks = -(-self.size // self.block)
        self.tail = self.size - (self.blocks - 1) * self.block
        self.slots = self.last = 0
        if not self.quota:
            return
        full, rest = divmod(self.quota, self.size)
        self.slots = full * self.blocks
        if rest:  # where in the last pass the short block stands decides how many blocks meet the rest
            at = int(permuted(np.array([self.blocks - 1]), self.blocks, self.keys(full), inverse=True)[0])
            if rest <= at * self.block:
                self.slots += -(-rest // self.block)
                self.last = (rest - 1) % self.block + 1
            elif rest <= at * self.block + self.tail:
                self.slots += at + 1
                self.last = rest - at * self.block
            else:
                beyond = rest - self.tail
                self.slots += 1 + -(-beyond // self.block)
                self.last = (beyond - 1) % self.block + 1

    def keys(self, turn: int) -> tuple[int, ...]:
        return round_keys(self.name, turn, self.seed)

    def take(self, first: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pass, block, words) of n slots from the first on."""
        slot = np.arange(first, first + n)
        turn = slot // self.blocks
        block = np.empty(n, np.int64)
        for t in np.unique(turn).tolist():
            block[turn == t] = permuted(slot[turn == t] % self.blocks, self.blocks, self.keys(t))
        words = np.where(block == self.blocks - 1, self.tail, self.block)
        if self.last:
            words[slot == self.slots - 1] = self.last
        return turn, block, words


def drawn(slots: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """How many of n slots drawn without replacement belong to each source."""
    out, rest = np.zeros_like(slots), int(slots.sum())
    for s in np.flatnonzero(slots).tolist():
        own, total = int(slots[s]), rest
        rest -= own
        if total < EXACT_DRAWS:
            got = int(rng.hypergeometric(own, rest, n)) if n else 0
        else:
            mean = n * own / total
            deviation = (mean * (rest / total) * ((total - n) / (total - 1))) ** 0.5
            got = min(max(round(rng.normal(mean, deviation)), n - rest, 0), own, n)
        out[s] = got
        n -= got
    return out


def fill_shards(sources: list[Source], wanted: tuple[int, int], shard: int, seed: int) -> Iterator[pa.RecordBatch]:
    """The slots of the shards from wanted[0] up to wanted[1]."""
    total = sum(s.slots for s in sources)

    def walk(a: int, b: int, which: np.ndarray, counts: np.ndarray, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        if b <= wanted[0] or wanted[1] <= a:
            return
        rng = np.random.default_rng([seed, a, b])
        if b - a == 1:
            taken = [(np.full(n, s), *sources[s].take(f, n)) for s, n, f in zip(which.tolist(), counts.tolist(), starts.tolist(), strict=True) if n]
            source, turn, block, words = (np.concatenate(c) for c in zip(*taken, strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(source), a)), pa.array(rng.permutation(len(source)).astype(np.int32)), pa.array(source.astype(np.int32)), pa.array(turn.astype(np.int32)), pa.array(block), pa.array(words.astype(np.int32))],
                names=["shard", "slot", "source_index", "pass", "block", "words"],
            )
            return
        middle = (a + b) // 2
        left = drawn(counts, min(middle * shard, total) - a * shard, rng)
        for lo, hi, n, first in ((a, middle, left, starts), (middle, b, counts - left, starts + left)):
            some = n > 0
            yield from walk(lo, hi, which[some], n[some], first[some])

    slots = np.array([s.slots for s in sources], np.int64)
    some = np.flatnonzero(slots)
    yield from walk(0, -(-total // shard), some, slots[some], np.zeros(len(some), np.int64))


@dataclass
class Mix:
    """``rows``: the documents, with row, doc_id, source, size, text_hash and the words before them in their source.
    ``sources``: source, weight, source_size, target, n_blocks, n_slots. ``fragments``: what the mix takes, a row per
    document and slot: shard, slot, place (of its first word in the slot), source_index, pass, block, row, doc_id,
    text_hash, word (of the document, from 0), n_words.
    """

    rows: DataFrame
    sources: DataFrame
    fragments: DataFrame


def mix(docs: DataFrame, block: int = BLOCK, shard: int = SHARD, repeats: int = REPEATS, weights: tuple[int, ...] = WEIGHTS, seed: int = SEED) -> Mix:
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), count_words(text).alias("size"), F.xxhash64(text).alias("text_hash"))
    rows, groups = sequenced(sized.withColumn("_group", group_key(F.col("source"), nulls_last=True)), "_group", ["doc_id", "text_hash", "size"], "size")
    groups = materialize(groups, "sources")
    if groups.count() > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: give documents coarser ones")
    found = sorted(map(tuple, groups.select("_group", "total").collect()), key=lambda g: g[0].encode())
    sizes, weight = np.array([t for _, t in found], np.int64), np.array([weights[i % len(weights)] for i in range(len(found))], np.int64)
    target = share_out(sizes, weight, repeats)
    sources = [Source(g, n, min(int(t + 0.5), repeats * n), block, seed) for (g, n), t in zip(found, target.tolist(), strict=True)]
    table = spark.createDataFrame(
        [(s.name, i, int(weight[i]), s.size, float(target[i]), s.blocks, s.slots) for i, s in enumerate(sources)],
        "_group string, source_index int, weight int, source_size long, target double, n_blocks long, n_slots long",
    )
    table = F.broadcast(table)
    rows = rows.join(table.select("_group", "source_index"), "_group").drop("_group")
    shards = -(-sum(s.slots for s in sources) // shard)
    shared = spark.sparkContext.broadcast(sources)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids in itertools.chain.from_iterable(np.array_split(b.column(0).to_numpy(), -(-b.num_rows // 64)) for b in batches if b.num_rows):
            yield from fill_shards(shared.value, (int(ids[0]), int(ids[-1]) + 1), shard, seed)

    slots = spark.range(0, shards, 1, max(1, min(shards, 1 << 16))).mapInArrow(fill, SLOTS_DDL)
    first, n, b = F.col("first"), F.col("size"), F.col("block")
    blocks = rows.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(first / block), F.floor((first + n - 1) / block))))
    start = F.greatest(first, b * block)
    pieces = blocks.select(
        "source_index", "block", "row", "doc_id", "text_hash", (start - b * block).cast("int").alias("place"), (start - first).alias("word"), (F.least(first + n, (b + 1) * block) - start).alias("_n")
    )
    kept = F.least(F.col("_n"), F.col("words") - F.col("place"))
    # Spark takes the slots for as few as the shards that they come from, and would broadcast them.
    fragments = slots.hint("merge").join(pieces, ["source_index", "block"]).where(F.col("place") < F.col("words"))
    return Mix(rows, table.withColumn("source", F.when(F.col("_group") != "2", F.substring("_group", 2, 1 << 30))).drop("_group"), fragments.withColumn("n_words", kept).drop("_n", "words"))


def shard_texts(docs: DataFrame, mixed: Mix) -> DataFrame:
    """The mix as text: shard, slot, and the slot's words joined by one space."""
    text = F.col("text").cast("string")
    held = docs.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64(text).alias("_hash"), text.alias("text")).dropDuplicates(["_id", "_hash"])
    joined = mixed.fragments.join(held, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))).select("shard", "slot", "place", "word", "n_words", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, words = None, []
        for batch in batches:
            out = []
            for word, n, t in zip(*(batch.column(c).to_pylist() for c in (3, 4, 5)), strict=True):
                if t != whole:
                    whole, words = t, t.encode().split()
                out.append(b" ".join(words[word : word + n]).decode())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(3)), pa.array(out, pa.string())], names=["shard", "slot", "place", "piece"])

    pieces = joined.mapInArrow(cut, "shard long, slot int, place int, piece string")
    ordered = F.array_sort(F.collect_list(F.struct("place", "piece")))
    return pieces.groupBy("shard", "slot").agg(F.array_join(F.transform(ordered, lambda p: p["piece"]), " ").alias("text"))


def digest(mixed: Mix) -> DataFrame:
    """The columns of the query, per document: how many of its words the mix takes, repeats counted."""
    taken = mixed.fragments.groupBy("row").agg(F.sum("n_words").alias("taken"))
    own = mixed.rows.join(taken, "row", "left").join(F.broadcast(mixed.sources.select("source_index", "source_size", "target")), "source_index")
    return own.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
