"""Ranked lexical search, document at a time over compressed postings.

Documents are cut into shards of some megabytes of text. A shard is a row per term, its posting list: documents of
the shard in order of doc_id, as gaps and term frequencies in variable-length bytes; and one row with the ids and
lengths of its documents. The index depends on the documents alone, is stored once and serves any queries.

A query's lists in a shard are merged by a heap on the next document of each; a document's score is complete when
the heap moves past it. A bounded heap keeps the shard's best documents, keyed by score, then doc_id. Once it is
full, lists whose largest contributions together cannot lift a document over its least entry leave the merge; they
are looked up only for documents that the others bring, rarest first, while those can still enter. As documents
come in order of doc_id, a later one of an equal score never enters, so nothing is lost. The best of all shards are
merged by rank; a window that Spark limits before the shuffle.

Terms are held in a dictionary per block of ``block_bytes`` of query text; a larger query table takes several passes
over the lists of its own terms. No group grows with a term: a frequent one only makes its list longer in each shard.

Score of a document: the sum over the query's terms, repeats included, of
w * ((1000000000 * tf) div (1000 * tf + 12 * m)), w = floor(1000 * ln((2N + 2) / (2df + 1))), m = 75 + ((25 * n * N) div L).

Defined results: null and empty texts have no term, count in no statistic and are never found; a query without
terms finds nothing; only scores above 0 count; every row of the query table is a query of its own, repeated and
null ids too; documents of one id are ranked as they are, null ids first; further columns are ignored.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from heapq import heapify, heappop, heappush, heapreplace

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import texts
from .decontaminate import NO_ID, Numbers, words

SHARD_BYTES = 8 << 20  # of text, with some bytes for each document
BLOCK_BYTES = 4 << 20  # of query text at a time
TOP = 20
MOST_PARTITIONS = 1 << 15
INDEX_DDL = "shard long, term binary, df long, n_terms long, postings binary"


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers as bytes of seven bits, the high bit set on all but a number's last; and each number's end."""
    size = np.ones(len(values), np.int64)
    for bits in (7, 14, 21, 28):
        size += values >= (1 << bits)
    end = np.cumsum(size)
    out = np.zeros(int(end[-1]) if len(end) else 0, np.uint8)
    rest = values.copy()
    for k in range(5):
        has = size > k
        if not has.any():
            break
        out[(end - 1 - k)[has]] = (rest[has] & 127) | (128 if k else 0)
        rest >>= 7
    return out, end


def unpack(data: np.ndarray) -> np.ndarray:
    """The numbers of :func:`pack`."""
    last = data < 128
    end = np.flatnonzero(last)
    begin = np.concatenate([[0], end[:-1] + 1]) if len(end) else end
    size = end - begin + 1
    out = np.zeros(len(end), np.int64)
    for k in range(int(size.max()) if len(size) else 0):
        has = size > k
        out[has] = (out[has] << 7) | (data[begin[has] + k] & 127)
    return out


def index_shards(shard_bytes: int):
    """mapInArrow body: documents to shards of posting lists."""

    def flush(number: int, ids: list[int], tokens: list[np.ndarray], vocabulary: Numbers) -> Iterator[pa.RecordBatch]:
        order = np.argsort(np.array(ids, np.int64), kind="stable")
        doc_ids = np.array(ids, np.int64)[order]
        lengths = np.array([len(tokens[i]) for i in order.tolist()], np.int64)
        shard, total = (TaskContext.get().partitionId() << 32) | number, int(lengths.sum())
        blob = np.concatenate([doc_ids, lengths]).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([None], pa.binary()), pa.array([int((lengths > 0).sum())]), pa.array([total]), pa.array([blob])], names=["shard", "term", "df", "n_terms", "postings"])
        flat = np.concatenate([tokens[i] for i in order.tolist()]).astype(np.int64)
        if not len(flat):
            return
        width = len(doc_ids)
        pair, tf = np.unique(flat * width + np.repeat(np.arange(width), lengths), return_counts=True)
        term, doc = pair // width, pair % width
        first = np.concatenate([[True], term[1:] != term[:-1]])
        gap = doc.copy()
        gap[1:] -= np.where(first[1:], 0, doc[:-1])
        both = np.empty(2 * len(gap), np.int64)
        both[::2], both[1::2] = gap, tf
        data, end = pack(both)
        starts = np.flatnonzero(first)
        stops = np.append(starts[1:], len(term))
        edges = np.concatenate([[0], end[2 * stops - 1]])
        names = list(vocabulary)
        for a in range(0, len(starts), 8192):
            b = min(a + 8192, len(starts))
            offsets = (edges[a : b + 1] - edges[a]).astype(np.int32)
            lists = pa.BinaryArray.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[edges[a] : edges[b]].tobytes())])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(b - a, shard)), pa.array(names[a:b], pa.binary()), pa.array(stops[a:b] - starts[a:b]), pa.array(np.zeros(b - a, np.int64)), lists],
                names=["shard", "term", "df", "n_terms", "postings"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, ids, tokens, held, number = Numbers(), [], [], 0, 0
        for batch in batches:
            text = batch.column(1).cast(pa.binary())
            for a in range(0, batch.num_rows, 256):
                for doc, t in zip(batch.column(0).slice(a, 256).to_pylist(), text.slice(a, 256).to_pylist(), strict=True):
                    found = words(t)
                    ids.append(NO_ID if doc is None else doc)
                    tokens.append(np.fromiter(map(vocabulary.__getitem__, found), np.int32, len(found)))
                    held += len(t or b"") + 64
                    if held >= shard_bytes:
                        yield from flush(number, ids, tokens, vocabulary)
                        vocabulary, ids, tokens, held, number = Numbers(), [], [], 0, number + 1
        if ids:
            yield from flush(number, ids, tokens, vocabulary)

    return run


def build_index(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Store the index of ``docs`` in the shared folder. The row of a shard without a term holds its documents."""
    return materialize(texts(docs).mapInArrow(index_shards(shard_bytes), INDEX_DDL), "lists")


def best(lists: list[tuple[list[int], list[int], int, int]], top: int) -> list[tuple[int, int]]:
    """The ``top`` highest (score, -document) of lists of (documents, contributions, their largest, repeats), best first."""
    lists = sorted(((d, c, largest * times, times) for d, c, largest, times in lists if largest > 0), key=lambda x: x[2])
    docs, gains, most, times = ([x[i] for x in lists] for i in range(4))
    bound, total = [], 0
    for m in most:
        total += m
        bound.append(total)
    at = [0] * len(lists)
    merge = [(d[0], k) for k, d in enumerate(docs)]
    heapify(merge)
    found: list[tuple[int, int]] = []
    floor = essential = 0
    while merge:
        doc, k = merge[0]
        score = 0
        while True:
            i = at[k]
            score += gains[k][i] * times[k]
            i += 1
            at[k] = i
            if i < len(docs[k]):
                heapreplace(merge, (docs[k][i], k))
            else:
                heappop(merge)
                if not merge:
                    break
            if merge[0][0] != doc:
                break
            k = merge[0][1]
        for k in range(essential - 1, -1, -1):
            if score + bound[k] <= floor:
                break
            i = at[k] = bisect_left(docs[k], doc, at[k])
            if i < len(docs[k]) and docs[k][i] == doc:
                score += gains[k][i] * times[k]
        if score <= floor:
            continue
        if len(found) < top:
            heappush(found, (score, -doc))
        else:
            heapreplace(found, (score, -doc))
        if len(found) == top and found[0][0] > floor:
            floor = found[0][0]
            old = essential
            while essential < len(lists) and bound[essential] <= floor:
                essential += 1
            if essential > old:
                merge = [x for x in merge if x[1] >= essential]
                heapify(merge)
    return sorted(found, reverse=True)


def search_shard(shared: Broadcast, n_docs: int, n_terms: int, top: int):
    """applyInArrow body: one shard's lists of the terms asked for, to its best documents for each query.

    ``shared`` holds the queries, as (number, [(term, repeats)]), and the terms' weights.
    """
    schema = pa.schema([("query", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        queries, weight = shared.value
        terms, lists, dfs = table.column("term").to_pylist(), table.column("postings").combine_chunks(), table.column("df").to_numpy()
        own = terms.index(None)
        ids, length = np.frombuffer(lists[own].as_py(), np.int64).reshape(2, -1)
        rows = [i for i, t in enumerate(terms) if t is not None]
        held = unpack(np.frombuffer(b"".join(lists[i].as_py() for i in rows), np.uint8)).reshape(-1, 2)
        count = dfs[rows].astype(np.int64)
        first = np.cumsum(count) - count
        # Gaps to places: a running sum, less what ran up before each list.
        run_up = np.cumsum(held[:, 0])
        doc = run_up - np.repeat(np.where(first > 0, run_up[first - 1], 0), count) if len(held) else run_up
        tf = held[:, 1]
        m = 75 + (25 * length[doc] * n_docs) // max(1, n_terms)
        gain = (1_000_000_000 * tf) // (1000 * tf + 12 * m)
        ready: dict[bytes, tuple[list[int], list[int], int]] = {}
        for i, a, n in zip(rows, first.tolist(), count.tolist(), strict=True):
            own_gain = weight[terms[i]] * gain[a : a + n]
            ready[terms[i]] = doc[a : a + n].tolist(), own_gain.tolist(), int(own_gain.max())
        out = [(q, int(ids[-d]), s) for q, asked in queries for s, d in best([(*ready[t], c) for t, c in asked if t in ready], top)]
        columns = list(zip(*out, strict=True)) or [[], [], []]
        found = np.array(columns[1], np.int64)
        return pa.Table.from_arrays([pa.array(columns[0], pa.int64()), pa.array(found, mask=found == NO_ID), pa.array(columns[2], pa.int64())], schema=schema)

    return run


def query_index(index: DataFrame, queries: DataFrame, top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the ``top`` best documents of each row of ``queries`` (item_id, text)."""
    spark = index.sparkSession
    asked = queries.select(F.col("item_id"), F.col("text").cast("string").alias("text")).withColumn("query", F.monotonically_increasing_id())
    asked = materialize(asked, "asked")
    n_shards, n_docs, n_terms = index.where("term IS NULL").agg(F.count("*"), F.coalesce(F.sum("df"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    shards = max(1, min(n_shards, MOST_PARTITIONS))
    blocks = max(1, -(-(asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes))
    found = None
    for b in range(blocks):
        held = [(r.query, sorted(Counter(words((r.text or "").encode())).items())) for r in (asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b)).collect()]
        names = sorted({t for _, ts in held for t, _ in ts})
        vocabulary = spark.createDataFrame([(bytearray(t),) for t in names], "term binary")
        hits = index.join(F.broadcast(vocabulary), "term", "left_semi")  # bounded by block_bytes
        weight = {bytes(r.term): math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r.df + 1))) for r in hits.groupBy("term").agg(F.sum("df").alias("df")).collect()}
        shared = spark.sparkContext.broadcast((held, weight))
        body = search_shard(shared, n_docs, n_terms, top)
        lists = hits.unionByName(index.where("term IS NULL")).select("shard", "term", "df", "postings")
        # A stated number of partitions: few bytes make much work here, so they are not to be put together.
        part = lists.repartition(shards, "shard").groupBy("shard").applyInArrow(body, "query long, doc_id long, score long")
        part = part if blocks == 1 else materialize(part, "found")
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(asked.select("query", "item_id"), "query").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, queries: DataFrame, top: int = TOP, shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Index ``docs`` and ask the index: see :func:`query_index`."""
    return query_index(build_index(docs, shard_bytes), queries, top, block_bytes)
