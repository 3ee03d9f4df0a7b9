"""Media columns: chroma fingerprints of audio, and alignment of recordings.

A recording (WAV bytes) becomes frames of twelve pitch-class energies. Sixteen rectangle filters over windows
of sixteen frames are read from an integral image, each is quantized to two bits in Gray code, and the
thirty-two bits of a frame are packed into an integer. Two recordings are aligned by the histogram of offsets
at which the halves of their integers agree, a vote for each half; at the bars that reach half of the highest one the
share of differing bits over the overlap (the bit error) is measured, and the least decides whether they match. Whole integers hardly ever agree from a bit error of
0.1 on, halves still do at the limit of 0.2.

Search: the queries are a stated set (every recording whose id is divisible by ``every``), sent to all
recordings in blocks of at most ``block`` query classes. Recordings with equal fingerprints are one class and
are searched once; copies are not expanded. Each task keeps one row per query, so nothing grows with pairs.

Defined results: null, empty and undecodable media have no fingerprint, no class and no match; recordings
shorter than one filter window have an empty fingerprint, which matches nothing; of equal bit errors the
higher bar counts, then the smallest offset, and the smallest class; repeated rows stay; an empty table gives none.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import ragged

RATE, FRAME, HOP = 2000, 512, 128
CLASSES, FILTERS, WIDTH = 12, 16, 16
THRESHOLDS = np.array([-0.12, 0.0, 0.12])
GRAY = np.array([0, 1, 3, 2], np.uint32)
NOTE = 256  # samples of a rendered note
SLICE = 128  # recordings that a task holds decoded or rendered at once


def decode_wav(data: bytes | None) -> np.ndarray | None:
    """Mono samples at RATE from 16-bit PCM WAV bytes; None if they cannot be read."""
    if not data:
        return None
    try:
        with wave.open(io.BytesIO(data)) as w:
            if w.getsampwidth() != 2 or w.getnframes() == 0:
                return None
            x = np.frombuffer(w.readframes(w.getnframes()), "<i2").reshape(-1, w.getnchannels()).mean(1) / 32768
            rate = w.getframerate()
    except (wave.Error, EOFError, ValueError):
        return None
    return x if rate == RATE else np.interp(np.arange(int(len(x) * RATE / rate)) * rate / RATE, np.arange(len(x)), x)


def encode_wav(samples: np.ndarray) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(RATE)
        w.writeframes((np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


@cache
def pitch_classes() -> np.ndarray:
    """(spectrum bins, 12): 1 where a bin between 55 and 880 Hz belongs to a pitch class."""
    f = np.fft.rfftfreq(FRAME, 1 / RATE)
    out = np.zeros((len(f), CLASSES))
    ok = (f >= 55) & (f <= 880)
    out[np.flatnonzero(ok), np.round(CLASSES * np.log2(f[ok] / 440)).astype(int) % CLASSES] = 1
    return out


def chroma(samples: np.ndarray) -> np.ndarray:
    """(frames, 12) pitch-class energies, each frame of length one."""
    if len(samples) < FRAME:
        return np.zeros((0, CLASSES))
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    out = []
    for a in range(0, len(frames), 1024):
        spectrum = np.fft.rfft(frames[a : a + 1024] * np.hanning(FRAME))
        out.append((spectrum.real**2 + spectrum.imag**2) @ pitch_classes())
    x = np.concatenate(out)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.where(norm > 1e-6, x / np.maximum(norm, 1e-6), 0)


@cache
def filter_bank() -> list[tuple[list[tuple[int, int, int, int]], list[tuple[int, int, int, int]]]]:
    """By filter: the rectangles (frame, class, frames, classes) that add and those that subtract.

    Rule: filter k looks at 2 + k mod 3 classes from class 5k mod 12 on (cut at the top) over 4, 8, 12 or 16
    frames, and compares halves in time, halves in pitch, a cross of both, or the middle with the sides.
    """
    bank = []
    for k in range(FILTERS):
        w = 4 * (1 + k // 4)
        y = min(5 * k % CLASSES, CLASSES - 2)
        h = 2 * max(1, min(2 + k % 3, CLASSES - y) // 2)
        t, v = w // 2, h // 2
        bank.append(
            [
                ([(0, y, t, h)], [(t, y, t, h)]),
                ([(0, y, w, v)], [(0, y + v, w, v)]),
                ([(0, y, t, v), (t, y + v, t, v)], [(t, y, t, v), (0, y + v, t, v)]),
                ([(w // 4, y, t, h)], [(0, y, w // 4, h), (w // 4 + t, y, w // 4, h)]),
            ][k % 4]
        )
    return bank


def fingerprint(samples: np.ndarray | None) -> np.ndarray | None:
    """A packed 32-bit integer per frame position; empty if the recording is shorter than a filter window."""
    if samples is None:
        return None
    c = chroma(samples)
    n = len(c) - WIDTH + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    image = np.zeros((len(c) + 1, CLASSES + 1))
    image[1:, 1:] = c.cumsum(0).cumsum(1)
    area = lambda x, y, w, h: image[x + w : x + w + n, y + h] - image[x : x + n, y + h] - image[x + w : x + w + n, y] + image[x : x + n, y]
    out = np.zeros(n, np.uint32)
    for plus, minus in filter_bank():
        response = np.log1p(sum(area(*r) for r in plus)) - np.log1p(sum(area(*r) for r in minus))
        out = (out << np.uint32(2)) | GRAY[np.searchsorted(THRESHOLDS, response)]
    return out


def fingerprints(media: DataFrame) -> DataFrame:
    """(id, media) to (id, fp): fp is the fingerprint as binary, four bytes per frame position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, SLICE):
                out = [None if (f := fingerprint(decode_wav(m))) is None else f.astype("<u4").tobytes() for m in batch.column(1).slice(a, SLICE).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, SLICE), pa.array(out, pa.binary())], names=["id", "fp"])

    return media.select(F.col("id").cast("long").alias("id"), F.col("media").cast("binary").alias("media")).mapInArrow(run, "id long, fp binary")


def melody(v: list[float] | None) -> bytes | None:
    """WAV bytes whose notes follow the numbers; None without any."""
    if not v:
        return None
    x = np.nan_to_num(np.array([0.0 if a is None else a for a in v], float))
    note = np.clip(np.floor((np.clip(x / 0.3, -1, 1) + 1) * 12), 0, 23)
    t = np.arange(NOTE) / RATE
    return encode_wav((0.5 * np.sin(2 * np.pi * (110 * 2 ** (note / 12))[:, None] * t)).ravel())


def other_take(i: int, media: bytes | None) -> bytes | None:
    """The recording again: cut at the front, quieter, noisy, as drawn from its id."""
    x = decode_wav(media)
    if x is None:
        return media
    rng = np.random.default_rng(abs(i))
    y = x[min(int(rng.integers(0, 2000)), len(x) // 2) :]
    return encode_wav(y * rng.uniform(0.3, 1) + rng.normal(0, rng.uniform(0, 0.1), len(y)))


def _recordings(vectors: DataFrame, every: int | None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, SLICE):
                ids = batch.column(0).slice(a, SLICE).to_pylist()
                media = [melody(v) for v in batch.column(1).slice(a, SLICE).to_pylist()]
                if every is not None:
                    again = [(2 * i + 1, other_take(i, m)) for i, m in zip(ids, media, strict=True) if i is not None and i % every == 0]
                    ids = [None if i is None else 2 * i for i in ids] + [i for i, _ in again]
                    media += [m for _, m in again]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(media, pa.binary())], names=["id", "media"])

    return vectors.select(F.col("id").cast("long").alias("id"), "vector").mapInArrow(run, "id long, media binary")


def render(vectors: DataFrame) -> DataFrame:
    """(id, vector) to (id, media): a melody whose notes follow the vector's numbers, as WAV bytes.

    The given tables hold no audio; this makes a media column whose recordings are alike if the vectors are.
    """
    return _recordings(vectors, None)


def takes(vectors: DataFrame, every: int) -> DataFrame:
    """(id, vector) to (id, media): 2 * id is the melody, 2 * id + 1 another take of it where ``every`` divides id.

    The other take starts up to 2,000 samples later, is quieter and has noise of up to a fifth of the melody's amplitude,
    all drawn from its id, so that recordings of one melody have to be aligned to be found.
    """
    return _recordings(vectors, every)


def halves(prints: np.ndarray) -> np.ndarray:
    """The upper halves of packed integers, then the lower ones, which are told apart by a bit of their own."""
    return np.concatenate([prints >> np.uint32(16), (prints & np.uint32(0xFFFF)) | np.uint32(1 << 16)])


class QueryBlock:
    """Fingerprints of a block of queries, searchable by halves of integers."""

    def __init__(self, ids: list[int], prints: list[np.ndarray]):
        self.ids = np.array(ids, np.int64)
        self.sizes = np.array([len(p) for p in prints], np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.flat = np.concatenate([np.zeros(0, np.uint32), *prints]).astype(np.uint32)
        self.owner = np.repeat(np.arange(len(ids)), self.sizes)
        self.place = np.arange(len(self.flat)) - np.repeat(self.first, self.sizes)
        parts = halves(self.flat)
        order = np.argsort(parts, kind="stable")
        self.keys = parts[order]
        self.order = order % max(1, len(self.flat))

    def align(self, prints: list[np.ndarray], least_votes: int) -> tuple[np.ndarray, ...]:
        """(row, query, offset, votes, bit error) of each pair with a bar of at least ``least_votes``, where its error is least."""
        sizes = np.array([len(p) for p in prints], np.int64)
        flat = np.concatenate([np.zeros(0, np.uint32), *prints]).astype(np.uint32)
        first = np.cumsum(sizes) - sizes
        row = np.repeat(np.arange(len(prints)), sizes)
        place = np.arange(len(flat)) - np.repeat(first, sizes)
        parts = halves(flat)
        low, high = np.searchsorted(self.keys, parts), np.searchsorted(self.keys, parts, side="right")
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for part in np.split(np.arange(len(parts)), np.flatnonzero(np.diff(np.cumsum(high - low) >> 21)) + 1) if len(flat) else []:
            at, own = ragged(low[part], (high - low)[part])
            hit = self.order[at]
            own = part[own] % len(flat)
            pair = row[own] * len(self.ids) + self.owner[hit]
            bar, votes = np.unique((pair << 32) | (place[own] - self.place[hit] + (1 << 31)), return_counts=True)
            found.append((bar, votes))
        if not found:
            return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0),)
        if len(found) > 1:
            bar, back = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
            votes = np.bincount(back, np.concatenate([f[1] for f in found])).astype(np.int64)
        enough = votes >= least_votes
        bar, votes = bar[enough], votes[enough]
        pair, offset = bar >> 32, (bar & 0xFFFFFFFF) - (1 << 31)
        by = np.lexsort((offset, -votes, pair))
        start = np.diff(pair[by], prepend=-1) != 0
        highest = votes[by][np.flatnonzero(start)][np.cumsum(start) - 1]
        top = by[2 * votes[by] >= highest]
        r, q, offset, votes = pair[top] // len(self.ids), pair[top] % len(self.ids), offset[top], votes[top]
        a = np.maximum(offset, 0)
        n = np.minimum(sizes[r] - a, self.sizes[q] - np.maximum(-offset, 0))
        error = np.empty(len(top))
        for part in np.split(np.arange(len(top)), np.flatnonzero(np.diff(np.cumsum(n) >> 21)) + 1) if len(top) else []:
            x, own = ragged(first[r[part]] + a[part], n[part])
            y, _ = ragged(self.first[q[part]] + np.maximum(-offset[part], 0), n[part])
            bits = np.bitwise_count(flat[x] ^ self.flat[y])
            error[part] = np.bincount(own, bits, len(part)) / (32 * n[part])
        by = np.lexsort((offset, -votes, error, pair[top]))
        least = by[np.diff(pair[top][by], prepend=-1) != 0]
        return r[least], q[least], offset[least], votes[least], error[least]


def align_recordings(prints: DataFrame, every: int = 100, least_votes: int = 3, most_error: float = 0.2, block: int = 2048) -> DataFrame:
    """(id, fp) to one row per recording.

    Columns: id, n_frames, fingerprint_sha256, class_id (smallest id with the same fingerprint), is_query;
    for queries n_links (other classes that match), best_class, best_offset, best_error; null for others.
    """
    spark = prints.sparkSession
    is_query = F.coalesce(F.col("id") % every == 0, F.lit(False))
    known = prints.where("fp is not null").withColumn("print", F.sha2("fp", 256))
    classes = materialize(known.groupBy("print").agg(F.min("id").alias("class_id"), F.min("fp").alias("fp"), F.max(is_query).alias("asked")), "classes")
    asked = classes.where(F.col("asked") & (F.octet_length("fp") > 0))
    blocks = max(1, -(-asked.count() * 5 // (4 * block)))
    links: list[DataFrame] = []
    for b in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("class_id"), F.lit(blocks)) == b).select("class_id", "fp").collect()
        shared = spark.sparkContext.broadcast(QueryBlock([r.class_id for r in mine], [np.frombuffer(r.fp, "<u4") for r in mine]))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            queries = shared.value
            best: dict[int, list] = {}
            for batch in batches:
                for a in range(0, batch.num_rows, 128):
                    ids = batch.column(0).slice(a, 128).to_pylist()
                    r, q, offset, votes, error = queries.align([np.frombuffer(f, "<u4") for f in batch.column(1).slice(a, 128).to_pylist()], least_votes)
                    for x, y, o, v, e in zip(r.tolist(), q.tolist(), offset.tolist(), votes.tolist(), error.tolist(), strict=True):
                        mine, other = int(queries.ids[y]), ids[x]
                        if e > most_error or mine == other:
                            continue
                        row = best.setdefault(mine, [0, (2.0, 0, 0)])
                        row[0] += 1
                        row[1] = min(row[1], (e, other, o))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(best), pa.int64()), pa.array([v[0] for v in best.values()], pa.int64()), *(pa.array([v[1][k] for v in best.values()], t) for k, t in ((0, pa.float64()), (1, pa.int64()), (2, pa.int64())))],
                names=["class_id", "n", "error", "other", "offset"],
            )

        links.append(classes.select("class_id", "fp").mapInArrow(run, "class_id long, n long, error double, other long, offset long"))
    every_link = links[0]
    for x in links[1:]:
        every_link = every_link.unionByName(x)
    best = every_link.groupBy("class_id").agg(F.sum("n").alias("n_links"), F.min(F.struct("error", "other", "offset")).alias("best"))
    named = classes.join(best, "class_id", "left").select("print", "class_id", "n_links", "best")
    out = prints.withColumn("print", F.sha2("fp", 256)).join(named, "print", "left")
    return out.select(
        "id",
        F.coalesce((F.octet_length("fp") / 4).cast("long"), F.lit(0).cast("long")).alias("n_frames"),
        F.col("print").alias("fingerprint_sha256"),
        "class_id",
        is_query.alias("is_query"),
        F.when(is_query & F.col("class_id").isNotNull(), F.coalesce("n_links", F.lit(0).cast("long"))).alias("n_links"),
        F.when(is_query, F.col("best.other")).alias("best_class"),
        F.when(is_query, F.col("best.offset")).alias("best_offset"),
        F.when(is_query, F.round("best.error", 6)).alias("best_error"),
    )


def fingerprint_vectors(vectors: DataFrame, every: int = 100) -> DataFrame:
    """Render, fingerprint and align a table of (id, vector)."""
    prints = materialize(fingerprints(render(vectors)), "prints")
    return align_recordings(prints, every)


def fingerprint_takes(vectors: DataFrame, every: int = 100) -> DataFrame:
    """Recordings of all vectors (``takes``), fingerprinted and aligned; the melodies of ids divisible by ``every`` ask.

    id is the vector's, take 0 or 1 (null for a null id); class_id and best_class are recordings, 2 * id + take.
    """
    prints = materialize(fingerprints(takes(vectors, every)), "prints")
    found = align_recordings(prints, 2 * every)
    return found.select(F.floor(F.col("id") / 2).alias("id"), F.pmod("id", F.lit(2)).alias("take"), *(c for c in found.columns if c != "id"))
