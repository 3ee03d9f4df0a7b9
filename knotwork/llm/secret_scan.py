"""Secret scans: fixed patterns, and sliding-window Shannon entropy per character class.

Candidates are maximal runs of key-like characters that hold a digit and a letter. A window of fixed width
slides over each candidate; its entropy follows from incremental counts (one character in, one out). The
candidate's character class (hex, lower-alphanumeric, base64) sets the threshold; a maximal union of windows
at or above it is a span of kind ``entropy``. Candidates on the allow-list (e-mail and host names, UUIDs,
version and date shapes, words joined by marks, placeholder words) are suppressed. A host name has to end in a
top-level label, an e-mail address has to have such a host and must not be the user or password of a URL.

Defined results: null or empty text has no span; texts of any length are scanned whole; every row gives one
row, repeated rows too; an empty table gives none; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the same matches as [0-9a-f]+ with at least 24 characters
HINTS = ("password", "passwd", "secret", "token", "api_key", "apikey")
KINDS = ("assign", "access", "hex", "entropy")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
ALLOWED = re.compile(
    r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}"  # UUID
    r"|[a-z]+(?:[-_/+][A-Za-z]+)*[-_/+]?[0-9]{0,4}"  # words joined by marks, a number after
    r"|[0-9+/_=-]+"  # digits and marks only
    r"|(?i:.*(?:example|placeholder|your[-_]?key|xxxx|lorem).*)"
)
#: What follows the first label of a host name; not more labels than a name has, so that a long run costs no more.
HOST_REST = re.compile(r"(?:\.[A-Za-z0-9][A-Za-z0-9-]{0,62}){0,10}\.(?:[a-z]{2,24}|[A-Z]{2,24})(?![A-Za-z0-9_+=@-]|\.[A-Za-z0-9])")
ADDRESS_REST = re.compile(r"@[A-Za-z0-9][A-Za-z0-9-]{0,62}" + HOST_REST.pattern)
LABEL = re.compile(r"/{0,2}[A-Za-z0-9-]{1,63}")
LOCAL = re.compile(r"[A-Za-z0-9+_-]{1,64}")
#: A file or an e-mail name of words, each with a number after at most.
WORDS = re.compile(r"[-+/_]*+(?:[A-Z]?+[a-z]*+[0-9]{0,4}+[-+/_]++)*+[A-Z]?[a-z]*+[0-9]{0,4}")


@dataclass(frozen=True)
class EntropyRule:
    """Window width and, by character class, the bits per character from which a window is suspect."""

    window: int = 20
    hex_bits: float = 3.0
    lower_bits: float = 3.5
    base64_bits: float = 3.7


def character_class(s: str) -> str:
    if not s.strip("0123456789abcdef") or not s.strip("0123456789ABCDEF"):
        return "hex"
    return "lower" if s.islower() or s.isupper() else "base64"


def entropy_windows(s: str, width: int) -> Iterator[float]:
    """Shannon entropy of each window of ``width``, by incremental counts."""
    term = [0.0, *(c * math.log2(c) for c in range(1, width + 1))]
    counts: dict[str, int] = {}
    total = 0.0
    for i, ch in enumerate(s):
        if i >= width:
            out = s[i - width]
            n = counts[out]
            counts[out] = n - 1
            total += term[n - 1] - term[n]
        n = counts.get(ch, 0)
        counts[ch] = n + 1
        total += term[n + 1] - term[n]
        if i >= width - 1:
            yield math.log2(width) - total / width


def named(text: str, start: int, end: int) -> bool:
    """Whether a candidate is part of a host name, an e-mail address or the name of a file, and no key beside one."""
    s, before, after = text[start:end], text[start - 1 : start] if start else "", text[end : end + 1]
    if s.startswith("eyJ") or (after not in (".", "@") and before != "@"):
        return False
    if after == "@":
        if s.startswith("/") or (before == ":" and text[max(0, start - 7) : start].lower() != "mailto:"):
            return False  # user or password of a URL
        return bool(LOCAL.fullmatch(s) and ADDRESS_REST.match(text, end))
    if after == "." and LABEL.fullmatch(s) and HOST_REST.match(text, end):
        return True
    return after == "." and text[end + 1 : end + 2].isalpha() and bool(WORDS.fullmatch(s))


def entropy_spans(text: str, rule: EntropyRule = EntropyRule()) -> list[tuple[int, int]]:
    spans: list[tuple[int, int]] = []
    for m in CANDIDATE.finditer(text):
        s = m[0]
        if s.isalpha() or not (any(c.isdigit() for c in s) and any(c.isalpha() for c in s)) or ALLOWED.fullmatch(s):
            continue
        if named(text, m.start(), m.end()):
            continue
        bits = getattr(rule, f"{character_class(s)}_bits")
        start = end = -1
        for i, h in enumerate(entropy_windows(s, rule.window)):
            if h >= bits - 1e-9:
                if start < 0 or i > end:
                    if start >= 0:
                        spans.append((m.start() + start, m.start() + end))
                    start = i
                end = i + rule.window
        if start >= 0:
            spans.append((m.start() + start, m.start() + end))
    return spans


def find_secrets(text: str | None, rule: EntropyRule = EntropyRule()) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, end exclusive, by start, then kind in the order of KINDS."""
    if not text:
        return []
    found: list[tuple[int, int, str]] = []
    low = text.lower()
    # Lower-casing can only turn further letters into these ASCII ones, so a hint is never missed.
    if any(h in low for h in HINTS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    found += [(a, b, "entropy") for a, b in entropy_spans(text, rule)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def redact(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    """The text with each maximal union of spans replaced by ``[SECRET]``."""
    if not text or not spans:
        return text
    out, at, end = [], 0, -1
    for a, b, _ in sorted(spans):
        if a > end:
            if end >= 0:
                at = end
            out += [text[at:a], "[SECRET]"]
        end = max(end, b)
    return "".join([*out, text[end:]])


SPAN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))


def scan(docs: DataFrame, rule: EntropyRule = EntropyRule(), redacted: bool = False) -> DataFrame:
    """doc_id, spans ``array<struct<start,end,kind>>`` and, if asked for, the redacted text."""
    schema = pa.schema([("doc_id", pa.int64()), ("spans", SPAN_TYPE), *([("redacted", pa.string())] if redacted else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                text = batch.column(1).slice(a, 512).to_pylist()
                found = [find_secrets(t, rule) for t in text]
                cols = [batch.column(0).slice(a, 512), pa.array([[{"start": s, "end": e, "kind": k} for s, e, k in f] for f in found], type=SPAN_TYPE)]
                if redacted:
                    cols.append(pa.array([redact(t, f) for t, f in zip(text, found, strict=True)], type=pa.string()))
                yield pa.RecordBatch.from_arrays(cols, schema=schema)

    ddl = "doc_id long, spans array<struct<start:long,end:long,kind:string>>" + (", redacted string" if redacted else "")
    return texts(docs).mapInArrow(run, ddl)


def redacted_documents(docs: DataFrame, columns: tuple[str, ...], rule: EntropyRule = EntropyRule()) -> DataFrame:
    """The documents with ``columns``, every span redacted and n_chars set to the new length, in one pass.

    The schema of ``docs`` is kept for these columns; a row without spans is returned as it is.
    """
    chosen = docs.select(*columns)
    at, chars = columns.index("text"), columns.index("n_chars") if "n_chars" in columns else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                text = part.column(at).to_pylist()
                new = [redact(t, find_secrets(t, rule)) for t in text]
                cols = list(part.columns)
                cols[at] = pa.array(new, type=part.schema.field(at).type)
                if chars >= 0:
                    n = [k if y is x or y == x else len(y) for k, x, y in zip(cols[chars].to_pylist(), text, new, strict=True)]
                    cols[chars] = pa.array(n, type=part.schema.field(chars).type)
                yield pa.RecordBatch.from_arrays(cols, schema=part.schema)

    return chosen.mapInArrow(run, chosen.schema)


def digest(scanned: DataFrame) -> DataFrame:
    """The columns of the query, from the spans of :func:`scan`."""
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return scanned.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in KINDS),
        F.sha2(joined(F.filter("spans", lambda s: s["kind"] != "entropy")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


