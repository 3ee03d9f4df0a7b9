"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities of lexicon words (their summed and largest log-odds, hits, distinct hits), hits
near a second-person word, second-person density, shares of capitals, punctuation, exclamation marks and
digits, obfuscated words, word length and repetition. The lexicon is learned: words and word stems (prefixes)
that labelled toxic rows use far more than others.

Fitting sees at most ``max_rows`` labelled rows, drawn by hash, in three disjoint parts: one for the lexicon,
one for the trees, one for the calibration, so none is judged on what it was made from. A lexicon key occurs in
three toxic rows or more, whatever the size of the sample; the lexicon is bounded by ``lexicon_size``. The score
is the isotonic calibration of the trees' margin (their own probability where the calibration rows have one label).

Defined results: null and empty texts have zero features and are scored like any text; a row labelled twice
counts as toxic if any label says so; null labels teach nothing; without labels of both kinds the score is the
share of toxic labels (0.5 without any); texts of any length are used whole; every row gives one row; an empty
table gives none; further columns are never looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import texts

STEMS = (4, 5, 6)
EDGE = ".,;:!?\"'()[]{}<>|-_*#%&$…¿¡"
LEET = str.maketrans("0134@5$7", "oieaasst")
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch euer tu te ti tú vous votre vos toi usted ustedes vosotros".split())
NEAR = 5
INSIDE = re.compile(r"[a-z][^a-z\s'’.,-]+[a-z]", re.I)
N_FEATURES = 16


def clean(word: str) -> str:
    """Lower-cased word without marks at its ends; digits and signs that stand for letters are read as such."""
    w = word.strip(EDGE).lower()
    return w.translate(LEET) if w and not w.isalpha() and any(c.isalpha() for c in w) else w


def keys_of(word: str) -> list[str]:
    """Lexicon keys of a cleaned word: itself, and its stems."""
    return [word, *(word[:n] + "*" for n in STEMS if len(word) > n)]


@dataclass
class Tree:
    """A complete binary tree by level: inner nodes hold (feature, threshold); leaves hold values."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        for _ in range((len(self.feature) + 1).bit_length() - 1):
            node = 2 * node + 1 + (x[np.arange(len(x)), self.feature[node]] > self.threshold[node])
        return self.value[node - len(self.feature)]


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, least: float = 1.0) -> tuple[float, list[Tree]]:
    """Second-order boosting for the logistic loss over quantile bins."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], 1)
    start = float(np.log(max(y.mean(), 1e-3) / max(1 - y.mean(), 1e-3)))
    margin, trees, inner = np.full(len(y), start), [], (1 << depth) - 1
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            best = np.full(width, 1e-6)
            split = np.full(width, bins)
            for f, c in enumerate(cuts):
                at = (node - first) * bins + binned[:, f]
                sg = np.bincount(at, g, width * bins).reshape(width, bins).cumsum(1)
                sh = np.bincount(at, h, width * bins).reshape(width, bins).cumsum(1)
                rg, rh = sg[:, -1:] - sg, sh[:, -1:] - sh
                gain = sg**2 / (sh + 1) + rg**2 / (rh + 1) - sg[:, -1:] ** 2 / (sh[:, -1:] + 1)
                gain[(sh < least) | (rh < least)] = 0
                gain[:, len(c) :] = 0
                k = gain.argmax(1)
                top = gain[np.arange(width), k]
                for j in np.flatnonzero(top > best + 1e-9):
                    best[j], split[j], feature[first + j], threshold[first + j] = top[j], k[j], f, c[k[j]]
            node = 2 * node + 1 + (binned[np.arange(len(y)), feature[node]] > split[node - first])
        leaf = node - inner
        value = -rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + 1)
        trees.append(Tree(feature, threshold, value))
        margin += value[leaf]
    return start, trees


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots and calibrated values, both ascending."""
    order = np.lexsort((y, raw))
    blocks: list[list[float]] = []  # sum, weight, lowest raw, highest raw
    for r, v in zip(raw[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([v, 1.0, r, r])
        while len(blocks) > 1 and (blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1] or blocks[-2][3] == blocks[-1][2]):
            s, w, _, hi = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += w
            blocks[-1][3] = hi
    knots = [k for b in blocks for k in (b[2], b[3])]
    values = [v for b in blocks for v in (b[0] / b[1],) * 2]
    return np.array(knots), np.array(values)


@dataclass
class ToxicityModel:
    lexicon: dict[str, float] = field(default_factory=dict)
    start: float = 0.0
    trees: list[Tree] = field(default_factory=list)
    knots: np.ndarray = field(default_factory=lambda: np.zeros(0))
    values: np.ndarray = field(default_factory=lambda: np.zeros(0))
    prior: float = 0.5

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.start + sum((t(x) for t in self.trees), np.zeros(len(x)))

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.trees:
            return np.full(len(x), self.prior)
        raw = self.raw(x)
        return np.interp(raw, self.knots, self.values) if len(self.knots) else 1 / (1 + np.exp(-raw))


class Featurizer:
    """Features of texts under a lexicon; remembers words in a bounded table."""

    def __init__(self, lexicon: dict[str, float], size: int = 200_000):
        self.lexicon, self.size = lexicon, size
        self.known: dict[str, tuple[float, int]] = {}

    def word(self, raw: str) -> tuple[float, int]:
        """(largest log-odds of the word's keys or 0, flags: 1 second person, 2 obfuscated)."""
        w = clean(raw)
        found = [self.lexicon[k] for k in keys_of(w) if k in self.lexicon] if w else []
        out = (max(found, default=0.0), (w in SECOND_PERSON) | 2 * bool(INSIDE.search(raw.strip(EDGE))))
        if len(self.known) >= self.size:
            self.known.clear()
        self.known[raw] = out
        return out

    def __call__(self, text: str | None) -> list[float]:
        if not text:
            return [0.0] * N_FEATURES
        words = text.split()
        get = self.known.get
        marks = [get(w) or self.word(w) for w in words]
        n = max(1, len(words))
        hits = [(k, m[0]) for k, m in enumerate(marks) if m[0] > 0]
        strong = [k for k, s in hits if s >= 2.0]
        persons = [k for k, m in enumerate(marks) if m[1] & 1]
        near = 0
        if strong and persons:
            p = np.array(persons)
            s = np.array(strong)
            at = np.searchsorted(p, s - NEAR)
            near = int(((at < len(p)) & (p[np.minimum(at, len(p) - 1)] <= s + NEAR)).sum())
        hist = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
        size = max(1, int(hist.sum()))
        upper, digits = int(hist[65:91].sum()), int(hist[48:58].sum())
        punct = int(hist[33:48].sum() + hist[58:65].sum() + hist[91:97].sum() + hist[123:127].sum())
        return [
            float(np.log1p(len(words))),
            max((s for _, s in hits), default=0.0),
            sum(s for _, s in hits) / n,
            float(len(strong)),
            len(strong) / n,
            float(len({words[k] for k in strong})),
            sum(s for _, s in hits),
            float(near),
            len(persons) / n,
            upper / size,
            punct / size,
            int(hist[33]) / size,
            digits / size,
            sum(1 for m in marks if m[1] & 2) / n,
            size / n,
            len(set(words)) / n,
        ]


def held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % folds == fold, F.lit(True))


def featurize(docs: DataFrame, lexicon: dict[str, float], extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the ``extra`` columns, and features (array of double)."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Featurizer(shared.value)
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                x = pa.array([make(t) for t in part.column(1).to_pylist()], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column(0), *part.columns[2:], x], names=["doc_id", *extra, "features"])

    kinds = dict(chosen.dtypes)
    return chosen.mapInArrow(run, ", ".join(["doc_id long", *(f"{c} {kinds[c]}" for c in extra), "features array<double>"]))


def learn_lexicon(rows: DataFrame, size: int, least: int = 3) -> dict[str, float]:
    """Keys with their log-odds, from (text, toxic): keys of at least ``least`` toxic rows, then their use elsewhere."""

    def counted(keep: set[str] | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: dict[str, int] = {}
            for batch in batches:
                for text in batch.column(0).to_pylist():
                    for k in {k for w in set(map(clean, (text or "").split())) if w for k in keys_of(w)}:
                        if keep is None or k in keep:
                            seen[k] = seen.get(k, 0) + 1
            keys = list(seen)
            for a in range(0, len(keys), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[a : a + 10_000], pa.string()), pa.array([seen[k] for k in keys[a : a + 10_000]], pa.int64())], names=["k", "n"])

        return run

    def totals(of: DataFrame, keep: set[str] | None = None) -> DataFrame:
        return of.select("text").mapInArrow(counted(keep), "k string, n long").groupBy("k").agg(F.sum("n").alias("n"))

    n = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = n.get(1, 0), n.get(0, 0)
    toxic = {r.k: r.n for r in totals(rows.where("toxic = 1")).where(F.col("n") >= least).orderBy(F.desc("n"), "k").limit(4 * size).collect()}
    keep = set(toxic)
    other = {r.k: r.n for r in totals(rows.where("toxic = 0"), keep).collect()} if keep else {}
    odds = {k: float(np.log((c + 0.5) / (bad + 1)) - np.log((other.get(k, 0) + 0.5) / (good + 1))) for k, c in toxic.items()}
    best = sorted((k for k in odds if odds[k] >= 1.0), key=lambda k: (-odds[k] * toxic[k] ** 0.5, k))[:size]
    return {k: odds[k] for k in best}


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, lexicon_size: int = 20_000) -> ToxicityModel:
    """Learn from (doc_id, text) and (doc_id, toxic): ``labels`` must hold learnable rows only."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    known = materialize(known, "labels")
    total = known.count()
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    bounded = known.where(draw < int((1 << 30) * min(1.0, 0.95 * max_rows / max(1, total)))).limit(max_rows)
    # At most max_rows pairs of numbers are sent along.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").dropna(subset=["doc_id"]).join(F.broadcast(bounded), "doc_id")
    rows = materialize(rows.select("doc_id", "text", "toxic", F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(20)).alias("part")), "labelled")
    kinds = [r.toxic for r in rows.select("toxic").distinct().collect()]
    if len(kinds) < 2:
        share = rows.agg(F.avg("toxic")).first()[0]
        return ToxicityModel(prior=0.5 if share is None else float(share))
    lexicon = learn_lexicon(rows.where("part < 10"), lexicon_size)
    got = featurize(rows.where("part >= 10"), lexicon, ("toxic", "part")).collect()  # at most max_rows / 2 rows of features
    got.sort(key=lambda r: r.doc_id)
    x, y, part = np.array([r.features for r in got]).reshape(-1, N_FEATURES), np.array([r.toxic for r in got], float), np.array([r.part for r in got])
    trees_on, tune_on = part < 16, part >= 16
    if len(set(y[trees_on])) < 2:
        return ToxicityModel(lexicon, prior=float(y.mean()) if len(y) else 0.5)
    model = ToxicityModel(lexicon, *boost(x[trees_on], y[trees_on]))
    if len(set(y[tune_on])) == 2:
        model.knots, model.values = isotonic(model.raw(x[tune_on]), y[tune_on])
    return model


def score(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted (1 from ``threshold`` on)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Featurizer(shared.value.lexicon)
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                x = np.array([make(t) for t in batch.column(1).slice(a, 512).to_pylist()]).reshape(-1, N_FEATURES)
                s = shared.value.score(x)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, 512), pa.array(s), pa.array((s >= threshold).astype(np.int32))], schema=schema)

    return texts(docs).mapInArrow(run, "doc_id long, score double, predicted int")


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from all labels not held out, then score every row; adds held_out."""
    model = fit(docs, labels.where(~held_out(F.col("doc_id"))))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
