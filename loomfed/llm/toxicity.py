"""Toxicity by non-negative positive-unlabelled learning.

Features are the words of a text and their beginnings of 3 to 8 bytes, as sets
(``[0-9A-Za-z]`` and bytes from 0x80, A-Z folded).  A linear classifier is
trained in numpy on confirmed toxic texts (P) against unlabelled text (U) by
the class-prior-corrected risk

    prior * E_P[loss(+)] + max(0, E_U[loss(-)] - prior * E_P[loss(-)])

with the logistic loss; where the second term falls below zero its gradient is
reversed, so what the model learns cannot overfit to a negative risk.  The prior
is the toxic share of the labelled training rows unless it is given.

The fit uses at most ``POSITIVES`` and ``UNLABELLED`` documents (those with the
smallest id hashes), of which those with the same set of features count once,
and the features that ``MIN_DOCS`` of these have and that stand more often in P
than in U by ``MIN_Z`` standard errors (``Z_PER_ROOT`` times the root of the
positives, if that is more: near copies in P count as evidence that grows so):
weights for all others would only learn the sample by heart.  Features are
counted on the executors, and the driver gets, for each row of the sample, those
that were selected.  The model keeps the 64-bit hash of each feature with a
weight, so a feature that was never learnt cannot take another one's weight.

Defined results: a null or empty text has no features and gets the score of
the bias alone; without positives every score is 0; without unlabelled rows
the labelled ones, of both kinds, stand for U, whose mixture they then are;
rows that repeat an id are one document of the sample, with the text that sorts
first; repeated rows are scored each; an empty table gives an empty one; other
columns play no part (a column named like an output gives way to it).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import hash_spans, mix, text_slices
from .shared import discard, materialise

POSITIVES = 2_000
UNLABELLED = 5_000
MIN_DOCS = 5
MIN_Z = 5.0
Z_PER_ROOT = 0.15
BEGINNINGS = (3, 4, 5, 6, 8)
SIEVE_BITS = 22
LEAST_WEIGHT = 0.02
SAMPLE_TASKS = 8  # tasks that count the features of the sample, whose size is bounded

_WORD = np.zeros(256, dtype=bool)
_WORD[0x30:0x3A] = _WORD[0x41:0x5B] = _WORD[0x61:0x7B] = _WORD[0x80:] = True


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each run of word bytes; runs end with their row."""
    if not len(data):
        none = np.empty(0, dtype=np.int64)
        return none, none, none
    solid = _WORD[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[offsets] = True
    before, after = np.zeros(len(data), dtype=bool), np.zeros(len(data), dtype=bool)
    before[1:], after[:-1] = solid[:-1], solid[1:]
    starts = np.flatnonzero(solid & (~before | cut[:-1]))
    ends = np.flatnonzero(solid & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def _features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes and rows of the words and of each length of beginning; with repeats."""
    starts, ends, rows = _tokens(data, offsets)
    yield hash_spans(data, starts, ends), rows
    for n in BEGINNINGS:
        long = ends - starts >= n
        s = starts[long]
        yield mix(hash_spans(data, s, s + n) ^ np.uint64(0x9E6C63D0876A9A35 + n)), rows[long]


@dataclass
class ToxicityModel:
    """Feature hashes in ascending order, their weights, and the bias."""

    hashes: np.ndarray
    weights: np.ndarray
    bias: float

    def __post_init__(self) -> None:
        self.sieve = np.zeros(1 << SIEVE_BITS, dtype=bool)
        self.sieve[(self.hashes >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)] = True

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The classifier's value for each row of a slice."""
        n = len(offsets) - 1
        found_at, found_row = [], []
        for h, rows in _features(data, offsets):
            may = self.sieve[(h >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)]
            h, rows = h[may], rows[may]
            if len(h) and len(self.hashes):
                at = np.searchsorted(self.hashes, h)
                at[at == len(self.hashes)] = 0
                hit = self.hashes[at] == h
                found_at.append(at[hit])
                found_row.append(rows[hit])
        out = np.full(n, self.bias)
        if found_at:
            once = np.unique(np.concatenate(found_row) * np.int64(len(self.hashes)) + np.concatenate(found_at))
            out += np.bincount(once // len(self.hashes), self.weights[once % len(self.hashes)], minlength=n)
        return out


def select_features(hashes: np.ndarray, in_p: np.ndarray, in_u: np.ndarray, n_p: int, n_u: int, min_docs: int = MIN_DOCS, min_z: float = MIN_Z) -> np.ndarray:
    """The features, in ascending order, that stand more often in ``n_p`` positive rows than in ``n_u`` unlabelled ones."""
    n = in_p + in_u
    pooled = n / (n_p + n_u)
    error = np.sqrt(np.maximum(pooled * (1 - pooled), 1e-12) * (1 / n_p + 1 / n_u))
    least = max(min_z, Z_PER_ROOT * n_p**0.5)
    return np.sort(hashes[(n >= min_docs) & (in_p / n_p - in_u / n_u > least * error)])


def nnpu_risk(w: np.ndarray, flat: np.ndarray, owner: np.ndarray, n_p: int, n_u: int, prior: float, slack: float = 0.0) -> tuple[float, float, np.ndarray]:
    """Both terms of the risk, and the direction that a step goes against.

    Row ``owner[i]`` has the feature ``flat[i]``; the first ``n_p`` rows are
    positive; the last weight is the bias.  The direction is the gradient of
    the risk, or that of the negative second term where this is below ``-slack``.
    """
    p, u = slice(0, n_p), slice(n_p, None)
    g = np.bincount(owner, w[flat], minlength=n_p + n_u) + w[-1]
    s = 1 / (1 + np.exp(-np.clip(g, -40, 40)))
    positive = prior * np.logaddexp(0, -g[p]).mean()
    negative = np.logaddexp(0, g[u]).mean() - prior * np.logaddexp(0, g[p]).mean()
    # d loss(+)/dg = s - 1 and d loss(-)/dg = s
    d_neg = np.concatenate([-prior * s[p] / n_p, s[u] / n_u])
    d = -d_neg if negative < -slack else d_neg + np.concatenate([prior * (s[p] - 1) / n_p, np.zeros(n_u)])
    return positive, negative, np.append(np.bincount(flat, d[owner], minlength=len(w) - 1), d.sum())


def nnpu_fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], hashes: np.ndarray, prior: float, steps: int = 600, rate: float = 0.05, decay: float = 2e-4, sparsity: float = 1e-3, slack: float = 0.0) -> ToxicityModel:
    """A linear model on rows of places in the selected ``hashes``, by Adam on the non-negative risk."""
    if not positive or not unlabelled:
        return ToxicityModel(np.empty(0, dtype=np.uint64), np.empty(0), -np.inf)
    rows = positive + unlabelled
    w = np.zeros(len(hashes) + 1)  # the last one is the bias
    w[-1] = np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
    m, v = np.zeros_like(w), np.zeros_like(w)
    # few features are left, so each step takes all rows: the sign of the risk is not a matter of the draw
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    flat = np.concatenate(rows).astype(np.int64)
    for t in range(1, steps + 1):
        _, _, grad = nnpu_risk(w, flat, owner, len(positive), len(unlabelled), prior, slack)
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-6)
        w -= step
        w[:-1] -= rate * decay * w[:-1]
        w[:-1] = np.sign(w[:-1]) * np.maximum(np.abs(w[:-1]) - rate * sparsity, 0.0)
    keep = np.abs(w[:-1]) > LEAST_WEIGHT
    return ToxicityModel(hashes[keep], w[:-1][keep], float(w[-1]))


def _picked(docs: DataFrame, labels: DataFrame, id_col: str, toxic_col: str, positives: int, unlabelled: int) -> tuple[DataFrame, float]:
    """``_id, _p`` of the sample, and the toxic share of the labelled rows."""
    label, own_id = F.col(f"`{toxic_col}`"), F.col(f"`{id_col}`")
    marks = labels.filter(label.isNotNull() & own_id.isNotNull()).groupBy(own_id.alias("_id")).agg(F.max(label.cast("int")).alias("_toxic"))
    share = marks.agg(F.avg("_toxic")).first()[0] or 0.0
    known = docs.select(own_id.alias("_id")).filter("_id is not null").distinct().join(marks, "_id", "left")
    first = [F.xxhash64("_id"), F.col("_id")]

    def some(which: DataFrame, n: int, p: bool) -> DataFrame:
        return which.select("_id").orderBy(*first).limit(n).withColumn("_p", F.lit(p))

    pick_p, free = some(known.filter("_toxic = 1"), positives, True), known.filter("_toxic is null")
    return pick_p.unionByName(some(known if free.isEmpty() else free, unlabelled, False)), float(share)


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    toxic_col: str = "toxic",
    prior: float | None = None,
    positives: int = POSITIVES,
    unlabelled: int = UNLABELLED,
    min_docs: int = MIN_DOCS,
    min_z: float = MIN_Z,
    **fit: float,
) -> ToxicityModel:
    """A model of the confirmed toxic rows of ``labels`` against unlabelled documents."""
    spark = docs.sparkSession
    picked, share = _picked(docs, labels, id_col, toxic_col, positives, unlabelled)
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text")).join(F.broadcast(picked), "_id")
    rows = rows.groupBy("_id", "_p").agg(F.min("_text").alias("_text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, data, offsets in text_slices(batch.column(0)):
                n = len(offsets) - 1
                parts = list(_features(data, offsets))
                h, r = np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(base, n), pa.array(_by_row(h, r, n), pa.binary())], ["p", "h"])

    sets = rows.select("_text", "_p").mapInArrow(run, "p boolean, h binary")
    # rows with the same set of features count once: copies would make their own words look toxic
    sample, path = materialise(sets.groupBy("p", F.sha2("h", 256).alias("digest")).agg(F.min("h").alias("h")).repartition(SAMPLE_TASKS, "digest"), "sample")
    size = {r["p"]: r["n"] for r in sample.groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_p, n_u = size.get(True, 0), size.get(False, 0)
    if not n_p or not n_u:
        discard(spark, path)
        return nnpu_fit([], [], np.empty(0, dtype=np.uint64), 0.0)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[list[bytes]] = [[], []]
        for batch in batches:
            for flag, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[flag].append(h)
        own = [np.unique(np.frombuffer(b"".join(x), dtype=np.uint64), return_counts=True) for x in seen]
        for flag, (h, n) in enumerate(own):
            zero = np.zeros(len(h), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), *map(pa.array, (n, zero) if flag else (zero, n))], ["h", "in_p", "in_u"])

    counts = sample.select("p", "h").mapInArrow(count, "h long, in_p long, in_u long").groupBy("h").agg(F.sum("in_p").alias("in_p"), F.sum("in_u").alias("in_u"))
    # of all features these may be selected: others are too rare, or not more frequent in P
    counts = counts.filter((F.col("in_p") + F.col("in_u") >= min_docs) & (F.col("in_p") * n_u > F.col("in_u") * n_p)).toArrow()
    hashes = select_features(counts["h"].to_numpy().view(np.uint64), counts["in_p"].to_numpy(), counts["in_u"].to_numpy(), n_p, n_u, min_docs, min_z)

    def places(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.flatnonzero(np.isin(hashes, np.frombuffer(h, dtype=np.uint64), assume_unique=True)).astype(np.int32).tobytes() for h in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.binary())], ["p", "digest", "at"])

    got = sorted(map(tuple, sample.select("p", "h", "digest").mapInArrow(places, "p boolean, digest string, at binary").select("digest", "p", "at").collect()))
    discard(spark, path)
    # sorted: an order that no partitioning changes
    sides = [[np.frombuffer(at, dtype=np.int32) for _, own, at in got if own is flag] for flag in (True, False)]
    return nnpu_fit(*sides, hashes, share if prior is None else float(prior), **fit)


def _by_row(h: np.ndarray, r: np.ndarray, n: int) -> list[bytes]:
    order = np.argsort(r, kind="stable")
    cuts = np.searchsorted(r[order], np.arange(n + 1))
    h = h[order]
    return [np.unique(h[a:b]).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id column, ``score`` and ``predicted`` of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, data, offsets in text_slices(batch.column(1)):
                s = _score(sent.value.logits(data, offsets))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(base, len(s)), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [id_col, "score", "predicted"])

    narrow = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    kind = narrow.schema[0].dataType.simpleString()
    return narrow.mapInArrow(run, f"`{id_col}` {kind}, score double, predicted int")


def _score(logits: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-logits))


def drop_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """The documents that are not predicted toxic, with all their columns, in one pass."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, data, offsets in text_slices(batch.column(at)):
                clean = _score(sent.value.logits(data, offsets)) < 0.5
                yield batch.slice(base, len(clean)).filter(pa.array(clean))

    return docs.mapInArrow(run, docs.schema)
