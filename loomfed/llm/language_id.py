"""Language identification by sparse multinomial logistic regression.

Features are character n-grams (1 to 3, lower-cased) hashed to ``BUCKETS``,
weighted by TF-IDF and scaled to unit length.  Document frequencies are counted
over all training documents.  The weights are learnt with
follow-the-regularised-leader (per-coordinate rates, L1 and L2 penalties) on at
most ``TRAIN_DOCS`` documents a language: of about twice as many whose hashes of
id and text lie below the language's threshold, those with the smallest.  A
temperature is fitted on every fifth of these, which is kept from the learning.
The thresholds come from the languages' counts, so no task sees more of a
language than its share of the sample, however common the language is.

The model has one column a language, and the driver one row a language of the
sample's bound; the number of languages has to be one that a model can have.

Defined results: a text that is null or has no letter (Unicode category L) is
``und`` with score 0; an empty training table makes every text ``und``; ties in
the score go to the language that sorts first; repeated rows are predicted
each, and count once in the sample; other columns play no part, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .array_sum import summed
from .byte_bpe import row_runs

BUCKETS = 1 << 16
TRAIN_DOCS = 1_000
ORDERS = (1, 2, 3)
DENSE_FROM = 2_048
RUN_CHARS = 1 << 19
LETTER = regex.compile(r"\p{L}")
_MUL = [np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)]


def gram_buckets(text: str, buckets: int = BUCKETS) -> np.ndarray:
    """The bucket of every n-gram of a text, one entry an occurrence."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    shift = np.uint32(32 - (buckets.bit_length() - 1))
    out = []
    for n in ORDERS:
        if len(points) < n:
            break
        h = np.full(len(points) - n + 1, np.uint32(n * 0x27D4EB2F & 0xFFFFFFFF), dtype=np.uint32)
        for k in range(n):
            h = (h ^ points[k : len(points) - n + 1 + k]) * _MUL[k]
            h ^= h >> np.uint32(15)
        out.append((h * np.uint32(0x2C1B3C6D)) >> shift)
    return np.concatenate(out) if out else np.empty(0, dtype=np.uint32)


def gram_counts(text: str, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and how many n-grams of the text fall into each.

    Very long texts are counted in pieces; n-grams across two pieces are counted too.
    """
    total = None
    if len(text) > RUN_CHARS:
        total = np.zeros(buckets, dtype=np.int64)
        tail = ORDERS[-1] - 1
        for at in range(0, len(text), RUN_CHARS):
            total += np.bincount(gram_buckets(text[at : at + RUN_CHARS], buckets), minlength=buckets)
            seam = at + RUN_CHARS
            if seam < len(text):
                around, left, right = text[seam - tail : seam + tail], text[seam - tail : seam], text[seam : seam + tail]
                for part, sign in ((around, 1), (left, -1), (right, -1)):
                    total += sign * np.bincount(gram_buckets(part, buckets), minlength=buckets)
    else:
        found = gram_buckets(text, buckets)
        if len(found) < DENSE_FROM:
            idx, n = np.unique(found, return_counts=True)
            return idx.astype(np.int64), n
        total = np.bincount(found, minlength=buckets)
    idx = np.flatnonzero(total)
    return idx, total[idx]


@dataclass
class LanguageModel:
    """Weights (buckets x languages), IDF, bias, temperature; ``languages`` in order."""

    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    folded: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.folded = (self.weights * self.idf[:, None]).astype(np.float32)

    def logits(self, text: str) -> np.ndarray:
        idx, n = gram_counts(text, len(self.idf))
        tf = n.astype(np.float32)
        norm = np.sqrt(((tf * self.idf[idx]) ** 2).sum()) or 1.0
        return tf @ self.folded[idx] / norm + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not text or not LETTER.search(text):
            return "und", 0.0
        z = self.logits(text).astype(np.float64) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def _learn(samples: list[tuple[np.ndarray, np.ndarray, int]], classes: int, buckets: int, alpha: float, beta: float, l1: float, l2: float, epochs: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal on sparse rows (indices, unit-length values, class)."""
    z = np.zeros((buckets + 1, classes))
    n = np.zeros((buckets + 1, classes))

    def weights(at: np.ndarray) -> np.ndarray:
        zz = z[at]
        return -np.sign(zz) * np.maximum(np.abs(zz) - l1, 0.0) / ((beta + np.sqrt(n[at])) / alpha + l2)

    rng = np.random.Generator(np.random.PCG64(seed))
    for _ in range(epochs):
        for k in rng.permutation(len(samples)):
            idx, val, label = samples[k]
            at, x = np.append(idx, buckets), np.append(val, 1.0)  # the last one is the bias
            w = weights(at)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[label] -= 1.0
            g = x[:, None] * p[None]
            root = np.sqrt(n[at])
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - root) / alpha * w
            n[at] = grown
    w = weights(np.arange(buckets + 1))
    return w[:-1], w[-1]


def _temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search on its logarithm."""
    if not len(labels):
        return 1.0

    def loss(log_t: float) -> float:
        s = logits / np.exp(log_t)
        s = s - s.max(1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(1)) - s[np.arange(len(labels)), labels]))

    low, high, ratio = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def _sample(own: DataFrame, per_language: int) -> DataFrame:
    """``h, text, lang`` of at most ``per_language`` distinct rows a language: those with the smallest hashes ``h``."""
    h = F.xxhash64(F.lit(11), F.col("id").cast("string"), F.col("text"))
    share = {r["lang"]: min(1.0, 2.0 * (per_language + 50) / r["n"]) for r in own.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not share:
        return own.select(h.alias("h"), "text", "lang")
    below = F.create_map(*[F.lit(x) for lang, s in share.items() for x in (lang, min(int((s - 0.5) * 2**64), (1 << 63) - 1))])
    near = own.select(h.alias("h"), "text", "lang").filter(F.col("h") <= F.element_at(below, F.col("lang")))
    once = near.groupBy("lang", "h").agg(F.min("text").alias("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    return once.withColumn("_r", rank).filter(F.col("_r") <= per_language).select("h", "text", "lang")


def train(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_language: int = TRAIN_DOCS,
    buckets: int = BUCKETS,
    alpha: float = 1.0,
    beta: float = 1.0,
    l1: float = 0.02,
    l2: float = 1e-4,
    epochs: int = 3,
    seed: int = 5,
) -> LanguageModel:
    """A model of the labelled rows of ``docs``; rows without a language are left out."""
    own = docs.filter(F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))

    def presence(batches: Iterable[pa.RecordBatch]) -> np.ndarray:
        df = np.zeros(buckets + 1, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0):
                if text.is_valid:
                    idx, _ = gram_counts(text.as_py(), buckets)
                    df[idx] += 1
                df[buckets] += 1
        return df

    df = summed(own.select("text"), presence, buckets + 1)
    idf = np.log((1 + df[-1]) / (1 + df[:-1])).astype(np.float64) + 1.0
    sampled = _sample(own.filter("text is not null"), per_language)

    def features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_runs(batches, 500):
            got = [gram_counts(t, buckets) for t in batch.column(1).to_pylist()]
            data = [pa.array([x[k].astype(np.int32).tobytes() for x in got], pa.binary()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *data], ["h", "lang", "idx", "n"])

    got = sorted(sampled.mapInArrow(features, "h long, lang string, idx binary, n binary").collect(), key=lambda r: (r["lang"], r["h"]))
    languages = sorted({r["lang"] for r in got})
    samples = []
    for r in got:
        idx, n = np.frombuffer(r["idx"], dtype=np.int32), np.frombuffer(r["n"], dtype=np.int32)
        if len(idx):
            val = (n * idf[idx]).astype(np.float32)
            samples.append((idx, val / np.sqrt((val**2).sum()), languages.index(r["lang"])))
    if not samples:
        return LanguageModel([], idf, np.zeros((buckets, 0)), np.zeros(0))
    held = samples[::5] if len(samples) >= 20 else []
    used = [s for k, s in enumerate(samples) if k % 5] if held else samples
    w, bias = _learn(used, len(languages), buckets, alpha, beta, l1, l2, epochs, seed)
    logits = np.array([val @ w[idx] + bias for idx, val, _ in held])
    return LanguageModel(languages, idf, w, bias, _temperature(logits, np.array([y for _, _, y in held])))


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id column, ``lang_pred`` and ``score`` of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_runs(batches, 1_000):
            found = [sent.value.predict(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], [id_col, "lang_pred", "score"])

    narrow = docs.select(F.col(id_col), F.col(text_col))
    kind = narrow.schema[0].dataType.simpleString()
    return narrow.mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")


def fold_of(id_col: str, folds: int) -> Column:
    """``crc32`` of the id as text, modulo ``folds``; a null id counts as empty."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(folds))
