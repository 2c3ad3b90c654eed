"""Quality classifier learnt from positives and unlabelled text.

The model is logistic over standardized text statistics and hashed byte-pair
shares. It minimizes the non-negative unbiased risk: pi * R_P(+) + max(0, R_U(-) -
pi * R_P(-)), with trusted positives P, a sample U of all documents used without
labels, and an estimated class prior pi; whenever the
estimate of the negative risk drops below zero, the step goes up that term instead.
Rows labelled negative play no part.

The prior comes from P and U alone. A classifier that tells P from U is learnt on one
half of each; on the other half, the share of U that scores above any threshold is at
least pi times the share of P that does, since U holds positives too. So every threshold
bounds pi by the ratio of the shares, and the least bound is taken over thresholds that
LEAST_SHARE of P or more exceed: at the top of the scores nearly all of U is positive.

Fitting takes bounded samples (MAX_POSITIVE and MAX_UNLABELLED rows, the least by a
hash of their id), so the driver's work does not grow with the corpus; every
document is scored on its whole text.

Defined results: null and empty texts are scored as texts of no words; a document
with a null id is scored, never learnt from and not held out; repeated rows each
give a row; of texts with one id the one of least hash is learnt from, and an id that is
labelled both ways is not trusted; without any trusted positive every score is the prior
0.5; an empty table gives no rows; columns other than doc_id and text are never inputs.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shipping import ship

MAX_POSITIVE = 6_000
MAX_UNLABELLED = 12_000
HASHED = 256
THRESHOLD = 0.3
FOLDS = 5
STEPS, PRIOR_STEPS = 600, 150
LEAST_SHARE = 0.5
SYMBOLS = b"!|#*$%&<>@?.,:;-_/()[]{}\"'=+~"
DENSE = 19 + len(SYMBOLS)


def features(text: str | None) -> np.ndarray:
    """Statistics of a whole text, then shares of its hashed byte pairs."""
    raw = (text or "").encode("utf-8", "replace")
    out = np.zeros(DENSE + HASHED, np.float32)
    words = raw.split()
    n, size = len(words), max(1, len(raw))
    if not n:
        return out
    codes = np.frombuffer(raw, np.uint8)
    of = np.bincount(codes, minlength=256)
    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    fours = Counter(zip(words, words[1:], words[2:], words[3:], strict=False))
    doubled = sum(a == b for a, b in zip(words, words[1:], strict=False)) / n
    out[:19] = (
        np.log1p(n),
        sum(map(len, words)) / n,
        of[65:91].sum() / size,
        of[97:123].sum() / size,
        of[48:58].sum() / size,
        of[128:].sum() / size,
        of[:33].sum() / size,
        len(counts) / n,
        np.log(len(counts)) / np.log1p(n),
        max(counts.values()) / n,
        doubled,
        np.sqrt(doubled),
        1 - len(fours) / max(1, n - 3),
        1 - len(set(lines)) / max(1, len(lines)),
        np.log1p(size / max(1, len(lines))),
        len(lines) / n,
        len(zlib.compress(raw, 1)) / size,
        sum(w.isupper() for w in words) / n,
        sum(len(w) == 1 for w in words) / n,
    )
    out[19:DENSE] = of[np.frombuffer(SYMBOLS, np.uint8)] / n
    if len(codes) > 1:
        pairs = (codes[:-1].astype(np.int32) * 37 + codes[1:]) % HASHED
        out[DENSE:] = np.bincount(pairs, minlength=HASHED) / len(pairs)
    return out


@dataclass
class Model:
    """score = sigmoid(bias + weights . clipped standardized features)."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(standard(x, self.mean, self.scale) @ self.weights + self.bias)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    out = x - mean
    out /= scale
    return np.clip(out, -8, 8, out=out)


def measured(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and scale of every feature, in the rows' own precision."""
    return x.mean(axis=0, dtype=np.float64).astype(x.dtype), (x.std(axis=0, dtype=np.float64) + 1e-4).astype(x.dtype)


def descended(gradient_at, width: int, bias: float, steps: int, dtype, rate: float = 0.02, decay: float = 1e-4) -> np.ndarray:
    """Weights, the bias last, after so many steps of Adam."""
    w, m, v = np.zeros(width + 1, dtype), 0.0, 0.0
    w[-1] = bias
    for step in range(1, steps + 1):
        gradient = gradient_at(w)
        gradient[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def slope(x: np.ndarray, d: np.ndarray) -> np.ndarray:
    return np.append(x.T @ d, d.sum()) / x.dtype.type(len(d))


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, steps: int = PRIOR_STEPS) -> float:
    """The estimated share of positives in unlabelled rows, between 0.05 and 0.95; the mean of both ways round of the halves."""
    mean, scale = measured(unlabelled)
    p, u = standard(positive, mean, scale), standard(unlabelled, mean, scale)
    if min(len(p), len(u)) < 4:
        return 0.5
    bounds = []
    for half in (0, 1):
        learnt_p, learnt_u = p[half::2], u[half::2]
        w = descended(lambda w: slope(learnt_p, sigmoid(learnt_p @ w[:-1] + w[-1]) - 1) + slope(learnt_u, sigmoid(learnt_u @ w[:-1] + w[-1])), p.shape[1], 0.0, steps, p.dtype)  # noqa: B023
        sp, su = np.sort(p[1 - half :: 2] @ w[:-1]), np.sort(u[1 - half :: 2] @ w[:-1])
        limits = sp[: max(1, int(len(sp) * (1 - LEAST_SHARE)))]
        above = lambda s: 1 - np.searchsorted(s, limits) / len(s)  # noqa: B023,E731
        bounds.append((above(su) / above(sp)).min())
    return float(np.clip(np.mean(bounds), 0.05, 0.95))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = STEPS) -> Model:
    """Minimizes the non-negative PU risk by Adam over all rows at once."""
    mean, scale = measured(unlabelled)
    p, u = standard(positive, mean, scale), standard(unlabelled, mean, scale)

    def gradient_at(w: np.ndarray) -> np.ndarray:
        sp, su = sigmoid(p @ w[:-1] + w[-1]), sigmoid(u @ w[:-1] + w[-1])
        loss = lambda s: -np.log(np.clip(1 - s, 1e-12, 1)).mean()  # noqa: E731  of calling rows negative
        negative = slope(u, su) - prior * slope(p, sp)
        return -negative if loss(su) < prior * loss(sp) else prior * slope(p, sp - 1) + negative

    w = descended(gradient_at, p.shape[1], float(np.log(prior / (1 - prior))), steps, p.dtype).astype(np.float64)
    return Model(mean, scale, w[:-1], float(w[-1]), prior)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def feature_rows(docs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            rows = [features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in rows], pa.binary())], names=["doc_id", "x"])

    return docs.mapInArrow(run, "doc_id long, x binary")


def learn(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Fits on bounded samples of positives and of all documents outside the held-out fold."""
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), "text").where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = labels.select(F.col("doc_id").cast("long"), "quality").where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    trusted = known.groupBy("doc_id").agg(F.min("quality").alias("least"), F.max("quality").alias("most")).where("least = 1 and most = 1").orderBy(*order).limit(MAX_POSITIVE).select("doc_id", F.lit(True).alias("trusted"))
    sample = docs.select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(MAX_UNLABELLED).select("doc_id", F.lit(False).alias("trusted"))
    # At most MAX_POSITIVE + MAX_UNLABELLED ids: a bounded broadcast.
    chosen = F.broadcast(trusted.union(sample).groupBy("doc_id").agg(F.max("trusted").alias("trusted"), F.max(~F.col("trusted")).alias("sampled")))
    picked = docs.join(chosen, "doc_id").groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    found = feature_rows(picked).join(chosen, "doc_id").orderBy("doc_id").select("x", "trusted", "sampled").collect()
    if not found:
        return None
    # Single precision: the sample is all that the driver holds, twice over while it fits.
    p, u = np.array([r["trusted"] for r in found], bool), np.array([r["sampled"] for r in found], bool)
    x = np.frombuffer(b"".join([r["x"] for r in found]), np.float32).reshape(len(found), -1)
    del found
    if not p.any() or not u.any():
        return None
    positive, unlabelled = x[p], x[u]
    del x
    return fit(positive, unlabelled, class_prior(positive, unlabelled))


def scored(rows: DataFrame, model: Model | None, key: str = "doc_id") -> DataFrame:
    """(key, text) to (key, score)."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            out = model.score(np.array([features(t) for t in texts], np.float64).reshape(len(texts), -1)) if model else np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=[key, "score"])

    ship(rows.sparkSession)
    return rows.mapInArrow(run, f"{key} {rows.schema[0].dataType.simpleString()}, score double")


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document."""
    model = learn(docs, labels)
    out = scored(docs.select(F.col("doc_id").cast("long"), "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_predicted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, with all their columns, that score at least THRESHOLD."""
    model = learn(docs, labels)
    ship(docs.sparkSession)
    place = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            texts = batch.column(place).to_pylist()
            if model:
                batch = batch.filter(pa.array(model.score(np.array([features(t) for t in texts], np.float64).reshape(len(texts), -1)) >= THRESHOLD))
            yield batch

    return docs.mapInArrow(run, docs.schema)
