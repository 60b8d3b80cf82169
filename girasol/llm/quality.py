"""Quality classifier: regularised quadratic discriminant over document statistics.

Each class is a Gaussian over transformed statistics of a text. Class covariances are
shrunk towards the pooled one and its diagonal; their Cholesky factors are computed
once. A score is the logistic of the difference of the log densities, calibrated on
the same bounded training sample.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import is_held_out, text_slices

STATISTICS = (
    "log_chars", "log_word_length", "upper", "digit", "symbol", "punctuation", "distinct_words",
    "top_word", "adjacent_repeats", "repeated_lines", "log_line_length", "byte_entropy", "shouted_words",
)
#: Byte classes: 0 other, 1 lower, 2 upper, 3 digit, 4 common punctuation, 5 symbol, 6 white space.
_CLASS = np.zeros(256, np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 1, 2, 3
_CLASS[[i for i in range(33, 127) if not chr(i).isalnum()]] = 5
_CLASS[[ord(x) for x in ".,;:'\"()-?"]] = 4
_CLASS[[9, 10, 11, 12, 13, 32]] = 6


def _logit(hits: float, of: float, weight: float = 4.0) -> float:
    """Log odds of a share, drawn towards a low share where there is little text."""
    p = (hits + 0.02 * weight) / (of + weight)
    return float(np.log(p / (1 - min(p, 1 - 1e-6))))


def statistics(text: str) -> list[float]:
    """The vector of one whole text; an empty text has one too."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    hist = np.bincount(raw, minlength=256)
    kind = np.bincount(_CLASS, hist, 7)
    words = text.split()
    n, counts = len(words), Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    letters = kind[0] + kind[1] + kind[2]
    p = hist[hist > 0] / max(len(raw), 1)
    return [
        np.log1p(len(raw)),
        np.log((sum(map(len, words)) + 5) / (n + 1)),
        _logit(kind[2], letters, 40),
        _logit(kind[3], len(raw), 40),
        _logit(kind[5], len(raw), 40),
        _logit(kind[4], len(raw), 40),
        np.log((len(counts) + 4) / (n + 4)) / np.log(n + 8),
        _logit(max(counts.values(), default=0), n, 10),
        _logit(sum(a == b for a, b in zip(words, words[1:])), n, 10),
        _logit(len(lines) - len(set(lines)), len(lines), 4),
        np.log((sum(map(len, lines)) + 60) / (len(lines) + 1)),
        float(-(p * np.log2(p)).sum()) if len(p) else 0.0,
        _logit(sum(x.isupper() and len(x) > 1 for x in words), n, 10),
    ]


@dataclass(frozen=True)
class Model:
    """Means, inverse Cholesky factors and log determinants by class, and the calibration."""

    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    log_dets: np.ndarray
    slope: float
    offset: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0, a dimension."""
        z = np.clip((x - self.centre) / self.scale, -8, 8)
        d = [-0.5 * (((z - m) @ f.T) ** 2).sum(1) - 0.5 * g for m, f, g in zip(self.means, self.factors, self.log_dets)]
        return (d[1] - d[0]) / x.shape[1]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.offset, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, shrink: float = 0.1, ridge: float = 0.05) -> Model:
    """Fit on rows x with labels y; a missing class leaves a constant score."""
    d = x.shape[1]
    if len(set(y.tolist())) < 2:
        one = 4.0 if len(y) == 0 or y[0] == 1 else -4.0
        return Model(np.zeros(d), np.ones(d), np.zeros((2, d)), np.stack([np.eye(d)] * 2), np.zeros(2), 0.0, one)
    centre, scale = x.mean(0), x.std(0) + 1e-6
    z = np.clip((x - centre) / scale, -8, 8)
    parts = [z[y == k] for k in (0, 1)]
    pooled = sum((p - p.mean(0)).T @ (p - p.mean(0)) for p in parts) / len(z)
    means, factors, dets = [], [], []
    for p in parts:
        own = (p - p.mean(0)).T @ (p - p.mean(0)) / len(p)
        cov = (1 - shrink) * own + shrink * pooled
        cov = (1 - ridge) * cov + ridge * np.diag(np.diag(pooled))
        lower = np.linalg.cholesky(cov + 1e-6 * np.eye(d))
        means.append(p.mean(0))
        factors.append(np.linalg.inv(lower))
        dets.append(2 * np.log(np.diag(lower)).sum())
    raw = Model(centre, scale, np.array(means), np.array(factors), np.array(dets), 1.0, 0.0)
    slope, offset = _calibrate(raw.margin(x), y)
    return Model(centre, scale, raw.means, raw.factors, raw.log_dets, slope, offset)


def _calibrate(margin: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Logistic fit of the labels on the clipped margin, by damped Newton steps."""
    m = np.clip(margin, -20, 20)
    a = np.stack([m, np.ones_like(m)], 1)
    w = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - y) + 1e-3 * w
        hess = (a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w = w - step * min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
    return float(max(w[0], 0.0)), float(w[1])


def _with_statistics(docs: DataFrame, keep: list[str], model: Model | None, slice_bytes: int) -> DataFrame:
    """Score (or, without a model, the statistics) of each row's text, which is __girasol_text or,
    where there is no such column, text, beside its columns in keep."""
    at = "__girasol_text" if "__girasol_text" in docs.columns else "text"
    name, kind = ("__girasol_score", T.DoubleType()) if model else ("__girasol_statistics", T.ArrayType(T.DoubleType()))
    schema = docs.select(*[F.col(f"`{c}`") for c in keep]).schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, slice_bytes, at):
            x = np.array([statistics(t) for t in texts], np.float64)
            out = pa.array(model.score(x)) if model else pa.array(list(x), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), out], names=[*keep, name])

    return docs.mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, *, sample: int = 6000, slice_bytes: int = 4 << 20) -> Model:
    """Fit on at most ``sample`` labelled rows of each class, none held out.

    The rows are those with the least hash of the id, so that they are the same at any
    partitioning. Only their statistics come to the driver: 2 x sample x 13 doubles.
    """
    own = labels.select("doc_id", F.col("quality").cast("int").alias("_y")).where(
        F.col("_y").isin(0, 1) & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id"))
    )
    picked = None
    for y in (0, 1):
        part = own.where(F.col("_y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        picked = part if picked is None else picked.unionByName(part)
    chosen = docs.select("doc_id", F.col("text").cast("string").alias("__girasol_text")).join(F.broadcast(picked), "doc_id")
    # An id that is repeated, in either table, counts once.
    chosen = chosen.groupBy("doc_id").agg(F.min(F.struct("_y", "__girasol_text")).alias("_one")).select("_one.*")
    rows = _with_statistics(chosen, ["_y"], None, slice_bytes).toArrow()
    x = np.array(rows.column("__girasol_statistics").to_pylist(), np.float64).reshape(-1, len(STATISTICS))
    return fit(x, np.array(rows.column("_y").to_pylist(), np.int64))


def score_documents(docs: DataFrame, model: Model, *, keep: list[str] | None = None, threshold: float = 0.3,
                    slice_bytes: int = 4 << 20) -> DataFrame:
    """Adds score (0 to 1) and predicted (1 from ``threshold``) to every row.

    A null text counts as an empty one and has a score like any other. Columns named
    score or predicted are replaced; other columns pass through.
    """
    keep = [c for c in docs.columns if c not in ("score", "predicted")] if keep is None else keep
    # A text that passes through is sent to the worker once.
    own = [] if "text" in keep and docs.schema["text"].dataType == T.StringType() else [F.col("text").cast("string").alias("__girasol_text")]
    source = docs.select(*[F.col(f"`{c}`") for c in keep], *own)
    out = _with_statistics(source, keep, model, slice_bytes)
    return out.withColumnRenamed("__girasol_score", "score").withColumn("predicted", (F.col("score") >= threshold).cast("int"))
