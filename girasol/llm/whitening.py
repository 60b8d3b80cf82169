"""Whitening of embeddings on principal components whose eigenvectors are refined.

The covariance is summed on Spark, over each distinct vector once and centred before it is multiplied.
Its eigenvectors are found in 32 bits and corrected by Ogita's and Aishima's iteration, a few matrix
products in higher precision. Eigenvalues that the products cannot tell apart are a cluster: there
the iteration only keeps the vectors orthonormal, and a small eigenproblem of the cluster, shifted
by its mean, turns them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from girasol.functions import vec

from .components import written
from .hardneg import matrix, quantised

#: Widths up to this are refined in extended precision, whose products are not blocked.
EXTENDED_WIDTH = 256
FAN_IN = 64


def _norm(m: np.ndarray) -> float:
    return float(np.sqrt((np.asarray(m, np.float64) ** 2).sum()))


def _turned(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """``a`` between the columns of x, symmetric to the last bit."""
    s = x.T @ a @ x
    return (s + s.T) / 2


def refined(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """One step of Ogita and Aishima for the symmetric ``a``: eigenvectors with about twice the digits.

    Where two eigenvalues are no further apart than the step can tell, it only makes their vectors
    more orthonormal."""
    r, s = np.eye(len(a), dtype=a.dtype) - x.T @ x, _turned(a, x)
    values = np.diag(s) / (1 - np.diag(r))
    delta = 2 * (_norm(s - np.diag(values)) + _norm(a) * (_norm(r) + float(np.finfo(a.dtype).eps)))
    gap = values[None, :] - values[:, None]
    apart = np.abs(gap) > delta
    return x + x @ np.where(apart, (s + values[None, :] * r) / np.where(apart, gap, 1), r / 2)


def _clusters(values: np.ndarray, near: float) -> list[np.ndarray]:
    """Places of eigenvalues, in falling order, no further than ``near`` from the next."""
    order = np.argsort(-values, kind="stable")
    cuts = np.flatnonzero(-np.diff(values[order].astype(np.float64)) > near) + 1
    return np.split(order, cuts)


def eigenvectors(a: np.ndarray, *, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in falling order and unit eigenvectors, as columns, of a symmetric matrix."""
    top = float(np.abs(a).max(initial=0.0))
    if not top:
        return np.zeros(len(a)), np.eye(len(a))
    wide = np.longdouble if len(a) <= EXTENDED_WIDTH else np.float64
    exact = (a / top).astype(wide)
    x = np.linalg.eigh(exact.astype(np.float32))[1].astype(wide)
    small = 4 * float(np.finfo(wide).eps) * len(a)
    for _ in range(rounds):
        x = refined(exact, x)
        s = _turned(exact, x)
        off = _norm(s - np.diag(np.diag(s)))
        if off <= small and _norm(x.T @ x - np.eye(len(a))) <= small:
            break
        for own in _clusters(np.diag(s), 2 * off):
            part = s[np.ix_(own, own)]
            shifted = part - np.eye(len(own), dtype=wide) * (np.trace(part) / len(own))
            size = np.abs(shifted).max()
            if len(own) > 1 and size > small:
                x[:, own] = x[:, own] @ np.linalg.eigh((shifted / size).astype(np.float64))[1].astype(wide)
    for _ in range(2):
        x = x + x @ (np.eye(len(a), dtype=wide) - x.T @ x) / 2
    values = np.diag(_turned(exact, x))
    order = np.argsort(-values, kind="stable")
    return (values[order] * top).astype(np.float64), x[:, order].astype(np.float64)


@dataclass(frozen=True)
class Whitening:
    """A fitted transform: n vectors, their sums, and the components with a variance above rounding."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    scale: int
    identity_error: float | None = None

    @property
    def width(self) -> int:
        return len(self.sums)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return x.astype(np.float64) - np.array([s / self.n for s in self.sums])

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sums of (n * x - S)^2 over a row; None beyond a long."""
        large = max(map(abs, self.sums), default=0) + self.n * (max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0)
        if large * large * max(1, self.width) < 1 << 63:
            d = x * np.int64(self.n) - np.array(self.sums, np.int64)
            return (d * d).sum(1).tolist()
        d = x.astype(object) * self.n - np.array(self.sums, object)
        return [v if v < 1 << 63 else None for v in (int((row * row).sum()) for row in d)]


def clean(rows: DataFrame, scale: int, keep: list[str]) -> DataFrame:
    """``keep`` in a struct, and x = floor(scale * component), of rows without null or non-finite entries."""
    good = rows.where(vec.is_finite(F.col("vector")))
    return good.select(F.struct(*keep).alias("kept"), quantised(F.col("vector"), scale).alias("x"))


def _padded(x: Column, width: int) -> Column:
    return F.concat(x, F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size(x)))


def product_sums(rows: DataFrame, width: int, transform) -> np.ndarray:  # noqa: ANN001
    """(1 + k) x k: the sum of the rows that ``transform`` makes of x, and of their outer products.

    A task adds up what it reads; sums meet in a tree of FAN_IN, so that none holds more than two.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            y = transform(matrix(pa.chunked_array([batch.column(0)]), width))
            part = np.vstack([y.sum(0), y.T @ y])
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for raw in batch.column(0):
                part = np.frombuffer(raw.as_buffer(), np.float64)
                total = part.copy() if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    sums = rows.select("x").mapInArrow(partial, "sums binary")
    tasks = rows.rdd.getNumPartitions()
    while tasks > 1:
        tasks = -(-tasks // FAN_IN)
        sums = sums.repartition(tasks).mapInArrow(add, "sums binary")
    found = [np.frombuffer(r.sums, np.float64) for r in sums.collect()]
    return np.sum(found, axis=0) if found else np.zeros(0)


def fit(rows: DataFrame, *, components: int = 4, scale: int = 256) -> Whitening:
    """The transform of ``rows`` (vector) from each distinct vector once.

    Vectors that are null, or hold a null or non-finite entry, are left out; a shorter one counts as if
    zeros followed. Components whose eigenvalue is rounding (as all are where all vectors are equal)
    are not kept, nor are there more than the width. Without rows there are none.
    """
    x = clean(rows, scale, ["vector"]).select("x")
    width = x.agg(F.max(F.size("x"))).first()[0] or 0
    listed, _ = written(x.select(_padded(F.col("x"), width).alias("x")).distinct())
    facts = listed.agg(F.count(F.lit(1)), *[F.sum(F.get("x", F.lit(i)).cast("decimal(20,0)")) for i in range(width)]).first()
    n, sums = facts[0], tuple(int(s or 0) for s in facts[1:])
    none = np.zeros((width, 0))
    if not n or not width:
        return Whitening(n, sums, none, np.zeros(0), np.zeros(0), scale)
    centre = Whitening(n, sums, none, np.zeros(0), np.zeros(0), scale)
    found = product_sums(listed, width, centre.centred).reshape(1 + width, width)
    # What rounding left of the mean goes; it is exact in the sums.
    v = found[1:] / n - np.outer(found[0] / n, found[0] / n)
    values, vectors = eigenvectors((v + v.T) / 2)
    trace = float(np.trace(v))
    real = int((values[:components] > np.finfo(np.float64).eps * width * max(float(values[0]), 0.0)).sum()) if trace > 0 else 0
    model = Whitening(n, sums, vectors[:, :real], values[:real], values[:real] / trace if real else np.zeros(0), scale)
    if not real:
        return model
    white = product_sums(listed, width, model.project).reshape(1 + real, real)
    cov = white[1:] / n - np.outer(white[0] / n, white[0] / n)
    return Whitening(n, sums, model.components, model.values, model.explained, scale, float(np.abs(cov - np.eye(real)).max()))


def whiten(rows: DataFrame, model: Whitening, *, keep: list[str]) -> DataFrame:
    """``keep``, whitened (a value for each component) and deviation of the rows of ``rows`` whose
    vector has no null or non-finite entry.

    deviation is the sum of (n * x - S)^2, null beyond a long. Entries beyond the fit's width are not
    read. Columns of ``keep`` named whitened or deviation give way to the results.
    """
    kept = [c for c in keep if c.lower() not in ("whitened", "deviation")]
    width = model.width
    source = clean(rows, model.scale, kept).select("kept", _padded(F.slice("x", 1, width), width).alias("x")) if width else clean(rows, model.scale, kept)
    schema = source.select("kept").schema.add("whitened", T.ArrayType(T.DoubleType())).add("deviation", T.LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(pa.chunked_array([batch.column(1)]), width)
            y = model.project(x) if model.n else np.zeros((len(x), 0))
            places = pa.array(np.arange(0, y.size + 1, max(1, y.shape[1]), dtype=np.int32) if y.shape[1] else np.zeros(len(x) + 1, np.int32))
            lists = pa.ListArray.from_arrays(places, pa.array(y.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(model.deviation(x), pa.int64())], names=["kept", "whitened", "deviation"])

    return source.mapInArrow(run, schema).select("kept.*", "whitened", "deviation")


def components_of(white: DataFrame, model: Whitening, key: str) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): a row for each component."""
    explained = F.array(*[F.lit(float(v)) for v in model.explained]) if len(model.explained) else F.array().cast("array<double>")
    out = white.select(key, "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return out.select(key, (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, "at").alias("explained"), F.lit(model.identity_error).cast("double").alias("identity_error"))
