"""Sums of vectors and of their products, in Arrow batches: no value is exploded into a row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WIDE = pa.list_(pa.float64())
#: Partial sums that are added in one step of the tree.
FAN_IN = 64


def _rows(keys: pa.Array, parts: list, n: list, sums: dict[str, list], name: str) -> pa.RecordBatch:
    columns = {name: keys, "_part": pa.array(parts, pa.int32()), "n": pa.array(n, pa.int64()), **{c: pa.array(v, _WIDE) for c, v in sums.items()}}
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _added(partial: DataFrame, key: str, names: list[str], tasks: int) -> DataFrame:
    """Partial sums (key, _part, n, names) of ``tasks`` tasks, added in a tree. A step sorts what belongs
    together and keeps a running sum, so a task holds two matrices beside its batch."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n, sums, kind = None, 0, [], pa.null()
        done = lambda: _rows(pa.array([at[0]], kind), [at[1]], [n], {c: [v.tolist()] for c, v in zip(names, sums)}, key)
        for batch in batches:
            kind = batch.schema.field(0).type
            for i in range(batch.num_rows):
                own = (batch.column(0)[i].as_py(), batch.column(1)[i].as_py())
                part = [batch.column(3 + j).slice(i, 1).flatten().to_numpy(zero_copy_only=False) for j in range(len(names))]
                if at == own:
                    n, sums = n + batch.column(2)[i].as_py(), [x + y for x, y in zip(sums, part)]
                    continue
                if at is not None:
                    yield done()
                at, n, sums = own, batch.column(2)[i].as_py(), part
        if at is not None:
            yield done()

    columns = [key, "_part", "n", *names]
    while tasks > 1:
        tasks = -(-tasks // FAN_IN)
        near = partial.withColumn("_part", F.floor(F.col("_part") / FAN_IN).cast("int"))
        partial = near.repartition(key, "_part").sortWithinPartitions(key, "_part").select(columns).mapInArrow(add, partial.select(columns).schema)
    return partial.drop("_part")


def _sums(df: DataFrame, vector: str, key: str, products: bool) -> DataFrame:
    kind = df.schema[key].dataType.simpleString()
    names = ["s", "p"] if products else ["s"]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sums: dict = {}
        arrow = pa.null()
        for batch in batches:
            arrow = batch.schema.field(0).type
            if not batch.num_rows:
                continue
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(np.float64)
            of = batch.column(0).dictionary_encode(null_encoding="encode")
            places = of.indices.to_numpy(zero_copy_only=False)
            for g, k in enumerate(of.dictionary.to_pylist()):
                part = x[places == g]
                n, *old = sums.get(k, (0, 0.0, 0.0))
                sums[k] = (n + len(part), old[0] + part.sum(0), *([old[1] + part.T @ part] if products else []))
        for k, (n, *own) in sums.items():
            yield _rows(pa.array([k], arrow), [TaskContext.get().partitionId()], [n], {c: [v.ravel().tolist()] for c, v in zip(names, own)}, key)

    rows = df.where(F.col(vector).isNotNull()).select(key, vector)
    columns = ", ".join(f"{c} array<double>" for c in names)
    return _added(rows.mapInArrow(partial, f"`{key}` {kind}, _part int, n long, {columns}"), key, names, rows.rdd.getNumPartitions())


def vector_moments(df: DataFrame, vector: str, key: str) -> DataFrame:
    """(key, n, s, p): rows, their sum and the sum of their outer products, row by row. A task sends one
    row a key. Null vectors are left out; vectors of a key are of one width."""
    return _sums(df, vector, key, True)


def vector_means(df: DataFrame, vector: str, key: str) -> DataFrame:
    """(key, n, mean) in the same way, without products."""
    return _sums(df, vector, key, False).select(key, "n", F.transform("s", lambda x: x / F.col("n")).alias("mean"))


def covariance(n: float, s: np.ndarray, p: np.ndarray) -> np.ndarray:
    mean = np.asarray(s) / n
    return np.asarray(p).reshape(len(mean), -1) / n - np.outer(mean, mean)


def principal_axes(moments: DataFrame, key: str, count: int) -> DataFrame:
    """(key, component, singular, mean, axis): the first right singular vectors of a key's centred
    rows; the largest value of an axis is positive."""
    kind = moments.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for k, n, s, p in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                values, vectors = np.linalg.eigh(covariance(n, np.array(s), np.array(p)))
                for c in range(min(count, len(values))):
                    axis = vectors[:, -1 - c]
                    axis = axis * np.sign(axis[np.abs(axis).argmax()])
                    out.append((k, c, float(np.sqrt(max(values[-1 - c], 0.0) * n)), (np.array(s) / n).tolist(), axis.tolist()))
            cols = list(zip(*out)) or [()] * 5
            wide = pa.list_(pa.float64())
            types = (batch.schema.field(0).type, pa.int32(), pa.float64(), wide, wide)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[key, "component", "singular", "mean", "axis"])

    return moments.mapInArrow(run, f"`{key}` {kind}, component int, singular double, mean array<double>, axis array<double>")
