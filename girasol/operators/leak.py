"""Guards between training and evaluation data: by id, by hash and by similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from girasol.functions import vec

#: Bytes of reference vectors that one broadcast may hold, and of rows or references of a block.
BROADCAST_BYTES = 32 << 20
#: Rows and references of which a task holds all products at once.
TILE_ROWS, TILE_REFS = 1024, 2048
#: Products of a matrix product and of a plain sum differ by less than this share of the lengths.
ROUNDING = 1e-12


def _matrix(column: pa.ChunkedArray | pa.Array, n: int) -> np.ndarray:
    flat = column.flatten() if isinstance(column, pa.Array) else column.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(n, -1)


def _plain(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Dot products of paired rows, summed from the first place to the last as SQL does: equal vectors give
    equal values wherever they stand, as a matrix product's do not."""
    return np.cumsum(x * y, axis=1)[:, -1] if x.shape[1] else np.zeros(len(x))


def _nearest(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x the place of the row of y with the greatest plain dot product, the first at ties,
    and that product. What comes near the greatest in a matrix product is summed again."""
    best, at = np.full(len(x), -np.inf), np.zeros(len(x), np.int64)
    for i in range(0, len(y), TILE_REFS):
        own = y[i : i + TILE_REFS].astype(np.float64)
        length = np.linalg.norm(own, axis=1).max()
        for s in range(0, len(x), TILE_ROWS):
            part = x[s : s + TILE_ROWS].astype(np.float64)
            cos = part @ own.T
            floor = np.maximum(cos.max(1), best[s : s + TILE_ROWS]) - ROUNDING * np.linalg.norm(part, axis=1) * length
            r, c = np.nonzero(cos >= floor[:, None])
            v = np.concatenate([_plain(part[r[k : k + 65_536]], own[c[k : k + 65_536]]) for k in range(0, len(r), 65_536)] or [np.zeros(0)])
            order = np.lexsort((c, -v, r))
            order = order[np.r_[True, np.diff(r[order]) > 0]] if len(order) else order
            order = order[v[order] > best[s + r[order]]]
            best[s + r[order]], at[s + r[order]] = v[order], i + c[order]
    return best, at


def _against(rows: DataFrame, vector: str, key: str, ids: np.ndarray, matrix: np.ndarray) -> DataFrame:
    schema = rows.select(key).schema.add("ref_id", "long").add("cos", "double")
    shared = rows.sparkSession.sparkContext.broadcast((ids, matrix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            best, at = _nearest(_matrix(batch.column(1), batch.num_rows), matrix)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids[at]), pa.array(best)], names=[key, "ref_id", "cos"])

    return rows.select(key, vector).mapInArrow(run, schema)


def max_cosine(rows: DataFrame, refs: DataFrame, vector: str, key: str, ref_key: str, *, limit: int = BROADCAST_BYTES) -> DataFrame:
    """(key, ref_id, cos): the reference with the greatest dot product, the least id at ties.

    Vectors are units of one width; rows whose vector is null or not finite get nulls, and such references
    are left out. Equal references count once. References of at most ``limit`` bytes are broadcast. More of
    them are dealt into blocks of that size, and so are the rows: every two blocks meet in one task, nothing
    of them in the driver, and the blocks' results in an aggregate. Products are made in tiles, so a
    task's memory is bounded by ``limit`` whatever the tables' sizes.
    """
    whole, refs = rows, refs.where(vec.is_finite(F.col(vector)))
    rows = whole.where(vec.is_finite(F.col(vector)))
    none = whole.where(~vec.is_finite(F.col(vector))).select(key, F.lit(None).cast("long").alias("ref_id"), F.lit(None).cast("double").alias("cos"))
    return _max_cosine(rows, refs, vector, key, ref_key, limit).unionByName(none)


def _max_cosine(rows: DataFrame, refs: DataFrame, vector: str, key: str, ref_key: str, limit: int) -> DataFrame:
    kind = "array<float>" if rows.schema[vector].dataType == refs.schema[vector].dataType == T.ArrayType(T.FloatType()) else "array<double>"
    size = 4 if kind == "array<float>" else 8
    refs = refs.groupBy(F.col(vector).cast(kind).alias("_v")).agg(F.min(F.col(ref_key).cast("long")).alias("_ref"))
    count, width = refs.agg(F.count(F.lit(1)), F.max(F.size("_v"))).first()
    if not count:
        return rows.select(key, F.lit(None).cast("long").alias("ref_id"), F.lit(None).cast("double").alias("cos"))
    blocks = -(-count * width * size // limit)
    if blocks == 1:
        got = refs.orderBy("_ref").toArrow()
        return _against(rows, vector, key, got.column("_ref").to_numpy(), _matrix(got.column("_v"), got.num_rows))
    parts = max(1, -(-rows.count() * width * size // limit))
    deal = lambda df, of, n, name: df.withColumn(name, F.pmod(F.xxhash64(of), F.lit(n)).cast("int"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = deal(rows.select(key, F.col(vector).cast(kind).alias("_v")), key, parts, "_a").withColumn("_b", every(blocks))
    others = deal(refs, "_ref", blocks, "_b").withColumn("_a", every(parts))
    schema = rows.select(key).schema.add("ref_id", "long").add("cos", "double")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({key: left.column(key).slice(0, 0), "ref_id": pa.array([], pa.int64()), "cos": pa.array([], pa.float64())})
        right = right.sort_by("_ref")
        best, at = _nearest(_matrix(left.column("_v"), left.num_rows), _matrix(right.column("_v"), right.num_rows))
        return pa.table({key: left.column(key), "ref_id": pa.array(right.column("_ref").to_numpy()[at]), "cos": pa.array(best)})

    out = own.groupBy("_a", "_b").cogroup(others.groupBy("_a", "_b")).applyInArrow(meet, schema)
    return out.groupBy(key).agg(F.max(F.struct(F.col("cos"), (-F.col("ref_id")).alias("m"))).alias("b")).select(key, (-F.col("b.m")).alias("ref_id"), "b.cos")


#: Rows and references of a block.
BLOCK_ROWS, BLOCK_REFS = 32_768, 4_096


def nearest_rows(rows: DataFrame, refs: DataFrame, vector: str, key: str, label: str, k: int) -> DataFrame:
    """(label, key, cos, rank): for each reference, known by its label, the k rows of other labels with the
    greatest dot product, the least key at ties.

    Rows and references are dealt into blocks; every two meet in one task, which keeps k rows a
    reference. Vectors and labels that are null, or vectors that are not finite, take no part."""
    from girasol.operators import select

    good = vec.is_finite(F.col(vector)) & F.col(label).isNotNull()
    rows = rows.where(good).select(key, F.col(label).alias("_own"), vec.doubles(F.col(vector)).alias("_v"))
    refs = refs.where(good).select(F.col(label).alias("_ref"), vec.doubles(F.col(vector)).alias("_r"))
    parts, blocks = max(1, -(-rows.count() // BLOCK_ROWS)), max(1, -(-refs.count() // BLOCK_REFS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # Of one type on both sides: a whole number's hash, by which groups meet, differs by its width.
    left = rows.withColumn("_a", F.pmod(F.xxhash64("_v", key), F.lit(parts)).cast("int")).withColumn("_b", every(blocks))
    right = refs.withColumn("_y", F.pmod(F.xxhash64("_ref"), F.lit(blocks)).cast("int")).withColumn("_x", every(parts))
    names = {"_ref": rows.schema["_own"].dataType, "_key": rows.schema[key].dataType}

    def meet(own: pa.Table, asked: pa.Table) -> pa.Table:
        if not own.num_rows or not asked.num_rows:
            return pa.table({"_ref": asked.column("_ref").slice(0, 0), "_key": own.column(key).slice(0, 0), "cos": pa.array([], pa.float64())})
        own = own.sort_by(key)
        x, y = _matrix(own.column("_v"), own.num_rows), _matrix(asked.column("_r"), asked.num_rows)
        error = ROUNDING * np.linalg.norm(x, axis=1)
        labels, mine = own.column("_own").to_numpy(), asked.column("_ref").to_numpy()
        at, rows, values = [], [], []
        for i in range(0, len(y), 64):
            cos = np.where(mine[i : i + 64, None] != labels[None, :], y[i : i + 64] @ x.T, -np.inf)
            for j, line in enumerate(cos):
                # All that may be among the first k by a plain sum, in which equal rows tie wherever they stand.
                slack = error * np.linalg.norm(y[i + j])
                low = line - slack
                kth = np.partition(low, len(line) - k)[len(line) - k] if k < len(line) else -np.inf
                near = np.flatnonzero((line + slack >= kth) & (line > -np.inf))
                exact = _plain(x[near], y[i + j])
                first = np.argsort(-exact, kind="stable")[:k]
                near, exact = near[first], exact[first]
                at += [i + j] * len(near)
                rows += near.tolist()
                values += exact.tolist()
        return pa.table({"_ref": asked.column("_ref").take(at), "_key": own.column(key).take(rows), "cos": pa.array(values, pa.float64())})

    found = left.groupBy("_a", "_b").cogroup(right.groupBy("_x", "_y")).applyInArrow(meet, T.StructType([*(T.StructField(n, t) for n, t in names.items()), T.StructField("cos", T.DoubleType())]))
    best = select.first_n(found, ["_ref"], [F.desc("cos"), F.col("_key")], k, "rank")
    return best.select(F.col("_ref").alias(label), F.col("_key").alias(key), "cos", "rank")


def similarity_guard(rows: DataFrame, refs: DataFrame, vector: str, key: str, ref_key: str, threshold: float) -> DataFrame:
    """Rows whose greatest cosine is not above the threshold, with it."""
    near = max_cosine(rows, refs, vector, key, ref_key).where(F.coalesce("cos", F.lit(-1.0)) <= threshold)
    return rows.join(near, key)


def hash_guard(docs: DataFrame, held: DataFrame, key: str, ids: str, stride: int, span: int) -> DataFrame:
    """Documents of which no span at an aligned offset has a hash of ``held`` (column hash)."""
    from girasol.functions.text import span_hash

    offsets = F.sequence(F.lit(0), F.greatest(F.size(ids) - 1, F.lit(0)), F.lit(stride))
    spans = docs.select(key, F.explode(F.transform(offsets, lambda s: span_hash(F.slice(F.col(ids), s + 1, F.lit(span))))).alias("hash"))
    return docs.join(spans.join(held, "hash", "left_semi").select(key).distinct(), key, "left_anti")
