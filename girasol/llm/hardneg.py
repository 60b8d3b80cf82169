"""Hard negatives: for an anchor and each of its positives, the best rows of another label that score
between two shares of the positive's score.

The windows of an anchor overlap, so none is searched by itself. The positives' upper limits cut the
scores into disjoint slots; each pair of blocks keeps the first k rows a slot, the slots of all blocks
merge by slot, and a window is what its own slot and those below it hold, read downwards.

Anchors are a stated query set. They meet the rows in blocks: a pair of blocks is one task, and what
leaves it are k rows an anchor and slot.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from girasol.functions import vec
from girasol.operators import select

from .components import written

#: Rows and anchors of a block, and scores that a task holds at once.
ROWS, ANCHORS, CELLS = 65_536, 4_096, 1 << 21
_NONE = -(1 << 62)
_FOUND = "anchor long, slot int, id long, score long"
#: (anchor's row, slot, column) of what is kept, by a slice of the anchors, the rows' ids and labels, and scores.
Pick = Callable[[pa.Table, np.ndarray, np.ndarray, np.ndarray], Iterator[tuple[np.ndarray, int, np.ndarray]]]


def quantised(v: Column, scale: int) -> Column:
    """Whole numbers floor(scale * x), with x as a double."""
    return F.transform(vec.doubles(v), lambda x: F.floor(x * F.lit(float(scale))))


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of long arrays, padded with zeros to ``width``."""
    lists = column.combine_chunks()
    lengths = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if (lengths == width).all():
        return flat.reshape(len(lists), width)
    out = np.zeros((len(lists), width), np.int64)
    out[np.arange(width)[None, :] < lengths[:, None]] = flat
    return out


def scorer(x: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Exact inner products with the rows of x: as doubles where no sum can pass 2^53, else as Python's
    integers, a hundred times which have to fit a long."""
    top = lambda m: max(abs(int(m.max())), abs(int(m.min()))) if m.size else 0
    own, doubles = top(x), x.astype(np.float64).T

    def score(q: np.ndarray) -> np.ndarray:
        bound = own * top(q) * x.shape[1]
        if bound < 1 << 53:
            return (q.astype(np.float64) @ doubles).astype(np.int64)
        exact = q.astype(object) @ x.astype(object).T
        if exact.size and max(abs(int(s)) for s in exact.ravel()) * 100 >= 1 << 63:
            raise OverflowError("a hundred times a score does not fit a long")
        return exact.astype(np.int64)

    return score


def firsts(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the first k allowed columns of each row: falling score, then rising column."""
    n = scores.shape[1]
    if not scores.size:
        return np.zeros(0, int), np.zeros(0, int)
    if max(abs(int(scores.max())), abs(int(scores.min()))) < (1 << 62) // (n + 1) - 1:
        # Different values for different columns, so that a cut at k is the cut.
        falling = np.where(allowed, (np.arange(n) - n + 1) - scores * n, -_NONE)
        at = np.argpartition(falling, k - 1, axis=1)[:, :k] if k < n else np.broadcast_to(np.arange(n), scores.shape)
        rows, cols = np.repeat(np.arange(len(scores)), at.shape[1]), at.ravel()
        good = allowed[rows, cols]
        return rows[good], cols[good]
    out = [(i, j) for i in range(len(scores)) for j in sorted(np.flatnonzero(allowed[i]).tolist(), key=lambda j: (-int(scores[i, j]), j))[:k]]
    return np.array([i for i, _ in out], int), np.array([j for _, j in out], int)


def _meetings(rows: DataFrame, anchors: DataFrame, pick: Pick, width: int) -> DataFrame:
    """(anchor, slot, id, score) of what ``pick`` keeps in each pair of a block of rows and one of anchors."""
    n = rows.count()
    parts = max(1, -(-n // ROWS), min(8, -(-n // 1024)))
    blocks = max(1, -(-anchors.count() // ANCHORS))
    deal = lambda k: F.pmod(F.xxhash64("vec_id", "x"), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = rows.withColumn("part", deal(parts)).withColumn("block", every(blocks))
    right = anchors.withColumn("block", deal(blocks)).withColumn("part", every(parts))

    def meet(own: pa.Table, asked: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64),) * 4]
        if own.num_rows and asked.num_rows:
            own = own.sort_by("vec_id")
            ids, labels, score = own.column("vec_id").to_numpy(), own.column("label").to_numpy(), scorer(matrix(own.column("x"), width))
            names, q = asked.column("anchor").to_numpy(), matrix(asked.column("x"), width)
            step = max(1, CELLS // len(ids))
            for i in range(0, len(q), step):
                scores = score(q[i : i + step])
                for at, slot, col in pick(asked.slice(i, step), ids, labels, scores):
                    found.append((names[i + at], np.full(len(at), slot), ids[col], scores[at, col]))
        kinds = {"anchor": pa.int64(), "slot": pa.int32(), "id": pa.int64(), "score": pa.int64()}
        return pa.table({c: pa.array(np.concatenate(v), k) for (c, k), v in zip(kinds.items(), zip(*found))})

    return left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInArrow(meet, _FOUND)


def _positives(k: int) -> Pick:
    def pick(anchors: pa.Table, ids: np.ndarray, labels: np.ndarray, scores: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
        own, names = anchors.column("label").to_numpy(), anchors.column("vec_id").to_numpy()
        for label in np.unique(own):
            at, cols = np.flatnonzero(own == label), np.flatnonzero(labels == label)
            r, c = firsts(scores[np.ix_(at, cols)], ids[cols][None, :] != names[at][:, None], k)
            yield at[r], 0, cols[c]

    return pick


def _negatives(k: int) -> Pick:
    def pick(anchors: pa.Table, ids: np.ndarray, labels: np.ndarray, scores: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
        own, lowest, limits = anchors.column("label").to_numpy(), anchors.column("lowest").to_numpy(), anchors.column("upper").to_pylist()
        hundreds = scores * 100
        allowed = (labels[None, :] != own[:, None]) & (hundreds >= lowest[:, None])
        slots = max(map(len, limits), default=0)
        bounds = np.array([u + [np.iinfo(np.int64).min] * (slots + 1 - len(u)) for u in limits], np.int64)
        for slot in range(slots):
            inside = allowed & (hundreds <= bounds[:, slot][:, None]) & (hundreds > bounds[:, slot + 1][:, None])
            r, c = firsts(scores, inside, k)
            yield r, slot, c

    return pick


def mine(rows: DataFrame, is_anchor: Column, *, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95, scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of ``rows`` (vec_id,
    label, vector), where ``is_anchor`` tells the query set by vec_id.

    Scores are inner products of floor(scale * component). An anchor's positives are the first rows of its
    label; negatives have another label and from ``least`` to ``most`` hundredths of the positive's score.
    Higher scores come first, then lower ids.

    Rows with a null id, label or vector, or a component that is null or not finite, take no part. A
    shorter vector counts as if zeros followed. Rows that are equal count once; rows that share an id and
    differ are rows and anchors of their own, but a row of an anchor's id is not its positive. A positive
    score below zero has an empty window. A hundred times a score has to fit a long. An empty table
    gives no rows; further columns are not read.
    """
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & vec.is_finite(F.col("vector"))
    clean = rows.where(good).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), quantised(F.col("vector"), scale).alias("x"))
    clean, _ = written(clean.distinct())
    width = clean.agg(F.max(F.size("x"))).first()[0] or 0
    asked, _ = written(clean.where(is_anchor).withColumn("anchor", F.xxhash64("vec_id", "label", "x")))
    best = select.first_n(_meetings(clean, asked, _positives(positives), width), ["anchor"], [F.desc("score"), F.col("id")], positives, "place")
    known = best.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("place", "id", "score"))).alias("found"))
    limits = F.array_distinct(F.transform("found", lambda p: p["score"] * most))
    lowest = F.array_min(F.transform("found", lambda p: p["score"] * least))
    known, _ = written(known.select("anchor", "found", limits.alias("upper"), lowest.alias("lowest")))
    searched = asked.join(known.select("anchor", "upper", "lowest"), "anchor")
    kept = select.first_n(_meetings(clean, searched, _negatives(negatives), width), ["anchor", "slot"], [F.desc("score"), F.col("id")], negatives, "place")
    merged = kept.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("slot", "place", "id", "score"))).alias("down"))
    pairs = asked.select("anchor", F.col("vec_id").alias("anchor_id")).join(known, "anchor").join(merged, "anchor")
    pairs = pairs.select("anchor_id", "upper", "down", F.explode("found").alias("p"))
    slot = F.array_position("upper", F.col("p.score") * most) - 1
    window = F.slice(F.filter("down", lambda d: d["slot"] >= slot), 1, negatives)
    found = pairs.select("anchor_id", "p", F.posexplode(window).alias("at", "n")).where(F.col("n.score") * 100 >= F.col("p.score") * least)
    return found.select("anchor_id", F.col("p.id").alias("positive_id"), (F.col("at") + 1).alias("rank"), F.col("n.id").alias("negative_id"), F.col("p.score").alias("positive_score"), F.col("n.score").alias("negative_score"))
