"""The dip test of unimodality, by group, over each group's whole distribution.

The dip is the least distance of an empirical distribution from any unimodal one: half the largest gap
that stays as the interval of the mode is narrowed between the greatest convex minorant and the least
concave majorant. The distribution is a group's distinct values and their counts, ranked in parts.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .packing import in_order

#: Cells of equal rank; a group with more distinct values than these hold keeps two values of each.
CELLS = 1 << 17
#: Values of a sample of the uniform null, at most, and samples.
NULL_SIZE, NULL_DRAWS = 500, 400


def _minorant(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Places where the greatest convex minorant of (x, y) touches it; x rises."""
    xs, ys, kept = x.tolist(), y.tolist(), []
    for i, (px, py) in enumerate(zip(xs, ys)):
        while len(kept) > 1:
            b, a = kept[-1], kept[-2]
            if (ys[b] - ys[a]) * (px - xs[b]) < (py - ys[b]) * (xs[b] - xs[a]):
                break
            kept.pop()
        kept.append(i)
    return np.array(kept)


def dip(x: np.ndarray, cum: np.ndarray) -> float:
    """The dip of rising distinct values x with cumulative counts cum; 0 for a single value."""
    low = np.concatenate([[0], cum[:-1]])
    lo, hi, found = 0, len(x) - 1, 0.0
    while lo < hi:
        at, top, bottom = x[lo : hi + 1], cum[lo : hi + 1], low[lo : hi + 1]
        g, c = _minorant(at, bottom), _minorant(at, -top)
        under, over = np.interp(at, at[g], bottom[g]), np.interp(at, at[c], top[c])
        gap = over - under
        if gap[g].max() > gap[c].max():
            a = g[gap[g].argmax()]
            b = c[np.searchsorted(c, a)]
        else:
            b = c[gap[c].argmax()]
            a = g[np.searchsorted(g, b, side="right") - 1]
        if gap.max() <= found:
            break
        found = max(found, (top - under)[:a].max(initial=0.0), (over - bottom)[b + 1 :].max(initial=0.0))
        lo, hi = lo + int(a), lo + int(b)
    return float(found) / (2 * float(cum[-1]))


@lru_cache(maxsize=64)
def null_dips(size: int, draws: int, seed: int) -> np.ndarray:
    """Dips of ``draws`` samples of ``size`` uniform values, sorted."""
    rng = np.random.default_rng([seed, size])
    return np.sort([dip(np.sort(rng.random(size)), np.arange(1, size + 1)) for _ in range(draws)])


def distribution(df: DataFrame, group: str, value: str, *, cells: int = CELLS, rows: int = 65_536) -> DataFrame:
    """(group, value, cum, n): cumulative counts of each group's distinct finite values. Where they are more
    than cells hold, of each cell of equal rank its first and its last value."""
    x = F.col(value).cast("double")
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    counts = df.where(finite).groupBy(F.col(group), x.alias(value)).agg(F.count(F.lit(1)).alias("_c"))
    parts = in_order(counts, [F.col(group), F.col(value)], rows)
    # A row for each group and part that has some of it.
    sums = parts.groupBy(group, "_part").agg(F.sum("_c").alias("_s"))
    own = Window.partitionBy(group)
    sums = sums.select(group, "_part", F.sum("_s").over(own).alias("n"), (F.sum("_s").over(own.orderBy("_part")) - F.col("_s")).alias("_o"))
    within = F.sum("_c").over(Window.partitionBy(group, "_part").orderBy("_in"))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in (group, "_part")]
    placed = parts.withColumn("_w", within).alias("r").join(sums.alias("s"), same[0] & same[1])
    placed = placed.select(F.col(f"r.{group}").alias(group), value, (F.col("_o") + F.col("_w")).alias("cum"), "n")
    cell = F.floor((F.col("cum") - 1) / F.col("n") * F.lit(cells))
    ends = placed.groupBy(group, "n", cell.alias("_cell")).agg(F.min(F.struct(value, "cum")).alias("a"), F.max(F.struct(value, "cum")).alias("b"))
    kept = ends.select(group, "n", F.explode(F.array_distinct(F.array("a", "b"))).alias("e"))
    return kept.select(group, F.col(f"e.{value}").alias(value), "e.cum", "n")


def dip_test(df: DataFrame, group: str, value: str, *, seed: int = 0, draws: int = NULL_DRAWS, cells: int = CELLS) -> DataFrame:
    """(group, n, dip, error, p): the dip of each group's values and its p under a uniform null.

    Nulls and values that are not finite take no part; a group without others has no row, and equal values
    have a dip of 0. A task holds at most two values for each of ``cells`` cells of a group: dips of groups
    of at most so many rows are exact (error 0), others at most ``error`` = 1 / cells away. p is the share of ``draws``
    seeded samples whose dip, in units of one over the root of their size, is not below; samples have the
    group's size, or NULL_SIZE values if that is less, which the dip's limit law allows.
    """

    def run(pdf):  # noqa: ANN001, ANN202
        pdf = pdf.sort_values(value)
        n, size = int(pdf["n"].iloc[0]), min(int(pdf["n"].iloc[0]), NULL_SIZE)
        d = dip(pdf[value].to_numpy(float), pdf["cum"].to_numpy(float))
        null = null_dips(size, draws, seed) * size**0.5
        above = draws - int(np.searchsorted(null, d * n**0.5 - 1e-12))
        out = pdf.head(1)[[group]]
        return out.assign(n=n, dip=d, error=0.0 if n <= cells else 1 / cells, p=(1 + above) / (1 + draws))

    kind = df.schema[group].dataType.simpleString()
    return distribution(df, group, value, cells=cells).groupBy(group).applyInPandas(run, f"`{group}` {kind}, n long, dip double, error double, p double")
