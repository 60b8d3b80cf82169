"""Greedy cuts of one long sequence, as bins and batches are, in parallel.

A run that starts at row i ends before the first row j with c(j) > q(i), where c does not fall along the
order. So every row knows where the next run would start if one started at it, by a search; which
rows do start runs is a walk from the first one. The order is cut into parts. In a part the walk from
each of its rows is a table; a walk enters a part only where a run of an earlier part may end, which are
few rows; and those entries are walked by pointer doubling: a join for each power of two of the parts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from girasol.sources.sinks import saved, stored

#: Rows of a part, which a task holds with two numbers each.
ROWS = 65_536


def in_order(df: DataFrame, order: list[Column], rows: int = ROWS) -> DataFrame:
    """``df`` as a table with _part and _in: parts follow the order, rows of a part are numbered along it.

    Rows that are equal in ``order`` come as they were read, so a value that many rows share is
    split over parts as well."""
    parts = max(1, -(-df.count() // rows))
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    ranged = tied.repartitionByRange(parts, *order, "_tie").sortWithinPartitions(*order, "_tie")
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return stored(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_in", place).drop("_tie"))


def neighbours(df: DataFrame, order: str, value: str, rows: int = ROWS) -> DataFrame:
    """Adds lo and hi: the last value that is not null up to a row, and the first from it on, along ``order``,
    which is different in each row. A part needs one value of the parts before it and one of those after."""
    cut = in_order(df, [F.col(order)], rows)
    there = F.when(F.col(value).isNotNull(), F.col("_in"))
    ends = cut.groupBy("_part").agg(F.min_by(value, there).alias("_first"), F.max_by(value, there).alias("_last"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("_part", F.last("_last", True).over(earlier).alias("_lo"), F.last("_first", True).over(later).alias("_hi"))
    up, down = (Window.partitionBy("_part").orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in (F.col("_in"), F.desc("_in")))
    found = cut.withColumn("lo", F.last(value, True).over(up)).withColumn("hi", F.last(value, True).over(down)).join(F.broadcast(ends), "_part")
    return found.withColumn("lo", F.coalesce("lo", "_lo")).withColumn("hi", F.coalesce("hi", "_hi")).drop("_part", "_in", "_lo", "_hi")


def _before(rows: DataFrame, value: Column) -> DataFrame:
    """(_part, _before): the sum of ``value`` over the parts before; one row a part meets in one place."""
    sums = rows.groupBy("_part").agg(F.sum(value).alias("_s"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("_part", F.coalesce(F.sum("_s").over(earlier), F.lit(0)).cast("long").alias("_before"))


def _walk(c: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of a part: the next start (len(c): outside), the last start of the walk in the part, and
    how many starts it has there."""
    n = len(c)
    after = np.searchsorted(c, q, side="right")
    last, starts = np.arange(n), np.ones(n, np.int64)
    for i in range(n - 1, -1, -1):
        j = after[i]
        if j < n:
            last[i], starts[i] = last[j], starts[j] + 1
    return after, last, starts


def _table(columns: dict[str, tuple[object, pa.DataType]]) -> pa.Table:
    return pa.table({k: pa.array(v, t) for k, (v, t) in columns.items()})


def runs(rows: DataFrame) -> DataFrame:
    """(_part, _in, run): numbers from 0 of the runs of ``rows`` (_part, _in, c, q), where c does not fall
    along the order, is not negative, and q is not less than the row's own c."""
    tops = sorted(map(tuple, rows.groupBy("_part").agg(F.max("c")).collect()))
    if not tops:
        return rows.select("_part", "_in", F.lit(0).cast("long").alias("run"))
    names, ends = np.array([p for p, _ in tops]), np.array([c for _, c in tops])
    shared = rows.sparkSession.sparkContext.broadcast((names, ends))
    long = pa.int64()

    def leaving(part: pa.Table) -> pa.Table:
        part = part.sort_by("_in")
        c, q = part.column("c").to_numpy(), part.column("q").to_numpy()
        names, ends = shared.value
        out = np.unique(q[np.searchsorted(c, q, side="right") == len(c)])
        at = np.searchsorted(ends, out, side="right")
        inside = at < len(ends)
        return _table({"q": (out[inside], long), "_part": (names[at[inside]], pa.int32())})

    def entering(part: pa.Table, asked: pa.Table) -> pa.Table:
        part = part.sort_by("_in")
        c, q = part.column("c").to_numpy(), part.column("q").to_numpy()
        _, last, starts = _walk(c, q)
        wanted = asked.column("q").to_numpy()
        j = np.searchsorted(c, wanted, side="right")
        return _table({"q": (wanted, long), "_part": (np.full(len(j), part.column("_part")[0].as_py()), pa.int32()), "to": (q[last[j]], long), "starts": (starts[j], long)})

    loose = rows.groupBy("_part").applyInArrow(leaving, "q long, _part int").distinct()
    first = rows.sparkSession.createDataFrame([(-1, int(names[0]))], "q long, _part int")
    asked = loose.unionByName(first).withColumnRenamed("_part", "_at")
    entries = saved(rows.groupBy("_part").cogroup(asked.groupBy("_at")).applyInArrow(entering, "q long, _part int, to long, starts long"))
    steps = [entries.select("q", "to")]
    for _ in range(max(0, int(len(names) - 1).bit_length() - 1)):
        now = steps[-1]
        steps.append(saved(now.join(now.select(F.col("q").alias("to"), F.col("to").alias("_to")), "to").select("q", F.col("_to").alias("to"))))
    seen = first.select("q")
    for step in reversed(steps):
        seen = saved(seen.unionByName(step.join(seen, "q", "left_semi").select(F.col("to").alias("q")))).distinct()
    walked = entries.join(F.broadcast(seen), "q", "left_semi")
    counted = rows.select("_part").distinct().join(walked.select("_part", "q", "starts"), "_part", "left")
    counted = stored(counted.join(_before(counted, F.coalesce("starts", F.lit(0))), "_part").select(F.col("_part").alias("_at"), "q", "_before"))

    def numbered(part: pa.Table, entry: pa.Table) -> pa.Table:
        part = part.sort_by("_in")
        c, q = part.column("c").to_numpy(), part.column("q").to_numpy()
        entered, before = entry.column("q")[0].as_py(), entry.column("_before")[0].as_py()
        starts = np.zeros(len(c), np.int64)
        if entered is not None:
            after = np.searchsorted(c, q, side="right")
            i = int(np.searchsorted(c, entered, side="right"))
            while i < len(c):
                starts[i], i = 1, int(after[i])
        return _table({"_part": (part.column("_part"), pa.int32()), "_in": (part.column("_in"), long), "run": (np.cumsum(starts) + before - 1, long)})

    return rows.groupBy("_part").cogroup(counted.groupBy("_at")).applyInArrow(numbered, "_part int, _in long, run long")


def _with_runs(table: DataFrame, rows: DataFrame, name: str) -> DataFrame:
    found = runs(stored(rows.select("_part", "_in", "c", "q")))
    return table.join(found.withColumnRenamed("run", name), ["_part", "_in"]).drop("_part", "_in")


def pack(df: DataFrame, order: list[Column], length: str, budget: int, *, rows: int = ROWS, name: str = "bin") -> DataFrame:
    """Adds bin: rows in order, a new bin when the next row does not fit; rows longer than the budget, or
    without a length, go."""
    table = in_order(df.where(F.col(length) <= budget), order, rows)
    within = Window.partitionBy("_part").orderBy("_in").rowsBetween(Window.unboundedPreceding, 0)
    size = F.greatest(F.col(length).cast("long"), F.lit(0).cast("long"))
    sums = table.select("_part", "_in", size.alias("n"))
    c = F.sum("n").over(within) + F.col("_before")
    placed = sums.join(_before(sums, F.col("n")), "_part").select("_part", "_in", c.alias("c"), "n")
    return _with_runs(table, placed.withColumn("q", F.col("c") - F.col("n") + budget), name)


def batch(df: DataFrame, order: list[Column], length: str, budget: int, most: int, *, rows: int = ROWS, name: str = "batch") -> DataFrame:
    """Adds batch: rows by falling length, then ``order``; the rows of a batch times its longest are within
    the budget, and they are ``most`` at most; a row that is beyond the budget is a batch of its own.
    A missing length counts as none."""
    size = F.greatest(F.coalesce(F.col(length).cast("long"), F.lit(0).cast("long")), F.lit(0).cast("long"))
    table = in_order(df.withColumn("_size", size), [F.desc("_size"), *order], rows)
    counts = _before(table.select("_part"), F.lit(1))
    fits = F.expr(f"CASE WHEN _size > 0 THEN {int(budget)} div _size ELSE {int(most)} END")
    taken = F.greatest(F.lit(1).cast("long"), F.least(F.lit(most).cast("long"), fits))
    placed = table.select("_part", "_in", taken.alias("k")).join(counts, "_part")
    placed = placed.select("_part", "_in", (F.col("_before") + F.col("_in")).alias("c"), "k")
    return _with_runs(table.drop("_size"), placed.withColumn("q", F.col("c") + F.col("k") - 1), name)


def summary(packed: DataFrame, name: str, length: str) -> DataFrame:
    """(name, rows, total, longest) of each bin or batch."""
    return packed.groupBy(name).agg(F.count(F.lit(1)).alias("rows"), F.sum(length).alias("total"), F.max(length).alias("longest"))
