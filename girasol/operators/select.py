"""Sampling, quotas, caps, splits: seeded by hashed keys, so that any run repeats them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from girasol.functions.keys import hkey


def sample(df: DataFrame, seed: int, key: str, n: int) -> DataFrame:
    """n rows without replacement (a top-n by hashed key: no full sort)."""
    return df.orderBy(hkey(seed, F.col(key)), key).limit(n)


def first_n(df: DataFrame, group: list[str], order: list[Column], n: int, rank: str | None = None) -> DataFrame:
    """The first n rows of each group; Spark limits each task's rows before the shuffle."""
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(name) <= n)
    return out if rank else out.drop(name)


def sample_by(df: DataFrame, group: str, seed: int, key: str, n: int, rank: str | None = None) -> DataFrame:
    """min(n, available) rows of each group."""
    return first_n(df, [group], [hkey(seed, F.col(key)), F.col(key)], n, rank)


def strided_shard(df: DataFrame, index: str, rank: int, world: int, skip: int = 0) -> DataFrame:
    """Rows skip + rank + world * k of a materialised index."""
    return df.where((F.col(index) >= skip) & (F.pmod(F.col(index) - skip, F.lit(world)) == rank))


def numbered(df: DataFrame, bucket: Column, order: list[Column], name: str, within: list[str] | None = None, *, descending: bool = False) -> DataFrame:
    """Adds name: 1, 2, ... in ``order`` (in each group of ``within``), where ``bucket`` does not
    fall (with ``descending``: rise) along it. Rows are numbered within a bucket; only the buckets'
    sizes meet in one place, so their number has to be bounded."""
    keys = within or []
    b = df.withColumn("_b", bucket)
    sizes = b.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_c"))
    along = Window.partitionBy(*keys, F.lit(0)).orderBy(F.desc("_b") if descending else F.col("_b")).rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(*keys, "_b", F.coalesce(F.sum("_c").over(along), F.lit(0)).alias("_o"))
    place = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(*order))
    return b.withColumn("_p", place).join(before, [*keys, "_b"]).withColumn(name, F.col("_o") + F.col("_p")).drop("_b", "_o", "_p")


def split_groups(df: DataFrame, group: str, seed: int, held: float) -> DataFrame:
    """Adds held_out: whole groups, max(1, int(groups * held)) of them."""
    groups = df.select(group).distinct()
    key = hkey(seed, F.col(group))
    ranked = numbered(groups, F.substring(key, 1, 3), [key, F.col(group)], "_n")
    count = groups.agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) * held)).alias("_held"))
    marked = ranked.crossJoin(F.broadcast(count)).select(group, (F.col("_n") <= F.col("_held")).alias("held_out"))
    return df.join(marked, group)


def largest_remainder(strata: DataFrame, weight: str, total: int, key: str) -> DataFrame:
    """Adds quota: total shared out in proportion to weight, remainders to the largest fractions."""
    every = Window.partitionBy(F.lit(1))
    exact = F.col(weight) * F.lit(float(total)) / F.sum(weight).over(every)
    w = strata.withColumn("_exact", exact).withColumn("_floor", F.floor("_exact"))
    w = w.withColumn("_left", F.lit(total) - F.sum("_floor").over(every))
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc(F.col("_exact") - F.col("_floor")), key)
    w = w.withColumn("quota", (F.col("_floor") + (F.row_number().over(order) <= F.col("_left")).cast("int")).cast("long"))
    return w.drop("_exact", "_floor", "_left")


def breadth_first(df: DataFrame, feature: str, rank: str, seed: int, cap: int, per_feature: int | None = None) -> DataFrame:
    """All features' first rows before any second one; a random part of the level that the cap cuts."""
    deep = df.withColumn("depth", F.row_number().over(Window.partitionBy(feature).orderBy(rank)) - 1)
    if per_feature is not None:
        deep = deep.where(F.col("depth") < per_feature)
    return deep.orderBy("depth", hkey(seed, F.col(feature), F.col(rank)), feature, rank).limit(cap) if cap else deep


def level_capacity(df: DataFrame, block: str, rank: str, doc: str, seed: int, levels: int, doc_cap: int, *, start: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """Greedy selection: in each level every block that has no more rows than levels before takes its best
    unused row whose document has room; ``most`` rows in all, of the last level a seeded part. ``start``
    is an earlier selection to go on with; (block, rank) tells rows apart. A pass a level; the state
    between passes is a table, not the driver's memory."""
    from girasol.sources.sinks import saved

    chosen = start
    for level in range(levels):
        free = df
        if chosen is not None:
            full = chosen.groupBy(doc).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= doc_cap).select(doc)
            ahead = chosen.groupBy(block).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > level).select(block)
            free = df.join(chosen.select(block, rank), [block, rank], "left_anti").join(full, doc, "left_anti").join(ahead, block, "left_anti")
        pick = first_n(free, [block], [F.col(rank), hkey(seed, F.col(doc)), F.col(doc)], 1)
        room = F.lit(doc_cap)
        if chosen is not None:
            used = chosen.groupBy(doc).agg(F.count(F.lit(1)).alias("_used"))
            pick = pick.join(used, doc, "left")
            room = F.lit(doc_cap) - F.coalesce("_used", F.lit(0))
        order = Window.partitionBy(doc).orderBy(hkey(seed, F.col(block)), block)
        pick = pick.withColumn("_in", F.row_number().over(order)).where(F.col("_in") <= room).select(*df.columns, F.lit(level).alias("level"))
        if most is not None:
            left = most - (0 if chosen is None else chosen.count())
            pick = pick.orderBy(hkey(seed, F.col(block), F.col(rank)), block, rank).limit(max(0, left))
        chosen = saved(pick if chosen is None else chosen.unionByName(pick))
    return chosen


def topped_up(df: DataFrame, block: str, rank: str, doc: str, wave: str, rule: Column, *, seed: int, levels: int, doc_cap: int, rows: int, tolerance: float = 0.0) -> tuple[DataFrame, int]:
    """A selection of ``rows`` rows that all keep a rule, and how many are missing.

    Selected first without the rule; rows that break it go, which frees their blocks' and documents' room,
    and the rest is selected among those that keep it. While more than ``tolerance`` of the rows are missing,
    the candidates of the next wave join and the selection is made anew; column topped_up tells the second
    part. A rule that is null is broken."""
    from girasol.sources.sinks import saved

    good = F.coalesce(rule, F.lit(False))
    waves = sorted(r[0] for r in df.select(wave).where(F.col(wave).isNotNull()).distinct().collect())
    found, missing = df.where("false").withColumns({"level": F.lit(0), "topped_up": F.lit(False)}), rows
    for last in waves:
        pool = df.where(F.col(wave) <= last)
        first = level_capacity(pool, block, rank, doc, seed, levels, doc_cap, most=rows)
        kept = saved(first.where(good).withColumn("topped_up", F.lit(False)))
        more = level_capacity(pool.where(good).withColumn("topped_up", F.lit(True)), block, rank, doc, seed, levels, doc_cap, start=kept, most=rows)
        found, missing = more, rows - more.count()
        if missing <= tolerance * rows:
            break
    return found, missing


def verified(df: DataFrame, key: str, seed: int, order: str, n: int) -> DataFrame:
    """n rows of each key by a seeded draw; a key that has fewer is an error, not a gap."""
    checked = F.assert_true(F.col("_have") >= n, F.concat(F.lit(f"fewer than {n} rows for "), F.col(key).cast("string")))
    enough = df.groupBy(key).agg(F.count(F.lit(1)).alias("_have")).where(F.coalesce(checked.cast("boolean"), F.lit(True))).select(key)
    return sample_by(df, key, seed, order, n).join(enough, key, "left_semi")
