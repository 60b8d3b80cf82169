"""Banks: a spec of sources becomes one plan of union, exclusion, quota, shuffle and new ids."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from girasol.functions import vec
from girasol.functions.keys import hkey

from . import select


@dataclass(frozen=True)
class Source:
    """A part of a mix: rows of some families of one bank, n in all (None: every row)."""

    name: str
    families: tuple = ()
    n: int | None = None


def mix(banks: dict[str, DataFrame], spec: list[Source], *, key: str, family: str, seed: int, exclude: DataFrame | None = None) -> DataFrame:
    """src_bank, src_<key> and the bank's columns. Quotas are shared out over families by size;
    ``exclude`` has (src_bank, <key>) rows to leave out."""
    parts = []
    for source in spec:
        rows = banks[source.name]
        if source.families:
            rows = rows.where(F.col(family).isin(*source.families))
        if exclude is not None:
            rows = rows.join(exclude.where(F.col("src_bank") == source.name).select(key), key, "left_anti")
        if source.n is not None:
            sizes = rows.groupBy(family).agg(F.count(F.lit(1)).alias("_w"))
            quotas = select.largest_remainder(sizes, "_w", source.n, family).select(family, F.col("quota").alias("_q"))
            ranked = select.sample_by(rows, family, seed, key, source.n, "_r")
            rows = ranked.join(quotas, family).where("_r <= _q").drop("_r", "_q")
        parts.append(rows.withColumn("src_bank", F.lit(source.name)).withColumnRenamed(key, f"src_{key}"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def rekey(df: DataFrame, seed: int, *keys: str, name: str = "vec_idx", buckets: int = 256) -> DataFrame:
    """Adds dense ids in hashed order. A bucket's rows are numbered by themselves; only the
    buckets' sizes meet in one place."""
    from pyspark.sql import Window

    k = hkey(seed, *[F.col(c) for c in keys])
    b = df.withColumn("_k", k).withColumn("_b", F.pmod(F.conv(F.substring(k, 1, 6), 16, 10).cast("long"), F.lit(buckets)))
    sizes = b.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("_b").orderBy("_k", *keys)) - 1
    offset = F.broadcast(sizes.select("_b", before.alias("_o")))
    return b.withColumn("_p", place).join(offset, "_b").withColumn(name, F.col("_o") + F.col("_p")).drop("_k", "_b", "_p", "_o")


def verify(df: DataFrame, key: str, vector: str) -> DataFrame:
    """One row of facts about a published bank: rows, different ids, range of ids, units, not finite."""
    n = vec.norm(F.col(vector))
    return df.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(key).alias("ids"), F.min(key).alias("lo"), F.max(key).alias("hi"),
        F.count_if((n >= 0.98) & (n <= 1.02)).alias("units"), F.count_if(~vec.is_finite(F.col(vector))).alias("not_finite"),
    )
