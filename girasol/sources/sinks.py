"""Writing tables, and tables in between."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from girasol.functions import vec
from girasol.session import shared_folder


def saved(df: DataFrame) -> DataFrame:
    """Cut lineage in the folder that spark.checkpoint.dir names."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Like saved, but as Parquet, so that a later step reads the columns that it needs."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def publish(df: DataFrame, path: str, *, by: list[str] | None = None) -> None:
    """Written once: refuses to overwrite; the commit protocol leaves _SUCCESS last."""
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def append(df: DataFrame, path: str, *, fmt: str = "json") -> None:
    df.write.mode("append").format(fmt).save(path)


def pool_rows(df: DataFrame, vector: str, least: float = 1e-6) -> DataFrame:
    """Unit vectors of the rows that are finite and not near zero; the others are rejected."""
    n = vec.norm(F.col(vector))
    return df.where(vec.is_finite(F.col(vector)) & (n >= least)).withColumn(vector, vec.unit(F.col(vector)))


def sidecar(df: DataFrame, family: str) -> DataFrame:
    """Row counts by family, with the total."""
    return df.rollup(family).agg(F.count(F.lit(1)).alias("n"), F.grouping(family).cast("int").alias("is_total"))


#: Shards of a run that are read back by name.
LISTED_SHARDS = 10_000


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    kind = "shard long, kept long, check long"
    try:
        return spark.read.schema(kind).parquet(f"{path}/_manifest")
    except AnalysisException:
        return spark.createDataFrame([], kind)


def commit_shards(df: DataFrame, shard: str, key: str, path: str) -> DataFrame:
    """Write those shards that the manifest of ``path`` has not; returns the manifest.

    A shard counts only once its manifest row is there, which is written from what was read back. A run
    that breaks off before leaves files without one: they never count, and a run that has their shard
    replaces them. Only the shards of this run are read back.
    """
    spark = df.sparkSession
    done = _manifest(spark, path).select("shard").distinct()
    todo = df.withColumn("shard", F.col(shard).cast("long")).join(done, "shard", "left_anti")
    data = f"{path}/data"
    own = saved(todo.select("shard").distinct())
    todo.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(data)
    try:
        back = spark.read.parquet(data)
    except AnalysisException:
        return _manifest(spark, path)
    if own.count() <= LISTED_SHARDS:
        # A list prunes the folders that are read.
        back = back.where(F.col("shard").isin([r.shard for r in own.collect()]))
    back = back.withColumn("shard", F.col("shard").cast("long")).join(own, "shard", "left_semi")
    facts = back.groupBy("shard").agg(F.count(F.lit(1)).alias("kept"), F.sum(F.xxhash64(key) % 1_000_003).alias("check"))
    facts.coalesce(1).write.mode("append").parquet(f"{path}/_manifest")
    return _manifest(spark, path)


def committed(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all shards that the manifest has."""
    rows = spark.read.parquet(f"{path}/data").withColumn("shard", F.col("shard").cast("long"))
    return rows.join(_manifest(spark, path).select("shard").distinct(), "shard", "left_semi")


def finalised(df: DataFrame, shard: str, key: str, vector: str, seed: int) -> DataFrame:
    """One bank of all shards: vec_idx is dense in hashed order; fails where a vector is no unit."""
    from girasol.operators import bank

    n = vec.norm(F.col(vector))
    good = F.assert_true(F.coalesce((n >= 0.98) & (n <= 1.02), F.lit(False)), F.lit("a vector is no unit"))
    return bank.rekey(df.where(F.coalesce(good.cast("boolean"), F.lit(True))), seed, shard, key)
