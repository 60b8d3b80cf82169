"""Connected components of an edge table, without collecting anything."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from girasol.session import shared_folder


def saved(df: DataFrame) -> DataFrame:
    """Computed once and kept in the shared checkpoint folder, so that lost executors cost nothing."""
    spark = df.sparkSession
    shared_folder(spark)
    out = df.checkpoint(eager=True)
    # What df shuffled can go as well, unless the caller holds on to it.
    del df
    release(spark)
    return out


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps that are done, which it does only when the
    driver has collected its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """Like saved, but as compressed Parquet, for tables of texts; the caller drops the path."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    schema = df.schema
    del df
    release(spark)
    return spark.read.schema(schema).parquet(path), path


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing reads any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def connected_components(edges: DataFrame, *, most_rounds: int = 50) -> DataFrame:
    """(node, component): every node of ``edges`` (a, b) with the least node reachable from it.

    Large-star and small-star steps in turn; the number of rounds grows with the logarithm
    of a component's size; more than ``most_rounds`` are an error. Self-loops and repeated edges do no harm; no edges give no rows.
    """
    now = saved(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    nodes = now.select(F.col("u").alias("node")).union(now.select("v")).distinct()
    mark = None
    for _ in range(most_rounds):
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least).where("u != v").distinct()
        now = saved(small)
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError(f"components are not settled after {most_rounds} rounds")
    return nodes.join(now.select(F.col("u").alias("node"), F.col("v").alias("m")), "node", "left").select("node", F.coalesce("m", "node").alias("component"))
