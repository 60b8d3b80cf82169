"""A side table that streams read anew for every micro-batch, by version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from girasol.streaming import state


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions below ``path`` that are whole: their writer's last file is there."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.listStatus(root) if fs.exists(root) else []
    numbers = [int(f.getPath().getName().removeprefix("version=")) for f in found if f.getPath().getName().startswith("version=")]
    return sorted(n for n in numbers if fs.exists(hadoop.Path(f"{path}/version={n}/_SUCCESS")))


def publish(df: DataFrame, path: str) -> int:
    """Write the next version; readers see it once it is whole. A version is never written twice."""
    number = max([0, *versions(df.sparkSession, path)]) + 1
    df.write.mode("overwrite").parquet(f"{path}/version={number}")
    return number


def drop_listed(stream: DataFrame, side: str, key: str, name: str, *, at: str | None = None) -> tuple[DataFrame, str]:
    """The rows of a stream whose key the side table does not list, with side_version (0: none yet), and
    the folder of the run to go on with.

    Each micro-batch takes the newest whole version there is when it begins; one that is half written
    is passed over. A null key is listed by nothing."""
    spark = stream.sparkSession

    def refreshed(batch: DataFrame) -> DataFrame:
        whole = versions(spark, side)
        if not whole:
            return batch.withColumn("side_version", F.lit(0))
        listed = spark.read.parquet(f"{side}/version={whole[-1]}").select(key).distinct()
        return batch.join(listed, key, "left_anti").withColumn("side_version", F.lit(whole[-1]))

    schema = stream.schema.add("side_version", "integer")
    return state.run_batches(stream, name, "append", refreshed, schema, at=at)
