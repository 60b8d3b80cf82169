"""A session with the settings that the library expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build(app: str = "girasol", **conf: str) -> SparkSession:
    """UTC and adaptive execution; whatever else is set already, or given here, stays."""
    builder = SparkSession.builder.appName(app)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    for key, value in {**settings, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, set on the context if it is not yet. Only a
    session within one process gets one of our own where the setting is missing."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or "/tmp/girasol-checkpoints")
    return context.getCheckpointDir()
