"""Scans: documents, records, shards and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from girasol.functions.keys import hkey


def corpus(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None) -> DataFrame:
    """Documents with text = content, else text, else empty."""
    reader = spark.read.schema(schema) if schema else spark.read
    df = reader.option("mode", "DROPMALFORMED").format(fmt).load(path) if fmt == "json" else reader.format(fmt).load(path)
    parts = [F.nullif(F.col(c), F.lit("")) for c in ("content", "text") if c in df.columns]
    return df.withColumn("text", F.coalesce(*parts, F.lit("")))


def interleaved(df: DataFrame, file: str, order: str, turn: int) -> DataFrame:
    """Adds turn and slot: files take turns of ``turn`` rows each."""
    n = F.row_number().over(Window.partitionBy(file).orderBy(order)) - 1
    return df.withColumn("_n", n).withColumn("turn", F.floor(F.col("_n") / turn).cast("long")).withColumn("slot", (F.col("_n") % turn).cast("long")).drop("_n")


def assign_files(files: DataFrame, domain: str, file: str, seed: int, per_domain: int, world: int, used: DataFrame | None = None) -> DataFrame:
    """(domain, file, rank): a seeded choice in each domain, dealt out in turn; used files are left out."""
    free = files.select(domain, file).distinct()
    if used is not None:
        free = free.join(used, file, "left_anti")
    chosen = free.withColumn("_n", F.row_number().over(Window.partitionBy(domain).orderBy(hkey(seed, F.col(file)), file))).where(F.col("_n") <= per_domain)
    dealt = F.row_number().over(Window.orderBy(domain, "_n")) - 1
    return chosen.select(domain, file, "_n").withColumn("rank", F.pmod(dealt, F.lit(world)).cast("int")).drop("_n")


def aligned_records(records: DataFrame, key: str, expected: int) -> DataFrame:
    """The records, or an error if keys are not 0 .. expected - 1, each once."""
    facts = records.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(key).alias("d"), F.min(key).alias("lo"), F.max(key).alias("hi"))
    ok = (F.col("n") == expected) & (F.col("d") == expected) & (F.col("lo") == 0) & (F.col("hi") == expected - 1)
    checked = facts.select(F.assert_true(ok, F.lit("records and vectors are not aligned")).alias("_ok"))
    return records.crossJoin(F.broadcast(checked)).where(F.col("_ok").isNull()).drop("_ok")


def log_lines(lines: DataFrame, column: str, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """Fields by (pattern with one group, type) from text lines; rows without any match go."""
    found = [F.nullif(F.regexp_extract(column, p, 1), F.lit("")).cast(t).alias(n) for n, (p, t) in fields.items()]
    return lines.select(*found).where(F.coalesce(*[F.col(n).cast("string") for n in fields]).isNotNull())


def metric_rows(rows: DataFrame, step: str, needed: list[str]) -> DataFrame:
    """Rows that have a step and all needed metrics; NaN counts as missing."""
    out = rows.where(F.col(step).isNotNull())
    for c in needed:
        out = out.where(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")))
    return out


def jsonl_documents(spark: SparkSession, path: str, schema: str, *, least_chars: int = 0, least_tokens: int = 0) -> DataFrame:
    """Documents of JSON lines files, with file. Malformed rows are skipped, files without any
    good row give none, and short documents go."""
    rows = corpus(spark, path, "json", schema).withColumn("file", F.col("_metadata.file_name"))
    rows = rows.where(F.length("text") >= least_chars)
    return rows.where(F.size(F.split(F.trim("text"), r"\s+")) >= least_tokens) if least_tokens else rows
