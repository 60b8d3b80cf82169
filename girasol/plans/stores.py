"""Sharded stores, gathers by key, frozen caches, and the vectorised function surfaces."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from girasol.functions import text as tx
from girasol.functions import vec
from girasol.functions.keys import hkey
from girasol.operators import select
from girasol.sources import sinks

from .common import query, table
from .corpus import IDS


@query("SELECT vec_id, vec_id // 128 AS shard, vec_id % 128 AS local_row FROM embeddings")
def s12_sharded_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A global row is a shard and a row in it; Parquet keeps the vectors beside the key."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 128).alias("shard"), (F.col("vec_id") % 128).alias("local_row"))


@query("SELECT vec_id, epoch, row_number() OVER (PARTITION BY epoch ORDER BY md5('61:' || epoch || ':' || vec_id), vec_id) AS place FROM embeddings, (SELECT unnest([0, 1, 2]) epoch)")
def s13_epoch_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's place in each epoch's own order."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("epoch"))
    key = hkey(61, F.col("epoch"), F.col("vec_id"))
    return select.numbered(e, F.substring(key, 1, 3), [key, F.col("vec_id")], "place", ["epoch"])


@query("SELECT vec_id, label FROM embeddings WHERE vec_id % 50 = 0")
def s15_frozen_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frozen set is used only if its manifest (rows, seed, width) is the one expected."""
    e = table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0")
    facts = e.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("width"))
    expected = {"n": e.count(), "width": 64}
    same = (F.col("n") == expected["n"]) & (F.col("width") == expected["width"])
    checked = facts.select(F.assert_true(same, F.lit("the frozen set is another one")).alias("_ok"))
    return e.crossJoin(F.broadcast(checked)).where(F.col("_ok").isNull()).select("vec_id", "label")


@query("SELECT event_id, user_id % 500 AS vec_id, label, round(embedding[1]::DOUBLE, 6) AS head FROM events JOIN embeddings ON vec_id = user_id % 500")
def j2_gather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records meet their vectors by key; the planner picks the join."""
    r = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 500).alias("vec_id"))
    return r.join(table(spark, sf_dir, "embeddings"), "vec_id").select("event_id", "vec_id", "label", F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("head"))


@query("SELECT m.src_bank, m.src_id, m.new_id, e.label FROM (SELECT CASE WHEN vec_id % 2 = 0 THEN 'even' ELSE 'odd' END src_bank, vec_id src_id, vec_id + 10000 new_id FROM embeddings WHERE vec_id % 3 = 0) m JOIN (SELECT CASE WHEN vec_id % 2 = 0 THEN 'even' ELSE 'odd' END b, vec_id, label FROM embeddings) e ON e.b = m.src_bank AND e.vec_id = m.src_id")
def j3_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    bank = F.when(F.col("vec_id") % 2 == 0, "even").otherwise("odd")
    e = table(spark, sf_dir, "embeddings").select(bank.alias("src_bank"), F.col("vec_id").alias("src_id"), "label")
    m = e.where("src_id % 3 = 0").select("src_bank", "src_id", (F.col("src_id") + 10_000).alias("new_id"))
    return m.join(e, ["src_bank", "src_id"]).select("src_bank", "src_id", "new_id", "label")


@query("SELECT l_partkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) - 1 AS depth FROM lineitem WHERE l_quantity > 30")
def w1_depth_within_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber")
    return table(spark, sf_dir, "lineitem").where("l_quantity > 30").select("l_partkey", "l_orderkey", "l_linenumber", (F.row_number().over(w) - 1).alias("depth"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC) AS from_end FROM lineitem WHERE l_partkey % 4 <> 0")
def w6_distance_from_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts kept tokens only."""
    w = Window.partitionBy("l_orderkey").orderBy(F.desc("l_linenumber"), F.desc("l_partkey"))
    return table(spark, sf_dir, "lineitem").where("l_partkey % 4 <> 0").select("l_orderkey", "l_linenumber", "l_partkey", F.row_number().over(w).alias("from_end"))


@query("SELECT user_id, event_id FROM events WHERE value < 50 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY md5('62:' || event_id), event_id) <= 2")
def t32_verified_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two draws below the floor for each key; a key with fewer is an error."""
    return select.verified(table(spark, sf_dir, "events").where("value < 50").select("user_id", "event_id"), "user_id", 62, "event_id", 2)


@query(f"""
WITH t AS (SELECT doc_id, {IDS} v FROM documents), p AS (SELECT doc_id, list_concat(list_transform(range((16 - len(v) % 16) % 16), lambda i: -1), v) w, len(v) n FROM t)
SELECT doc_id, n, list_sum(w[len(w) - n + 1:len(w)])::BIGINT AS span_sum, w[1] AS first FROM p WHERE n > 0""")
def c12_left_pads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Padded on the left to a multiple of 16; the true span is the last n."""
    t = table(spark, sf_dir, "documents").select("doc_id", tx.token_ids(F.col("text")).alias("v")).where("size(v) > 0")
    p = t.select("doc_id", F.size("v").alias("n"), F.concat(F.array_repeat(F.lit(-1), F.pmod(-F.size("v"), F.lit(16))), "v").alias("w"))
    span = F.slice("w", F.size("w") - F.col("n") + 1, F.col("n"))
    return p.select("doc_id", F.col("n").cast("long").alias("n"), F.aggregate(span, F.lit(0).cast("long"), lambda a, x: a + x).alias("span_sum"), F.get("w", F.lit(0)).alias("first"))


@query("SELECT event_id, floor(log10(value + 1) * 8)::BIGINT AS bin, round(ln(1 + value), 6) AS log1p, ceil(value / 7)::BIGINT AS up, round(least(greatest(value, 5), 95), 4) AS clipped FROM events")
def c16_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return table(spark, sf_dir, "events").select("event_id", F.floor(F.log10(v + 1) * 8).alias("bin"), F.round(F.log1p(v), 6).alias("log1p"), F.ceil(v / 7).alias("up"), F.round(F.least(F.greatest(v, F.lit(5.0)), F.lit(95.0)), 4).alias("clipped"))


@query("SELECT vec_id, len(list_filter(embedding, lambda x: abs(x) >= 0.2)) AS active, round(list_max(embedding)::DOUBLE, 4) AS top FROM embeddings")
def p18_sparse_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounded on emit; only places above the floor count."""
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.size(F.filter(e, lambda x: F.abs(x) >= F.lit(0.2).cast("float"))).cast("long").alias("active"), F.round(F.array_max(e).cast("double"), 4).alias("top"))


@query()
def p7_subspace_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projection on a fixed subspace, unit-normalised, with its cosine to the row and its share of
    the length; an Arrow function over batches."""
    basis, _ = np.linalg.qr(np.random.default_rng(71).normal(size=(64, 8)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            y = np.stack(b.embedding.to_numpy()).astype(float) if len(b) else np.zeros((0, 64))
            p = y @ basis @ basis.T
            n, full = np.linalg.norm(p, axis=1), np.linalg.norm(y, axis=1)
            yield pd.DataFrame({"vec_id": b.vec_id, "direction": list(p / np.maximum(n, 1e-12)[:, None]), "cos": (p * y).sum(1) / np.maximum(n * full, 1e-12), "share": n / np.maximum(full, 1e-12)})

    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding").mapInPandas(run, "vec_id long, direction array<double>, cos double, share double")


@query()
def p11_lens_pullback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """unit(row x J) for a fixed matrix."""
    jacobian = np.random.default_rng(72).normal(size=(64, 64)) / 8

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            y = (np.stack(b.embedding.to_numpy()).astype(float) if len(b) else np.zeros((0, 64))) @ jacobian
            yield pd.DataFrame({"vec_id": b.vec_id, "direction": list(y / np.maximum(np.linalg.norm(y, axis=1), 1e-12)[:, None])})

    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding").mapInPandas(run, "vec_id long, direction array<double>")


@query(f"WITH t AS (SELECT doc_id, {IDS} v FROM documents) SELECT doc_id, round(list_avg(v) / 65536, 6) AS score FROM t WHERE len(v) > 0")
def h1_scoring_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H1, H2, H4: a scorer over token numbers, whole Arrow batches at a time; here it is their scaled mean."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = np.diff(b.column(1).offsets.to_numpy())
            sums = np.add.reduceat(np.r_[b.column(1).flatten().to_numpy(), 0].astype(np.int64), np.r_[0, np.cumsum(lengths)])[:-1]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sums / np.maximum(lengths, 1) / 65536)], names=["doc_id", "score"])

    t = table(spark, sf_dir, "documents").select("doc_id", tx.token_ids(F.col("text")).alias("v")).where("size(v) > 0")
    return t.mapInArrow(run, "doc_id long, score double").select("doc_id", F.round("score", 6).alias("score"))


@query("""
WITH e AS (SELECT event_id, user_id, value, value >= 80 top, value >= 60 fire, event_id % 3 = 0 padded FROM events)
SELECT rule, count(*) AS kept FROM (SELECT 'last' rule, event_id FROM e WHERE top OR padded UNION ALL SELECT 'last2', event_id FROM e WHERE top OR fire OR padded UNION ALL SELECT 'fire_last', event_id FROM e WHERE fire AND NOT padded) GROUP BY rule""")
def h5_rule_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named rules as column expressions, all counted in one pass."""
    top, fire, padded = F.col("value") >= 80, F.col("value") >= 60, F.col("event_id") % 3 == 0
    rules = {"last": top | padded, "last2": top | fire | padded, "fire_last": fire & ~padded}
    named = F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()])
    hits = table(spark, sf_dir, "events").select(F.explode(F.filter(named, lambda x: x.isNotNull())).alias("rule"))
    return hits.groupBy("rule").agg(F.count(F.lit(1)).alias("kept"))


@query("SELECT vec_id, label FROM embeddings WHERE label = 6")
def k2_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written once under a new path of the shared scratch folder, then read back."""
    from girasol.streaming.state import scratch

    path = scratch(spark, "published")
    sinks.publish(table(spark, sf_dir, "embeddings").where("label = 6").select("vec_id", "label"), path)
    return spark.read.schema("vec_id long, label int").parquet(path)


@query("SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS raw_norm FROM embeddings WHERE sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) <= 1.1 * (SELECT median(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) FROM (SELECT * FROM embeddings ORDER BY md5('63:' || vec_id), vec_id LIMIT 200))")
def f1g_raw_norm_presample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw norms against a multiple of a bounded presample's median."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", vec.norm(F.col("embedding")).alias("n"))
    limit = select.sample(e, 63, "vec_id", 200).agg((1.1 * F.expr("percentile(n, 0.5)")).alias("limit"))
    return e.crossJoin(F.broadcast(limit)).where("n <= limit").select("vec_id", F.round("n", 6).alias("raw_norm"))
