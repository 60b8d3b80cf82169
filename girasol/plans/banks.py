"""Bank algebra and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from girasol.functions.keys import hkey
from girasol.operators import bank, leak, select
from girasol.sources import sinks

from .common import query, table


def _bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")


@query("""
WITH a AS (SELECT 'a' src_bank, vec_id, label FROM embeddings WHERE vec_id < 300 AND vec_id % 10 <> 0), b AS (SELECT 'b' src_bank, vec_id, label FROM embeddings WHERE vec_id >= 300 AND label IN (1, 2, 3)),
s AS (SELECT label, count(*) w FROM a GROUP BY label), e AS (SELECT label, w * 100.0::DOUBLE / sum(w) OVER () x FROM s), f AS (SELECT *, floor(x) q FROM e),
q AS (SELECT label, q + (row_number() OVER (ORDER BY x - q DESC, label) <= 100 - sum(q) OVER ())::INT quota FROM f),
r AS (SELECT a.*, row_number() OVER (PARTITION BY label ORDER BY md5('41:' || vec_id), vec_id) n FROM a)
SELECT src_bank, vec_id AS src_vec_id, r.label FROM r JOIN q ON q.label = r.label WHERE n <= quota UNION ALL SELECT src_bank, vec_id, label FROM b""")
def h6_mix_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mix by spec, with exclusions and quotas by family."""
    e = _bank(spark, sf_dir)
    banks = {"a": e.where("vec_id < 300"), "b": e.where("vec_id >= 300")}
    gone = e.where("vec_id % 10 = 0 AND vec_id < 300").select(F.lit("a").alias("src_bank"), "vec_id")
    spec = [bank.Source("a", n=100), bank.Source("b", families=(1, 2, 3))]
    return bank.mix(banks, spec, key="vec_id", family="label", seed=41, exclude=gone).select("src_bank", "src_vec_id", "label")


@query("SELECT vec_id + 0 AS vec_idx, 'x' AS part, label FROM embeddings WHERE label < 5 UNION ALL SELECT vec_id + 1000, 'y', label FROM embeddings WHERE label >= 5")
def u1_union_rebased(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _bank(spark, sf_dir)
    one = lambda d, by, part: d.select((F.col("vec_id") + by).alias("vec_idx"), F.lit(part).alias("part"), "label")
    return one(e.where("label < 5"), 0, "x").unionByName(one(e.where("label >= 5"), 1000, "y"))


@query("WITH u AS (SELECT 'x' part, vec_id FROM embeddings WHERE label < 3 UNION ALL SELECT 'y', vec_id FROM embeddings WHERE label >= 7), b AS (SELECT *, md5('42:' || part || ':' || vec_id) k FROM u) SELECT part, vec_id, row_number() OVER (ORDER BY ('0x' || k[1:6])::BIGINT % 256, k) - 1 AS vec_idx FROM b")
def u2_union_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two banks, one seeded order, dense ids."""
    e = _bank(spark, sf_dir)
    u = e.where("label < 3").select(F.lit("x").alias("part"), "vec_id").unionByName(e.where("label >= 7").select(F.lit("y").alias("part"), "vec_id"))
    return bank.rekey(u, 42, "part", "vec_id")


@query("SELECT part, count(*) AS n, sum(vec_id) AS ids FROM (SELECT 0 part, vec_id FROM embeddings UNION ALL SELECT 1, vec_id FROM embeddings UNION ALL SELECT 2, vec_id FROM embeddings WHERE label = 1) GROUP BY part")
def u3_virtual_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts may repeat."""
    e = _bank(spark, sf_dir).select("vec_id", "label")
    parts = [e, e, e.where("label = 1")]
    u = None
    for i, p in enumerate(parts):
        p = p.select(F.lit(i).alias("part"), "vec_id")
        u = p if u is None else u.unionByName(p)
    return u.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("vec_id").alias("ids"))


@query("SELECT label, vec_id FROM embeddings WHERE label IN (0, 1, 2) QUALIFY row_number() OVER (PARTITION BY label ORDER BY md5('43:' || vec_id), vec_id) <= 30")
def u5_balanced_thirds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """So many rows of each family."""
    return select.sample_by(_bank(spark, sf_dir).where("label IN (0, 1, 2)").select("label", "vec_id"), "label", 43, "vec_id", 30)


@query("WITH c AS (SELECT vec_id FROM embeddings WHERE label = 0 ORDER BY md5('44:' || vec_id), vec_id LIMIT 20) SELECT arm, vec_id FROM (SELECT unnest([1, 2]) arm), c UNION ALL SELECT label, vec_id FROM embeddings WHERE label IN (1, 2)")
def u6_arms_with_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _bank(spark, sf_dir)
    control = select.sample(e.where("label = 0").select("vec_id"), 44, "vec_id", 20)
    shared = control.withColumn("arm", F.explode(F.array(F.lit(1), F.lit(2)))).select("arm", "vec_id")
    return shared.unionByName(e.where("label IN (1, 2)").select(F.col("label").cast("int").alias("arm"), "vec_id"))


@query("SELECT vec_id, label FROM embeddings WHERE vec_id < 123")
def u8_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bank(spark, sf_dir).where("vec_id < 123").select("vec_id", "label")


@query("SELECT vec_id, family FROM embeddings, (SELECT unnest(['enc', 'dec']) family) WHERE NOT (family = 'dec' AND vec_id % 10 = 0)")
def u9_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each of two families, less the flagged ones."""
    e = _bank(spark, sf_dir).select("vec_id", F.explode(F.array(F.lit("enc"), F.lit("dec"))).alias("family"))
    flagged = _bank(spark, sf_dir).where("vec_id % 10 = 0").select("vec_id", F.lit("dec").alias("family"))
    return e.join(flagged, ["vec_id", "family"], "left_anti")


@query("SELECT vec_id, copy FROM embeddings, (SELECT unnest(range(1, 5)) copy) WHERE label = 4")
def u10_probe_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bank(spark, sf_dir).where("label = 4").select("vec_id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(4).cast("long"))).alias("copy"))


@query("""
WITH t AS (SELECT vec_id, label, embedding::DOUBLE[] e FROM embeddings), near AS (SELECT a.vec_id FROM t a, t b WHERE a.label <> 9 AND b.vec_id % 25 = 0 AND a.vec_id % 25 <> 0 GROUP BY a.vec_id HAVING max(list_dot_product(a.e, b.e)) <= 0.33),
a AS (SELECT label, vec_id FROM t JOIN near USING (vec_id) QUALIFY row_number() OVER (PARTITION BY label ORDER BY md5('45:' || vec_id), vec_id) <= 12)
SELECT label, vec_id FROM a UNION ALL SELECT label, vec_id FROM t WHERE label = 9""")
def u14_capped_bank_with_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leak-dropped before the quota, so it is filled; then the probes."""
    e = _bank(spark, sf_dir)
    rows = e.where("label <> 9 AND vec_id % 25 <> 0")
    kept = leak.similarity_guard(rows, e.where("vec_id % 25 = 0"), "embedding", "vec_id", "vec_id", 0.33)
    return select.sample_by(kept.select("label", "vec_id"), "label", 45, "vec_id", 12).unionByName(e.where("label = 9").select("label", "vec_id"))


@query("SELECT vec_id, label, round(CASE WHEN label = 2 THEN -embedding[1] ELSE embedding[1] END, 6) AS head FROM embeddings")
def u17_replace_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One family's vectors anew under the same ids; all other rows as they were."""
    e = _bank(spark, sf_dir)
    new = e.where("label = 2").withColumn("embedding", F.transform("embedding", lambda x: -x))
    out = e.where("label <> 2 OR label IS NULL").unionByName(new)
    return out.select("vec_id", "label", F.round(F.get("embedding", F.lit(0)), 6).alias("head"))


@query("SELECT user_id AS done FROM events WHERE event_type = 'click' AND value > 95 UNION SELECT user_id FROM events WHERE event_type = 'view' AND value > 95")
def u18_done_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("value > 95")
    one = lambda t: e.where(F.col("event_type") == t).select(F.col("user_id").alias("done"))
    return one("click").union(one("view")).distinct()


@query("SELECT row_number() OVER (ORDER BY vec_id) - 1 AS vec_idx, vec_id, label FROM embeddings WHERE vec_id % 17 <> 0")
def k1_pool_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejects vectors that are zero or not finite (planted on every seventeenth row)."""
    from pyspark.sql import Window

    e = _bank(spark, sf_dir)
    bad = F.transform("embedding", lambda x: F.when(F.col("vec_id") % 2 == 0, F.lit(0.0)).otherwise(F.lit(float("nan"))).cast("float"))
    planted = e.withColumn("embedding", F.when(F.col("vec_id") % 17 == 0, bad).otherwise(F.col("embedding")))
    rows = sinks.pool_rows(planted, "embedding").select("vec_id", "label")
    blocks = rows.withColumn("_b", F.floor(F.col("vec_id") / 128))
    sizes = blocks.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("_b").orderBy("vec_id")) - 1
    return blocks.withColumn("_p", place).join(sizes.select("_b", before.alias("_o")), "_b").select((F.col("_o") + F.col("_p")).alias("vec_idx"), "vec_id", "label")


@query("SELECT label, count(*) AS n, grouping(label) AS is_total FROM embeddings GROUP BY ROLLUP (label)")
def k6_stats_sidecar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.sidecar(_bank(spark, sf_dir), "label")


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 3")
def k8_transcript_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows of each group, as the appended transcript (or a preview) has them."""
    return select.first_n(table(spark, sf_dir, "events").select("user_id", "event_id", "ts"), ["user_id"], [F.col("ts"), F.col("event_id")], 3).select("user_id", "event_id")


@query("SELECT event_type AS family, metric, round(v, 6) AS value FROM (UNPIVOT (SELECT event_type, avg(value) AS mean, max(value) AS top FROM events GROUP BY event_type) ON mean, top INTO NAME metric VALUE v)")
def k10_direction_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A long table behind the aggregates."""
    wide = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("family")).agg(F.avg("value").alias("mean"), F.max("value").alias("top"))
    return wide.unpivot("family", ["mean", "top"], "metric", "value").select("family", "metric", F.round("value", 6).alias("value"))


@query("SELECT vec_id % 4 AS shard, count(*) AS kept, min(md5('46:' || vec_id)) AS first_key FROM embeddings WHERE label <> 5 GROUP BY shard")
def k9_sharded_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each shard's pass kept, merged."""
    e = _bank(spark, sf_dir).where("label <> 5 OR label IS NULL")
    return e.groupBy((F.col("vec_id") % 4).alias("shard")).agg(F.count(F.lit(1)).alias("kept"), F.min(hkey(46, F.col("vec_id"))).alias("first_key"))
