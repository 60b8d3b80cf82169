"""Streams run to their end, and the batch forms of stateful operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from girasol.functions.keys import hkey
from girasol.operators import select
from girasol.streaming import side, state, timed

from .common import query, table


@query("SELECT epoch(time_bucket(INTERVAL '1 day', ts))::BIGINT AS day_s, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def st1_windowed_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream's daily windows under a watermark, equal to the batch result."""
    s = state.events_stream(spark, sf_dir).withWatermark("ts", "1 day")
    g = s.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
    flat = g.select(F.unix_seconds("window.start").alias("day_s"), "event_type", "n", "total")
    return state.run_to_end(flat, "windows", "complete")


_BLOCKS = "WITH b AS (SELECT user_id % 40 q, event_id, user_id step, row_number() OVER (PARTITION BY user_id % 40 ORDER BY {0}) r, count(*) OVER (PARTITION BY user_id % 40) c FROM events)"


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select((F.col("user_id") % 40).alias("q"), "event_id", F.col("user_id").alias("step"))


@query(_BLOCKS.format("user_id, event_id") + " SELECT q, event_id, step, 'take' AS action FROM b WHERE c >= 4 AND r <= 4")
def st2_fifo_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.pick_blocks(_blocks(spark, sf_dir), "q", "event_id", "step", 4, drop_stale=False)


@query(_BLOCKS.format("user_id DESC, event_id DESC") + " SELECT q, event_id, step, CASE WHEN r <= 4 THEN 'take' ELSE 'stale' END AS action FROM b WHERE c >= 4")
def st2_drop_stale_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.pick_blocks(_blocks(spark, sf_dir), "q", "event_id", "step", 4, drop_stale=True)


@query("SELECT user_id AS step, round(avg(user_id - event_id % (user_id + 1)), 5) AS mean_lag, max(user_id - event_id % (user_id + 1)) AS max_lag FROM events GROUP BY user_id")
def st3_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    lag = F.col("user_id") - F.col("event_id") % (F.col("user_id") + 1)
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("step")).agg(F.round(F.avg(lag), 5).alias("mean_lag"), F.max(lag).alias("max_lag"))


@query("""
WITH r AS (SELECT user_id, event_id, sum((value > 50)::INT) OVER w passes, count(*) OVER w visits FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))
SELECT user_id, event_id, passes::BIGINT AS passes, visits FROM r WHERE visits >= 8 AND passes / visits >= 0.6 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1""")
def st4_pass_rate_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tracker as a stateful stream; the SQL is its batch form."""
    s = state.events_stream(spark, sf_dir, columns="event_id user_id value").withColumn("passed", F.col("value") > 50)
    return state.run_to_end(state.drop_solved(s, "user_id", "event_id", "passed", 0.6, 8), "solved", "append", partitions=state.PARTITIONS)


@query("""
WITH r AS (SELECT user_id, event_id, sum((value > 50)::INT) OVER w passes, count(*) OVER w visits FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)),
d AS (SELECT user_id, min(event_id) gone_at FROM r WHERE visits >= 8 AND passes / visits >= 0.6 GROUP BY user_id)
SELECT count(*) AS kept FROM events e LEFT JOIN d USING (user_id) WHERE gone_at IS NULL OR e.event_id <= gone_at""")
def st4_resampling_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("value") > 50).cast("int").alias("p"))
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    r = e.withColumn("passes", F.sum("p").over(w)).withColumn("visits", F.count(F.lit(1)).over(w))
    hit = (F.col("visits") >= 8) & (F.col("passes") / F.col("visits") >= 0.6)
    gone = F.coalesce(F.max(hit.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return r.withColumn("gone", gone).where("gone = 0").agg(F.count(F.lit(1)).alias("kept"))


@query("WITH d AS (SELECT doc_id, n_chars // 512 w FROM documents) SELECT count(*) AS docs_iterated, count(*) FILTER (w = 0) AS short_docs, sum(w)::BIGINT AS windows FROM d")
def st6_window_producer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The resume offset counts short documents too."""
    d = table(spark, sf_dir, "documents").select(F.floor(F.col("n_chars") / 512).alias("w"))
    return d.agg(F.count(F.lit(1)).alias("docs_iterated"), F.count_if(F.col("w") == 0).alias("short_docs"), F.sum("w").alias("windows"))


@query("SELECT user_id % 8 AS rank, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id % 8 ORDER BY md5('51:' || event_id), event_id) <= 32 // 8")
def st7_balanced_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 8).alias("rank"), "event_id")
    return select.first_n(e, ["rank"], [hkey(51, F.col("event_id")), F.col("event_id")], 4)


@query("""
WITH e AS (SELECT user_id * 100 + epoch_us(ts) // 1000 // 518400000 % 100 req, event_type shard, epoch_us(ts) // 1000 ms FROM events WHERE event_type <> 'error'),
f AS (SELECT *, min(ms) OVER (PARTITION BY req) + 129600000 due FROM e), g AS (SELECT req, due, shard, min(ms) ms FROM f WHERE ms <= due GROUP BY ALL), r AS (SELECT req, due, count(*) shards, max(ms) last FROM g GROUP BY ALL),
w AS (SELECT max(epoch_us(ts) // 1000) - 3600000 AS mark FROM events WHERE event_type <> 'error')
SELECT req, 'scored' AS outcome, last AS at_ms, shards FROM r WHERE shards = 4 UNION ALL SELECT req, 'timeout', due, shards FROM r, w WHERE shards < 4 AND due <= mark
UNION ALL SELECT f.req, 'late', f.ms, r.shards FROM f JOIN r USING (req) WHERE r.shards < 4 AND f.ms > f.due""")
def st8_rendezvous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of several files in the order of time: a request, a user's six days, is scored when its four shards
    are there within 36 hours, and else times out in event time."""
    time = F.unix_micros(F.col("ts").cast("timestamp"))
    s = state.events_stream(spark, sf_dir, columns="ts user_id event_type", by=time).where("event_type != 'error'")
    s = s.withColumn("req", F.col("user_id") * 100 + F.expr("unix_millis(ts) div 518400000 % 100"))
    met = timed.rendezvous(s, "req", "event_type", "ts", shards=4, limit_ms=129_600_000, keep_ms=518_400_000, delay="1 hour")
    return state.run_to_end(met, "rendezvous", "append", partitions=state.PARTITIONS)


@query("""
WITH f AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) k FROM events WHERE event_type = 'error')
SELECT user_id, event_id, CASE WHEN k <= 3 THEN 'retry' ELSE 'give_up' END AS action FROM f WHERE k <= 4""")
def st10_retry_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures are rows; three retries, then the key is given up."""
    f = table(spark, sf_dir, "events").where("event_type = 'error'").select("user_id", "event_id")
    top = select.first_n(f, ["user_id"], [F.col("event_id")], 4, "k")
    return top.select("user_id", "event_id", F.when(F.col("k") <= 3, "retry").otherwise("give_up").alias("action"))


@query("""
WITH s AS (SELECT user_id arm, max((event_type = 'view' AND value > 60)::INT) bank, max((event_type = 'click' AND value > 60)::INT) sft, max((event_type = 'purchase' AND value > 60)::INT) rl FROM events GROUP BY user_id)
SELECT arm, CASE WHEN bank = 0 THEN 'bank' WHEN sft = 0 THEN 'sft' WHEN rl = 0 THEN 'rl' ELSE 'eval' END AS next_stage FROM s""")
def st11_dependency_tick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stage is done once it has a good enough event; the first that is not is next."""
    has = lambda t, n: F.max(((F.col("event_type") == t) & (F.col("value") > 60)).cast("int")).alias(n)
    s = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("arm")).agg(has("view", "bank"), has("click", "sft"), has("purchase", "rl"))
    stage = F.when(F.col("bank") == 0, "bank").when(F.col("sft") == 0, "sft").when(F.col("rl") == 0, "rl").otherwise("eval")
    return s.select("arm", stage.alias("next_stage"))


@query("""
WITH c AS (SELECT DISTINCT user_id ckpt FROM events), d AS (SELECT DISTINCT user_id ckpt FROM events WHERE event_type = 'purchase' AND value > 70)
SELECT ckpt, row_number() OVER (ORDER BY ckpt DESC) AS turn FROM c WHERE ckpt NOT IN (SELECT ckpt FROM d)""")
def st12_pending_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left to evaluate, latest first; the done set is a table."""
    e = table(spark, sf_dir, "events")
    c = e.select(F.col("user_id").alias("ckpt")).distinct()
    done = e.where("event_type = 'purchase' AND value > 70").select(F.col("user_id").alias("ckpt")).distinct()
    left = c.join(done, "ckpt", "left_anti")
    return select.numbered(left, F.floor(F.col("ckpt") / 1024), [F.desc("ckpt")], "turn", descending=True)


@query("SELECT source, max(doc_id) AS last_doc, count(*) AS lines FROM documents WHERE doc_id % 9 < 7 GROUP BY source")
def st13_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("doc_id % 9 < 7")
    return d.groupBy("source").agg(F.max("doc_id").alias("last_doc"), F.count(F.lit(1)).alias("lines"))


@query("""
WITH m AS (SELECT min(event_id) lo, max(event_id) - min(event_id) + 1 n FROM events), e AS (SELECT event_id, user_id, value, (event_id - lo) * 3 // n part FROM events, m)
SELECT CASE WHEN part = 0 THEN 1 ELSE 2 END AS side_version, user_id, count(*) AS n FROM e
WHERE user_id NOT IN (SELECT user_id FROM e d WHERE d.part = 0 AND d.value > 97 OR e.part > 0 AND d.part = 1 AND d.value > 97) GROUP BY ALL""")
def st14_drop_list_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three runs of one stream: the drop list grows after the first file, and what follows the second is
    half written, so the last whole version stays."""
    events, at = table(spark, sf_dir, "events"), None
    path, lists = state.scratch(spark, "intake"), state.scratch(spark, "drop-lists")
    low, high = events.agg(F.min("event_id"), F.max("event_id")).first()
    part = F.expr(f"(event_id - {low}) * 3 div {high - low + 1}")
    parts = [events.where(part == i) for i in range(3)]
    for i, rows in enumerate(parts):
        if i < 2:
            side.publish(events.where((part <= i) & (F.col("value") > 97)).select("user_id").distinct(), lists)
        else:
            events.select("user_id").write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{lists}/version=3")
        rows.write.mode("append").parquet(path)
        stream = spark.readStream.schema(events.schema).parquet(path).select("event_id", "user_id")
        kept, at = side.drop_listed(stream, lists, "user_id", "dropped", at=at)
    return kept.groupBy("side_version", "user_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(DISTINCT event_id) AS n FROM events")
def st12_deduplicated_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Idempotent intake: repeats within the watermark are dropped."""
    s = state.events_stream(spark, sf_dir).withWatermark("ts", "40 days").dropDuplicatesWithinWatermark(["event_id"]).select("event_id")
    return state.run_to_end(s, "once", "append").agg(F.count(F.lit(1)).alias("n"))
