"""Run logs as time series: an event type is a run, a user id a step, the mean value the metric."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from girasol.functions import schedule
from girasol.operators import packing

from .common import query, table

LOG = "log AS (SELECT event_type run, user_id step, avg(value) y, count(*) n FROM events GROUP BY ALL)"


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("run"), F.col("user_id").alias("step")).agg(F.avg("value").alias("y"), F.count(F.lit(1)).alias("n"))


def _run() -> WindowSpec:
    return Window.partitionBy("run").orderBy("step")


@query(f"WITH {LOG} SELECT run, step, round(avg(CASE WHEN step % 7 <> 0 THEN y END) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS smooth FROM log")
def w7_rolling_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centred; missing values leave the denominator."""
    y = F.when(F.col("step") % 7 != 0, F.col("y"))
    return _log(spark, sf_dir).select("run", "step", F.round(F.avg(y).over(_run().rowsBetween(-2, 2)), 6).alias("smooth"))


@query(f"WITH {LOG}, r AS (SELECT run, step, avg(y) OVER w m, count(*) OVER w c FROM log WINDOW w AS (PARTITION BY run ORDER BY step ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) SELECT run, step, round(m, 6) AS smooth FROM r WHERE c = 5")
def w8_rolling_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _run().rowsBetween(-4, 0)
    r = _log(spark, sf_dir).select("run", "step", F.avg("y").over(w).alias("m"), F.count(F.lit(1)).over(w).alias("c"))
    return r.where("c = 5").select("run", "step", F.round("m", 6).alias("smooth"))


@query(f"WITH {LOG} SELECT run, step, round(avg(y) OVER (PARTITION BY run ORDER BY step RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING), 6) AS smooth FROM log WHERE step % 3 <> 1")
def w9_range_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir).where("step % 3 <> 1").select("run", "step", F.round(F.avg("y").over(_run().rangeBetween(-5, 5)), 6).alias("smooth"))


_GAPS = "WITH g AS (SELECT user_id, ts, event_id, coalesce(epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 43200, true) new FROM events), s AS (SELECT *, sum(new::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) seg FROM g)"


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new segment after a gap of half a day."""
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    new = F.coalesce(F.col("t") - F.lag("t").over(w) > 43_200_000_000, F.lit(True)).cast("int")
    return e.withColumn("new", new).withColumn("seg", F.sum("new").over(w))


@query(_GAPS + " SELECT user_id, seg, count(*) AS n FROM s GROUP BY ALL")
def w10_gap_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(spark, sf_dir).groupBy("user_id", "seg").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {LOG}, f AS (SELECT run, step, min((y > 48)::INT) OVER w ok, count(*) OVER w c FROM log WINDOW w AS (PARTITION BY run ORDER BY step ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)) SELECT run, min(step) AS onset FROM f WHERE ok = 1 AND c = 3 AND step >= 5 GROUP BY run")
def w11_onset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of three steps in a row above the threshold."""
    w = _run().rowsBetween(0, 2)
    f = _log(spark, sf_dir).select("run", "step", F.min((F.col("y") > 48).cast("int")).over(w).alias("ok"), F.count(F.lit(1)).over(w).alias("c"))
    return f.where("ok = 1 AND c = 3 AND step >= 5").groupBy("run").agg(F.min("step").alias("onset"))


@query(f"WITH {LOG}, b AS (SELECT run, max(step) FILTER (y <= 30) bad, max(step) last FROM log GROUP BY run) SELECT b.run, CASE WHEN bad = last THEN NULL ELSE min(step) END AS onset FROM b LEFT JOIN log l ON l.run = b.run AND l.step > coalesce(bad, -1) GROUP BY b.run, bad, last")
def w12_onset_for_good(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir)
    b = log.groupBy("run").agg(F.max(F.when(F.col("y") <= 30, F.col("step"))).alias("bad"))
    after = log.join(b, "run").where(F.col("step") > F.coalesce("bad", F.lit(-1))).groupBy("run").agg(F.min("step").alias("onset"))
    return b.select("run").join(after, "run", "left")


@query(f"WITH {LOG}, o AS (SELECT run, step, y FROM log WHERE run <> 'click' AND step < 90), n AS (SELECT o.run, 60 + row_number() OVER (PARTITION BY run ORDER BY step) - 1 step, y FROM o WHERE step >= 30) SELECT run, step, round(y, 6) AS y, 0 AS resumed FROM o WHERE step < 60 UNION ALL SELECT run, step, round(y, 6), 1 FROM n")
def w13_resume_stitching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old rows before the cut, then the resumed ones under new step numbers."""
    o = _log(spark, sf_dir).where("run <> 'click' AND step < 90").select("run", "step", "y")
    n = o.where("step >= 30").withColumn("step", (F.lit(59) + F.row_number().over(_run())).cast("long"))
    out = o.where("step < 60").withColumn("resumed", F.lit(0)).unionByName(n.withColumn("resumed", F.lit(1)))
    return out.withColumn("y", F.round("y", 6))


@query(f"WITH {LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY step DESC) k FROM log) SELECT run, round(avg(y) FILTER (k <= 10), 6) AS last10, round(avg(y) FILTER (step BETWEEN 20 AND 40), 6) AS mid FROM r GROUP BY run")
def w14_trailing_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _log(spark, sf_dir).withColumn("k", F.row_number().over(Window.partitionBy("run").orderBy(F.desc("step"))))
    return r.groupBy("run").agg(F.round(F.avg(F.when(F.col("k") <= 10, F.col("y"))), 6).alias("last10"), F.round(F.avg(F.when(F.col("step").between(20, 40), F.col("y"))), 6).alias("mid"))


@query(f"WITH {LOG} SELECT run, step, round(cume_dist() OVER (PARTITION BY run ORDER BY y), 6) AS ecdf FROM log")
def w16_ecdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir).select("run", "step", F.round(F.cume_dist().over(Window.partitionBy("run").orderBy("y")), 6).alias("ecdf"))


@query("SELECT user_id AS step, event_id, round(value, 4) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_type = 'purchase' THEN 0 ELSE 1 END, ts DESC, event_id DESC) = 1")
def w18_last_writer_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The preferred source, then the latest row; an aggregate, not a sort."""
    e = table(spark, sf_dir, "events")
    best = F.max(F.struct((F.col("event_type") == "purchase").alias("p"), F.col("ts"), F.col("event_id"), F.col("value"))).alias("b")
    return e.groupBy(F.col("user_id").alias("step")).agg(best).select("step", F.col("b.event_id").alias("event_id"), F.round("b.value", 4).alias("value"))


@query("""
WITH e AS (SELECT user_id step, event_id, CASE WHEN event_type = 'click' THEN value END a, CASE WHEN event_type = 'view' THEN value END b FROM events)
SELECT step, round(arg_max(a, event_id) FILTER (a IS NOT NULL), 4) AS a, round(arg_max(b, event_id) FILTER (b IS NOT NULL), 4) AS b FROM e GROUP BY step""")
def w19_coalescing_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By column, the latest value that is there."""
    e = table(spark, sf_dir, "events")
    last = lambda t: F.round(F.max_by(F.when(F.col("event_type") == t, F.col("value")), F.when(F.col("event_type") == t, F.col("event_id"))), 4)
    return e.groupBy(F.col("user_id").alias("step")).agg(last("click").alias("a"), last("view").alias("b"))


@query("SELECT s AS missing FROM (SELECT unnest(range(0, (SELECT max(user_id) FROM events) + 1)) s) WHERE s NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 60)")
def w19_missing_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    steps = e.agg(F.max("user_id").alias("m")).select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("m"))).alias("missing"))
    return steps.join(e.where("event_type = 'error' AND value > 60").select(F.col("user_id").alias("missing")).distinct(), "missing", "left_anti")


@query("WITH d AS (SELECT event_id, user_id // 10 g, coalesce(user_id // 10 <> lag(user_id // 10) OVER (ORDER BY event_id), true)::INT new FROM events), r AS (SELECT *, sum(new) OVER (ORDER BY event_id) k FROM d) SELECT event_id, k AS direction FROM r WHERE k <= 50")
def w20_front_reservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the first 50 directions; runs of identical neighbours are one. The order is cut into parts;
    a part needs the last row of the one before and how many runs began earlier."""
    e = table(spark, sf_dir, "events").select("event_id", F.floor(F.col("user_id") / 10).alias("g"))
    rows = packing.in_order(e, [F.col("event_id")])
    own = Window.partitionBy("_part").orderBy("_in")
    ends = rows.groupBy("_part").agg(F.max_by("g", "_in").alias("last")).withColumn("before", F.lag("last").over(Window.orderBy("_part"))).select("_part", "before")
    marked = rows.join(ends, "_part").withColumn("new", F.coalesce(F.col("g") != F.coalesce(F.lag("g").over(own), F.col("before")), F.lit(True)).cast("int"))
    earlier = marked.groupBy("_part").agg(F.sum("new").alias("n")).select("_part", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    numbered = marked.join(earlier.where("earlier <= 50"), "_part").withColumn("direction", F.col("earlier") + F.sum("new").over(own))
    return numbered.where("direction <= 50").select("event_id", "direction")


@query(f"""
WITH {LOG}, b AS (SELECT step x, y FROM log WHERE run = 'view' AND step % 3 = 0), a AS (SELECT step x FROM log WHERE run = 'click'),
j AS (SELECT a.x, (SELECT max(x) FROM b WHERE b.x <= a.x) lo, (SELECT min(x) FROM b WHERE b.x >= a.x) hi FROM a)
SELECT j.x AS step, round(CASE WHEN lo IS NULL OR hi IS NULL THEN NULL WHEN lo = hi THEN l.y ELSE l.y + (h.y - l.y) * (j.x - lo) / (hi - lo) END, 6) AS y FROM j LEFT JOIN b l ON l.x = lo LEFT JOIN b h ON h.x = hi""")
def j17_interpolated_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact where there is a value, else between its neighbours, else NULL: one sort of both sides, cut into parts."""
    log = _log(spark, sf_dir)
    known, ask = (F.col("run") == "view") & (F.col("step") % 3 == 0), F.col("run") == "click"
    both = log.where(known | ask).groupBy(F.col("step").alias("x")).agg(F.max(F.when(known, F.struct("step", "y"))).alias("p"), F.max(ask).alias("ask"))
    u = packing.neighbours(both, "x", "p")
    l, h = F.col("lo"), F.col("hi")
    y = F.when(l.isNotNull() & h.isNotNull(), F.when(l["step"] == h["step"], l["y"]).otherwise(l["y"] + (h["y"] - l["y"]) * (F.col("x") - l["step"]) / (h["step"] - l["step"])))
    return u.where("ask").select(F.col("x").alias("step"), F.round(y, 6).alias("y"))


@query(f"WITH {LOG}, a AS (SELECT step, y FROM log WHERE run = 'click'), b AS (SELECT step, y FROM log WHERE run = 'view'), z AS (SELECT avg(y) base FROM a WHERE step < 10) SELECT step, round(a.y - base, 6) AS da, round(b.y - base, 6) AS db, round(a.y - b.y, 6) AS diff FROM a JOIN b USING (step), z")
def j24_matched_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir)
    a, b = (log.where(F.col("run") == r).select("step", F.col("y").alias(n)) for r, n in (("click", "a"), ("view", "b")))
    z = a.where("step < 10").agg(F.avg("a").alias("base"))
    j = a.join(b, "step").crossJoin(F.broadcast(z))
    return j.select("step", F.round(F.col("a") - F.col("base"), 6).alias("da"), F.round(F.col("b") - F.col("base"), 6).alias("db"), F.round(F.col("a") - F.col("b"), 6).alias("diff"))


@query("""
WITH d AS (SELECT user_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6 dt FROM events)
SELECT user_id, round(quantile_cont(dt, 0.5), 3) AS pace, round(sum(dt) / 3600, 3) AS hours FROM d WHERE dt > 0 AND dt < 86400 GROUP BY user_id""")
def a55_pace_and_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    d = e.withColumn("dt", (F.col("t") - F.lag("t").over(w)) / 1e6).where("dt > 0 AND dt < 86400")
    return d.groupBy("user_id").agg(F.round(F.expr("percentile(dt, 0.5)"), 3).alias("pace"), F.round(F.sum("dt") / 3600, 3).alias("hours"))


@query(f"WITH {LOG} SELECT run, round(avg(y) FILTER (step < 50), 6) AS early, round(avg(y) FILTER (step >= 100), 6) AS late, round(min(y) FILTER (step >= 10), 6) AS low, round(max(y) FILTER (step >= 10), 6) AS high, round(arg_min(y, step) FILTER (step > 2), 6) AS first_y FROM log GROUP BY run")
def a56_dynamics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, y = F.col("step"), F.col("y")
    part = lambda f, c, n: F.round(f(F.when(c, y)), 6).alias(n)
    first = F.round(F.min_by(F.when(s > 2, y), F.when(s > 2, s)), 6).alias("first_y")
    return _log(spark, sf_dir).groupBy("run").agg(part(F.avg, s < 50, "early"), part(F.avg, s >= 100, "late"), part(F.min, s >= 10, "low"), part(F.max, s >= 10, "high"), first)


@query(f"""
WITH {LOG}, f AS (SELECT run, step, min((y > 48)::INT) OVER w ok, count(*) OVER w c FROM log WINDOW w AS (PARTITION BY run ORDER BY step ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)), o AS (SELECT run, min(step) FILTER (ok = 1 AND c = 3) onset FROM f GROUP BY run),
r AS (SELECT run, onset, (SELECT onset FROM o WHERE run = 'view') ref FROM o)
SELECT run, CASE WHEN onset IS NULL THEN 'pending' WHEN abs(onset - ref) <= 0.25 * ref THEN 'match' WHEN onset > ref THEN 'later' ELSE 'earlier' END AS verdict FROM r""")
def a57_budget_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _run().rowsBetween(0, 2)
    f = _log(spark, sf_dir).select("run", "step", F.min((F.col("y") > 48).cast("int")).over(w).alias("ok"), F.count(F.lit(1)).over(w).alias("c"))
    o = f.groupBy("run").agg(F.min(F.when((F.col("ok") == 1) & (F.col("c") == 3), F.col("step"))).alias("onset"))
    r = o.crossJoin(F.broadcast(o.where("run = 'view'").select(F.col("onset").alias("ref"))))
    verdict = F.when(F.col("onset").isNull(), "pending").when(F.abs(F.col("onset") - F.col("ref")) <= 0.25 * F.col("ref"), "match").when(F.col("onset") > F.col("ref"), "later").otherwise("earlier")
    return r.select("run", verdict.alias("verdict"))


@query("""
WITH r AS (SELECT event_type run, max(user_id) + 1 total, (max(user_id) + 1) // 10 + 1 warm FROM events GROUP BY run), s AS (SELECT run, total, warm, unnest(range(1, total + 1)) step FROM r),
l AS (SELECT *, CASE WHEN step <= warm THEN step / warm ELSE 0.5 * (1 + cos(pi() * (step - warm) / (total - warm))) END lr FROM s), c AS (SELECT *, sum(lr) OVER (PARTITION BY run ORDER BY step) cum, sum(lr) OVER (PARTITION BY run) whole FROM l),
h AS (SELECT run, min(step) half FROM c WHERE cum >= 0.5 * whole + 1e-9 GROUP BY run), e AS (SELECT DISTINCT event_type run, user_id + 1 step FROM events)
SELECT run, step, round(lr, 6) AS lr, round(cum, 5) AS cum_lr, half AS half_step FROM e JOIN c USING (run, step) JOIN h USING (run)""")
def p17_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate and its closed-form sum at the steps that a run logs, and the step that has half of the whole sum."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("run"), (F.col("user_id") + 1).alias("step")).distinct()
    r = e.groupBy("run").agg(F.max("step").alias("total")).withColumn("warm", F.floor(F.col("total") / 10) + 1)
    at = lambda f, s: f(s, F.col("warm"), F.col("total"))
    half = 0.5 * at(schedule.cum_lr, F.col("total")) + 1e-9
    steps = F.filter(F.sequence(F.lit(1).cast("long"), "total"), lambda s: at(schedule.cum_lr, s) >= half)
    r = r.withColumn("half_step", F.get(steps, F.lit(0)))
    return e.join(r, "run").select("run", "step", F.round(at(schedule.lr_at, F.col("step")), 6).alias("lr"), F.round(at(schedule.cum_lr, F.col("step")), 5).alias("cum_lr"), "half_step")


@query("SELECT event_id, floor(epoch(ts))::BIGINT AS epoch_s, strftime(ts, '%Y-%m-%d') AS day FROM events")
def c17_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select("event_id", F.unix_seconds(ts).alias("epoch_s"), F.date_format(ts, "yyyy-MM-dd").alias("day"))
