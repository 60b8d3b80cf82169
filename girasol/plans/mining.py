"""Top examples of a feature, and features that fire together; baskets stand in for tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from girasol.operators import cofire, select
from girasol.operators.topstore import TopStore
from girasol.streaming.state import scratch

from .common import query, table

#: DuckDB: firing events (token, unit) of frequent enough units.
EV = "ev AS (SELECT DISTINCT l_orderkey tok, l_suppkey unit FROM lineitem WHERE l_quantity >= 20)"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").where("l_quantity >= 20")
    return li.select(F.col("l_orderkey").alias("tok"), F.col("l_suppkey").alias("unit")).distinct()


def poisson_tail(count: Column, mean: Column, terms: int = 60) -> Column:
    """P(X >= count) of a Poisson variable, by a series from the term at ``count`` on."""
    log_first = count * F.log(mean) - mean - _log_factorial(count)
    step = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)), F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")),
        lambda acc, k: F.struct((acc["t"] * mean / (count + k)).alias("t"), (acc["s"] + acc["t"] * mean / (count + k)).alias("s")),
        lambda acc: acc["s"],
    )
    return F.least(F.lit(1.0), F.exp(log_first) * step)


def _log_factorial(n: Column) -> Column:
    """Stirling's series on n + 8, less the logs of the eight factors in between."""
    x = n + F.lit(9.0)
    gamma = (x - 0.5) * F.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5.0)))
    return gamma - sum((F.log(n + F.lit(float(i))) for i in range(1, 9)), F.lit(0.0))


def _top_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_partkey").alias("feature"), F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("pos"), F.col("l_extendedprice").cast("double").alias("act"), F.col("l_suppkey").alias("supp"))


@query("""
SELECT l_partkey AS feature, l_orderkey AS doc, l_linenumber AS pos, l_extendedprice::DOUBLE AS act, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank
FROM lineitem QUALIFY rank <= 5""")
def a9_top_n_per_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.first_n(_top_rows(spark, sf_dir).drop("supp"), ["feature"], [F.desc("act"), F.col("doc"), F.col("pos")], 5, "rank")


@query("""
SELECT l_partkey AS feature, l_orderkey AS doc, l_linenumber AS pos, l_extendedprice::DOUBLE AS act, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank
FROM lineitem WHERE l_linenumber % 3 < 2 QUALIFY rank <= 5""")
def a9_growing_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four ranks send what they have at three steps, one of them misses the last; the store is what
    all have, as one pass over it would give. A rank is a supplier's, a step a line's."""
    rows = _top_rows(spark, sf_dir)
    store = TopStore(spark, scratch(spark, "top"), "feature", [F.desc("act"), F.col("doc"), F.col("pos")], 5, 4)
    for step in range(3):
        for rank in range(4):
            if (rank, step) != (2, 2):
                part = rows.where((F.col("supp") % 4 == rank) & (F.col("pos") % 3 == step)).drop("supp")
                store.arrive(part, rank, step, {"norm_factor": 1.0})
    return store.merged().withColumnRenamed("rank_in_feature", "rank")


@query("""
WITH o AS (SELECT l_suppkey feature, l_orderkey doc, max(l_extendedprice)::DOUBLE act FROM lineitem GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY act DESC, doc) rank FROM o)
SELECT feature, count(*) AS windows, round(max(act), 2) AS top, round(min(act), 2) AS bottom FROM r WHERE rank <= 8 GROUP BY feature""")
def a10_top_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most one window a document: its strongest."""
    o = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("feature"), F.col("l_orderkey").alias("doc")).agg(F.max("l_extendedprice").cast("double").alias("act"))
    top = select.first_n(o, ["feature"], [F.desc("act"), F.col("doc")], 8)
    return top.groupBy("feature").agg(F.count(F.lit(1)).alias("windows"), F.round(F.max("act"), 2).alias("top"), F.round(F.min("act"), 2).alias("bottom"))


@query("""
SELECT l_suppkey AS feature, l_orderkey AS row_id, l_extendedprice::DOUBLE AS act FROM lineitem WHERE l_linenumber > 1
QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey) = 1""")
def a11_running_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The maximum and the earliest row that has it; an aggregate of a struct."""
    li = table(spark, sf_dir, "lineitem").where("l_linenumber > 1")
    best = li.groupBy(F.col("l_suppkey").alias("feature")).agg(F.max(F.struct(F.col("l_extendedprice").alias("a"), (-F.col("l_orderkey")).alias("r"))).alias("b"))
    return best.select("feature", (-F.col("b.r")).alias("row_id"), F.col("b.a").cast("double").alias("act"))


@query("""
WITH d AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 dim, unnest(embedding)::DOUBLE x FROM embeddings)
SELECT dim, vec_id, round(x, 6) AS value FROM d QUALIFY row_number() OVER (PARTITION BY dim ORDER BY abs(x) DESC, vec_id) <= 4""")
def a12_top_by_magnitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("dim", "x")).select("vec_id", F.col("dim").cast("long").alias("dim"), F.col("x").cast("double").alias("x"))
    return select.first_n(d, ["dim"], [F.desc(F.abs("x")), F.col("vec_id")], 4).select("dim", "vec_id", F.round("x", 6).alias("value"))


@query(f"WITH {EV} SELECT a.unit AS i, b.unit AS j, count(*) AS C FROM ev a JOIN ev b ON a.tok = b.tok AND a.unit < b.unit GROUP BY ALL HAVING C >= 3")
def j11_cofire_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J11, A13."""
    return cofire.pair_counts(_events(spark, sf_dir)).where("C >= 3")


@query("""
WITH e AS (SELECT l_orderkey tok, l_suppkey unit, sum(l_quantity)::DOUBLE a FROM lineitem GROUP BY ALL)
SELECT x.unit AS i, y.unit AS j, count(*) AS C, round(sum(x.a), 2) AS S FROM e x JOIN e y ON x.tok = y.tok AND x.unit < y.unit GROUP BY ALL HAVING C >= 10""")
def a13_cofire_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("tok"), F.col("l_suppkey").alias("unit")).agg(F.sum("l_quantity").cast("double").alias("a"))
    return cofire.pair_counts(e, value="a").where("C >= 10").select("i", "j", "C", F.round("S", 2).alias("S"))


_LIFT = f"{EV}, n AS (SELECT unit, count(*) n FROM ev GROUP BY unit), t AS (SELECT count(DISTINCT tok) T FROM ev), p AS (SELECT a.unit i, b.unit j, count(*) C FROM ev a JOIN ev b ON a.tok = b.tok AND a.unit < b.unit GROUP BY ALL)"


def _lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _events(spark, sf_dir)
    n = ev.groupBy("unit").agg(F.count(F.lit(1)).alias("n"))
    total = ev.select("tok").distinct().count()
    p = cofire.pair_counts(ev).join(n.select(F.col("unit").alias("i"), F.col("n").alias("ni")), "i").join(n.select(F.col("unit").alias("j"), F.col("n").alias("nj")), "j")
    return p.withColumn("E", F.col("ni") * F.col("nj") / F.lit(float(total)))


@query(f"WITH {_LIFT} SELECT i, j, C, round(a.n * b.n / T, 5) AS expected, round(C / (a.n * b.n / T), 5) AS lift FROM p JOIN n a ON a.unit = i JOIN n b ON b.unit = j, t WHERE C >= 3 AND C / (a.n * b.n / T) >= 1.2")
def a14_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _lift(spark, sf_dir).where((F.col("C") >= 3) & (F.col("C") / F.col("E") >= 1.2))
    return r.select("i", "j", "C", F.round("E", 5).alias("expected"), F.round(F.col("C") / F.col("E"), 5).alias("lift"))


@query()
def a14_poisson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tests hold the tail against a plain sum."""
    r = _lift(spark, sf_dir).where("C >= 3").withColumn("p", poisson_tail(F.col("C").cast("double"), F.col("E")))
    return r.where("p < 0.01").select("i", "j", "C", "p")


@query(f"WITH {_LIFT} SELECT i, j, round(C / least(a.n, b.n), 6) AS coact FROM p JOIN n a ON a.unit = i JOIN n b ON b.unit = j WHERE C >= 5")
def a15_conditional_coactivation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lift(spark, sf_dir).where("C >= 5").select("i", "j", F.round(F.col("C") / F.least("ni", "nj"), 6).alias("coact"))


@query(f"""
WITH {EV}, s AS (SELECT a.unit i, b.unit j FROM ev a JOIN ev b ON a.tok = b.tok AND a.unit < b.unit GROUP BY ALL HAVING count(*) >= 2),
f AS (SELECT x.i, x.j, y.j k FROM s x JOIN s y ON x.j = y.i JOIN s z ON z.i = x.i AND z.j = y.j)
SELECT i, j, k, count(*) AS n FROM f JOIN ev a ON a.unit = i JOIN ev b ON b.unit = j AND b.tok = a.tok JOIN ev c ON c.unit = k AND c.tok = a.tok GROUP BY ALL""")
def j12_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strong edges first; then tokens on which all three fire."""
    return cofire.triangles(_events(spark, sf_dir), 2)


@query("""
WITH e AS (SELECT user_id u, value v, CAST(json_extract_string(props, '$.k') AS DOUBLE) k FROM events)
SELECT u AS unit, round(corr(v, k), 5) AS pearson FROM e GROUP BY u HAVING count(*) >= 10""")
def a16_pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("unit"), F.col("value").alias("v"), F.get_json_object("props", "$.k").cast("double").alias("k"))
    g = e.groupBy("unit").agg(F.corr("v", "k").alias("r"), F.count(F.lit(1)).alias("n"))
    return g.where("n >= 10").select("unit", F.round("r", 5).alias("pearson"))


@query("""
WITH b AS (SELECT l_suppkey unit, l_discount > 0.05 pos, least(greatest(floor((log10(l_extendedprice::DOUBLE) - 2) * 8)::INT + 1, 0), 30) bin FROM lineitem)
SELECT unit, pos, bin, count(*) AS n FROM b GROUP BY ALL""")
def a5_log_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("l_extendedprice").cast("double")
    bin_ = F.least(F.greatest((F.floor((F.log10(x) - 2) * 8) + 1).cast("int"), F.lit(0)), F.lit(30))
    b = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("unit"), (F.col("l_discount") > 0.05).alias("pos"), bin_.alias("bin"))
    return b.groupBy("unit", "pos", "bin").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH h AS (SELECT user_id unit, floor(value / 5)::INT bin, count(*) n FROM events GROUP BY ALL)
SELECT unit, round(sum(CASE WHEN bin * 5 >= 42 THEN n WHEN (bin + 1) * 5 <= 42 THEN 0 ELSE n * ((bin + 1) * 5 - 42) / 5.0 END), 5) AS above FROM h GROUP BY unit""")
def a6_tail_from_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole bins above the threshold, and a share of the one that straddles it."""
    h = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("unit"), F.floor(F.col("value") / 5).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    lo, hi = F.col("bin") * 5, (F.col("bin") + 1) * 5
    part = F.when(lo >= 42, F.col("n").cast("double")).when(hi <= 42, 0.0).otherwise(F.col("n") * (hi - 42) / 5.0)
    return h.groupBy("unit").agg(F.round(F.sum(part), 5).alias("above"))


@query("""
WITH h AS (SELECT user_id unit, floor(value / 5)::INT bin, count(*) n FROM events GROUP BY ALL), v AS (SELECT user_id unit, max(value) / 2 x FROM events GROUP BY user_id)
SELECT unit, round(least(greatest(sum(CASE WHEN (bin + 1) * 5 <= x THEN n WHEN bin * 5 >= x THEN 0 ELSE n * (x - bin * 5) / 5.0 END) / sum(n), 0), 1), 5) AS percentile FROM h JOIN v USING (unit) GROUP BY unit""")
def a7_percentile_from_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    h = e.groupBy(F.col("user_id").alias("unit"), F.floor(F.col("value") / 5).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    v = e.groupBy(F.col("user_id").alias("unit")).agg((F.max("value") / 2).alias("x"))
    lo, hi = F.col("bin") * 5, (F.col("bin") + 1) * 5
    part = F.when(hi <= F.col("x"), F.col("n").cast("double")).when(lo >= F.col("x"), 0.0).otherwise(F.col("n") * (F.col("x") - lo) / 5.0)
    share = F.sum(part) / F.sum("n")
    return h.join(v, "unit").groupBy("unit").agg(F.round(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)), 5).alias("percentile"))


@query("SELECT l_partkey AS feature, count(*) FILTER (l_quantity > 45) AS fires, round(count(*) FILTER (l_quantity > 45) / count(*), 6) AS rate, coalesce(sum(l_quantity) FILTER (l_quantity > 45), 0)::DOUBLE AS total FROM lineitem GROUP BY l_partkey")
def a8_fire_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    fire = F.col("l_quantity") > 45
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("feature"))
    return g.agg(F.count_if(fire).alias("fires"), F.round(F.count_if(fire) / F.count(F.lit(1)), 6).alias("rate"), F.sum(F.when(fire, F.col("l_quantity")).otherwise(0)).cast("double").alias("total"))


@query("""
WITH f AS (SELECT p_partkey feature, coalesce(n, 0) n, top FROM part LEFT JOIN (SELECT l_partkey, count(*) n, max(l_quantity)::DOUBLE top FROM lineitem WHERE l_quantity > 46 GROUP BY l_partkey) ON l_partkey = p_partkey)
SELECT count(*) FILTER (n > 0) AS live, round(count(*) FILTER (n = 0) / count(*), 6) AS dead_share, count(*) FILTER (n >= 3) AS full_n, round(quantile_cont(n, 0.5) FILTER (n > 0), 4) AS median_live, round(quantile_cont(top, 0.9) FILTER (top > 0), 4) AS p90_top FROM f""")
def a48_live_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "lineitem").where("l_quantity > 46").groupBy(F.col("l_partkey").alias("feature")).agg(F.count(F.lit(1)).alias("n"), F.max("l_quantity").cast("double").alias("top"))
    f = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("feature")).join(s, "feature", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return f.agg(
        F.count_if(F.col("n") > 0).alias("live"), F.round(F.count_if(F.col("n") == 0) / F.count(F.lit(1)), 6).alias("dead_share"),
        F.count_if(F.col("n") >= 3).alias("full_n"), F.round(F.expr("percentile(CASE WHEN n > 0 THEN n END, 0.5)"), 4).alias("median_live"), F.round(F.expr("percentile(CASE WHEN top > 0 THEN top END, 0.9)"), 4).alias("p90_top"),
    )


@query("""
WITH f AS (SELECT p_partkey, coalesce(n, 0) windows FROM part LEFT JOIN (SELECT l_partkey, count(*) n FROM lineitem WHERE l_quantity > 46 GROUP BY l_partkey) ON l_partkey = p_partkey)
SELECT windows, count(*) AS features FROM f GROUP BY windows""")
def a30_coverage_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "lineitem").where("l_quantity > 46").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("n"))
    f = table(spark, sf_dir, "part").select("p_partkey").join(s, "p_partkey", "left").select(F.coalesce("n", F.lit(0)).cast("long").alias("windows"))
    return f.groupBy("windows").agg(F.count(F.lit(1)).alias("features"))


@query("""
WITH a AS (SELECT l_orderkey row_id, l_linenumber f, l_extendedprice::DOUBLE v FROM lineitem),
t AS (SELECT min(v) tau FROM (SELECT v FROM a ORDER BY v DESC LIMIT 500))
SELECT row_id, f FROM a, t WHERE v >= tau AND v > 0""")
def a46_batch_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The k x B largest of a batch; ties at the threshold all stay."""
    a = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("row_id"), F.col("l_linenumber").alias("f"), F.col("l_extendedprice").cast("double").alias("v"))
    tau = a.select("v").orderBy(F.desc("v")).limit(500).agg(F.min("v").alias("tau"))
    return a.join(F.broadcast(tau), F.col("v") >= F.col("tau")).where("v > 0").select("row_id", "f")


@query(f"""
WITH {_LIFT}, r AS (SELECT i, j, C, C / (a.n * b.n / T) lift FROM p JOIN n a ON a.unit = i JOIN n b ON b.unit = j, t WHERE C >= 3),
d AS (SELECT unit, count(*) deg FROM (SELECT i unit FROM r UNION ALL SELECT j FROM r) GROUP BY unit)
SELECT least(deg, 20) AS degree, count(*) AS units FROM d GROUP BY degree""")
def a58_degree_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _lift(spark, sf_dir).where("C >= 3")
    d = r.select(F.col("i").alias("unit")).union(r.select("j")).groupBy("unit").agg(F.count(F.lit(1)).alias("deg"))
    return d.groupBy(F.least("deg", F.lit(20)).alias("degree")).agg(F.count(F.lit(1)).alias("units"))


@query("""
WITH s AS (SELECT l_orderkey, round(sum(l_extendedprice::DOUBLE * (1 - l_discount::DOUBLE) * (1 + l_tax::DOUBLE)), 2) top FROM lineitem GROUP BY l_orderkey), r AS (SELECT o_orderkey l_orderkey, o_totalprice::DOUBLE rec FROM orders)
SELECT round(avg((coalesce(abs(rec - top) <= 1e-6 + 1e-4 * abs(top), false))::INT), 6) AS match_rate, count(*) AS checked FROM r FULL JOIN s USING (l_orderkey)""")
def j21_stats_cross_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded statistics against those of the rows: orders' totals and the sums of their lines; a key
    that only one side has does not match."""
    d = lambda c: F.col(c).cast("double")
    s = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.round(F.sum(d("l_extendedprice") * (1 - d("l_discount")) * (1 + d("l_tax"))), 2).alias("top"))
    r = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), d("o_totalprice").alias("rec"))
    close = F.coalesce(F.abs(F.col("rec") - F.col("top")) <= 1e-6 + 1e-4 * F.abs("top"), F.lit(False))
    return r.join(s, "l_orderkey", "full").agg(F.round(F.avg(close.cast("int")), 6).alias("match_rate"), F.count(F.lit(1)).alias("checked"))


@query("""
WITH o AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_linenumber <= 2)
SELECT count(*) FILTER (a.l_quantity <> b.l_quantity OR a.l_partkey <> b.l_partkey) AS mismatch, count(*) AS checked FROM (SELECT l_orderkey, min(l_partkey) l_partkey, min(l_quantity) l_quantity FROM o WHERE l_linenumber = 1 GROUP BY ALL) a JOIN (SELECT l_orderkey, min(l_partkey) l_partkey, min(l_quantity) l_quantity FROM o GROUP BY ALL) b USING (l_orderkey)""")
def j20_store_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "lineitem").where("l_linenumber <= 2")
    low = lambda d, s: d.groupBy("l_orderkey").agg(F.min("l_partkey").alias(f"p{s}"), F.min("l_quantity").alias(f"q{s}"))
    both = low(o.where("l_linenumber = 1"), 1).join(low(o, 2), "l_orderkey")
    return both.agg(F.count_if((F.col("q1") != F.col("q2")) | (F.col("p1") != F.col("p2"))).alias("mismatch"), F.count(F.lit(1)).alias("checked"))


@query("""
WITH r AS (SELECT l_suppkey % 8 AS rank, l_orderkey // 16 AS step, count(*) n FROM lineitem WHERE (l_orderkey + l_suppkey) % 3 <> 0 GROUP BY ALL)
SELECT step, sum(n) AS n FROM r GROUP BY step HAVING count(DISTINCT rank) = 8""")
def j19_full_coverage_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A step is merged only if every rank has its shard."""
    li = table(spark, sf_dir, "lineitem").where("(l_orderkey + l_suppkey) % 3 <> 0")
    r = li.groupBy((F.col("l_suppkey") % 8).alias("rank"), F.floor(F.col("l_orderkey") / 16).alias("step")).agg(F.count(F.lit(1)).alias("n"))
    return r.groupBy("step").agg(F.sum("n").alias("n"), F.countDistinct("rank").alias("ranks")).where("ranks = 8").select("step", "n")


@query("""
WITH e AS (SELECT l_suppkey unit, l_orderkey tok, l_quantity::DOUBLE v FROM lineitem), m AS (SELECT unit, max(v) peak FROM e GROUP BY unit)
SELECT e.unit, count(*) AS n, round(avg((v >= 0.5 * peak)::INT), 6) AS near_peak FROM e JOIN m USING (unit) GROUP BY e.unit""")
def a50_share_near_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("unit"), F.col("l_quantity").cast("double").alias("v"))
    m = e.groupBy("unit").agg(F.max("v").alias("peak"))
    return e.join(m, "unit").groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("v") >= 0.5 * F.col("peak")).cast("int")), 6).alias("near_peak"))
