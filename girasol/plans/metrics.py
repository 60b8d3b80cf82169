"""Evaluation metrics; events stand in for scores (user = direction, event_type = arm or family)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from girasol.operators.dip import dip_test

from .common import query, table


def rank_auc(df: DataFrame, group: str, score: str, positive: str) -> DataFrame:
    """(group, auc): Mann-Whitney with ties at a half, NULL if a side is empty.

    Equal scores are counted first, so a group's window has a row for each different score.
    """
    by = df.groupBy(group, score).agg(F.count_if(F.col(positive)).alias("p"), F.count_if(~F.col(positive)).alias("n"))
    below = F.coalesce(F.sum("n").over(Window.partitionBy(group).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    s = by.withColumn("won", F.col("p") * (below + F.col("n") / 2))
    return s.groupBy(group).agg(F.try_divide(F.sum("won"), F.sum("p").cast("double") * F.sum("n")).alias("auc"))


def locality(a: Column) -> dict[str, Column]:
    """Peak share, best 3- and 5-window shares, Gini and count at half the peak; NULL without mass."""
    total = F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    n = F.size(a)

    def best(k: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1)))
        sums = F.transform(starts, lambda i: F.aggregate(F.slice(a, i, F.lit(k)), F.lit(0.0), lambda s, x: s + x))
        return F.when(n <= k, 1.0).otherwise(F.array_max(sums) / total)

    ranked = F.array_sort(a)
    weighted = F.aggregate(F.zip_with(ranked, F.sequence(F.lit(1), n), lambda x, i: x * i), F.lit(0.0), lambda s, x: s + x)
    out = {
        "peak_share": F.array_max(a) / total, "win3": best(3), "win5": best(5), "gini": 2 * weighted / (n * total) - (n + 1) / n,
        "half_peak": F.size(F.filter(a, lambda x: x >= F.array_max(a) / 2)).cast("long"),
    }
    return {k: F.when(total > 0, v) for k, v in out.items()}


@query("SELECT source AS family, count(*) AS n FROM documents GROUP BY source")
def a1_family_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.col("source").alias("family")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, round(max(value), 6) AS best, arg_max(event_id, (value, -event_id)) AS text_id, count(*) AS n FROM events WHERE event_id % 4 <> 0 GROUP BY user_id")
def a17_best_of_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of equal maxima gives the attached text."""
    e = table(spark, sf_dir, "events").where("event_id % 4 <> 0")
    best = F.max(F.struct(F.col("value"), (-F.col("event_id")).alias("i"))).alias("b")
    return e.groupBy("user_id").agg(best, F.count(F.lit(1)).alias("n")).select("user_id", F.round("b.value", 6).alias("best"), (-F.col("b.i")).alias("text_id"), "n")


@query("""
WITH m AS (SELECT user_id, event_type, max(value) v FROM events GROUP BY ALL)
SELECT user_id, round(min(v), 6) AS weakest, round(max(v), 6) AS strongest FROM m GROUP BY user_id""")
def a18_member_min_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max("value").alias("v"))
    return m.groupBy("user_id").agg(F.round(F.min("v"), 6).alias("weakest"), F.round(F.max("v"), 6).alias("strongest"))


@query("""
SELECT event_type, round(avg((value >= 10)::INT), 6) AS ge10, round(avg((value >= 50)::INT), 6) AS ge50, round(avg((value > 75)::INT), 6) AS fired, round(avg((value <= 75)::INT), 6) AS unverbalized, round(avg((value < 10)::INT), 6) AS p10 FROM events GROUP BY event_type""")
def a19_threshold_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = lambda c, n: F.round(F.avg(c.cast("int")), 6).alias(n)
    v = F.col("value")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(share(v >= 10, "ge10"), share(v >= 50, "ge50"), share(v > 75, "fired"), share(v <= 75, "unverbalized"), share(v < 10, "p10"))


_RANKS = "WITH b AS (SELECT user_id, event_type, max(value) v FROM events GROUP BY ALL), r AS (SELECT *, rank() OVER (PARTITION BY event_type ORDER BY v DESC) r FROM b)"


def _ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max("value").alias("v"))
    # Equal values have one rank: those before it. Values are counted, and numbered by whole parts.
    values = b.groupBy("event_type", "v").agg(F.count(F.lit(1)).alias("c")).withColumn("b", F.floor("v"))
    sizes = values.groupBy("event_type", "b").agg(F.sum("c").alias("s"))
    down = lambda by, *keys: Window.partitionBy(*keys).orderBy(F.desc(by)).rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("event_type", "b", F.coalesce(F.sum("s").over(down("b", "event_type")), F.lit(0)).alias("o"))
    own = F.coalesce(F.sum("c").over(down("v", "event_type", "b")), F.lit(0))
    ranks = values.withColumn("p", own).join(before, ["event_type", "b"]).select("event_type", "v", (F.col("o") + F.col("p") + 1).alias("r"))
    return b.join(ranks, ["event_type", "v"])


@query(_RANKS + " SELECT user_id, event_type, r AS rank FROM r")
def w5_strict_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranks(spark, sf_dir).select("user_id", "event_type", F.col("r").cast("long").alias("rank"))


@query(_RANKS + ", u AS (SELECT user_id, avg(r) m, min(r) lo FROM r GROUP BY user_id) SELECT count(*) AS n, round(avg((lo = 1)::INT), 6) AS rank1, round(avg((lo <= 10)::INT), 6) AS top10, round(avg(m), 5) AS mean_rank, round(median(m), 5) AS median_rank, round(avg(1.0 / lo), 6) AS mrr FROM u")
def a20_rank_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = _ranks(spark, sf_dir).groupBy("user_id").agg(F.avg("r").alias("m"), F.min("r").alias("lo"))
    return u.agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("lo") == 1).cast("int")), 6).alias("rank1"), F.round(F.avg((F.col("lo") <= 10).cast("int")), 6).alias("top10"),
        F.round(F.avg("m"), 5).alias("mean_rank"), F.round(F.expr("percentile(m, 0.5)"), 5).alias("median_rank"), F.round(F.avg(1.0 / F.col("lo")), 6).alias("mrr"),
    )


@query("WITH f AS (SELECT event_type, avg(value) m FROM events WHERE event_type <> 'error' GROUP BY event_type) SELECT round(avg(m), 6) AS mean_all, count(*) AS families FROM f")
def a21_macro_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "events").where("event_type <> 'error'").groupBy("event_type").agg(F.avg("value").alias("m"))
    return f.agg(F.round(F.avg("m"), 6).alias("mean_all"), F.count(F.lit(1)).alias("families"))


@query("""
WITH s AS (SELECT lang, n_chars % 50 s, quality = 1 pos FROM documents JOIN labels USING (doc_id)),
b AS (SELECT lang, s, count(*) FILTER (pos) p, count(*) FILTER (NOT pos) n FROM s GROUP BY ALL),
w AS (SELECT *, p * (coalesce(sum(n) OVER (PARTITION BY lang ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + n / 2) won FROM b)
SELECT lang, round(CASE WHEN sum(p) * sum(n) > 0 THEN sum(won) / (sum(p) * sum(n)) END, 6) AS auc FROM w GROUP BY lang""")
def a22_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("lang", (F.col("n_chars") % 50).alias("s"), (F.col("quality") == 1).alias("pos"))
    return rank_auc(s, "lang", "s", "pos").select("lang", F.round("auc", 6).alias("auc"))


@query("""
WITH s AS (SELECT lang, n_chars % 100 s, toxic = 1 pos FROM documents JOIN labels USING (doc_id))
SELECT lang, round((avg((s >= 50)::INT) FILTER (pos) + avg((s < 50)::INT) FILTER (NOT pos)) / 2, 6) AS balanced FROM s GROUP BY lang""")
def a23_balanced_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("lang", (F.col("n_chars") % 100).alias("s"), (F.col("toxic") == 1).alias("pos"))
    hit = F.avg(F.when(F.col("pos"), (F.col("s") >= 50).cast("int"))) + F.avg(F.when(~F.col("pos"), (F.col("s") < 50).cast("int")))
    return s.groupBy("lang").agg(F.round(hit / 2, 6).alias("balanced"))


@query("SELECT user_id, count(*) AS n, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0) / sqrt(count(*)), 6) AS sem, round(1.96 * coalesce(stddev_samp(value), 0) / sqrt(count(*)), 6) AS ci95 FROM events GROUP BY user_id")
def a24_mean_sem(spark: SparkSession, sf_dir: str) -> DataFrame:
    sem = F.coalesce(F.stddev_samp("value"), F.lit(0.0)) / F.sqrt(F.count(F.lit(1)))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(sem, 6).alias("sem"), F.round(1.96 * sem, 6).alias("ci95"))


_ARMS = "WITH a AS (SELECT user_id, avg(value) FILTER (event_id % 2 = 0) x, avg(value) FILTER (event_id % 2 = 1) y FROM events GROUP BY user_id), d AS (SELECT user_id, x - y d FROM a WHERE x IS NOT NULL AND y IS NOT NULL)"


def _arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    a = e.groupBy("user_id").agg(F.avg(F.when(F.col("event_id") % 2 == 0, F.col("value"))).alias("x"), F.avg(F.when(F.col("event_id") % 2 == 1, F.col("value"))).alias("y"))
    return a.where("x IS NOT NULL AND y IS NOT NULL")


@query(_ARMS + " SELECT count(*) AS n, round(avg(d), 6) AS mean, round(stddev_samp(d) / sqrt(count(*)), 6) AS sem, round(avg((d >= 0)::INT), 6) AS frac_ge0 FROM d")
def a25_paired_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only keys with both arms."""
    d = _arms(spark, sf_dir).select((F.col("x") - F.col("y")).alias("d"))
    return d.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("d"), 6).alias("mean"), F.round(F.stddev_samp("d") / F.sqrt(F.count(F.lit(1))), 6).alias("sem"), F.round(F.avg((F.col("d") >= 0).cast("int")), 6).alias("frac_ge0"))


_PROFILE = "WITH p AS (SELECT l_orderkey k, list((l_quantity::DOUBLE - 20 + abs(l_quantity::DOUBLE - 20)) / 2 ORDER BY l_linenumber, l_quantity) a FROM lineitem GROUP BY l_orderkey), t AS (SELECT k, a, list_sum(a) s, len(a) n FROM p)"


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """relu(quantity - 20) of an order's lines: an activation profile."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber", F.col("l_quantity").cast("double").alias("q"))
    a = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "q"))), lambda s: F.greatest(s["q"] - 20, F.lit(0.0)))
    return li.groupBy("k").agg(a.alias("a"))


@query(_PROFILE + """, w AS (SELECT *, list_max(list_transform(range(1, greatest(n - 2, 1) + 1), lambda i: list_sum(a[i:i+2]))) w3, list_max(list_transform(range(1, greatest(n - 4, 1) + 1), lambda i: list_sum(a[i:i+4]))) w5,
list_sum(list_transform(list_sort(a), lambda x, i: x * i)) g FROM t)
SELECT k, CASE WHEN s > 0 THEN round(list_max(a) / s, 6) END AS peak_share, CASE WHEN s > 0 THEN round(CASE WHEN n <= 3 THEN 1.0 ELSE w3 / s END, 6) END AS win3, CASE WHEN s > 0 THEN round(CASE WHEN n <= 5 THEN 1.0 ELSE w5 / s END, 6) END AS win5,
CASE WHEN s > 0 THEN round(2 * g / (n * s) - (n + 1) / n, 6) END AS gini, CASE WHEN s > 0 THEN len(list_filter(a, lambda x: x >= list_max(a) / 2)) END AS half_peak FROM w""")
def a26_locality(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = locality(F.col("a"))
    return _profiles(spark, sf_dir).select("k", *[(v if k == "half_peak" else F.round(v, 6)).alias(k) for k, v in m.items()])


@query(_PROFILE + " SELECT k % 50 AS feature, count(*) AS n, round(avg((s > 0)::INT), 6) AS fired, round(avg(list_max(a) / s) FILTER (s > 0), 6) AS peak_share FROM t GROUP BY feature")
def a27_locality_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates over all texts, metrics over the firing ones."""
    s = F.aggregate("a", F.lit(0.0), lambda x, y: x + y)
    t = _profiles(spark, sf_dir).select((F.col("k") % 50).alias("feature"), F.array_max("a").alias("p"), s.alias("s"))
    return t.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("s") > 0).cast("int")), 6).alias("fired"), F.round(F.avg(F.when(F.col("s") > 0, F.col("p") / F.col("s"))), 6).alias("peak_share"))


@query(_PROFILE + " SELECT k, n, round(list_max(a), 4) AS peak, s > 0 AS fired, list_position(a, list_max(a)) > n - 5 AS in_last5, round((list_position(a, list_max(a)) - 1) / greatest(n - 1, 1), 6) AS place FROM t")
def a51_locality_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, at = F.size("a"), F.array_position("a", F.array_max("a"))
    s = F.aggregate("a", F.lit(0.0), lambda x, y: x + y)
    return _profiles(spark, sf_dir).select("k", n.cast("long").alias("n"), F.round(F.array_max("a"), 4).alias("peak"), (s > 0).alias("fired"), (at > n - 5).alias("in_last5"), F.round((at - 1) / F.greatest(n - 1, F.lit(1)), 6).alias("place"))


@query(_PROFILE + ", w AS (SELECT k, a, list_transform(range(1, n - 1), lambda i: list_sum(a[i:i+2])) v FROM t WHERE n >= 3) SELECT k, list_position(v, list_max(v)) AS start, round(list_max(v), 4) AS mass FROM w")
def w15_best_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _profiles(spark, sf_dir).where("size(a) >= 3")
    v = F.transform(F.sequence(F.lit(1), F.size("a") - 2), lambda i: F.aggregate(F.slice("a", i, F.lit(3)), F.lit(0.0), lambda s, x: s + x))
    return p.select("k", v.alias("v")).select("k", F.array_position("v", F.array_max("v")).alias("start"), F.round(F.array_max("v"), 4).alias("mass"))


@query(_PROFILE + " SELECT k, round(CASE WHEN n = 0 THEN 0 ELSE list_max(list_transform(a, lambda x, i: x - 0.5 * (n - i))) END, 6) AS reward, round(ln(1 + greatest(list_max(list_transform(a, lambda x, i: x / 50 - 0.05 * (n - i))), -0.9)), 6) AS shaped FROM t")
def a42_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greatest value less a penalty for distance from the end; W6 is that distance."""
    n = F.size("a")
    p = _profiles(spark, sf_dir)
    top = lambda by, cost: F.array_max(F.transform("a", lambda x, i: x / by - cost * (n - 1 - i)))
    return p.select("k", F.round(F.when(n == 0, 0.0).otherwise(top(1.0, 0.5)), 6).alias("reward"), F.round(F.log1p(F.greatest(top(50.0, 0.05), F.lit(-0.9))), 6).alias("shaped"))


@query(_ARMS + ", p AS (SELECT user_id, max(value) peak FROM events GROUP BY user_id) SELECT a.user_id, x > y AND x > 0.25 * peak AS holds FROM a JOIN p USING (user_id) WHERE x IS NOT NULL AND y IS NOT NULL")
def a28_holds(spark: SparkSession, sf_dir: str) -> DataFrame:
    peak = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("value").alias("peak"))
    return _arms(spark, sf_dir).join(peak, "user_id").select("user_id", ((F.col("x") > F.col("y")) & (F.col("x") > 0.25 * F.col("peak"))).alias("holds"))


@query("""
SELECT event_type, count(*) FILTER (value > 90) AS n_gt, round(avg((value > 90)::INT), 6) AS frac_gt, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.99), 6) AS p99, round(max(value), 6) AS top,
count(*) FILTER (value < 25) AS b0, count(*) FILTER (value >= 25 AND value < 50) AS b1, count(*) FILTER (value >= 50) AS b2 FROM events GROUP BY event_type""")
def a29_tail_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count_if(v > 90).alias("n_gt"), F.round(F.avg((v > 90).cast("int")), 6).alias("frac_gt"), F.round(F.expr("percentile(value, 0.5)"), 6).alias("p50"), F.round(F.expr("percentile(value, 0.99)"), 6).alias("p99"),
        F.round(F.max(v), 6).alias("top"), F.count_if(v < 25).alias("b0"), F.count_if((v >= 25) & (v < 50)).alias("b1"), F.count_if(v >= 50).alias("b2"),
    )


@query("SELECT event_type, q, round(x, 6) AS value FROM (SELECT event_type, unnest([5, 10, 25, 50, 75, 90, 95]) q, unnest(quantile_cont(value, [0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95])) x FROM events GROUP BY event_type)")
def a31_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    qs = (5, 10, 25, 50, 75, 90, 95)
    g = table(spark, sf_dir, "events").groupBy("event_type").agg(F.expr(f"percentile(value, array({', '.join(f'{q / 100}D' for q in qs)}))").alias("v"))
    return g.select("event_type", F.explode(F.arrays_zip(F.array(*[F.lit(q) for q in qs]).alias("q"), "v")).alias("x")).select("event_type", F.col("x.q").alias("q"), F.round("x.v", 6).alias("value"))


@query("""
SELECT floor(user_id / 20)::BIGINT AS bin, count(*) AS n, round(CASE WHEN count(*) >= 5 THEN avg(value) END, 6) AS mean, round(CASE WHEN count(*) >= 5 THEN quantile_cont(value, 0.5) END, 6) AS median, round(CASE WHEN count(*) >= 5 THEN quantile_cont(value, 0.75) END, 6) AS p75 FROM events GROUP BY bin""")
def a32_binned_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    enough = F.count(F.lit(1)) >= 5
    stat = lambda c, n: F.round(F.when(enough, c), 6).alias(n)
    return table(spark, sf_dir, "events").groupBy(F.floor(F.col("user_id") / 20).alias("bin")).agg(F.count(F.lit(1)).alias("n"), stat(F.avg("value"), "mean"), stat(F.expr("percentile(value, 0.5)"), "median"), stat(F.expr("percentile(value, 0.75)"), "p75"))


@query("SELECT source, round(skewness(n_chars), 5) AS skew, round(kurtosis(n_chars), 4) AS excess, round(avg((n_chars < 500)::INT), 6) AS miss, round(avg((n_chars >= 2000)::INT), 6) AS nailed FROM documents GROUP BY source")
def a33_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample-corrected skew and excess kurtosis from the population ones."""
    n, x = F.count("n_chars"), F.col("n_chars")
    skew = F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2)
    kurt = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6)
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.round(skew, 5).alias("skew"), F.round(kurt, 4).alias("excess"), F.round(F.avg((x < 500).cast("int")), 6).alias("miss"), F.round(F.avg((x >= 2000).cast("int")), 6).alias("nailed"))


_AVG_RANK = "WITH e AS (SELECT event_type g, event_id, value x, user_id y FROM events), r AS (SELECT g, rank() OVER (PARTITION BY g ORDER BY x) + (count(*) OVER (PARTITION BY g, x) - 1) / 2 rx, rank() OVER (PARTITION BY g ORDER BY y) + (count(*) OVER (PARTITION BY g, y) - 1) / 2 ry, x, y FROM e)"


@query(_AVG_RANK + " SELECT g AS event_type, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM r GROUP BY g")
def a35_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("g"), F.col("value").alias("x"), F.col("user_id").cast("double").alias("y"))

    def ranked(df: DataFrame, c: str) -> DataFrame:
        sizes = df.groupBy("g", c).agg(F.count(F.lit(1)).alias("n"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy("g").orderBy(c).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return df.join(sizes.select("g", c, (before + (F.col("n") + 1) / 2).alias(f"r{c}")), ["g", c])

    r = ranked(ranked(e, "x"), "y")
    return r.groupBy(F.col("g").alias("event_type")).agg(F.round(F.corr("x", "y"), 6).alias("pearson"), F.round(F.corr("rx", "ry"), 6).alias("spearman"))


@query("""
WITH t AS (SELECT label, generate_subscripts(embedding, 1) i, unnest(embedding)::DOUBLE x FROM embeddings), m AS (SELECT label, i, avg(x) m FROM t GROUP BY ALL), g AS (SELECT i, avg(x) m FROM t GROUP BY i)
SELECT round(1 - sum((x - m.m) * (x - m.m)) / sum((x - g.m) * (x - g.m)), 6) AS explained, round(count(*) FILTER (x > 0.1) / count(DISTINCT (label, i)), 4) AS l0 FROM t JOIN m USING (label, i) JOIN g USING (i)""")
def a36_explained_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    m, g = t.groupBy("label", "i").agg(F.avg("x").alias("m")), t.groupBy("i").agg(F.avg("x").alias("gm"))
    j = t.join(m, ["label", "i"]).join(F.broadcast(g), "i")
    groups = F.count_distinct("label", "i")
    return j.agg(F.round(1 - F.sum(F.pow(F.col("x") - F.col("m"), F.lit(2.0))) / F.sum(F.pow(F.col("x") - F.col("gm"), F.lit(2.0))), 6).alias("explained"), F.round(F.count_if(F.col("x") > 0.1) / groups, 4).alias("l0"))


_GROUPS = "WITH e AS (SELECT event_id, user_id g, value r FROM events), s AS (SELECT *, avg(r) OVER (PARTITION BY g) m, stddev_samp(r) OVER (PARTITION BY g) sd, stddev_pop(r) OVER (PARTITION BY g) sp FROM e)"


def _centred(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("g"), F.col("value").alias("r"))
    s = e.groupBy("g").agg(F.avg("r").alias("m"), F.stddev_samp("r").alias("sd"), F.stddev_pop("r").alias("sp"), F.count(F.lit(1)).alias("n"))
    return e.join(s, "g")


@query(_GROUPS + " SELECT event_id, round((r - m) / (coalesce(sd, 0) + 1e-6), 5) AS adv FROM s WHERE sd IS NOT NULL")
def a39_group_advantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _centred(spark, sf_dir).where("sd IS NOT NULL").select("event_id", F.round((F.col("r") - F.col("m")) / (F.col("sd") + 1e-6), 5).alias("adv"))


@query(_GROUPS + ", k AS (SELECT sqrt(avg((r - m) * (r - m))) b FROM s WHERE sp > 1e-9) SELECT event_id, round(CASE WHEN sp > 1e-9 THEN (r - m) / b ELSE 0 END, 5) AS adv FROM s, k")
def a39_batch_advantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups without variance are zeroed and leave the common spread."""
    s = _centred(spark, sf_dir)
    d = F.col("r") - F.col("m")
    spread = s.where("sp > 1e-9").agg(F.sqrt(F.avg(d * d)).alias("b"))
    return s.crossJoin(F.broadcast(spread)).select("event_id", F.round(F.when(F.col("sp") > 1e-9, d / F.col("b")).otherwise(0.0), 5).alias("adv"))


@query("""
WITH e AS (SELECT event_id, user_id g, 1 + event_id % 17 n FROM events WHERE event_id % 10 <> 0), t AS (SELECT *, sum(n) OVER () tt, count(*) OVER () rows, sum(n) OVER (PARTITION BY g) gt FROM e), c AS (SELECT count(DISTINCT g) gs FROM e)
SELECT event_id, round(1e6 / tt, 6) AS token_w, round(1e6 / (rows * n), 6) AS seq_w, round(1e6 / (gs * gt), 6) AS prompt_w FROM t, c""")
def a40_loss_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dropped rows leave all denominators; a million times each weight."""
    e = table(spark, sf_dir, "events").where("event_id % 10 <> 0").select("event_id", F.col("user_id").alias("g"), (1 + F.col("event_id") % 17).alias("n"))
    groups = e.groupBy("g").agg(F.sum("n").alias("gt"))
    whole = e.agg(F.sum("n").alias("tt"), F.count(F.lit(1)).alias("rows"), F.count_distinct("g").alias("gs"))
    t = e.join(groups, "g").crossJoin(F.broadcast(whole))
    return t.select("event_id", F.round(1e6 / F.col("tt"), 6).alias("token_w"), F.round(1e6 / (F.col("rows") * F.col("n")), 6).alias("seq_w"), F.round(1e6 / (F.col("gs") * F.col("gt")), 6).alias("prompt_w"))


@query("""
SELECT user_id AS step, round(avg(value), 5) AS mean, round(avg((value < 10)::INT), 6) AS degenerate, round(median(value), 5) AS median FROM events GROUP BY user_id""")
def a43_transcript_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("step")).agg(F.round(F.avg("value"), 5).alias("mean"), F.round(F.avg((F.col("value") < 10).cast("int")), 6).alias("degenerate"), F.round(F.expr("percentile(value, 0.5)"), 5).alias("median"))


@query("SELECT CASE WHEN value < 1 THEN 'low' WHEN value > 99 THEN 'high' WHEN user_id % 10 = 0 THEN 'reserved' ELSE 'ok' END AS reason, count(*) AS n FROM events GROUP BY reason")
def a44_drop_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    reason = F.when(v < 1, "low").when(v > 99, "high").when(F.col("user_id") % 10 == 0, "reserved").otherwise("ok")
    return table(spark, sf_dir, "events").groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH s AS (SELECT event_type, event_id, value, user_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY md5('31:' || event_id), event_id) <= 200)
SELECT event_type, count(*) AS n, round(avg((user_id % 7 < 5)::INT), 6) AS last5, round(avg(value), 5) AS mean_peak, round(median(value), 5) AS median_peak, round(quantile_cont(user_id % 7, 0.9), 4) AS p90_distance FROM s GROUP BY event_type""")
def a47_sampled_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    from girasol.operators import select

    s = select.sample_by(table(spark, sf_dir, "events"), "event_type", 31, "event_id", 200)
    return s.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("user_id") % 7 < 5).cast("int")), 6).alias("last5"), F.round(F.avg("value"), 5).alias("mean_peak"),
        F.round(F.expr("percentile(value, 0.5)"), 5).alias("median_peak"), F.round(F.expr("percentile(user_id % 7, 0.9)"), 4).alias("p90_distance"),
    )


@query("""
WITH d AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY md5('32:' || event_id), event_id) n, value FROM events WHERE event_type = 'view')
SELECT user_id, round(max(value), 6) AS chance FROM d WHERE n <= 4 GROUP BY user_id""")
def a49_chance_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best of four draws, seeded by row, so that partitioning cannot change them."""
    from girasol.operators import select

    d = select.sample_by(table(spark, sf_dir, "events").where("event_type = 'view'"), "user_id", 32, "event_id", 4)
    return d.groupBy("user_id").agg(F.round(F.max("value"), 6).alias("chance"))


@query("""
WITH f AS (SELECT user_id, avg((value > 60)::INT) r FROM events GROUP BY user_id)
SELECT round(avg(r), 6) AS mean_rate, round(avg((r > 0.5)::INT), 6) AS majority FROM f""")
def a52_firing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "events").groupBy("user_id").agg(F.avg((F.col("value") > 60).cast("int")).alias("r"))
    return f.agg(F.round(F.avg("r"), 6).alias("mean_rate"), F.round(F.avg((F.col("r") > 0.5).cast("int")), 6).alias("majority"))


@query("SELECT event_type, round(stddev_samp(value) / sqrt(count(*)), 6) AS se_mean, round(sqrt(greatest(least(avg((value > 60)::INT), 1), 0) * (1 - avg((value > 60)::INT)) / count(*)), 6) AS se_share FROM events GROUP BY event_type")
def a53_standard_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, p = F.count(F.lit(1)), F.avg((F.col("value") > 60).cast("int"))
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.stddev_samp("value") / F.sqrt(n), 6).alias("se_mean"), F.round(F.sqrt(p * (1 - p) / n), 6).alias("se_share"))


@query("WITH e AS (SELECT user_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END v FROM events) SELECT user_id, round(avg(v), 6) AS mean FROM e GROUP BY user_id")
def a54_mean_skipping_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("v"))
    return e.groupBy("user_id").agg(F.round(F.avg("v"), 6).alias("mean"))


@query("SELECT event_id, round(1 - value / 100, 6) AS verbalized, round(value / greatest(max(value) OVER (PARTITION BY user_id), 1e-6), 6) AS norm_act FROM events")
def p16_derived_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    peak = e.groupBy("user_id").agg(F.max("value").alias("peak"))
    return e.join(peak, "user_id").select("event_id", F.round(1 - F.col("value") / 100, 6).alias("verbalized"), F.round(F.col("value") / F.greatest("peak", F.lit(1e-6)), 6).alias("norm_act"))


@query("""
WITH f AS (SELECT DISTINCT event_type f FROM events), n AS (SELECT unnest([1, 2, 4]) n), t AS (SELECT unnest(range(3)) t)
SELECT 'f-' || f || '-N' || n || '-t' || t AS test_id, t % 2 AS label FROM f, n, t""")
def j22_test_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features by variants by tests; the lists of variants and tests are constants."""
    f = table(spark, sf_dir, "events").select(F.col("event_type").alias("f")).distinct()
    t = f.withColumn("n", F.explode(F.array(*[F.lit(x) for x in (1, 2, 4)]))).withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(2))))
    return t.select(F.concat(F.lit("f-"), "f", F.lit("-N"), "n", F.lit("-t"), "t").alias("test_id"), (F.col("t") % 2).alias("label"))


@query("""
WITH m AS (SELECT event_type arm, user_id % 3 metric, avg(value) v FROM events GROUP BY ALL), r AS (SELECT metric, v ref FROM m WHERE arm = 'view')
SELECT arm, round(max(v - ref) FILTER (metric = 0), 6) AS m0, round(max(v - ref) FILTER (metric = 1), 6) AS m1, round(max(v - ref) FILTER (metric = 2), 6) AS m2 FROM m LEFT JOIN r USING (metric) GROUP BY arm""")
def j23_delta_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arms by metrics, less the reference arm's value."""
    m = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("arm"), (F.col("user_id") % 3).alias("metric")).agg(F.avg("value").alias("v"))
    d = m.join(m.where("arm = 'view'").select("metric", F.col("v").alias("ref")), "metric", "left")
    wide = d.groupBy("arm").pivot("metric", [0, 1, 2]).agg(F.round(F.max(F.col("v") - F.col("ref")), 6))
    return wide.select("arm", *[F.col(str(i)).alias(f"m{i}") for i in range(3)])


@query()
def a34_dip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dip of each group's values, and its p under a seeded uniform null."""
    return dip_test(table(spark, sf_dir, "events"), "event_type", "value")
