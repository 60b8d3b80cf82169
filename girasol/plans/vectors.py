"""Vector expressions, norm filters and nearest-neighbour guards, on embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from girasol.functions import keys, vec
from girasol.functions.keys import hkey
from girasol.operators import leak, moments, select

from .common import query, table

def _v() -> Column:
    return F.col("embedding")


def _mean(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """One row: the element-wise mean, from a partial sum a task."""
    return moments.vector_means(df.withColumn("one", F.lit(0)), vector, "one").select("mean")


@query("""
WITH t AS (SELECT vec_id, label, embedding::DOUBLE[] e FROM embeddings),
cos AS (SELECT a.vec_id, a.label, max(list_dot_product(a.e, b.e)) c FROM t a, t b WHERE a.vec_id % 10 <> 0 AND b.vec_id % 10 = 0 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY c DESC, vec_id) rank FROM cos WHERE c <= 0.35)
SELECT label, rank, vec_id, round(c, 6) AS max_cos FROM r WHERE rank <= 5""")
def top_n_leak_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A9 + J7 + J8: the top rows of each family after dropping what is too near to evaluation rows."""
    e = table(spark, sf_dir, "embeddings")
    kept = leak.similarity_guard(e.where("vec_id % 10 <> 0"), e.where("vec_id % 10 = 0"), "embedding", "vec_id", "vec_id", 0.35)
    top = select.first_n(kept, ["label"], [F.desc("cos"), F.col("vec_id")], 5, "rank")
    return top.select("label", "rank", "vec_id", F.round("cos", 6).alias("max_cos"))


@query("""
WITH d AS (SELECT vec_id, generate_subscripts(embedding, 1) i, unnest(embedding)::DOUBLE x FROM embeddings),
m AS (SELECT i, avg(x) m FROM d GROUP BY i),
c AS (SELECT vec_id, i, x - m v FROM d JOIN m USING (i)),
n AS (SELECT vec_id, sqrt(sum(v * v)) n FROM c GROUP BY vec_id)
SELECT vec_id, round(n, 6) AS centred_norm, round(sum(v / n) FILTER (i <= 3), 6) AS head_sum FROM c JOIN n USING (vec_id) GROUP BY vec_id, n""")
def p1_centre_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    c = e.crossJoin(F.broadcast(_mean(e))).select("vec_id", vec.centred(_v(), F.col("mean")).alias("c"))
    u = c.select("vec_id", vec.norm(F.col("c")).alias("n"), vec.unit(F.col("c")).alias("u"))
    head = F.aggregate(F.slice("u", 1, 3), F.lit(0.0), lambda s, x: s + x)
    return u.select("vec_id", F.round("n", 6).alias("centred_norm"), F.round(head, 6).alias("head_sum"))


@query("SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings")
def p2_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(vec.norm(_v()), 6).alias("norm"))


@query("""
WITH t AS (SELECT vec_id, embedding::DOUBLE[] e FROM embeddings), w AS (SELECT vec_id feature, e w FROM t WHERE vec_id < 8)
SELECT vec_id, feature, round(a, 6) AS act FROM (SELECT vec_id, feature, greatest(0.0, list_dot_product(e, w) - 0.05) a FROM t, w) WHERE a > 0.1""")
def p4_sparse_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature table is eight rows; its size is fixed, so it is broadcast."""
    e = table(spark, sf_dir, "embeddings")
    w = e.where("vec_id < 8").select(F.col("vec_id").alias("feature"), _v().alias("w"))
    a = e.join(F.broadcast(w)).select("vec_id", "feature", vec.relu_encode(_v(), F.col("w"), F.lit(-0.05), threshold=0.1).alias("a"))
    return a.where("a > 0.1").select("vec_id", "feature", F.round("a", 6).alias("act"))


@query("""
WITH t AS (SELECT vec_id, embedding::DOUBLE[] e FROM embeddings)
SELECT a.vec_id, round(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))), 6) AS enc_dec_cos
FROM t a JOIN t b ON b.vec_id = a.vec_id + 1""")
def p5_encoder_decoder_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), _v().alias("dec"))
    return e.join(nxt, "vec_id").select("vec_id", F.round(vec.cosine(_v(), F.col("dec")), 6).alias("enc_dec_cos"))


@query("""
WITH t AS (SELECT vec_id, unnest(range(8)) g, embedding::DOUBLE[] e FROM embeddings)
SELECT vec_id, g AS block, round(sqrt(list_dot_product(e[g*8+1:g*8+8], e[g*8+1:g*8+8])), 6) AS gnorm FROM t""")
def p6_block_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(vec.block_norms(_v(), 8)).alias("block", "g"))
    return e.select("vec_id", F.col("block").cast("long").alias("block"), F.round("g", 6).alias("gnorm"))


@query("""
WITH t AS (SELECT l_orderkey % 100 AS grp, l_partkey % 500 AS vec_id, max(l_quantity)::DOUBLE a FROM lineitem GROUP BY ALL),
d AS (SELECT grp, a, generate_subscripts(embedding, 1) i, unnest(embedding)::DOUBLE x FROM t JOIN embeddings USING (vec_id)),
s AS (SELECT grp, i, sum(a * x) v FROM d GROUP BY ALL)
SELECT grp, round(sqrt(sum(v * v)), 4) AS length, round(max(v) / sqrt(sum(v * v)), 6) AS top FROM s GROUP BY grp""")
def p10_composite_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted sums of member directions, unit-normalised."""
    members = table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 100).alias("grp"), (F.col("l_partkey") % 500).alias("vec_id")).agg(F.max("l_quantity").cast("double").alias("a"))
    d = members.join(table(spark, sf_dir, "embeddings"), "vec_id").select("grp", "a", F.posexplode("embedding").alias("i", "x"))
    s = d.groupBy("grp", "i").agg(F.sum(F.col("a") * F.col("x").cast("double")).alias("v"))
    n = s.groupBy("grp").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("n"), F.max("v").alias("m"))
    return n.select("grp", F.round("n", 4).alias("length"), F.round(F.col("m") / F.col("n"), 6).alias("top"))


@query("""
WITH d AS (SELECT generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding)::DOUBLE x FROM embeddings)
SELECT dim, CASE WHEN max(x) >= -min(x) THEN 1 ELSE -1 END AS polarity, round(greatest(max(x), -min(x)), 6) AS max_abs FROM d GROUP BY dim""")
def p12_polarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "embeddings").select(F.posexplode("embedding").alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    g = d.groupBy(F.col("dim").cast("long").alias("dim")).agg(F.max("x").alias("hi"), F.min("x").alias("lo"))
    return g.select("dim", F.when(F.col("hi") >= -F.col("lo"), 1).otherwise(-1).alias("polarity"), F.round(F.greatest("hi", -F.col("lo")), 6).alias("max_abs"))


@query("""
WITH t AS (SELECT vec_id, embedding::DOUBLE[] e FROM embeddings)
SELECT a.vec_id, round(list_dot_product(a.e, b.e), 6) AS cos FROM t a JOIN t b ON b.vec_id = 0""")
def p13_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    one = e.where("vec_id = 0").select(_v().alias("ref"))
    return e.join(F.broadcast(one)).select("vec_id", F.round(vec.dot(_v(), F.col("ref")), 6).alias("cos"))


@query("""
WITH t AS (SELECT vec_id, embedding::DOUBLE[] e, unnest(range(8)) g FROM embeddings),
b AS (SELECT vec_id, g, list_dot_product(e[g*8+1:g*8+8], e[g*8+1:g*8+8]) s FROM t)
SELECT vec_id, arg_max(g, (s, -g)) AS block, round(max(s) / sum(s), 6) AS energy FROM b GROUP BY vec_id""")
def p19_best_block_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.transform(vec.block_norms(_v(), 8), lambda n: n * n)
    e = table(spark, sf_dir, "embeddings").select("vec_id", s.alias("s"))
    total = F.aggregate("s", F.lit(0.0), lambda a, x: a + x)
    return e.select("vec_id", (F.array_position("s", F.array_max("s")) - 1).alias("block"), F.round(F.array_max("s") / total, 6).alias("energy"))


def _norm_filter(df: DataFrame, norm: str, limit: DataFrame, low: float = 0.0) -> DataFrame:
    return df.crossJoin(F.broadcast(limit)).where((F.col(norm) > low) & (F.col(norm) <= F.col("limit")))


def _presample(df: DataFrame, key: str, n: int) -> DataFrame:
    return select.sample(df, 11, key, n)


_CUSTOMERS = "SELECT c_custkey id, abs(c_acctbal)::DOUBLE n FROM customer"


@query(f"""
WITH t AS ({_CUSTOMERS}), s AS (SELECT n FROM t ORDER BY md5('11:' || id), id LIMIT 512)
SELECT id, round(n, 2) AS norm FROM t WHERE n > 1e-3 AND n <= 1.5 * (SELECT median(n) FROM s)""")
def f1a_norm_presample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median of a bounded, seeded presample: the average of the middle two."""
    t = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.abs("c_acctbal").cast("double").alias("n"))
    limit = _presample(t, "id", 512).agg((1.5 * F.expr("percentile(n, 0.5)")).alias("limit"))
    return _norm_filter(t, "n", limit, 1e-3).select("id", F.round("n", 2).alias("norm"))


@query(f"""
WITH t AS ({_CUSTOMERS}), b AS (SELECT *, id // 100 AS batch FROM t),
m AS (SELECT *, quantile_disc(n, 0.5) OVER (PARTITION BY batch) med FROM b)
SELECT batch, count(*) AS kept, round(max(n), 2) AS largest FROM m WHERE n <= 1.5 * med GROUP BY batch""")
def f1e_norm_by_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lower middle, as torch takes it, in each micro-batch."""
    t = table(spark, sf_dir, "customer").select(F.floor(F.col("c_custkey") / 100).alias("batch"), F.abs("c_acctbal").cast("double").alias("n"))
    med = t.groupBy("batch").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY n)").alias("med"))
    return t.join(med, "batch").where("n <= 1.5 * med").groupBy("batch").agg(F.count(F.lit(1)).alias("kept"), F.round(F.max("n"), 2).alias("largest"))


@query("""
WITH v AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'NaN'::DOUBLE WHEN event_id % 11 = 0 THEN 'Infinity'::DOUBLE ELSE value END x FROM events)
SELECT count(*) AS kept, round(sum(x), 2) AS total FROM v WHERE isfinite(x)""")
def f2_finite_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    x = F.when(F.col("event_id") % 7 == 0, float("nan")).when(F.col("event_id") % 11 == 0, float("inf")).otherwise(F.col("value"))
    ok = e.select(x.alias("x")).where(vec.is_finite(F.array("x")))
    return ok.agg(F.count(F.lit(1)).alias("kept"), F.round(F.sum("x"), 2).alias("total"))


_SPLIT = "WITH t AS (SELECT vec_id, label, embedding::DOUBLE[] e FROM embeddings), c AS (SELECT a.vec_id, a.label, b.vec_id ref, b.label ref_label, list_dot_product(a.e, b.e) c FROM t a, t b WHERE a.vec_id % 10 <> 0 AND b.vec_id % 10 = 0)"


@query(_SPLIT + " SELECT vec_id, arg_max(ref, (c, -ref)) AS ref_id, round(max(c), 6) AS cos FROM c GROUP BY vec_id")
def j7_max_cosine_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    near = leak.max_cosine(e.where("vec_id % 10 <> 0"), e.where("vec_id % 10 = 0"), "embedding", "vec_id", "vec_id")
    return near.select("vec_id", "ref_id", F.round("cos", 6).alias("cos"))


@query(_SPLIT + ", m AS (SELECT vec_id, label, max(c) c FROM c GROUP BY ALL) SELECT label, count(*) AS n, count(*) FILTER (c > 0.35) AS dropped, round(max(c), 6) AS worst FROM m GROUP BY label")
def j8_similarity_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    rows = e.where("vec_id % 10 <> 0")
    near = rows.select("vec_id", "label").join(leak.max_cosine(rows, e.where("vec_id % 10 = 0"), "embedding", "vec_id", "vec_id"), "vec_id")
    return near.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("cos") > 0.35).alias("dropped"), F.round(F.max("cos"), 6).alias("worst"))


@query(_SPLIT + ", m AS (SELECT ref, max(c) c FROM c GROUP BY ref) SELECT count(*) AS refs, count(*) FILTER (c > 0.4) AS leaked FROM m")
def j9_reverse_leak_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    near = leak.max_cosine(e.where("vec_id % 10 = 0"), e.where("vec_id % 10 <> 0"), "embedding", "vec_id", "vec_id")
    return near.agg(F.count(F.lit(1)).alias("refs"), F.count_if(F.col("cos") > 0.4).alias("leaked"))


@query("""
WITH t AS (SELECT vec_id, embedding::DOUBLE[] e FROM embeddings),
bad AS (SELECT DISTINCT a.vec_id FROM t a, t b WHERE a.vec_id >= 20 AND b.vec_id < 20 AND list_dot_product(a.e, b.e) > 0.3)
SELECT vec_id FROM t WHERE vec_id >= 20 AND vec_id NOT IN (SELECT vec_id FROM bad)""")
def j10_domination_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    rows = e.where("vec_id >= 20")
    return leak.similarity_guard(rows, e.where("vec_id < 20"), "embedding", "vec_id", "vec_id", 0.3).select("vec_id")


@query("""
WITH t AS (SELECT vec_id, label, embedding::DOUBLE[] e FROM embeddings),
d AS (SELECT label, generate_subscripts(e, 1) i, unnest(e) x FROM t), m AS (SELECT label, i, avg(x) m FROM d GROUP BY ALL),
c AS (SELECT label AS centroid, list(m ORDER BY i) v FROM m GROUP BY label),
r AS (SELECT centroid, vec_id, list_dot_product(e, v) / sqrt(list_dot_product(v, v)) cos FROM t, c WHERE t.label <> c.centroid)
SELECT centroid, vec_id, rank, round(cos, 6) AS cos FROM (SELECT *, row_number() OVER (PARTITION BY centroid ORDER BY cos DESC, vec_id) rank FROM r) WHERE rank <= 3""")
def j14_centroid_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One centroid a label, the nearest rows of others; blocks of both meet in tasks."""
    e = table(spark, sf_dir, "embeddings")
    c = moments.vector_means(e, "embedding", "label").select("label", vec.unit(F.col("mean")).alias("embedding"))
    near = leak.nearest_rows(e, c, "embedding", "vec_id", "label", 3)
    return near.select(F.col("label").alias("centroid"), "vec_id", "rank", F.round("cos", 6).alias("cos"))


@query("""
WITH d AS (SELECT label, generate_subscripts(embedding, 1) i, unnest(embedding)::DOUBLE x FROM embeddings)
SELECT label, i - 1 AS dim, round(avg(x), 6) AS mean FROM d GROUP BY ALL""")
def a2_vector_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = moments.vector_means(table(spark, sf_dir, "embeddings"), "embedding", "label").select("label", F.posexplode("mean").alias("dim", "x"))
    return m.select("label", F.col("dim").cast("long").alias("dim"), F.round("x", 6).alias("mean"))


@query("""
WITH t AS (SELECT embedding::DOUBLE[] e FROM embeddings), p AS (SELECT unnest(range(1, 65)) i), q AS (SELECT unnest(range(1, 65)) j)
SELECT i, j, round(avg(e[i] * e[j]), 8) AS moment FROM t, p, q GROUP BY ALL""")
def a3_second_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of products by pair of places: a task sends one matrix."""
    m = moments.vector_moments(table(spark, sf_dir, "embeddings").withColumn("one", F.lit(0)), "embedding", "one")
    flat = m.select("n", F.size("s").alias("d"), F.posexplode("p").alias("at", "x"))
    place = lambda c: c.cast("long") + 1
    return flat.select(place(F.floor(F.col("at") / F.col("d"))).alias("i"), place(F.col("at") % F.col("d")).alias("j"), F.round(F.col("x") / F.col("n"), 8).alias("moment"))


@query("""
WITH d AS (SELECT generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding)::DOUBLE x FROM embeddings)
SELECT dim, round(sum(x), 6) AS s1, round(sum(x * x), 6) AS s2, round(min(x), 6) AS lo, round(max(x), 6) AS hi, count(*) FILTER (abs(x) < 0.01) AS n_zero FROM d GROUP BY dim""")
def a4_column_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "embeddings").select(F.posexplode("embedding").alias("dim", "x")).select(F.col("dim").cast("long").alias("dim"), F.col("x").cast("double").alias("x"))
    return d.groupBy("dim").agg(
        F.round(F.sum("x"), 6).alias("s1"), F.round(F.sum(F.col("x") * F.col("x")), 6).alias("s2"),
        F.round(F.min("x"), 6).alias("lo"), F.round(F.max("x"), 6).alias("hi"), F.count_if(F.abs("x") < 0.01).alias("n_zero"),
    )


@query("""
WITH t AS (SELECT label, embedding::DOUBLE[] e FROM embeddings), p AS (SELECT unnest(range(1, 65)) i), q AS (SELECT unnest(range(1, 65)) j),
c AS (SELECT label, i, j, avg(e[i] * e[j]) - avg(e[i]) * avg(e[j]) c FROM t, p, q GROUP BY ALL)
SELECT label, round(power(sum(c) FILTER (i = j), 2) / sum(c * c), 5) AS effective_rank FROM c GROUP BY label""")
def a37_effective_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = moments.vector_moments(table(spark, sf_dir, "embeddings"), "embedding", "label")
    flat = m.select("label", "n", "s", F.size("s").alias("d"), F.posexplode("p").alias("at", "x"))
    mean = lambda i: F.get("s", i.cast("int")) / F.col("n")
    i, j = F.floor(F.col("at") / F.col("d")), F.col("at") % F.col("d")
    c = flat.select("label", (i == j).alias("same"), (F.col("x") / F.col("n") - mean(i) * mean(j)).alias("c"))
    trace = F.sum(F.when(F.col("same"), F.col("c")))
    return c.groupBy("label").agg(F.round(trace * trace / F.sum(F.col("c") * F.col("c")), 5).alias("effective_rank"))


@query("""
WITH t AS (SELECT vec_id, label, embedding::DOUBLE[] e FROM embeddings), r AS (SELECT vec_id, e FROM t WHERE vec_id < 50),
m AS (SELECT t.vec_id, r.vec_id ref, list_dot_product(t.e, r.e) c FROM t, r WHERE t.vec_id >= 50)
SELECT vec_id, arg_max(ref, (abs(c), -ref)) AS nearest, round(arg_max(c, (abs(c), -ref)), 6) AS signed_cos FROM m GROUP BY vec_id""")
def a45_nearest_abs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greatest absolute cosine: the reference rows and their negatives, then the better."""
    e = table(spark, sf_dir, "embeddings")
    rows, refs = e.where("vec_id >= 50"), e.where("vec_id < 50")
    up = leak.max_cosine(rows, refs, "embedding", "vec_id", "vec_id")
    flipped = refs.withColumn("embedding", F.transform(_v(), lambda x: -x))
    down = leak.max_cosine(rows, flipped, "embedding", "vec_id", "vec_id").select("vec_id", F.col("ref_id").alias("ref2"), F.col("cos").alias("cos2"))
    both = up.join(down, "vec_id")
    first = (F.col("cos") > F.col("cos2")) | ((F.col("cos") == F.col("cos2")) & (F.col("ref_id") <= F.col("ref2")))
    return both.select("vec_id", F.when(first, F.col("ref_id")).otherwise(F.col("ref2")).alias("nearest"), F.round(F.when(first, F.col("cos")).otherwise(-F.col("cos2")), 6).alias("signed_cos"))


@query()
def p3_zca_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second moments from a matrix a task; their eigenvectors (64 x 64) on the driver."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    m = moments.vector_moments(e.withColumn("one", F.lit(0)), "embedding", "one").first()
    if m is None:
        return e.select("vec_id", _v().cast("array<double>").alias("whitened"))
    mean = np.array(m.s) / m.n
    values, vectors = np.linalg.eigh(moments.covariance(m.n, np.array(m.s), np.array(m.p)))
    zca = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 0) + 1e-5)) @ vectors.T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(float)
            w = (flat.reshape(-1, len(mean)) - mean) @ zca
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(w), pa.list_(pa.float64()))], names=["vec_id", "whitened"])

    return e.where(_v().isNotNull()).mapInArrow(run, "vec_id long, whitened array<double>")


def _axes(spark: SparkSession, sf_dir: str, count: int) -> DataFrame:
    return moments.principal_axes(moments.vector_moments(table(spark, sf_dir, "embeddings"), "embedding", "label"), "label", count)


@query()
def p8_block_pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four right singular vectors of each label's centred rows, all of them: (label,
    component, singular, axis). A label's rows meet as one matrix of products."""
    return _axes(spark, sf_dir, 4).select("label", "component", "singular", "axis")


@query()
def p9_block_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row's coordinates in its label's basis, and the unit direction that they stand for."""
    axes = _axes(spark, sf_dir, 4).groupBy("label").agg(F.first("mean").alias("mean"), F.array_sort(F.collect_list(F.struct("component", "axis"))).alias("axes"))
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding").join(axes, "label")
    c = e.select("vec_id", "label", "axes", vec.centred(_v(), F.col("mean")).alias("x"))
    c = c.withColumn("coords", F.transform("axes", lambda a: vec.dot(F.col("x"), a["axis"])))
    back = F.transform(F.sequence(F.lit(0), F.size("x") - 1), lambda i: F.aggregate(F.zip_with("coords", "axes", lambda k, a: k * F.get(a["axis"], i)), F.lit(0.0), lambda s, v: s + v))
    b = c.select("vec_id", "label", "coords", back.alias("back"))
    return b.select("vec_id", "label", "coords", F.transform("back", lambda v: v / (vec.norm(F.col("back")) + 1e-8)).alias("direction"))


@query()
def a38_geometric_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weiszfeld steps over whole vectors: a task sends one weighted sum a step, until the move is
    below 1e-5; not settled after 500 steps is an error. A step's state is one vector."""
    e = table(spark, sf_dir, "embeddings").select("embedding").where(vec.is_finite(_v()))
    first = _mean(e).first()["mean"]
    now = np.array(first or [])
    for step in range(501 if len(now) else 0):
        if step == 500:
            raise RuntimeError("the median is not settled after 500 steps")
        at = now

        def run(batches: Iterator[pa.RecordBatch], at: np.ndarray = at) -> Iterator[pa.RecordBatch]:
            weight, total = 0.0, np.zeros(len(at))
            for b in batches:
                x = b.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, len(at))
                w = 1 / np.maximum(np.linalg.norm(x - at, axis=1), 1e-12)
                weight, total = weight + w.sum(), total + w @ x
            yield pa.RecordBatch.from_arrays([pa.array([weight]), pa.array([total.tolist()])], names=["w", "s"])

        sums = e.mapInArrow(run, "w double, s array<double>").select("w", F.posexplode("s").alias("i", "x"))
        new = sums.groupBy("i").agg((F.sum("x") / F.sum("w")).alias("x")).orderBy("i").toPandas().x.to_numpy()
        moved, now = np.linalg.norm(new - at), new
        if moved < 1e-5:
            break
    return spark.createDataFrame([(i, round(float(x), 4)) for i, x in enumerate(now)], "dim int, median double")


@query("""
WITH t AS (SELECT vec_id, embedding::DOUBLE[] e, len(embedding) d FROM embeddings), h AS (SELECT vec_id, e, d, list_transform(range((d + 1) // 2), lambda k: md5('3:' || vec_id || ':' || k)) h FROM t),
u AS (SELECT vec_id, e, d, list_transform(h, lambda x: sqrt(-2 * ln((('0x' || x[1:8])::BIGINT + 1) / 4294967296.0))) r, list_transform(h, lambda x: 2 * pi() * (('0x' || x[9:16])::BIGINT / 4294967296.0)) a FROM h),
z AS (SELECT vec_id, e, list_transform(range(d), lambda i: CASE WHEN i % 2 = 0 THEN r[i // 2 + 1] * cos(a[i // 2 + 1]) ELSE r[i // 2 + 1] * sin(a[i // 2 + 1]) END) z FROM u)
SELECT vec_id, round(z[1] / sqrt(list_dot_product(z, z)), 6) AS head, round(list_dot_product(z, e) / sqrt(list_dot_product(z, z)) / sqrt(list_dot_product(e, e)), 6) AS cos FROM z""")
def p14_random_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An isotropic unit row beside each row of the table, and its cosine with it."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", vec.unit(keys.normals(3, F.size("embedding"), F.col("vec_id"))).alias("control"))
    return e.select("vec_id", F.round(F.get("control", F.lit(0)), 6).alias("head"), F.round(vec.cosine(F.col("control"), F.col("embedding")), 6).alias("cos"))
