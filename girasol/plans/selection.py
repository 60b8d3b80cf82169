"""Scans, filters, sampling, quotas and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from girasol.functions.keys import hkey
from girasol.operators import packing, select
from girasol.sources import raw, readers
from girasol.streaming import state

from .common import query, table


@query("SELECT doc_id, source, length(text) AS chars FROM documents WHERE length(text) >= 1500")
def s1_corpus_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = readers.corpus(spark, f"{sf_dir}/documents.parquet")
    return docs.where(F.length("text") >= 1500).select("doc_id", "source", F.length("text").cast("long").alias("chars"))


@query("""
WITH q AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 n FROM documents WHERE length(text) >= 1500)
SELECT doc_id, source, n // 16 AS turn, n % 16 AS slot FROM q""")
def s2_round_robin_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where(F.length("text") >= 1500).select("doc_id", "source")
    return readers.interleaved(docs, "source", "doc_id", 16)


@query("SELECT doc_id, row_number() OVER (ORDER BY md5('9:' || doc_id), doc_id) AS place FROM documents WHERE length(text) >= 1500")
def s3_shuffled_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents that are long enough in a seeded order; a bucket of the key is numbered by itself."""
    docs = table(spark, sf_dir, "documents").where(F.length("text") >= 1500).select("doc_id")
    key = hkey(9, F.col("doc_id"))
    return select.numbered(docs, F.substring(key, 1, 3), [key, F.col("doc_id")], "place")


@query("SELECT doc_id FROM documents WHERE doc_id >= 7 AND (doc_id - 7) % 8 = 3")
def s4_strided_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.strided_shard(table(spark, sf_dir, "documents"), "doc_id", 3, 8, 7).select("doc_id")


@query("""
WITH f AS (SELECT DISTINCT lang, source FROM documents WHERE source NOT IN (SELECT DISTINCT source FROM documents WHERE doc_id % 97 = 5)),
c AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5('4:' || source), source) n FROM f)
SELECT lang, source, ((row_number() OVER (ORDER BY lang, n) - 1) % 3)::INT AS rank FROM c WHERE n <= 2""")
def s5_file_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two unused files a domain, dealt to three ranks."""
    docs = table(spark, sf_dir, "documents")
    used = docs.where("doc_id % 97 = 5").select("source").distinct()
    return readers.assign_files(docs, "lang", "source", 4, 2, 3, used)


@query("SELECT vec_id, label FROM embeddings WHERE vec_id BETWEEN 100 AND 199")
def s11_row_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A few rows and columns; both reach the scan."""
    return table(spark, sf_dir, "embeddings").where("vec_id BETWEEN 100 AND 199").select("vec_id", "label")


@query("SELECT count(*) AS n, min(vec_id) AS lo, max(vec_id) AS hi, sum(label)::BIGINT AS labels FROM embeddings")
def s8_aligned_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON records against the rows that the raw shards beside them hold by their sizes."""
    e = table(spark, sf_dir, "embeddings")
    shards, lines = state.scratch(spark, "vectors"), state.scratch(spark, "records")
    raw.write_vectors(e, "vec_id", "embedding", shards)
    e.select("vec_id", "label").write.json(lines)
    records = spark.read.schema("vec_id long, label int").json(lines)
    ok = readers.aligned_records(records, "vec_id", raw.row_count(shards, 64))
    return ok.agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("lo"), F.max("vec_id").alias("hi"), F.sum("label").alias("labels"))


@query("""
WITH r AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 n FROM events), k AS (SELECT count(*) // 8 keep FROM events)
SELECT event_id, n % 8 AS rank FROM r, k WHERE n // 8 < keep AND n % 8 = 2""")
def s14_loader_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id is dense from 0, so it is the row number."""
    e = table(spark, sf_dir, "events").select("event_id")
    keep = e.count() // 8
    return select.strided_shard(e, "event_id", 2, 8).where(F.floor(F.col("event_id") / 8) < keep).select("event_id", F.lit(2).cast("long").alias("rank"))


@query("""
WITH c AS (SELECT user_id AS step, min(event_id) % 3 AS kind FROM events GROUP BY user_id UNION ALL SELECT user_id + 1, 2 FROM events WHERE event_id < 40 GROUP BY user_id)
SELECT step, min(kind) AS kind FROM c GROUP BY step""")
def s16_checkpoint_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best kind of checkpoint wins a step."""
    e = table(spark, sf_dir, "events")
    one = e.groupBy(F.col("user_id").alias("step")).agg((F.min("event_id") % 3).alias("kind"))
    two = e.where("event_id < 40").groupBy((F.col("user_id") + 1).alias("step")).agg(F.lit(2).cast("long").alias("kind"))
    return select.first_n(one.unionByName(two), ["step"], [F.col("kind")], 1)


@query("SELECT event_id, user_id AS step, round(value, 4) AS reward FROM events WHERE event_type = 'purchase' AND value IS NOT NULL AND NOT isnan(value)")
def s17_run_log_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").where("event_type = 'purchase'")
    return readers.metric_rows(rows, "user_id", ["value"]).select("event_id", F.col("user_id").alias("step"), F.round("value", 4).alias("reward"))


@query("SELECT event_id, regexp_extract(props, '\"k\": ([0-9]+)', 1)::INT AS k FROM events WHERE regexp_matches(props, '\"k\": [0-9]+')")
def s18_log_regex_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "events").select(F.concat(F.lit("id="), F.col("event_id"), F.lit(" "), F.col("props")).alias("line"))
    found = readers.log_lines(lines, "line", {"event_id": (r"^id=(\d+)", "long"), "k": (r'"k": (\d+)', "int")})
    return found.where("k IS NOT NULL")


@query("""
WITH t AS (SELECT user_id, value, quantile_cont(value, 0.5) OVER (PARTITION BY user_id) med FROM events)
SELECT user_id, count(*) AS kept FROM t WHERE value <= 2 * med GROUP BY user_id""")
def f1f_norm_by_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    med = e.groupBy("user_id").agg(F.expr("percentile(value, 0.5)").alias("med"))
    return e.join(med, "user_id").where("value <= 2 * med").groupBy("user_id").agg(F.count(F.lit(1)).alias("kept"))


@query("""
WITH s AS (SELECT l_partkey part, count(*) fires, max(l_quantity) top FROM lineitem GROUP BY l_partkey)
SELECT part, fires, top::DOUBLE AS top FROM s WHERE fires > 0 AND top > 49""")
def f5_live_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("part")).agg(F.count(F.lit(1)).alias("fires"), F.max("l_quantity").cast("double").alias("top"))
    return s.where("fires > 0 AND top > 49")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_quantity > 45 AND l_linenumber >= 3")
def f6_candidate_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").where("l_quantity > 45 AND l_linenumber >= 3").select("l_orderkey", "l_linenumber", "l_partkey")


@query("""
WITH p AS (SELECT l_orderkey, list(l_quantity ORDER BY l_linenumber, l_quantity) a FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, list_position(a, list_max(a)) = len(a) AS last, list_position(a, list_max(a)) >= len(a) - 1 AS last2 FROM p""")
def f9_end_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity"))), lambda s: s["l_quantity"]).alias("a")
    p = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(a)
    at = F.array_position("a", F.array_max("a"))
    return p.select("l_orderkey", (at == F.size("a")).alias("last"), (at >= F.size("a") - 1).alias("last2"))


@query("""
WITH m AS (SELECT l_orderkey, l_partkey % 3 member, max(l_quantity) FILTER (l_linenumber <= 2) tail, max(l_quantity) top FROM lineitem GROUP BY ALL)
SELECT l_orderkey, bool_and(coalesce(tail = top, false)) AS all_anchored, bool_and(coalesce(tail > 10, false)) AS all_fire FROM m GROUP BY l_orderkey""")
def f10_member_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    m = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", (F.col("l_partkey") % 3).alias("member")).agg(F.max(F.when(F.col("l_linenumber") <= 2, q)).alias("tail"), F.max(q).alias("top"))
    ok = lambda c: F.bool_and(F.coalesce(c, F.lit(False)))
    return m.groupBy("l_orderkey").agg(ok(F.col("tail") == F.col("top")).alias("all_anchored"), ok(F.col("tail") > 10).alias("all_fire"))


@query("SELECT d.doc_id FROM documents d JOIN labels l USING (doc_id) WHERE lang = 'en' AND l.toxic = 0")
def f11_language_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").where("lang = 'en'"), table(spark, sf_dir, "labels").where("toxic = 0")
    return docs.join(labels.select("doc_id"), "doc_id").select("doc_id")


@query("SELECT event_id FROM events WHERE value >= 20 AND value / 100 >= 0.3 AND user_id % 5 <> 0")
def f12_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gates on two floors and a flag."""
    return table(spark, sf_dir, "events").where((F.col("value") >= 20) & (F.col("value") / 100 >= 0.3) & (F.col("user_id") % 5 != 0)).select("event_id")


@query("SELECT doc_id, CASE WHEN n_chars < 500 THEN 'early' WHEN n_chars < 2000 THEN 'mid' ELSE 'long' END AS bucket FROM documents")
def f15_position_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars")
    return table(spark, sf_dir, "documents").select("doc_id", F.when(n < 500, "early").when(n < 2000, "mid").otherwise("long").alias("bucket"))


@query("SELECT conv_id, turn FROM conversations WHERE contains(lower(text), 'error') OR contains(lower(text), 'the ')")
def f16_retryable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where(F.lower("text").rlike("error|the ")).select("conv_id", "turn")


@query("""
WITH t AS (SELECT l_partkey part, max(l_quantity) top FROM lineitem GROUP BY l_partkey)
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem JOIN t ON l_partkey = part WHERE l_quantity >= 0.95 * top AND l_linenumber >= 4""")
def f17_usable_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    top = li.groupBy("l_partkey").agg(F.max("l_quantity").alias("top"))
    return li.join(top, "l_partkey").where("l_quantity >= 0.95 * top AND l_linenumber >= 4").select("l_orderkey", "l_linenumber", "l_partkey")


@query("""
WITH f AS (SELECT l_partkey part, count(*) / (SELECT count(DISTINCT l_orderkey) FROM lineitem) r, max(l_extendedprice)::DOUBLE w FROM lineitem GROUP BY l_partkey),
p AS (SELECT quantile_cont(w, 0.25) p25 FROM f)
SELECT CASE WHEN r < 0.001 THEN 0 WHEN r < 0.0015 THEN 1 WHEN r < 0.002 THEN 2 WHEN r < 0.003 THEN 3 ELSE 4 END AS band, count(*) AS n, count(*) FILTER (w >= p25) AS sparse FROM f, p GROUP BY band""")
def f18_frequency_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    total = li.select("l_orderkey").distinct().count()
    f = li.groupBy("l_partkey").agg((F.count(F.lit(1)) / total).alias("r"), F.max("l_extendedprice").cast("double").alias("w"))
    r = F.col("r")
    band = F.when(r < 0.001, 0).when(r < 0.0015, 1).when(r < 0.002, 2).when(r < 0.003, 3).otherwise(4)
    p25 = f.agg(F.expr("percentile(w, 0.25)").alias("p25"))
    return f.crossJoin(F.broadcast(p25)).groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("w") >= F.col("p25")).alias("sparse"))


@query("SELECT vec_id, label FROM embeddings ORDER BY md5('7:' || vec_id), vec_id LIMIT 64")
def t1_seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.sample(table(spark, sf_dir, "embeddings"), 7, "vec_id", 64).select("vec_id", "label")


@query("SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY md5('7:' || vec_id), vec_id) AS rank FROM embeddings QUALIFY rank <= 6")
def t2_family_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.sample_by(table(spark, sf_dir, "embeddings"), "label", 7, "vec_id", 6, "rank").select("label", "vec_id", "rank")


@query("""
WITH t AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) r FROM embeddings)
SELECT label, vec_id FROM t WHERE r <= 20 QUALIFY row_number() OVER (PARTITION BY label ORDER BY md5('2:' || vec_id), vec_id) <= 5""")
def t3_tail_then_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = select.first_n(table(spark, sf_dir, "embeddings").select("label", "vec_id"), ["label"], [F.desc("vec_id")], 20)
    return select.sample_by(tail, "label", 2, "vec_id", 5)


@query("SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM embeddings ORDER BY md5('7:' || vec_id), vec_id LIMIT 400)")
def t4_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id")
    return e.join(select.sample(e, 7, "vec_id", 400), "vec_id", "left_anti")


@query("""
WITH g AS (SELECT DISTINCT source FROM documents), r AS (SELECT source, row_number() OVER (ORDER BY md5('5:' || source), source) n, count(*) OVER () c FROM g)
SELECT doc_id, source, n <= greatest(1, floor(c * 0.2)) AS held_out FROM documents JOIN r USING (source)""")
def t5_group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.split_groups(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", 5, 0.2)


@query("SELECT doc_id FROM documents, (SELECT count(*) n FROM documents) WHERE doc_id >= ceil(0.95 * n)")
def t6_positional_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id")
    n = d.agg(F.ceil(F.lit(0.95) * F.count(F.lit(1))).alias("edge"))
    return d.join(F.broadcast(n), F.col("doc_id") >= F.col("edge")).select("doc_id")


@query("""
WITH s AS (SELECT source, count(*) w FROM documents GROUP BY source),
e AS (SELECT source, w, w * 777.0::DOUBLE / sum(w) OVER () x FROM s), f AS (SELECT *, floor(x) q FROM e),
r AS (SELECT *, 777 - sum(q) OVER () rest, row_number() OVER (ORDER BY x - q DESC, source) n FROM f)
SELECT source, w, (q + (n <= rest)::INT)::BIGINT AS quota FROM r""")
def t7_largest_remainder(spark: SparkSession, sf_dir: str) -> DataFrame:
    strata = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("w"))
    return select.largest_remainder(strata, "w", 777, "source")


@query("""
WITH s AS (SELECT lang, count(*) w FROM documents GROUP BY lang), b AS (SELECT lang, w, least(w, 30) f FROM s),
t AS (SELECT *, (w - f) * (400 - sum(f) OVER ())::DOUBLE / sum(w - f) OVER () x FROM b), q AS (SELECT *, floor(x) k FROM t),
r AS (SELECT *, 400 - sum(f) OVER () - sum(k) OVER () rest, row_number() OVER (ORDER BY x - k DESC, lang) n FROM q)
SELECT lang, (f + k + (n <= rest)::INT)::BIGINT AS quota FROM r""")
def t8_allocation_with_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A floor for every stratum first, the rest in proportion to what is left of each."""
    s = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("w")).withColumn("f", F.least("w", F.lit(30)))
    rest = 400 - s.agg(F.sum("f")).first()[0]
    more = select.largest_remainder(s.withColumn("left", F.col("w") - F.col("f")), "left", rest, "lang")
    return more.select("lang", (F.col("f") + F.col("quota")).alias("quota"))


@query("""
WITH d AS (SELECT l_partkey, l_orderkey, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) - 1 depth, l_linenumber FROM lineitem WHERE l_quantity > 40)
SELECT l_partkey, l_orderkey, depth FROM d WHERE depth < 3 ORDER BY depth, md5('6:' || l_partkey || ':' || (l_orderkey * 8 + l_linenumber)), l_partkey LIMIT 3000""")
def t9_breadth_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").where("l_quantity > 40").select("l_partkey", "l_orderkey", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("rank"))
    return select.breadth_first(li, "l_partkey", "rank", 6, 3000, 3).select("l_partkey", "l_orderkey", "depth")


@query()
def t10_level_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy; tests hold it against a plain loop."""
    li = table(spark, sf_dir, "lineitem").where("l_quantity > 45")
    rows = li.groupBy((F.col("l_partkey") % 200).alias("block"), (F.col("l_orderkey") % 400).alias("doc")).agg(F.min("l_linenumber").cast("long").alias("rank"))
    return select.level_capacity(select.first_n(rows, ["block", "rank"], [F.col("doc")], 1), "block", "rank", "doc", 8, 3, 2)


@query()
def t11_topped_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half as many rows as there are parts, two a part and three an order, all of discount above 0.02: broken
    rows are dropped and their room is filled, with the orders of a second and third wave where
    the first leave a shortfall of over 2 %. Tests hold it against a plain loop."""
    li = table(spark, sf_dir, "lineitem")
    rows = li.groupBy(F.col("l_partkey").alias("block"), F.col("l_orderkey").alias("doc")).agg(F.min("l_linenumber").cast("long").alias("line"), F.max(F.col("l_discount").cast("double")).alias("discount"))
    rows = rows.withColumn("rank", F.col("line") * 1_000_000_000 + F.col("doc")).withColumn("wave", F.pmod(F.col("doc"), F.lit(3)))
    want = max(1, rows.select("block").distinct().count() // 2)
    found, missing = select.topped_up(rows, "block", "rank", "doc", "wave", F.col("discount") > 0.02, seed=8, levels=2, doc_cap=3, rows=want, tolerance=0.02)
    return found.select("block", "doc", "line", "wave", "topped_up", F.lit(missing).alias("shortfall"))


@query("""
WITH a AS (SELECT DISTINCT l_orderkey anchor, l_suppkey block FROM lineitem WHERE l_quantity >= 40)
SELECT anchor, block FROM a QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY md5('12:' || anchor || ':' || block), block) = 1""")
def t12_random_active_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "lineitem").where("l_quantity >= 40").select(F.col("l_orderkey").alias("anchor"), F.col("l_suppkey").alias("block")).distinct()
    return select.first_n(a, ["anchor"], [hkey(12, F.col("anchor"), F.col("block")), F.col("block")], 1)


@query("""
WITH m AS (SELECT l_suppkey block, l_orderkey, l_linenumber, l_extendedprice::DOUBLE g, count(*) OVER (PARTITION BY l_suppkey) n FROM lineitem WHERE l_discount >= 0.09)
SELECT block, l_orderkey, l_linenumber FROM m WHERE n >= 20 QUALIFY row_number() OVER (PARTITION BY block ORDER BY g DESC, l_orderkey, l_linenumber) <= 8""")
def t13_top_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "lineitem").where("l_discount >= 0.09").select(F.col("l_suppkey").alias("block"), "l_orderkey", "l_linenumber", "l_extendedprice")
    large = m.groupBy("block").agg(F.count(F.lit(1)).alias("n")).where("n >= 20").select("block")
    top = select.first_n(m, ["block"], [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")], 8)
    return top.join(large, "block").select("block", "l_orderkey", "l_linenumber")


@query("SELECT source, doc_id FROM documents WHERE n_chars >= 800 QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5('13:' || doc_id), doc_id) <= 10")
def t14_quota_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter, then a quota (or a cap) in each group; one pass needs no oversampling."""
    return select.sample_by(table(spark, sf_dir, "documents").where("n_chars >= 800").select("source", "doc_id"), "source", 13, "doc_id", 10)


@query("""
WITH p AS (SELECT doc_id, unnest(range(0, 12)) pos FROM documents)
SELECT doc_id, pos FROM p QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY md5('14:' || doc_id || ':' || pos), pos) <= 3""")
def t16_positions_per_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(11).cast("long"))).alias("pos"))
    return select.first_n(p, ["doc_id"], [hkey(14, F.col("doc_id"), F.col("pos")), F.col("pos")], 3)


@query("""
WITH o AS (SELECT l_suppkey unit, l_orderkey win, l_partkey tok, l_quantity::DOUBLE q FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_orderkey ORDER BY l_quantity DESC, l_partkey, l_linenumber) = 1)
SELECT unit, win, tok, q FROM o QUALIFY row_number() OVER (PARTITION BY unit ORDER BY q DESC, win) <= 5""")
def t17_distinct_window_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("unit"), F.col("l_orderkey").alias("win"), F.col("l_partkey").alias("tok"), F.col("l_quantity").cast("double").alias("q"), "l_linenumber")
    one = select.first_n(li, ["unit", "win"], [F.desc("q"), F.col("tok"), F.col("l_linenumber")], 1)
    return select.first_n(one, ["unit"], [F.desc("q"), F.col("win")], 5).select("unit", "win", "tok", "q")


@query("SELECT vec_id, row_number() OVER (ORDER BY md5('21:' || vec_id), vec_id) - 1 AS new_idx FROM embeddings")
def t18_global_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range-partitioned sort by key; new ids are the partition's offset and the place in it,
    so that no task sees all rows."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", hkey(21, F.col("vec_id")).alias("k"))
    bucket = F.conv(F.substring("k", 1, 3), 16, 10).cast("int")
    b = e.withColumn("b", bucket)
    sizes = b.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    offsets = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("b", "before")
    place = F.row_number().over(Window.partitionBy("b").orderBy("k", "vec_id")) - 1
    return b.withColumn("place", place).join(F.broadcast(offsets), "b").select("vec_id", (F.col("before") + F.col("place")).alias("new_idx"))


@query("""
WITH m AS (SELECT user_id, greatest(0.98 * max(value), 50) strict FROM events GROUP BY user_id), t AS (SELECT e.user_id, event_id, value, strict FROM events e JOIN m USING (user_id)),
s AS (SELECT user_id, count(*) FILTER (value >= strict) < 4 AS relaxed FROM t GROUP BY user_id),
c AS (SELECT t.user_id, relaxed, event_id, CASE WHEN value >= CASE WHEN relaxed THEN 50 ELSE strict END THEN 'pos' WHEN value < 5 THEN 'neg' END side FROM t JOIN s USING (user_id))
SELECT user_id, side, event_id, relaxed FROM c WHERE side IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id, side ORDER BY md5('15:' || event_id), event_id) <= 4""")
def t19_firing_and_not(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four draws near the peak, or where there are fewer, four that fire at all, so flagged; and four that do not."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    peak = e.groupBy("user_id").agg(F.greatest(0.98 * F.max("value"), F.lit(50.0)).alias("strict"))
    t = e.join(peak, "user_id")
    near = t.groupBy("user_id").agg((F.count_if(F.col("value") >= F.col("strict")) < 4).alias("relaxed"))
    floor = F.when(F.col("relaxed"), F.lit(50.0)).otherwise(F.col("strict"))
    side = F.when(F.col("value") >= floor, "pos").when(F.col("value") < 5, "neg")
    c = t.join(near, "user_id").select("user_id", side.alias("side"), "event_id", "relaxed").where("side IS NOT NULL")
    return select.first_n(c, ["user_id", "side"], [hkey(15, F.col("event_id")), F.col("event_id")], 4)


@query("SELECT user_id, event_id, round(value, 4) AS act FROM events WHERE value >= 20 AND value < 30 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) <= 3")
def t20_near_miss_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("value >= 20 AND value < 30").select("user_id", "event_id", "value")
    return select.first_n(e, ["user_id"], [F.desc("value"), F.col("event_id")], 3).select("user_id", "event_id", F.round("value", 4).alias("act"))


#: Every row's next start, and the walk over them; {0} has i, doc_id, n and nxt.
_RUNS = """
WITH RECURSIVE {0},
s(i, run) AS (SELECT 0::BIGINT, 0::BIGINT UNION ALL SELECT t.nxt, s.run + 1 FROM s JOIN t ON t.i = s.i WHERE t.nxt IN (SELECT i FROM t))
SELECT doc_id, n, (SELECT max(run) FROM s WHERE s.i <= t.i) AS {1} FROM t"""


@query(_RUNS.format("t AS (SELECT row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 i, doc_id, n_chars n, i + greatest(1, least(16, CASE WHEN n_chars > 0 THEN 20000 // n_chars ELSE 16 END)) nxt FROM documents)", "batch"))
def t21_budget_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table by falling length: rows times the longest within 20000, 16 rows at most."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("long").alias("n"))
    return packing.batch(docs, [F.col("doc_id")], "n", 20_000, 16)


@query(_RUNS.format("""p AS (SELECT row_number() OVER o - 1 i, doc_id, n_chars n, sum(n_chars) OVER (o ROWS UNBOUNDED PRECEDING) c FROM documents WHERE n_chars <= 8000 WINDOW o AS (ORDER BY md5('3:' || doc_id), doc_id)),
t AS (SELECT a.i, a.doc_id, a.n, b.i nxt FROM p a ASOF LEFT JOIN p b ON a.c - a.n + 8000 < b.c)""", "bin"))
def t22_next_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table in a seeded order, packed into bins of 8000; longer rows go."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("long").alias("n"))
    return packing.pack(docs, [hkey(3, F.col("doc_id")), F.col("doc_id")], "n", 8_000)


@query("""
WITH r AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars, doc_id) - 1 n FROM documents)
SELECT n // 32 AS micro_batch, count(*) AS rows, max(n_chars) - min(n_chars) AS spread FROM r GROUP BY micro_batch""")
def t23_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by length, cut into micro-batches: ranks come from counts by length, then the place in it."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("long").alias("n_chars"))
    sizes = d.groupBy("n_chars").agg(F.count(F.lit(1)).alias("c"))
    # Lengths are summed up within 4096 of them, and those sums then.
    sizes = sizes.withColumn("b", F.floor(F.col("n_chars") / 4096))
    up = lambda by, *keys: Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    whole = sizes.groupBy("b").agg(F.sum("c").alias("s")).select("b", F.coalesce(F.sum("s").over(up("b", F.lit(0))), F.lit(0)).alias("o"))
    part = sizes.withColumn("p", F.coalesce(F.sum("c").over(up("n_chars", "b")), F.lit(0)))
    before = part.join(whole, "b").select("n_chars", (F.col("o") + F.col("p")).alias("before"))
    r = d.join(before, "n_chars").withColumn("n", F.col("before") + F.row_number().over(Window.partitionBy("n_chars").orderBy("doc_id")) - 1)
    return r.groupBy(F.floor(F.col("n") / 32).alias("micro_batch")).agg(F.count(F.lit(1)).alias("rows"), (F.max("n_chars") - F.min("n_chars")).alias("spread"))


@query("""
WITH r AS (SELECT vec_id i, label set_name FROM embeddings)
SELECT i, set_name, i % 3 AS rank, (row_number() OVER (PARTITION BY i % 3, set_name ORDER BY i) - 1) // 8 AS chunk, 1000 + i AS seed FROM r""")
def t24_eval_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("i"), F.col("label").alias("set_name")).withColumn("rank", F.col("i") % 3)
    n = F.row_number().over(Window.partitionBy("rank", "set_name").orderBy("i")) - 1
    return r.withColumn("chunk", F.floor(n / 8)).withColumn("seed", F.col("i") + 1000)


@query("SELECT max(user_id) AS pending FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE value > 99.5)")
def t25_latest_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.join(e.where("value > 99.5").select("user_id").distinct(), "user_id", "left_anti").agg(F.max("user_id").alias("pending"))


@query("SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM embeddings WHERE label = 3) ORDER BY md5('16:' || vec_id), vec_id LIMIT 40")
def t26_sample_with_drop_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    return select.sample(e.join(e.where("label = 3").select("vec_id"), "vec_id", "left_anti"), 16, "vec_id", 40).select("vec_id")


@query("""
WITH r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('17:' || vec_id), vec_id) n FROM embeddings)
SELECT vec_id, label FROM r ORDER BY n, label LIMIT 15""")
def t27_diverse_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = select.sample_by(table(spark, sf_dir, "embeddings"), "label", 17, "vec_id", 15, "n")
    return r.orderBy("n", "label").limit(15).select("vec_id", "label")


@query("""
WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) - 1 i, count(*) OVER (PARTITION BY user_id) n FROM events)
SELECT user_id, max(event_id) FILTER (i = 0) AS best, max(event_id) FILTER (i = n // 2) AS median FROM r GROUP BY user_id""")
def t28_best_and_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id")
    r = table(spark, sf_dir, "events").withColumn("i", F.row_number().over(w.orderBy(F.desc("value"), "event_id")) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    pick = lambda at: F.max(F.when(F.col("i") == at, F.col("event_id")))
    return r.groupBy("user_id").agg(pick(F.lit(0)).alias("best"), pick(F.floor(F.col("n") / 2)).alias("median"))


@query("""
WITH s AS (SELECT vec_id, unnest(range(0, 256, 64)) off FROM embeddings)
SELECT vec_id, off FROM s ORDER BY md5('18:' || vec_id || ':' || off), vec_id, off LIMIT 100""")
def t29_window_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "embeddings").select("vec_id", F.explode(F.array(*[F.lit(i).cast("long") for i in range(0, 256, 64)])).alias("off"))
    return s.orderBy(hkey(18, F.col("vec_id"), F.col("off")), "vec_id", "off").limit(100)


@query("""
WITH p AS (SELECT p_partkey, CASE WHEN p_size < 10 THEN 0 WHEN p_size < 30 THEN 1 ELSE 2 END tier FROM part)
SELECT p_partkey, tier FROM p ORDER BY tier, md5('19:' || p_partkey), p_partkey LIMIT 600""")
def t30_tiered_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    tier = F.when(F.col("p_size") < 10, 0).when(F.col("p_size") < 30, 1).otherwise(2)
    return table(spark, sf_dir, "part").select("p_partkey", tier.alias("tier")).orderBy("tier", hkey(19, F.col("p_partkey")), "p_partkey").limit(600)


@query("""
WITH d AS (SELECT l_partkey, l_suppkey, max(l_quantity) q FROM lineitem WHERE l_quantity > 5 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY q DESC, l_suppkey) - 1 i, count(*) OVER (PARTITION BY l_partkey) n FROM d)
SELECT l_partkey, l_suppkey, CASE WHEN i < 2 THEN 'describe' ELSE 'test' END AS part FROM r WHERE n >= 4 AND i < 4""")
def t31_eligible_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").where("l_quantity > 5").groupBy("l_partkey", "l_suppkey").agg(F.max("l_quantity").alias("q"))
    w = Window.partitionBy("l_partkey")
    r = d.withColumn("i", F.row_number().over(w.orderBy(F.desc("q"), "l_suppkey")) - 1).withColumn("n", F.count(F.lit(1)).over(w)).where("n >= 4 AND i < 4")
    return r.select("l_partkey", "l_suppkey", F.when(F.col("i") < 2, "describe").otherwise("test").alias("part"))


@query("SELECT n_chars AS len, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY n_chars")
def t33_length_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups of one length that a drain takes, longest first, one after another."""
    return table(spark, sf_dir, "documents").groupBy(F.col("n_chars").alias("len")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))
