"""Building banks: raw and JSON readers, resumable shards, finalising, harvests, and norm filters."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from girasol.functions import text as tx
from girasol.functions import tokens
from girasol.functions import vec
from girasol.operators import bank, moments, select
from girasol.sources import raw, readers, sinks
from girasol.streaming import state

from .common import query, table
from .corpus import IDS


def _ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.token_ids(F.col("text")).alias("ids"))


@query("SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row, len(embedding) AS width, round(embedding[1]::DOUBLE, 6) AS head, round(embedding[64]::DOUBLE, 6) AS last FROM embeddings")
def s7_binary_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors written as raw 32-bit shards and read again in byte ranges, in the order of the shards."""
    path = state.scratch(spark, "vectors")
    raw.write_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", path)
    at = lambda i: F.round(F.get("embedding", F.lit(i)).cast("double"), 6)
    return raw.vectors(spark, path, 64, split_bytes=1 << 16).select("row", F.size("embedding").cast("long").alias("width"), at(0).alias("head"), at(63).alias("last"))


_ROWS_OF_FILES = "WITH r AS (SELECT row_number() OVER (ORDER BY source, doc_id) - 1 AS row, doc_id, length(text) AS chars FROM documents)"


def _lines(spark: SparkSession, sf_dir: str) -> str:
    """A folder of JSON lines: files of each source, in the order of doc_id."""
    path = state.scratch(spark, "lines")
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", F.to_json(F.struct("doc_id", "text")).alias("value"))
    docs.repartitionByRange("source", "doc_id").sortWithinPartitions("source", "doc_id").select("source", "value").write.partitionBy("source").text(path)
    return path


@query(_ROWS_OF_FILES + " SELECT row, doc_id, chars FROM r WHERE row IN (SELECT doc_id FROM labels)")
def s10_rows_by_line_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows out of many files of JSON lines by number: an index of offsets, then byte ranges only."""
    path = _lines(spark, sf_dir)
    wanted = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("row"))
    found = raw.lines_at(raw.line_index(spark, path, split_bytes=1 << 18), wanted, path)
    doc = F.from_json("line", "doc_id long, text string")
    return found.select("row", doc.alias("d")).select("row", "d.doc_id", F.length("d.text").cast("long").alias("chars"))


@query("""
WITH q AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 n FROM documents WHERE length(text) >= 1500 AND len(regexp_extract_all(text, '\\S+')) >= 100)
SELECT doc_id, source AS file, n // 16 AS turn, n % 16 AS slot FROM q""")
def s2_jsonl_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines in several files, some rows of them malformed and some files without a good one; long
    enough documents in turns of 16 a file."""
    path = state.scratch(spark, "jsonl")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    good = docs.select("source", F.to_json(F.struct("doc_id", "source", "text")).alias("value"))
    broken = docs.where("doc_id % 50 = 0").select("source", F.lit('{"doc_id": 1, "text": "cut').alias("value"))
    empty = spark.createDataFrame([("spent", "not json")], "source string, value string")
    good.union(broken).union(empty).write.partitionBy("source").text(path)
    found = readers.jsonl_documents(spark, path, "doc_id long, source string, text string", least_chars=1500, least_tokens=100)
    return readers.interleaved(found, "source", "doc_id", 16).select("doc_id", F.col("source").alias("file"), "turn", "slot")


@query("SELECT vec_id % 4 AS shard, count(*) AS kept, count(*) AS readable FROM embeddings GROUP BY shard")
def k3_resumed_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run that broke off after writing a shard but before its manifest row, and the run that
    resumes: each shard is committed once."""
    path = state.scratch(spark, "shards")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") % 4).alias("part"), "label", "embedding")
    sinks.commit_shards(rows.where("part < 2"), "part", "vec_id", path)
    rows.where("part = 2 AND vec_id % 3 = 0").withColumn("shard", F.col("part").cast("long")).write.mode("append").partitionBy("shard").parquet(f"{path}/data")
    manifest = sinks.commit_shards(rows, "part", "vec_id", path)
    found = sinks.committed(spark, path).groupBy("shard").agg(F.count(F.lit(1)).alias("readable"))
    return manifest.join(found, "shard").select("shard", "kept", "readable")


@query("WITH u AS (SELECT vec_id % 4 shard, vec_id, label FROM embeddings), b AS (SELECT *, md5('47:' || shard || ':' || vec_id) k FROM u) SELECT vec_id, label, row_number() OVER (ORDER BY ('0x' || k[1:6])::BIGINT % 256, k) - 1 AS vec_idx FROM b")
def k4_finalised_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All shards as one bank in a seeded order, checked for unit vectors."""
    rows = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 4).alias("shard"), "vec_id", "label", "embedding")
    return sinks.finalised(rows, "shard", "vec_id", "embedding", 47).select("vec_id", "label", "vec_idx")


@query("""
WITH d AS (SELECT generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding)::DOUBLE x FROM embeddings)
SELECT dim, round(avg(x), 6) AS mean, count(*) AS n FROM d GROUP BY dim""")
def k5_finalised_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of a store from its shards' sums; shards have to be of one width."""
    m = moments.vector_means(table(spark, sf_dir, "embeddings").withColumn("shard", F.col("vec_id") % 4), "embedding", "shard")
    wide = m.agg(F.max(F.size("mean")).alias("w"), F.min(F.size("mean")).alias("l"))
    checked = wide.select(F.assert_true(F.col("w") == F.col("l"), F.lit("shards differ in width")).alias("_ok"))
    flat = m.crossJoin(F.broadcast(checked)).where(F.col("_ok").isNull()).select("n", F.posexplode("mean").alias("dim", "x"))
    return flat.groupBy(F.col("dim").cast("long").alias("dim")).agg(F.round(F.sum(F.col("x") * F.col("n")) / F.sum("n"), 6).alias("mean"), F.sum("n").alias("n"))


@query("SELECT count(*) AS n, count(DISTINCT vec_id) AS ids, min(vec_id) AS lo, max(vec_id) AS hi, count(*) FILTER (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) BETWEEN 0.98 AND 1.02) AS units, 0 AS not_finite FROM embeddings")
def k11_verify_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published, read back from the files, and verified there."""
    path = state.scratch(spark, "bank")
    sinks.publish(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"), path)
    return bank.verify(spark.read.parquet(path), "vec_id", "embedding")


_CENTRED = """
WITH d AS (SELECT vec_id, generate_subscripts(embedding, 1) i, unnest(embedding)::DOUBLE x FROM embeddings), m AS (SELECT i, avg(x) m FROM d GROUP BY i),
c AS (SELECT vec_id, sqrt(sum((x - m) * (x - m))) n FROM d JOIN m USING (i) GROUP BY vec_id)"""


def _centred_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    mean = moments.vector_means(e.withColumn("one", F.lit(0)), "embedding", "one").select("mean")
    return e.crossJoin(F.broadcast(mean)).select("vec_id", vec.norm(vec.centred(F.col("embedding"), F.col("mean"))).alias("n"))


def _below(rows: DataFrame, median_of: DataFrame, cap: float, keep: Column) -> DataFrame:
    limit = median_of.agg((cap * F.expr("percentile(n, 0.5)")).alias("limit"))
    return rows.crossJoin(F.broadcast(limit)).where((F.col("n") <= F.col("limit")) & keep).select("vec_id", F.round("n", 6).alias("norm"))


@query(_CENTRED + " SELECT vec_id, round(n, 6) AS norm FROM c WHERE vec_id % 32 >= 16 AND n <= 1.02 * (SELECT median(n) FROM (SELECT n FROM c ORDER BY md5('64:' || vec_id), vec_id LIMIT 8000))")
def f1b_centred_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centred norms against a multiple of the median of 8000 presamples; places below 16 go (a row's place is its id modulo 32)."""
    n = _centred_norms(spark, sf_dir)
    return _below(n, select.sample(n, 64, "vec_id", 8000), 1.02, F.col("vec_id") % 32 >= 16)


@query(_CENTRED + " SELECT vec_id, round(n, 6) AS norm FROM c WHERE n > 1e-6 AND n <= 1.01 * (SELECT median(n) FROM (SELECT n FROM c ORDER BY md5('65:' || vec_id), vec_id LIMIT 20000))")
def f1c_centred_norm_with_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _centred_norms(spark, sf_dir)
    return _below(n, select.sample(n, 65, "vec_id", 20_000), 1.01, F.col("n") > 1e-6)


@query("WITH c AS (SELECT vec_id, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * (1 + vec_id % 7) n FROM embeddings) SELECT vec_id, round(n, 6) AS norm FROM c WHERE n <= 1.3 * (SELECT median(n) FROM (SELECT n FROM c ORDER BY vec_id LIMIT 256))")
def f1d_first_batch_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The median of the first 256 rows by id, frozen for all."""
    n = table(spark, sf_dir, "embeddings").select("vec_id", (vec.norm(F.col("embedding")) * (1 + F.col("vec_id") % 7)).alias("n"))
    return _below(n, n.orderBy("vec_id").limit(256), 1.3, F.lit(True))


@query()
def f8_ids_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 16 ids of whole texts, decoded and encoded again; tests hold the reasons against a loop."""
    import public_tokenizers

    return tokens.round_trips(table(spark, sf_dir, "documents"), "doc_id", F.col("text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query(f"""
WITH t AS (SELECT doc_id, {IDS} v, 8 + doc_id % 16 p, 1 + doc_id % 4 more FROM documents), l AS (SELECT * FROM t WHERE len(v) >= p + more + 1),
a AS (SELECT 'prefix' part, doc_id, p + more AS n, list_sum(v[1:p + more])::BIGINT total FROM l), w AS (SELECT 'window', doc_id, 8, list_sum(v[p - 6:p + 1])::BIGINT FROM l)
SELECT part, doc_id, n, total, copy FROM a, (SELECT unnest([0, 1]) AS copy) WHERE copy = 0 OR doc_id % 10 = 0 UNION ALL SELECT *, 0 FROM w""")
def u15_prefix_harvest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets from a document's start to one to four tokens past a place, windows that end at the place,
    and a second copy of probe rows."""
    p, more = (8 + F.col("doc_id") % 16).cast("int"), (1 + F.col("doc_id") % 4).cast("int")
    add = lambda v: F.aggregate(v, F.lit(0).cast("long"), lambda a, x: a + x)
    row = lambda part, v, copy: F.struct(F.lit(part).alias("part"), F.size(v).cast("long").alias("n"), add(v).alias("total"), F.lit(copy).alias("copy"))

    def harvest(prefix: Column) -> Column:
        window = tx.span(prefix, p, 8)
        both = F.array(row("prefix", prefix, 0), row("window", window, 0))
        return F.when(F.col("doc_id") % 10 == 0, F.concat(both, F.array(row("prefix", prefix, 1)))).otherwise(both)

    # A text is cut into tokens once; only those of the target, which holds the window, are hashed.
    rows = vec.bound(tx.tokens(F.col("text")), lambda t: F.when(F.size(t) >= p + more + 1, vec.bound(tx.numbers(F.slice(t, F.lit(1), p + more)), harvest)))
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(rows).alias("r")).select("r.part", "doc_id", "r.n", "r.total", "r.copy")


@query("""
WITH e AS (SELECT user_id, event_id, event_type, value, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) anchor FROM events),
r AS (SELECT CASE WHEN event_type = 'view' THEN 'realact' ELSE 'probe' END family, event_id, CASE WHEN event_type = 'view' THEN 'kept' WHEN anchor IS NULL THEN 'no_anchor' WHEN event_id - anchor > 2000 THEN 'far_anchor' WHEN value < 20 THEN 'weak' ELSE 'kept' END reason, coalesce(anchor, -1) a FROM e WHERE event_type IN ('view', 'click'))
SELECT family, reason, count(*) AS n, sum(a)::BIGINT AS anchors FROM r GROUP BY ALL""")
def u16_reanchored_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two families under one anchor rule: each probe takes the last realact row of its user as its
    anchor; what is dropped is counted by reason, in order of priority."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    view = F.col("event_type") == "view"
    e = e.withColumn("anchor", F.last(F.when(view, F.col("event_id")), True).over(Window.partitionBy("user_id").orderBy("event_id"))).where(F.col("event_type").isin("view", "click"))
    reason = F.when(view, "kept").when(F.col("anchor").isNull(), "no_anchor").when(F.col("event_id") - F.col("anchor") > 2000, "far_anchor").when(F.col("value") < 20, "weak").otherwise("kept")
    family = F.when(view, "realact").otherwise("probe")
    return e.groupBy(family.alias("family"), reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("anchor", F.lit(-1))).alias("anchors"))


@query()
def st5_replay_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tests hold the pools against a plain loop."""
    s = state.events_stream(spark, sf_dir).withColumn("pool", F.col("user_id") % 8)
    return state.run_to_end(state.replayed(s, "pool", "event_id", capacity=64, reuse=2, batch=16), "replayed", "append")


@query("""
WITH c AS (SELECT vec_id, embedding[1]::DOUBLE x FROM embeddings)
SELECT vec_id, 'call' AS stage, CASE WHEN x >= 0 THEN round(sqrt(x), 6) END AS value, CASE WHEN x < 0 THEN 'ValueError' END AS error FROM c
UNION ALL SELECT vec_id, 'then', round(sqrt(x) * 2, 6), NULL FROM c WHERE x >= 0""")
def st9_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A call for each row, one chained on it, failures as rows, all under a deadline."""
    import math

    calls = table(spark, sf_dir, "embeddings").select("vec_id", F.get("embedding", F.lit(0)).cast("double").alias("x"))
    out = state.fan_out(calls, "vec_id", "x", math.sqrt, seconds=600.0, then=lambda v: 2 * v)
    return out.select("vec_id", "stage", F.round("value", 6).alias("value"), "error")


class _Steps:
    """Rows until there are none: (part, item) of a generator that starts at ``first``."""

    def eval(self, first: int, count: int) -> Iterator[tuple[int, int]]:  # noqa: A003
        item = first
        for part in range(count):
            yield part, item
            item += part + 1


@query("SELECT vec_id, part, vec_id + part * (part + 1) // 2 AS item FROM embeddings, (SELECT unnest(range(0, 8)) AS part) WHERE part < vec_id % 8")
def h3_generator_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A generator as a table function, asked once a row."""
    spark.udtf.register("girasol_steps", F.udtf(_Steps, returnType="part long, item long"))
    table(spark, sf_dir, "embeddings").select("vec_id").createOrReplaceTempView("girasol_seeds")
    return spark.sql("SELECT s.vec_id, g.part, g.item FROM girasol_seeds s, LATERAL girasol_steps(s.vec_id, s.vec_id % 8) g")
