"""Text: windows, spans, hashes, normal forms, exact dedupe and leak guards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from girasol.functions import text as tx
from girasol.operators import leak, postings, select
from girasol.streaming.state import scratch

from .common import query, table

#: DuckDB: a document's token numbers, as text.token_ids has them.
IDS = "list_transform(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: (('0x' || md5(w)[1:8])::BIGINT % 65536)::INT)"


def _ids(spark: SparkSession, sf_dir: str, name: str = "documents", key: str = "doc_id") -> DataFrame:
    return table(spark, sf_dir, name).select(key, tx.token_ids(F.col("text")).alias("ids"))


@query("SELECT doc_id, length(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) AS chars, md5(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) AS form FROM documents")
def c1_normal_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = tx.normal_form(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(form).cast("long").alias("chars"), F.md5(form.cast("binary")).alias("form"))


@query("""
WITH t AS (SELECT doc_id, text, regexp_extract_all(lower(text), '[a-z0-9]+') w FROM documents)
SELECT doc_id, len(w) AS n, round(CASE WHEN len(w) < 4 THEN 1.0 ELSE len(list_distinct(w)) / len(w) END, 6) AS ttr, round(len(regexp_replace(text, '[ -~\\n]', '', 'g')) / greatest(len(text), 1), 6) AS non_ascii FROM t""")
def c2_type_token_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = tx.tokens(F.col("text"))
    other = F.length(F.regexp_replace("text", r"[ -~\n]", "")) / F.greatest(F.length("text"), F.lit(1))
    d = table(spark, sf_dir, "documents").select("doc_id", "text", w.alias("w"))
    return d.select("doc_id", F.size("w").cast("long").alias("n"), F.round(tx.type_token_ratio(F.col("w")), 6).alias("ttr"), F.round(other, 6).alias("non_ascii"))


@query("""
WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') w, text FROM documents),
r AS (SELECT doc_id, len(w) n, CASE WHEN len(w) < 4 THEN 1.0 ELSE len(list_distinct(w)) / len(w) END ttr, len(regexp_replace(text, '[ -~\\n]', '', 'g')) / greatest(len(text), 1) x FROM t)
SELECT doc_id, n <= 8 OR ttr < 0.3 AS rule_a, x > 0.3 OR (n >= 6 AND 1 - ttr > 0.5) OR n < 3 AS rule_b FROM r""")
def f14_degenerate_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both rules, side by side."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", tx.tokens(F.col("text")).alias("w"))
    r = d.select("doc_id", F.size("w").alias("n"), tx.type_token_ratio(F.col("w")).alias("ttr"), (F.length(F.regexp_replace("text", r"[ -~\n]", "")) / F.greatest(F.length("text"), F.lit(1))).alias("x"))
    n, ttr = F.col("n"), F.col("ttr")
    return r.select("doc_id", ((n <= 8) | (ttr < 0.3)).alias("rule_a"), ((F.col("x") > 0.3) | ((n >= 6) & (1 - ttr > 0.5)) | (n < 3)).alias("rule_b"))


@query("SELECT conv_id, turn, CASE WHEN regexp_matches(text, '[0-9]') THEN least(greatest(try_cast(regexp_extract(text, '[0-9]{1,9}', 0) AS INT), 0), 100) END AS score FROM conversations")
def c3_first_integer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.first_integer(F.col("text")).alias("score"))


@query("""SELECT event_id, len(v) AS n, v[1] AS head FROM (SELECT event_id, list_filter(['k' || json_extract_string(props, '$.k'), 'x', ''], lambda s: s <> '')[1:2] v FROM events)""")
def c4_json_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An array inside surrounding text, as strings that are not empty, at most two."""
    e = table(spark, sf_dir, "events")
    reply = F.concat(F.lit('Sure:\n```json\n["k'), F.get_json_object("props", "$.k"), F.lit('", "x", ""]\n```'))
    parsed = F.from_json(F.regexp_extract(reply, r"(?s)\[.*?\]", 0), "array<string>")
    v = F.slice(F.filter(parsed, lambda s: s != ""), 1, 2)
    return e.select("event_id", v.alias("v")).select("event_id", F.size("v").cast("long").alias("n"), F.get("v", F.lit(0)).alias("head"))


@query("""
WITH t AS (SELECT doc_id // 8 AS grp, list(text ORDER BY doc_id) FILTER (text IS NOT NULL) v FROM documents GROUP BY grp)
SELECT grp, list_aggregate(list_transform(v, lambda s, i: '[' || i || '] ' || s), 'string_agg', chr(10)) AS block FROM t""")
def c5_numbered_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts of eight documents each, numbered from 1."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").groupBy(F.floor(F.col("doc_id") / 8).alias("grp"))
    texts = docs.agg(F.sort_array(F.collect_list(F.struct("doc_id", "text"))).alias("v"))
    return texts.select("grp", F.array_join(F.transform("v", lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x["text"])), "\n").alias("block"))


@query("""
WITH t AS (SELECT doc_id, string_split(text, ' ') w FROM documents)
SELECT doc_id, concat_ws(' ', array_to_string(w[greatest(len(w)//2 - 3, 0) + 1:len(w)//2], ' '), '<<' || w[len(w)//2 + 1] || '>>') AS shown FROM t WHERE len(w) >= 8""")
def c6_marked_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").select("doc_id", F.split("text", " ").alias("w")).withColumn("m", F.floor(F.size("w") / 2).cast("int")).where(F.size("w") >= 8)
    before = F.array_join(F.slice("w", F.greatest(F.col("m") - 3, F.lit(0)) + 1, F.least(F.col("m"), F.lit(3))), " ")
    return t.select("doc_id", F.concat_ws(" ", before, F.concat(F.lit("<<"), F.get("w", F.col("m")), F.lit(">>"))).alias("shown"))


@query("SELECT conv_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS joined, count(*) AS turns FROM conversations WHERE text <> '' GROUP BY conv_id")
def c7_conversation_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of one conversation; its size is bounded by the conversation."""
    c = table(spark, sf_dir, "conversations").where("text <> ''")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    return c.groupBy("conv_id").agg(F.md5(F.array_join(parts, "\n\n").cast("binary")).alias("joined"), F.count(F.lit(1)).alias("turns"))


@query("SELECT doc_id, md5(left(text, 1200)) AS cut FROM documents")
def c8_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.substring("text", 1, 1200).cast("binary")).alias("cut"))


_LE = "list_aggregate(list_transform({0}, lambda x: lpad(to_hex(x & 255), 2, '0') || lpad(to_hex((x >> 8) & 255), 2, '0') || '0000'), 'string_agg', '')"


@query(f"WITH t AS (SELECT doc_id, {IDS}[1:16] v FROM documents) SELECT doc_id, sha1(from_hex({_LE.format('v')}))[1:16] AS hash FROM t WHERE len(v) > 0")
def c9_span_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _ids(spark, sf_dir).where(F.size("ids") > 0)
    return d.select("doc_id", tx.span_hash(F.slice("ids", 1, 16)).alias("hash"))


@query(f"WITH t AS (SELECT doc_id, {IDS} v FROM documents) SELECT doc_id, len(v[greatest(40 - 16 + 1, 0) + 1:41]) AS n, v[41] AS last FROM t WHERE len(v) > 40")
def c10_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _ids(spark, sf_dir).where(F.size("ids") > 40).select("doc_id", tx.span(F.col("ids"), F.lit(40), 16).alias("s"))
    return d.select("doc_id", F.size("s").cast("long").alias("n"), F.element_at("s", -1).alias("last"))


@query(f"""
WITH t AS (SELECT doc_id, {IDS} v FROM documents), w AS (SELECT doc_id, unnest(range(len(v) // 128)) i, v FROM t)
SELECT doc_id, i AS win, list_sum(v[i * 128 + 1:i * 128 + 128])::BIGINT AS total FROM w""")
def c11_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _ids(spark, sf_dir).select("doc_id", F.posexplode(tx.windows(F.col("ids"), 128)).alias("win", "w"))
    return w.select("doc_id", F.col("win").cast("long").alias("win"), F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query(f"""
WITH t AS (SELECT doc_id, {IDS} v FROM documents), w AS (SELECT doc_id, unnest(range((len(v) + 127) // 128)) i, v FROM t)
SELECT doc_id, i AS win, least(len(v) - i * 128, 128) AS n FROM w""")
def c11_windows_with_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _ids(spark, sf_dir).select("doc_id", F.posexplode(tx.windows(F.col("ids"), 128, keep_tail=True)).alias("win", "w"))
    return w.select("doc_id", F.col("win").cast("long").alias("win"), F.size("w").cast("long").alias("n"))


@query(f"SELECT doc_id, len(v) AS n_tokens FROM (SELECT doc_id, {IDS} v FROM documents) WHERE len(v) >= 128")
def f3_full_window_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ids(spark, sf_dir).where(F.size("ids") >= 128).select("doc_id", F.size("ids").cast("long").alias("n_tokens"))


@query("WITH t AS (SELECT doc_id, string_split(text, chr(10)) v FROM documents) SELECT doc_id, len(v) AS spans, len(list_filter(v, lambda s: length(regexp_replace(s, '^\\s+|\\s+$', '', 'g')) >= 3)) AS kept FROM t")
def f4_blank_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a text as spans; those with fewer than three characters between white space are blank."""
    t = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("v"))
    return t.select("doc_id", F.size("v").cast("long").alias("spans"), F.size(F.filter("v", lambda s: F.length(tx.strip(s)) >= 3)).cast("long").alias("kept"))


@query(f"WITH t AS (SELECT doc_id, {IDS} v FROM documents) SELECT doc_id, len(list_intersect(v[greatest(len(v) - 31, 1):], [1, 2, 3, 500, 900, 4242, 50000])) > 0 AS bad FROM t WHERE len(v) > 0")
def f7_special_tokens_in_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    special = F.array(*[F.lit(i) for i in (1, 2, 3, 500, 900, 4242, 50000)])
    last = F.slice("ids", F.greatest(F.size("ids") - 31, F.lit(1)), F.lit(32))
    return _ids(spark, sf_dir).where(F.size("ids") > 0).select("doc_id", F.arrays_overlap(last, special).alias("bad"))


@query("""
WITH t AS (SELECT doc_id, text s FROM documents), r AS (SELECT doc_id, s, array_to_string(regexp_extract_all(lower(s), '[a-z0-9]+'), ' ') back FROM t)
SELECT CASE WHEN regexp_matches(s, '[#$%&*]') THEN 'special_id_in_window' WHEN trim(s) = '' THEN 'blank' WHEN back <> lower(s) THEN 'roundtrip_fail' ELSE 'ok' END AS reason, count(*) AS n FROM r GROUP BY reason""")
def f8_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reject reasons in order of priority, counted; the tokenizer is the default word one."""
    t = table(spark, sf_dir, "documents").select(F.col("text").alias("s"))
    back = F.array_join(tx.tokens(F.col("s")), " ")
    reason = F.when(F.col("s").rlike("[#$%&*]"), "special_id_in_window").when(F.trim("s") == "", "blank").when(back != F.lower("s"), "roundtrip_fail").otherwise("ok")
    return t.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH d AS (SELECT doc_id, {IDS} v FROM documents), b AS (SELECT DISTINCT sha1(from_hex({_LE.format('v[1:8]')}))[1:16] hash FROM (SELECT {IDS} v FROM documents WHERE doc_id % 50 = 0) WHERE len(v) > 0),
s AS (SELECT doc_id, unnest(range(0, greatest(len(v), 1), 32)) o, v FROM d), h AS (SELECT doc_id, sha1(from_hex(coalesce({_LE.format('v[o + 1:o + 8]')}, '')))[1:16] hash FROM s)
SELECT doc_id FROM d WHERE doc_id NOT IN (SELECT doc_id FROM h JOIN b USING (hash))""")
def j5_hash_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _ids(spark, sf_dir)
    held = d.where("doc_id % 50 = 0 AND size(ids) > 0").select(tx.span_hash(F.slice("ids", 1, 8)).alias("hash")).distinct()
    return leak.hash_guard(d, held, "doc_id", "ids", 32, 8).select("doc_id")


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND (l.toxic = 1 OR l.quality = 0))")
def j4_id_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = table(spark, sf_dir, "labels").where("toxic = 1 OR quality = 0").select("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id").join(bad, "doc_id", "left_anti")


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM (SELECT doc_id FROM labels WHERE toxic = 1 UNION SELECT doc_id FROM documents WHERE n_chars < 100) x WHERE x.doc_id = d.doc_id)")
def j6_failure_list_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union of failure lists, without repeats."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    fails = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").union(docs.where("n_chars < 100").select("doc_id")).distinct()
    return docs.join(fails, "doc_id", "left_anti").select("doc_id")


_ASKED = f"(SELECT DISTINCT unnest({IDS}) FROM benchmark)"


def _index(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """The index of all documents' tokens, and the benchmark's tokens."""
    path = scratch(spark, "postings")
    postings.write_index(_ids(spark, sf_dir), "doc_id", F.col("ids"), path, buckets=64)
    return path, _ids(spark, sf_dir, "benchmark", "item_id").select(F.explode("ids").alias("tok"))


@query(f"WITH t AS (SELECT doc_id, unnest({IDS}) tok FROM documents) SELECT tok, count(*) AS n, min(doc_id) AS first_doc FROM t WHERE tok IN {_ASKED} GROUP BY tok")
def j13_occurrence_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the benchmark's tokens occur and where first, out of an index with places."""
    path, asked = _index(spark, sf_dir)
    return postings.counts(spark, path, asked)


@query(f"WITH t AS (SELECT doc_id AS doc, unnest({IDS}) tok, unnest(range(len({IDS}))) AS place FROM documents) SELECT tok, doc, place FROM t WHERE tok IN {_ASKED}")
def j13_occurrence_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All places of the benchmark's tokens, out of the same index."""
    path, asked = _index(spark, sf_dir)
    return postings.places(spark, path, asked)


@query("""
WITH f AS (SELECT conv_id, turn, lower(trim(text)) form FROM conversations)
SELECT f.conv_id, f.turn, coalesce(p.score, 50) AS score FROM f LEFT JOIN (SELECT form, max(length(form)) % 101 AS score FROM f WHERE conv_id % 2 = 0 GROUP BY form) p USING (form)""")
def j15_prior_result_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of identical prompts are reused; 50 where there is none."""
    f = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lower(F.trim("text")).alias("form"))
    prior = f.where("conv_id % 2 = 0").groupBy("form").agg((F.max(F.length("form")) % 101).alias("score"))
    return f.join(prior, "form", "left").select("conv_id", "turn", F.coalesce("score", F.lit(50)).alias("score"))


@query("""
WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source, text ORDER BY doc_id) n FROM documents)
SELECT doc_id, source FROM r WHERE n = 1""")
def w4_first_seen_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least id of each text and source; an aggregate, so copies combine before the shuffle."""
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy("source", F.xxhash64("text").alias("h1"), F.md5(F.col("text").cast("binary")).alias("h2")).agg(F.min("doc_id").alias("doc_id")).select("doc_id", "source")


@query("SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS within FROM documents QUALIFY within <= 20")
def w3_rank_within_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.first_n(table(spark, sf_dir, "documents").select("doc_id", "source"), ["source"], [F.col("doc_id")], 20, "within")


@query(f"""
WITH t AS (SELECT doc_id, {IDS} v FROM documents), p AS (SELECT doc_id, unnest(range(len(v))) pos, v FROM t)
SELECT doc_id, pos, least(pos + 1, 8) AS n, list_sum(v[greatest(pos - 7, 0) + 1:pos + 1])::BIGINT AS total FROM p""")
def w17_end_anchored_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window for every position; each row carries its own window alone."""
    each = F.transform("ids", lambda _, i: F.slice("ids", F.greatest(i - 6, F.lit(1)), F.least(i + 1, F.lit(8))))
    w = _ids(spark, sf_dir).select("doc_id", F.posexplode(each).alias("pos", "w")).withColumn("pos", F.col("pos").cast("long"))
    return w.select("doc_id", "pos", F.size("w").cast("long").alias("n"), F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query(f"WITH t AS (SELECT doc_id, {IDS} v FROM documents) SELECT doc_id, round(len(list_distinct(v)) / len(v), 6) AS distinct_share FROM t WHERE len(v) > 0")
def a41_distinct_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ids(spark, sf_dir).where(F.size("ids") > 0).select("doc_id", F.round(F.size(F.array_distinct("ids")) / F.size("ids"), 6).alias("distinct_share"))


@query(f"""
WITH t AS (SELECT doc_id, {IDS} v FROM documents), s AS (SELECT doc_id, v, list_position(v, list_max(v)) p FROM t WHERE len(v) > 0)
SELECT doc_id, CASE WHEN len(v) - p < 5 THEN len(v) ELSE p + 3 END AS kept FROM s WHERE CASE WHEN len(v) - p < 5 THEN len(v) ELSE p + 3 END >= 4""")
def c13_truncate_at_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole if the peak is among the last five, else up to three past it; short ones go."""
    s = _ids(spark, sf_dir).withColumnRenamed("ids", "v").where(F.size("v") > 0)
    p = F.array_position("v", F.array_max("v"))
    kept = F.when(F.size("v") - p < 5, F.size("v")).otherwise(p + 3).cast("long")
    return s.select("doc_id", kept.alias("kept")).where("kept >= 4")


@query(f"""
WITH t AS (SELECT doc_id, {IDS} v FROM documents), s AS (SELECT doc_id, v, coalesce(nullif(list_position(list_transform(v, lambda x: x % 16 = 0), true), 0), len(v)) e FROM t)
SELECT doc_id, e AS n, list_sum(list_transform(v[1:e], lambda x, i: CASE WHEN i <= 4 THEN -100 ELSE x END))::BIGINT AS label_sum FROM s WHERE len(v) > 0""")
def c15_stop_pad_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cut after the stop token; the first four labels are masked."""
    s = _ids(spark, sf_dir).withColumnRenamed("ids", "v").where(F.size("v") > 0)
    stop = F.array_position(F.transform("v", lambda x: x % 16 == 0), True)
    e = F.when(stop > 0, stop).otherwise(F.size("v")).cast("int")
    labels = F.transform(F.slice("v", F.lit(1), e), lambda x, i: F.when(i < 4, -100).otherwise(x))
    return s.select("doc_id", e.cast("long").alias("n"), F.aggregate(labels, F.lit(0).cast("long"), lambda a, x: a + x).alias("label_sum"))


@query("SELECT source, map_from_entries(list((lang, n) ORDER BY lang))::VARCHAR AS hist FROM (SELECT source, lang, count(*) n FROM documents GROUP BY ALL) GROUP BY source")
def c18_histogram_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    entries = F.array_sort(F.collect_list(F.struct("lang", "n")))
    shown = F.array_join(F.transform(entries, lambda x: F.concat(x["lang"], F.lit("="), x["n"])), ", ")
    return h.groupBy("source").agg(F.concat(F.lit("{"), shown, F.lit("}")).alias("hist"))


@query("SELECT role, round(sum(length(text) // 4 * 3e-6 + 40 * 15e-6), 6) AS cost FROM conversations GROUP BY role")
def c19_call_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.groupBy("role").agg(F.round(F.sum(F.floor(F.length("text") / 4) * 3e-6 + 40 * 15e-6), 6).alias("cost"))


@query("SELECT DISTINCT text_md5 FROM (SELECT md5(text) text_md5 FROM documents WHERE source IN ('src1', 'src2') INTERSECT SELECT md5(text) FROM documents WHERE source NOT IN ('src1', 'src2'))")
def u12_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("source", F.md5(F.col("text").cast("binary")).alias("text_md5"))
    here = F.col("source").isin("src1", "src2")
    return d.where(here).select("text_md5").intersect(d.where(~here).select("text_md5"))


@query("SELECT md5(text) AS text_md5 FROM documents WHERE lang = 'fr' EXCEPT SELECT md5(text) FROM documents WHERE lang <> 'fr' OR n_chars > 2000")
def u11_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("lang", "n_chars", F.md5(F.col("text").cast("binary")).alias("text_md5"))
    return d.where("lang = 'fr'").select("text_md5").subtract(d.where("lang <> 'fr' OR n_chars > 2000").select("text_md5"))


@query(f"""
WITH t AS (SELECT doc_id, len({IDS}) n FROM documents)
SELECT doc_id, doc_id // 4 AS pack, least(n, 64) AS len, sum(least(n, 64)) OVER (PARTITION BY doc_id // 4 ORDER BY doc_id) - least(n, 64) AS first_position FROM t""")
def p20_packed_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each example starts in its packed row; positions restart at 0 from there."""
    t = _ids(spark, sf_dir).select("doc_id", F.floor(F.col("doc_id") / 4).alias("pack"), F.least(F.size("ids"), F.lit(64)).cast("long").alias("len"))
    return t.withColumn("first_position", F.sum("len").over(Window.partitionBy("pack").orderBy("doc_id")) - F.col("len"))
