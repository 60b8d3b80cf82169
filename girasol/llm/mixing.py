"""Sources mixed to target weights: every source is put in a random order and cut at its budget.

A document's place in its source's order is a hash of its id. Ranges of the hash are summed first, so a
place in words is the ranges before its own and the documents before it in the range: no source is
sorted in one task. What comes out is one row a source, the document where its budget ends; documents
then compare themselves with that row where they are read, and no text is moved.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from girasol.functions.keys import hkey

from .components import written

#: What counts as a word: anything between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Sources up to this number are broadcast with their cuts, some hundred bytes each.
BROADCAST_SOURCES = 50_000
KEY_BITS = 60
OWN = ("size", "source_size", "target", "taken", "is_cut")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _keyed(docs: DataFrame, keep: list[str], seed: int) -> DataFrame:
    kept = F.struct(*[F.col(f"`{c}`") for c in keep if c.lower() not in OWN])
    key = F.conv(F.substring(hkey(seed, F.col("doc_id")), 1, KEY_BITS // 4), 16, 10).cast("long")
    # Code point order with null last, and a key that is never null.
    source = F.when(F.col("source").isNull(), "t").otherwise(F.concat(F.lit("s"), F.col("source").cast("string")))
    return docs.select(kept.alias("kept"), source.alias("source"), key.alias("key"), F.col("doc_id"), n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("print"))


def weighted(sources: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """Adds weight: the weights in turn, along the order of ``source``."""
    dealt, _ = written(sources.repartitionByRange("source").withColumn("part", F.spark_partition_id()))
    counts = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("source")) - 1 + F.col("before")
    turn = F.pmod(place, F.lit(len(weights))).cast("int")
    return dealt.join(F.broadcast(before), "part").select(*sources.columns, F.get(F.array(*map(F.lit, weights)), turn).alias("weight"))


def targets(sources: DataFrame, share: float, most: float) -> DataFrame:
    """Adds target: ``share`` of all words by weight, none above ``most`` times source_size.

    A round shares what the capped sources leave among the others and caps those that it lifts too
    high; the level only rises, so a source that is capped stays so. A round is one aggregate.
    """
    cap = F.col("source_size") * F.lit(float(most))
    total, left_weight = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    budget = share * (total or 0)
    left, below = budget, left_weight or 0
    while below:
        capped = cap * F.lit(float(below)) <= F.col("weight") * F.lit(float(left))
        held, free = sources.agg(F.sum(F.when(capped, cap)), F.sum(F.when(~capped, F.col("weight")))).first()
        if (free or 0) == below:
            break
        left, below = budget - (held or 0.0), free or 0
    if not below:
        return sources.withColumn("target", cap)
    level = F.col("weight") * F.lit(float(left)) / F.lit(float(below))
    return sources.withColumn("target", F.least(cap, level))


def words_before(units: DataFrame, rows_per_range: int) -> DataFrame:
    """Adds before: the words of a source's units (source, key, doc_id, size, print, n) that come
    before this one in the order of key."""
    bits = min(30, max(0, math.ceil(math.log2(max(1, units.count() / rows_per_range)))))
    words = F.col("size") * F.col("n")
    ranged = units.withColumn("range", F.shiftright("key", KEY_BITS - bits))
    sums = ranged.groupBy("source", "range").agg(F.sum(words).alias("words"))
    ranges = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offset = sums.select("source", "range", F.coalesce(F.sum("words").over(ranges), F.lit(0)).alias("offset"))
    within = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size", "print").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("before", F.coalesce(F.sum(words).over(within), F.lit(0)))
    return placed.join(offset, ["source", "range"]).withColumn("before", F.col("before") + F.col("offset")).drop("range", "offset")


def mix_documents(
    docs: DataFrame, *, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2, seed: int = 13, keep: list[str] | None = None, rows_per_range: int = 8_192
) -> DataFrame:
    """``keep`` (doc_id) and size, source_size, target, taken, is_cut for each row of ``docs`` (doc_id,
    source, text).

    Sources have the weights in turn, by code point, null last, and share ``share`` of all words by
    them, none more than ``most`` times its own. A source gives whole epochs and then the first
    documents of its random order, to the word: the one where the budget ends (is_cut) gives its
    first words only. taken counts the words of all epochs.

    A null text has no words; a source without words has the target 0. Rows that repeat an id are
    documents of their own; of rows that repeat id and text, any may be the one that is cut. An empty
    table gives no rows. A kept column that is named like one of the results gives way to it.
    """
    keyed = _keyed(docs, keep or ["doc_id"], seed)
    units, _ = written(keyed.groupBy("source", "key", "doc_id", "size", "print").agg(F.count(F.lit(1)).alias("n")))
    sizes = units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    sources, _ = written(targets(weighted(sizes, weights), share, most))
    whole = F.floor("target")
    epochs = F.coalesce(F.floor(F.try_divide(whole, F.col("source_size"))), F.lit(0))
    sources = sources.withColumn("epochs", epochs).withColumn("rest", whole - F.col("epochs") * F.col("source_size"))
    here = words_before(units, rows_per_range).join(sources.select("source", "rest"), "source")
    ends = here.where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("size") * F.col("n")))
    ends = ends.select("source", F.struct("key", "doc_id", "size", "print").alias("end"), F.col("n").alias("copies"), (F.col("rest") - F.col("before")).alias("over"))
    cuts, _ = written(sources.join(ends, "source", "left").select("source", "source_size", "target", "epochs", "end", "copies", "over"))
    count, tied = cuts.agg(F.count(F.lit(1)), F.count_if(F.col("copies") > 1)).first()
    rows = keyed.join(F.broadcast(cuts) if count <= BROADCAST_SOURCES else cuts, "source").withColumn("at", F.struct("key", "doc_id", "size", "print"))
    is_end = F.coalesce(F.col("at").eqNullSafe(F.col("end")) & F.col("end").isNotNull(), F.lit(False))
    if not tied:
        return _taken(rows.withColumn("part", F.when(is_end, F.col("over")).otherwise(0)))
    ties = is_end & (F.col("copies") > 1)
    return _taken(rows.where(~ties).withColumn("part", F.when(is_end, F.col("over")).otherwise(0)).unionByName(_dealt(rows.where(ties))))


def _dealt(ties: DataFrame) -> DataFrame:
    """Adds part: equal rows of a source take what is over one after another. They are numbered by the
    task that read them and the place in it."""
    rows, _ = written(ties.withColumn("task", F.spark_partition_id()))
    counts = rows.groupBy("source", "task").agg(F.count(F.lit(1)).alias("rows"))
    tasks = Window.partitionBy("source").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    earlier = counts.select("source", "task", F.coalesce(F.sum("rows").over(tasks), F.lit(0)).alias("earlier"))
    place = F.row_number().over(Window.partitionBy("source", "task").orderBy("key")) - 1 + F.col("earlier")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("over") - place * F.col("size")))
    return rows.join(earlier, ["source", "task"]).withColumn("part", part).drop("task", "earlier")


def _taken(rows: DataFrame) -> DataFrame:
    more = F.when(F.col("at") < F.col("end"), F.col("size")).otherwise(F.col("part"))
    cut = (F.col("part") > 0) & (F.col("part") < F.col("size"))
    return rows.select("kept.*", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.coalesce(more, F.lit(0))).cast("long").alias("taken"), cut.alias("is_cut"))


def mixed_texts(mix: DataFrame, text: str = "text") -> DataFrame:
    """A row with epoch and text for each time that the mix takes a document of ``mix`` (mix_documents
    with the text kept). A text that is cut has its first words, with single spaces."""
    times = F.ceil(F.try_divide(F.col("taken"), F.col("size")))
    out = mix.where("taken > 0").withColumn("epoch", F.explode(F.sequence(F.lit(1), times.cast("int"))))
    left = F.col("taken") - (F.col("epoch") - 1).cast("long") * F.col("size")
    first = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lit(1), left.cast("int")), " ")
    return out.withColumn(text, F.when(left < F.col("size"), first).otherwise(F.col(text)))
