"""Units that fire on the same tokens, two by two and three by three.

Events are rows (tok, unit), each at most once. Events without a token or a unit take no part; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Events of a token beyond which its units are dealt into blocks.
BLOCK_UNITS = 4096


def event_pairs(events: DataFrame, *, value: str | None = None, block: int = BLOCK_UNITS) -> DataFrame:
    """(tok, i, j): any two units of a token, i the lesser; with ``value`` also what i has there.

    The units of a token of more than ``block`` events are dealt into blocks by hash, and every two blocks meet
    under a key of their own, so that no task has all pairs of a token. Other tokens meet as they are.
    """
    kept = [value] if value else []
    events = events.where("tok IS NOT NULL AND unit IS NOT NULL").select("tok", "unit", *kept)
    hot = events.groupBy("tok").agg(F.ceil(F.count(F.lit(1)) / block).alias("_blocks")).where("_blocks > 1")
    cold = events.join(hot, "tok", "left_anti")
    few = cold.select("tok", F.col("unit").alias("i"), *kept).join(cold.select("tok", F.col("unit").alias("j")), "tok").where("i < j")
    dealt = events.join(hot, "tok").withColumn("_own", F.pmod(F.xxhash64("unit"), F.col("_blocks")))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1))
    left = dealt.select("tok", F.col("unit").alias("i"), *kept, F.col("_own").alias("_x"), every.alias("_y"))
    right = dealt.select("tok", F.col("unit").alias("j"), every.alias("_x"), F.col("_own").alias("_y"))
    names = ["tok", "i", "j", *kept]
    return few.select(names).union(left.join(right, ["tok", "_x", "_y"]).where("i < j").select(names))


def pair_counts(events: DataFrame, *, value: str | None = None, block: int = BLOCK_UNITS) -> DataFrame:
    """(i, j, C): tokens on which both units fire; with ``value`` also S, its sum at i. Counts combine before the shuffle."""
    sums = [F.sum(value).alias("S")] if value else []
    return event_pairs(events, value=value, block=block).groupBy("i", "j").agg(F.count(F.lit(1)).alias("C"), *sums)


def triangles(events: DataFrame, least: int, *, block: int = BLOCK_UNITS) -> DataFrame:
    """(i, j, k, n): tokens on which three units fire, of which any two fire together on ``least`` tokens or more.

    Pairs that are too rare go before two of them meet at their token and least unit, and the third edge is
    looked up, so a token's triples of rarely joined units are never made.
    """
    pairs = event_pairs(events, block=block)
    strong = pairs.groupBy("i", "j").agg(F.count(F.lit(1)).alias("C")).where(F.col("C") >= least).select("i", "j")
    edges = pairs.join(strong, ["i", "j"], "left_semi")
    third = edges.select("tok", "i", F.col("j").alias("k"))
    open_ = edges.join(third, ["tok", "i"]).where("j < k")
    closed = open_.join(strong.select(F.col("i").alias("j"), F.col("j").alias("k")), ["j", "k"], "left_semi")
    return closed.groupBy("i", "j", "k").agg(F.count(F.lit(1)).alias("n"))
