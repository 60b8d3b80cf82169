"""Requests that wait for all their shards, with a deadline in event time."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from girasol.streaming.state import BUCKETS

OUT = "req string, outcome string, at_ms long, shards long"


def rendezvous(stream: DataFrame, req: str, shard: str, ts: str, *, shards: int, limit_ms: int, keep_ms: int, delay: str) -> DataFrame:
    """(req, outcome, at_ms, shards) of a stream: scored, timeout, and a row for each late arrival.

    A request is scored by the row that brings its last shard, if that is within ``limit_ms`` of its first
    row; else it times out when the watermark passes that. Rows after the deadline are late. State, by bucket
    of requests: a request's first row, the shards seen, and a mark of the outcome that is forgotten
    ``keep_ms`` after the deadline. A bucket has one timer, for what is due next of its requests."""

    def step(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        bits, held = pickle.loads(state.get[0]) if state.exists else ({}, {})
        out = []
        arrived = [] if state.hasTimedOut else list(frames)
        if arrived:
            rows = pd.concat(arrived).sort_values(["ms", "shard"])
            for key, ms, name in zip(rows["req"].tolist(), rows["ms"].tolist(), rows["shard"].tolist()):
                first, seen, outcome = held.get(key, (ms, 0, None))
                if outcome == "scored":
                    continue
                if outcome is None:
                    first = min(first, ms)
                if outcome == "timeout" or ms > first + limit_ms:
                    out.append((key, "late", ms, seen.bit_count()))
                else:
                    seen |= bits.setdefault(name, 1 << len(bits))
                    if seen.bit_count() == shards:
                        outcome = "scored"
                        out.append((key, outcome, ms, shards))
                held[key] = first, seen, outcome
        mark, after = state.getCurrentWatermarkMs(), []
        for key, (first, seen, outcome) in list(held.items()):
            due = first + limit_ms
            if outcome is None and due <= mark:
                outcome = "timeout"
                out.append((key, outcome, due, seen.bit_count()))
                held[key] = first, seen, outcome
            if outcome is not None:
                due += keep_ms
            if due <= mark:
                del held[key]
            else:
                after.append(due)
        if held:
            state.update((pickle.dumps((bits, held)),))
            state.setTimeoutTimestamp(min(after))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["req", "outcome", "at_ms", "shards"])

    # As text a request is exact in pandas, null or not.
    rows = stream.withWatermark(ts, delay).select(
        ts, F.col(req).cast("string").alias("req"), F.col(shard).cast("string").alias("shard"), F.unix_millis(ts).alias("ms"),
        F.pmod(F.xxhash64(req), F.lit(BUCKETS)).alias("_bucket"),
    )
    met = rows.groupBy("_bucket").applyInPandasWithState(step, OUT, "held binary", "append", GroupStateTimeout.EventTimeTimeout)
    return met.withColumn("req", F.col("req").cast(stream.schema[req].dataType))
