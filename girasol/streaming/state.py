"""Stateful operators: queue picks, pass-rate tracking, replay pools; and streams run to their end."""

from __future__ import annotations

import pickle
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from girasol.session import shared_folder


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of spark.checkpoint.dir."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: Rows of one slice of a stream's intake, while that makes no more than MOST_SLICES, and of one of its files.
SLICE_ROWS, MOST_SLICES, FILE_ROWS = 1_000_000, 16, 250_000
#: Keys of a stateful operator are dealt into so many buckets; a bucket's state is one value, and more partitions
#: than these would cost a micro-batch more than its rows.
BUCKETS, PARTITIONS = 512, 64


def sliced(df: DataFrame, by: str | Column, path: str, slices: int = 3) -> int:
    """Files one slice after another, each slice with an even range of the whole numbers ``by``: a source that reads
    as many files at a time as a slice has, which is what this returns, sees them in that order."""
    by = F.col(f"`{by}`") if isinstance(by, str) else by
    count, low, high = df.agg(F.count(F.lit(1)), F.min(by), F.max(by)).first()
    n = max(slices, min(-(-count // SLICE_ROWS), MOST_SLICES))
    files = max(1, -(-count // (n * FILE_ROWS)))
    of = F.expr(f"(cast(_slice AS decimal(38,0)) - {low or 0}) * {n} div {(high or 0) - (low or 0) + 1}").cast("int")
    # Parted in one pass, so that a slice's files read its own rows only.
    parted = f"{path}-parted"
    df.withColumn("_slice", by).withColumn("_slice", of).where("_slice IS NOT NULL").write.partitionBy("_slice").parquet(parted)
    # The writer makes no folder for a slice without rows.
    filled = {r[0] for r in df.sparkSession.read.parquet(parted).select("_slice").distinct().collect()} if count else set()
    for i in sorted(filled):
        rows = df.sparkSession.read.schema(df.schema).parquet(f"{parted}/_slice={i}")
        (rows.repartition(files, by) if files > 1 else rows.coalesce(1)).write.mode("append").parquet(path)
    if not filled:
        df.limit(0).coalesce(1).write.mode("append").parquet(path)
    return files


def events_stream(spark: SparkSession, sf_dir: str, slices_per_trigger: int = 1, *, columns: str = "*", by: str | Column = "event_id") -> DataFrame:
    """ST1, ST13: a bounded intake of several files in the order of ``by``; the offsets are the checkpoint's. Event
    time is a TIMESTAMP."""
    events, path = spark.read.parquet(f"{sf_dir}/events.parquet").select(*columns.split()), scratch(spark, "events")
    files = sliced(events, by, path)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", slices_per_trigger * files).parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in stream.columns else stream


def run_batches(
    stream: DataFrame, name: str, mode: str, change: Callable[[DataFrame], DataFrame], schema: T.StructType, *, at: str | None = None, partitions: int | None = None
) -> tuple[DataFrame, str]:
    """Process all that is available; what the sink holds by then, and the folder to go on with.

    ``change`` is applied to each micro-batch, which is then written under its number: a batch that is tried
    again replaces itself. Of complete results the last one counts. The stream's state is in ``partitions`` at
    most."""
    spark = stream.sparkSession
    at = at or scratch(spark, name)

    def sink(batch: DataFrame, number: int) -> None:
        change(batch).write.mode("overwrite").parquet(f"{at}/out/batch={number}")

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").foreachBatch(sink).trigger(availableNow=True)
    setting = "spark.sql.shuffle.partitions"
    own = spark.conf.get(setting)
    try:
        # A stream keeps the settings it begins with.
        spark.conf.set(setting, str(min(int(own), partitions or int(own))))
        q = writer.start()
    finally:
        spark.conf.set(setting, own)
    q.awaitTermination()
    held = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{at}/out")
    if mode == "complete":
        held = held.where(F.col("batch") == held.agg(F.max("batch")).first()[0])
    return held.select(*[f"`{f.name}`" for f in schema.fields]), at


def run_to_end(stream: DataFrame, name: str, mode: str, *, at: str | None = None, partitions: int | None = None) -> DataFrame:
    """What the sink holds when all that is available is processed."""
    return run_batches(stream, name, mode, lambda batch: batch, stream.schema, at=at, partitions=partitions)[0]


def pick_blocks(blocks: DataFrame, queue: str, name: str, step: str, n: int, *, drop_stale: bool) -> DataFrame:
    """ST2: the oldest n blocks of each queue, or the newest with older ones marked as stale; no
    rows for a queue of fewer than n. Column action: take or stale."""
    order = [F.desc(step), F.desc(name)] if drop_stale else [F.col(step), F.col(name)]
    w = Window.partitionBy(queue)
    ranked = blocks.withColumn("_r", F.row_number().over(w.orderBy(*order))).withColumn("_n", F.count(F.lit(1)).over(w)).where(F.col("_n") >= n)
    out = ranked.withColumn("action", F.when(F.col("_r") <= n, "take").otherwise("stale"))
    return (out if drop_stale else out.where("action = 'take'")).drop("_r", "_n")


def drop_solved(stream: DataFrame, key: str, order: str, passed: str, threshold: float, least: int) -> DataFrame:
    """ST4: (key, order, passes, visits) once a key's pass rate reaches the threshold after at
    least ``least`` visits; from then on the key is dropped for good. State: two counts a key, or
    none for one that is gone, by bucket of keys."""

    def step(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = pickle.loads(state.get[0]) if state.exists else {}
        rows = pd.concat(list(frames)).sort_values(order)
        found = []
        for k, at, ok in zip(rows[key].tolist(), rows[order].tolist(), rows[passed].tolist()):
            counts = held.get(k, (0, 0))
            if counts is None:
                continue
            good, seen = counts[0] + bool(ok), counts[1] + 1
            held[k] = good, seen
            if seen >= least and good / seen >= threshold:
                held[k] = None
                found.append((k, at, good, seen))
        state.update((pickle.dumps(held),))
        yield pd.DataFrame(found, columns=[key, order, "passes", "visits"])

    kind, out = stream.schema[key].dataType, f"{key} string, {order} {stream.schema[order].dataType.simpleString()}, passes long, visits long"
    # As text a key is exact in pandas, null or not.
    rows = stream.select(F.col(key).cast("string").alias(key), order, passed, F.pmod(F.xxhash64(key), F.lit(BUCKETS)).alias("_bucket"))
    met = rows.groupBy("_bucket").applyInPandasWithState(step, out, "held binary", "append", GroupStateTimeout.NoTimeout)
    return met.withColumn(key, F.col(key).cast(kind))


class ReplayPool:
    """ST5: slots of which each is drawn at most ``reuse`` times; refilled when fewer than
    max(batch, share x capacity) are drawable. ``source`` gives rows, or None at the end, after
    which spent slots are recycled."""

    def __init__(self, source: Callable[[], list | None], capacity: int, reuse: int, share: float = 0.5) -> None:
        self.source, self.capacity, self.reuse, self.share = source, capacity, reuse, share
        self.slots: list[list] = []
        self.waiting: list = []
        self.ended = False

    def _drawable(self) -> list[list]:
        return [s for s in self.slots if s[1] < self.reuse]

    def _refill(self) -> None:
        self.slots = self._drawable()
        while len(self.slots) < self.capacity:
            if not self.waiting:
                rows = None if self.ended else self.source()
                if rows is None:
                    self.ended = True
                    break
                self.waiting = list(rows)
                continue
            self.slots.append([self.waiting.pop(0), 0])

    def draw(self, n: int, order: Callable[[object, int], object]) -> list:
        """n rows by the least ``order(row, uses)``; fewer only if the pool holds fewer."""
        if len(self._drawable()) < max(n, self.share * self.capacity):
            spent = [s for s in self.slots if s[1] >= self.reuse]
            self._refill()
            if self.ended and len(self._drawable()) < n:
                self.slots += [[row, 0] for row, _ in spent]
        chosen = sorted(self._drawable(), key=lambda s: order(s[0], s[1]))[:n]
        for s in chosen:
            s[1] += 1
        return [s[0] for s in chosen]


def replayed(stream: DataFrame, pool: str, item: str, *, capacity: int, reuse: int, batch: int) -> DataFrame:
    """ST5 as a stateful stream: (pool, draw, item). Items of a pool fill its slots, in order;
    draws of ``batch`` items are made as long as items wait for a slot. State: the slots and what
    waits, at most ``capacity`` and one micro-batch."""

    def step(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, uses, waiting, draws = state.get if state.exists else ([], [], [], 0)
        slots = ReplayPool(lambda: None, capacity, reuse)
        slots.slots = [list(s) for s in zip(held, uses)]
        slots.waiting = list(waiting) + sorted(x for f in frames for x in f[item].tolist())
        out = []
        while slots.waiting and len(slots.waiting) + len(slots._drawable()) >= batch:
            out += [(keys[0], draws, x) for x in slots.draw(batch, lambda x, n: (n, x))]
            draws += 1
            slots.ended = False
        state.update(([s[0] for s in slots.slots], [s[1] for s in slots.slots], slots.waiting, draws))
        yield pd.DataFrame(out, columns=[pool, "draw", item])

    schema = f"{pool} {stream.schema[pool].dataType.simpleString()}, draw long, {item} long"
    return stream.select(pool, F.col(item).cast("long").alias(item)).groupBy(pool).applyInPandasWithState(step, schema, "items array<long>, uses array<long>, waiting array<long>, draws long", "append", GroupStateTimeout.NoTimeout)


def fan_out(calls: DataFrame, key: str, argument: str, call: Callable[[object], float], *, seconds: float, then: Callable[[float], float] | None = None, workers: int = 16) -> DataFrame:
    """ST9: (key, stage, value, error). ``call`` runs for each row, many at a time in each task,
    and ``then`` on its value; what is not there after ``seconds`` for a batch, or fails, is a row with
    the error's name. ``then`` is not tried on a failure."""
    from concurrent.futures import ThreadPoolExecutor

    kind = calls.schema[key].dataType.simpleString()

    def one(x: object) -> list[tuple[str, float | None, str | None]]:
        out: list[tuple[str, float | None, str | None]] = []
        for stage, f in (("call", call), ("then", then)):
            if f is None:
                break
            try:
                x = float(f(x))
                out.append((stage, x, None))
            except Exception as e:  # noqa: BLE001  failures are data here
                out.append((stage, None, type(e).__name__))
                break
        return out

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            pool = ThreadPoolExecutor(workers)
            began = time.monotonic()
            jobs = [(k, pool.submit(one, x)) for k, x in zip(f[key].tolist(), f[argument].tolist())]
            rows = []
            for k, job in jobs:
                try:
                    rows += [(k, *r) for r in job.result(max(0.0, seconds - (time.monotonic() - began)))]
                except TimeoutError:
                    rows.append((k, "call", None, "TimeoutError"))
            pool.shutdown(wait=False, cancel_futures=True)
            yield pd.DataFrame(rows, columns=[key, "stage", "value", "error"]).astype({"value": float})

    return calls.select(key, argument).mapInPandas(run, f"{key} {kind}, stage string, value double, error string")
