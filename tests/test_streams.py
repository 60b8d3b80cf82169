"""Streams over several files, with restarts and retries in between."""

from __future__ import annotations

import datetime as dt

import duckdb
from pyspark.sql import functions as F

from girasol.plans import ORACLE_SQL, QUERIES
from girasol.streaming import side, state, timed

BASE = dt.datetime(2024, 1, 1)


def stream_of(spark, path):
    return spark.readStream.schema("req long, shard string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(path)


def test_requests_are_scored_time_out_or_are_late(spark, tmp_path):
    path = str(tmp_path / "in")
    at = lambda m: BASE + dt.timedelta(minutes=m)
    files = [
        [(1, "a", at(0)), (1, "b", at(5)), (2, "a", at(1)), (3, "a", at(2)), (3, "a", at(3))],
        [(2, "b", at(9)), (3, "b", at(40)), (4, "a", at(50)), (4, "b", at(70))],
        [(1, "a", at(90)), (3, "b", at(95)), (5, "a", at(100)), (6, "b", at(100)), (6, "a", at(110))],
    ]
    folder, held = None, None
    for rows in files:
        spark.createDataFrame(rows, "req long, shard string, ts timestamp").coalesce(1).write.mode("append").parquet(path)
        # Each file is a run of its own: state and timers come back from the checkpoint.
        met = timed.rendezvous(stream_of(spark, path), "req", "shard", "ts", shards=2, limit_ms=15 * 60_000, keep_ms=600 * 60_000, delay="10 minutes")
        held, folder = state.run_batches(met, "met", "append", lambda b: b, met.schema, at=folder)
    ms = lambda m: int(at(m).replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
    got = sorted(map(tuple, held.collect()))
    assert got == [
        (1, "scored", ms(5), 2), (2, "scored", ms(9), 2), (3, "late", ms(40), 1), (3, "late", ms(95), 1), (3, "timeout", ms(17), 1),
        (4, "late", ms(70), 1), (4, "timeout", ms(65), 1), (6, "scored", ms(110), 2),
    ]


def test_the_side_table_is_read_anew_and_broken_versions_are_passed_over(spark, tmp_path):
    lists, path = str(tmp_path / "lists"), str(tmp_path / "in")
    folder, held = None, None
    for i in range(4):
        if i == 1:
            assert side.publish(spark.createDataFrame([(0,), (1,)], "k long"), lists) == 1
        if i == 2:
            assert side.publish(spark.createDataFrame([(2,), (None,)], "k long"), lists) == 2
        if i == 3:
            (tmp_path / "lists/version=3").mkdir()
            (tmp_path / "lists/version=3/part-0.parquet").write_bytes(b"half")
            assert side.versions(spark, lists) == [1, 2]
        spark.createDataFrame([(k, i) for k in (0, 1, 2, 3, None)], "k long, i int").coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema("k long, i int").parquet(path)
        held, folder = side.drop_listed(stream, lists, "k", "side", at=folder)
    got = {}
    for r in held.collect():
        got.setdefault((r.i, r.side_version), set()).add(r.k)
    assert got == {(0, 0): {0, 1, 2, 3, None}, (1, 1): {2, 3, None}, (2, 2): {0, 1, 3, None}, (3, 2): {0, 1, 3, None}}
    # The next version takes the place of the broken one.
    assert side.publish(spark.createDataFrame([(3,)], "k long"), lists) == 3 and side.versions(spark, lists) == [1, 2, 3]


def test_a_micro_batch_that_is_tried_again_replaces_itself(spark, tmp_path):
    path = str(tmp_path / "in")
    state.sliced(spark.range(90).withColumn("v", F.col("id") % 7), "id", path, 3)
    stream = spark.readStream.schema("id long, v long").option("maxFilesPerTrigger", 1).parquet(path)
    tries = []

    def once_more(batch):
        tries.append(1)
        if len(tries) == 2:
            # The rows are written and then the batch fails.
            batch.write.mode("overwrite").parquet(f"{tmp_path}/run/out/batch=1")
            raise RuntimeError("lost")
        return batch

    at = str(tmp_path / "run")
    try:
        state.run_batches(stream, "x", "append", once_more, stream.schema, at=at)
    except Exception as e:
        assert "lost" in str(e)
    held, _ = state.run_batches(stream, "x", "append", once_more, stream.schema, at=at)
    assert sorted(r.id for r in held.collect()) == list(range(90)) and len(tries) == 4


def test_slices_are_read_once_and_written_in_order(spark, tmp_path):
    df = spark.range(3000).select(F.when(F.col("id") == 9, None).otherwise(F.col("id") * 7 % 3000).alias("k"), F.lit("x").alias("v"))
    calls = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            calls.add(b.num_rows)
            yield b

    path = str(tmp_path / "in")
    state.sliced(df.mapInArrow(seen, df.schema), "k", path, 10)
    # Once for the range and once for the slices, however many these are.
    assert calls.value <= 2 * 3000
    files = sorted(((tmp_path / "in").glob("*.parquet")), key=lambda f: f.stat().st_mtime_ns)
    ranges = [sorted(r.k for r in spark.read.parquet(str(f)).collect()) for f in files]
    assert len(files) == 10 and sum(ranges, []) == [k for k in range(3000) if k != 63]
    state.sliced(df.where("false"), "k", str(tmp_path / "none"))
    assert spark.read.schema(df.schema).parquet(str(tmp_path / "none")).count() == 0


def test_large_slices_have_several_files_and_stay_in_order(spark, tmp_path, monkeypatch):
    for name, n in (("SLICE_ROWS", 100), ("MOST_SLICES", 4), ("FILE_ROWS", 50)):
        monkeypatch.setattr(state, name, n)
    df = spark.range(1000).withColumn("ts", F.timestamp_seconds(1_000_000 - F.col("id")))
    assert state.sliced(df, F.unix_micros("ts"), str(tmp_path / "in")) == 5
    files = sorted(((tmp_path / "in").glob("*.parquet")), key=lambda f: f.stat().st_mtime_ns)
    slices = [sorted(r.id for f in files[i : i + 5] for r in spark.read.parquet(str(f)).collect()) for i in range(0, 20, 5)]
    assert len(files) == 20 and slices == [list(range(i, i + 250)) for i in (750, 500, 250, 0)]


def test_requests_do_not_depend_on_the_order_of_ids(spark, sf_dir, tmp_path):
    # Copies with shifted ids: the time begins anew in each of them.
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    copies = [e.withColumns({"event_id": F.col("event_id") + i * 1_000_000, "user_id": F.col("user_id") + i * 10_000}) for i in range(3)]
    copies[0].union(copies[1]).union(copies[2]).write.parquet(f"{tmp_path}/events.parquet")
    got = QUERIES["st8_rendezvous"](spark, str(tmp_path))
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
        want = c.execute(f"SELECT req, outcome, at_ms, shards FROM ({ORACLE_SQL['st8_rendezvous']})").fetchall()
    assert sorted(map(tuple, got.select("req", "outcome", "at_ms", "shards").collect())) == sorted(want)


def test_requests_are_held_by_bucket(spark, tmp_path):
    path = str(tmp_path / "in")
    at = lambda m: BASE + dt.timedelta(minutes=m)
    for shard in "ab":
        rows = [(k if k else None, shard, at(k % 5 + (shard == "b") * k % 7)) for k in range(1500)]
        spark.createDataFrame(rows, "req long, shard string, ts timestamp").coalesce(1).write.mode("append").parquet(path)
    met = timed.rendezvous(stream_of(spark, path), "req", "shard", "ts", shards=2, limit_ms=30 * 60_000, keep_ms=600 * 60_000, delay="10 minutes")
    held, folder = state.run_batches(met, "met", "append", lambda b: b, met.schema)
    assert {(r.req, r.outcome, r.shards) for r in held.collect()} == {(k if k else None, "scored", 2) for k in range(1500)}
    assert spark.read.format("statestore").load(f"{folder}/state").count() <= state.BUCKETS


def test_solved_keys_are_held_by_bucket(spark, tmp_path):
    path = str(tmp_path / "in")
    rows = [(k if k else None, i * 2000 + k, (k + i) % 3 > 0) for i in range(6) for k in range(1500)]
    state.sliced(spark.createDataFrame(rows, "k long, at long, ok boolean"), "at", path)
    want, seen = [], {}
    for k, at, ok in rows:
        good, n, gone = seen.get(k, (0, 0, False))
        good, n = good + ok, n + 1
        if not gone and n >= 3 and good / n >= 0.6:
            gone = True
            want.append((k or -1, at, good, n))
        seen[k] = good, n, gone
    stream = spark.readStream.schema("k long, at long, ok boolean").option("maxFilesPerTrigger", 1).parquet(path)
    solved = state.drop_solved(stream, "k", "at", "ok", 0.6, 3)
    held, folder = state.run_batches(solved, "solved", "append", lambda b: b, solved.schema, partitions=2)
    assert sorted((r.k or -1, r.at, r.passes, r.visits) for r in held.collect()) == sorted(want)
    assert held.schema["k"].dataType == stream.schema["k"].dataType and spark.conf.get("spark.sql.shuffle.partitions") == "4"
    assert spark.read.format("statestore").load(f"{folder}/state").count() <= state.BUCKETS
