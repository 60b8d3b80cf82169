"""The postings index and the growing top-N store against brute force."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from girasol.operators import postings, select
from girasol.operators.topstore import TopStore


def test_postings_hold_every_place(spark, tmp_path):
    rng = random.Random(6)
    docs = [(i * (1 if i < 190 else 10**12), [rng.choice("aaaaabcd") + rng.choice("xy") for _ in range(rng.randint(0, 40))]) for i in range(-3, 200)]
    docs += [(7, ["ax", None, "ax"]), (7, ["ax"]), (None, ["ax"]), (8, None), (9, ["only"])]
    df = spark.createDataFrame(docs, "doc_id long, ids array<string>").repartition(3)
    path = str(tmp_path / "index")
    postings.write_index(df, "doc_id", F.col("ids"), path, buckets=8, span=16)
    want = ["ax", "by", "only", "absent", None, "ax"]
    wanted = spark.createDataFrame([(t,) for t in want], "tok string")
    got = sorted(map(tuple, postings.places(spark, path, wanted).collect()))
    brute = sorted((t, d, p) for d, ids in docs if d is not None for p, t in enumerate(ids or []) if t in {"ax", "by", "only"})
    assert got == brute
    assert {tuple(r) for r in postings.counts(spark, path, wanted).collect()} == {(t, sum(x[0] == t for x in brute), min(x[1] for x in brute if x[0] == t)) for t in ("ax", "by", "only")}
    # A hot token is in many rows, and one that is wanted alone reads its part alone.
    assert postings.blocks_of(spark, path, wanted).where("tok = 'ax'").count() > 12
    one = postings.blocks_of(spark, path, wanted.where("tok = 'only'"))
    assert one.select(F.input_file_name()).distinct().count() == 1
    assert "bucket#" in one._jdf.queryExecution().toString().split("PartitionFilters: [")[1].split("]")[0]
    assert postings.places(spark, path, wanted.where("false")).count() == 0


def test_postings_are_packed_before_they_are_shuffled(monkeypatch):
    docs = pa.array(range(-5, 95), pa.int64())
    tokens = pa.array([[i % 3, None, 7, 7] if i % 10 else None for i in range(100)], pa.list_(pa.int32()))
    batch = pa.RecordBatch.from_arrays([docs, tokens], names=["doc", "toks"])
    want = sorted((t, d, p) for d, ts in zip(docs.to_pylist(), tokens.to_pylist()) for p, t in enumerate(ts or []) if t is not None)
    for step, most in ((1 << 20, 4 * 8), (50, 4 * 8 * 8)):
        monkeypatch.setattr(postings, "STEP", step)
        rows = [r for b in postings._packed(16)(iter([batch])) for r in b.to_pylist()]
        assert len(rows) <= most and sum(r["n"] for r in rows) == len(want)
        got = []
        for r in rows:
            doc, place = r["first"], 0
            for i, (by, p) in enumerate(zip(r["docs"], r["places"])):
                doc, place = doc + by, p if by or not i else place + p
                got.append((r["tok"], doc, place))
            assert {x[1] // 16 for x in got[-r["n"]:]} == {r["block"]}
        assert sorted(got) == want


def batches(spark, rows, path, order, scalars=lambda rank, step: {"norm": 1.5}, ranks=3, steps=3, skip=()):
    store = TopStore(spark, path, "f", [F.desc("act"), F.col("id")], 4, ranks)
    df = spark.createDataFrame(rows, "f long, id long, act double, note string")
    for rank, step in order:
        if (rank, step) not in skip:
            part = df.where((F.col("id") % ranks == rank) & (F.floor(F.col("id") / ranks) % steps == step))
            store.arrive(part, rank, step, scalars(rank, step))
    return store, df


ROWS = [(random.Random(i).randint(0, 9), i, float(random.Random(i + 5).randint(0, 20)), f"n{i}") for i in range(400)]


def test_parts_in_any_order_equal_one_pass(spark, tmp_path):
    order = [(r, s) for r in range(3) for s in range(3)]
    want = None
    for seed in (1, 2):
        random.Random(seed).shuffle(order)
        store, df = batches(spark, ROWS, str(tmp_path / str(seed)), order + order[:2])
        once = select.first_n(df, ["f"], [F.desc("act"), F.col("id")], 4, "rank_in_feature")
        want = want or sorted(map(tuple, once.collect()))
        assert sorted(map(tuple, store.merged().select(once.columns).collect())) == want
        assert {r.f: r.fires for r in store.fires().collect()} == {r.f: r["count"] for r in df.groupBy("f").count().collect()}


def test_the_last_step_that_all_ranks_have(spark, tmp_path):
    order = [(r, s) for s in range(3) for r in range(3)]
    store, df = batches(spark, ROWS, str(tmp_path / "a"), order, skip={(1, 2)})
    assert store.common_step() == 1
    own = df.where(F.floor(F.col("id") / 3) % 3 <= 1)
    assert sum(r.fires for r in store.fires().collect()) == own.count()
    with pytest.raises(ValueError, match="differ in their scalars"):
        batches(spark, ROWS, str(tmp_path / "b"), order[:6], scalars=lambda r, s: {"norm": 1.5 + (r == 2)})[0].merged()
    with pytest.raises(ValueError, match="2 of 3 ranks"):
        batches(spark, ROWS, str(tmp_path / "c"), order[:2])[0].merged(0)
    with pytest.raises(ValueError, match="no step"):
        TopStore(spark, str(tmp_path / "d"), "f", [F.col("act")], 4, 3).merged()


def test_a_part_without_its_log_line_does_not_count(spark, tmp_path):
    store, df = batches(spark, ROWS, str(tmp_path / "a"), [(r, 0) for r in range(3)])
    before = sorted(map(tuple, store.merged().collect()))
    df.limit(50).write.parquet(str(tmp_path / "a/top/rank=0/step=1"))
    assert sorted(map(tuple, store.merged(1).collect())) == before
