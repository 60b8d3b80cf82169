"""Known answers and brute force for operators that SQL does not express, and planted cases."""

from __future__ import annotations

import itertools
import math
import random
import struct
from hashlib import md5, sha1

import numpy as np
import pytest
from pyspark.sql import functions as F

from girasol.functions import text as tx
from girasol.functions import vec
from girasol.operators import bank, leak, select
from girasol.plans.mining import poisson_tail
from girasol.plans.metrics import locality, rank_auc
from girasol.sources import readers, sinks
from girasol.streaming import state


def test_windows_drop_the_tail(spark):
    df = spark.range(1).select(F.sequence(F.lit(0), F.lit(28)).alias("ids"))
    dropped, kept = df.select(tx.windows(F.col("ids"), 8), tx.windows(F.col("ids"), 8, keep_tail=True)).first()
    assert [len(w) for w in dropped] == [8, 8, 8]
    assert [len(w) for w in kept] == [8, 8, 8, 5]
    short = spark.range(1).select(tx.windows(F.array(F.lit(1)), 8).alias("w")).first()["w"]
    assert short == []


def test_span_hash(spark):
    ids = [1, 300, 70000]
    got = spark.range(1).select(tx.span_hash(F.array(*[F.lit(i) for i in ids])).alias("h")).first()["h"]
    assert got == "78302b144c5dce2f" == sha1(struct.pack("<3i", *ids)).hexdigest()[:16]


def test_first_integer(spark):
    df = spark.createDataFrame([("about 57.",), ("none",), ("250",)], "t string")
    assert [r[0] for r in df.select(tx.first_integer(F.col("t"))).collect()] == [57, None, 100]


def test_finite_and_units(spark):
    rows = [(0, [3.0, 4.0]), (1, [0.0, 0.0]), (2, [float("nan"), 1.0]), (3, None), (4, [float("inf"), 1.0])]
    out = sinks.pool_rows(spark.createDataFrame(rows, "id long, v array<double>"), "v").collect()
    assert [(r.id, r.v) for r in out] == [(0, [0.6, 0.8])]


def test_block_norms_and_cosine(spark):
    df = spark.createDataFrame([([3.0, 4.0, 0.0, 2.0],)], "v array<float>")
    assert df.select(vec.block_norms(F.col("v"), 2)).first()[0] == [5.0, 2.0]
    assert df.select(vec.cosine(F.col("v"), F.col("v"))).first()[0] == pytest.approx(1.0)


def test_strided_shards_cover_everything_once(spark):
    df = spark.range(500)
    parts = [set(r[0] for r in select.strided_shard(df, "id", r, 8, 7).collect()) for r in range(8)]
    assert set().union(*parts) == set(range(7, 500)) and sum(map(len, parts)) == 493


def test_breadth_first_known_answer(spark):
    rows = [(f, r) for f in range(11) for r in range(3) if f < 10 or r == 0]
    df = spark.createDataFrame(rows, "f long, r long")
    assert select.breadth_first(df, "f", "r", 1, 0, 3).count() == 31
    capped = select.breadth_first(df, "f", "r", 1, 16, 3).groupBy("depth").count().collect()
    assert {r["depth"]: r["count"] for r in capped} == {0: 11, 1: 5}


def test_largest_remainder_sums_up(spark):
    df = spark.createDataFrame([("a", 3), ("b", 3), ("c", 1)], "k string, w long")
    got = {r.k: r.quota for r in select.largest_remainder(df, "w", 10, "k").collect()}
    assert sum(got.values()) == 10 and got == {"a": 4, "b": 4, "c": 2}


def test_level_capacity_against_a_loop(spark):
    rng = random.Random(4)
    rows = sorted({(rng.randrange(12), rng.randrange(5), rng.randrange(8)) for _ in range(90)})
    rows = [min(g) for _, g in itertools.groupby(rows, key=lambda x: x[:2])]
    df = spark.createDataFrame(rows, "block long, rank long, doc long")
    key = lambda x: md5(f"8:{x}".encode()).hexdigest()
    chosen, used = [], {}
    for level in range(3):
        taken = {x[:2] for x in chosen}
        best = {}
        for b, r, d in rows:
            if (b, r) not in taken and used.get(d, 0) < 2:
                best[b] = min(best.get(b, (99, "", 0, 0)), (r, key(d), d, b))
        now = []
        for d in {x[2] for x in best.values()}:
            wanting = sorted((x for x in best.values() if x[2] == d), key=lambda x: (key(x[3]), x[3]))
            now += [(x[3], x[0], d) for x in wanting[: 2 - used.get(d, 0)]]
        for _, _, d in now:
            used[d] = used.get(d, 0) + 1
        chosen += now
    got = select.level_capacity(df, "block", "rank", "doc", 8, 3, 2).collect()
    assert sorted((r.block, r["rank"], r.doc) for r in got) == sorted(chosen)


def test_rules_are_kept_by_drops_and_top_ups(spark):
    rng = random.Random(11)
    rows = [(b, r, rng.randrange(14), rng.randrange(3), rng.random() < 0.5) for b in range(20) for r in range(6)]
    rows[3] = (*rows[3][:4], None)
    df = spark.createDataFrame(rows, "block long, rank long, doc long, wave int, good boolean")
    key = lambda *x: md5(":".join(map(str, (8, *x))).encode()).hexdigest()

    def chosen_from(pool, start, most):
        chosen = list(start)
        for level in range(2):
            count = lambda i, v: sum(c[i] == v for c in chosen)
            best = {}
            for row in pool:
                if row not in chosen and count(2, row[2]) < 3 and count(0, row[0]) <= level:
                    order = (row[1], key(row[2]), row[2])
                    if row[0] not in best or order < best[row[0]][0]:
                        best[row[0]] = (order, row)
            now = []
            for d in {r[2] for _, r in best.values()}:
                now += sorted((r for _, r in best.values() if r[2] == d), key=lambda r: (key(r[0]), r[0]))[: 3 - count(2, d)]
            chosen += sorted(now, key=lambda r: (key(r[0], r[1]), r[0], r[1]))[: most - len(chosen)]
        return chosen

    for want, tolerance in ((25, 0.0), (12, 0.3), (39, 0.0)):
        for last in range(3):
            pool = [r for r in rows if r[3] <= last]
            kept = [r for r in chosen_from(pool, [], want) if r[4]]
            plain = chosen_from([r for r in pool if r[4]], kept, want)
            if want - len(plain) <= tolerance * want:
                break
        found, missing = select.topped_up(df, "block", "rank", "doc", "wave", F.col("good"), seed=8, levels=2, doc_cap=3, rows=want, tolerance=tolerance)
        got = found.collect()
        assert sorted((r.block, r["rank"], r.doc) for r in got) == sorted(r[:3] for r in plain) and missing == want - len(plain)
        assert all(r.good for r in got) and {(r.block, r["rank"]) for r in got if not r.topped_up} == {r[:2] for r in kept}
    assert select.topped_up(df.where("false"), "block", "rank", "doc", "wave", F.col("good"), seed=8, levels=2, doc_cap=3, rows=5)[1] == 5


def test_max_cosine_in_blocks_equals_one_block(spark):
    rng = random.Random(2)
    unit = lambda: [x / math.sqrt(sum(y * y for y in v)) for v in [[rng.gauss(0, 1) for _ in range(6)]] for x in v]
    rows = spark.createDataFrame([(i, unit()) for i in range(40)], "k long, v array<double>")
    refs = spark.createDataFrame([(i, unit()) for i in range(30)] + [(99, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0])], "r long, v array<double>")
    one = {r.k: (r.ref_id, round(r.cos, 9)) for r in leak.max_cosine(rows, refs, "v", "k", "r").collect()}
    many = {r.k: (r.ref_id, round(r.cos, 9)) for r in leak.max_cosine(rows, refs, "v", "k", "r", limit=500).collect()}
    assert one == many and len(one) == 40
    none = leak.max_cosine(rows, refs.where("r < 0"), "v", "k", "r").collect()
    assert len(none) == 40 and all(r.cos is None for r in none)


def test_equal_rows_and_references_tie_exactly(spark, monkeypatch):
    rng = np.random.default_rng(11)
    base = rng.normal(size=(60, 64)).astype(np.float32)
    x = np.concatenate([base] * 40)
    df = spark.createDataFrame([(i, i % 60 % 5, v.tolist()) for i, v in enumerate(x)], "k long, g int, v array<float>")
    plain = lambda a, b: float(np.cumsum(a.astype(float) * b.astype(float))[-1])
    centre = base[:5] + base[5:10]
    refs = spark.createDataFrame([(g, v.tolist()) for g, v in enumerate(centre)], "g int, v array<float>")
    got = sorted((r.g, r["rank"], r.k, r.cos) for r in leak.nearest_rows(df, refs, "v", "k", "g", 9).collect())
    want = [(g, n, i, plain(x[i], centre[g])) for g in range(5) for n, i in enumerate(sorted((i for i in range(len(x)) if i % 60 % 5 != g), key=lambda i: (-plain(x[i], centre[g]), i))[:9], 1)]
    assert got == want
    asked = df.where("k % 7 = 0").select("k", "v")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        monkeypatch.setattr(leak, "BLOCK_ROWS", 300)
        monkeypatch.setattr(leak, "BLOCK_REFS", 2)
        assert sorted((r.g, r["rank"], r.k, r.cos) for r in leak.nearest_rows(df, refs, "v", "k", "g", 9).collect()) == want
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    held = df.where("k % 7 <> 0").select(F.col("k").alias("r"), "v")
    least = {}
    for i in sorted(i for i in range(len(x)) if i % 7):
        least.setdefault(i % 60, i)
    for limit in (leak.BROADCAST_BYTES, 64 * 4 * 16):
        for r in leak.max_cosine(asked, held, "v", "k", "r", limit=limit).collect():
            assert r.ref_id == max(least.values(), key=lambda i: (plain(x[r.k], x[i]), -i)) and r.cos == plain(x[r.k], x[r.ref_id])


def test_products_of_many_rows_stay_small():
    import tracemalloc

    x, y = (np.random.default_rng(i).normal(size=(20_000, 8)).astype(np.float32) for i in range(2))
    tracemalloc.start()
    best, at = leak._nearest(x, y)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20 and np.allclose(best, (x.astype(float) * y[at].astype(float)).sum(1))


def test_similarity_guard_drops_planted_copies(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "k long, v array<double>")
    refs = spark.createDataFrame([(7, [0.0, 1.0])], "k long, v array<double>")
    assert [r.k for r in leak.similarity_guard(rows, refs, "v", "k", "k", 0.999).collect()] == [0]


def test_hash_guard(spark):
    docs = spark.createDataFrame([(0, list(range(40))), (1, list(range(100, 140))), (2, [])], "d long, ids array<int>")
    held = docs.where("d = 0").select(tx.span_hash(F.slice("ids", 17, 8)).alias("hash"))
    assert [r.d for r in leak.hash_guard(docs, held, "d", "ids", 16, 8).orderBy("d").collect()] == [1, 2]


def test_poisson_tail(spark):
    cases = [(3.0, 0.7), (10.0, 2.5), (1.0, 5.0), (40.0, 20.0)]
    got = spark.createDataFrame(cases, "c double, m double").select(poisson_tail(F.col("c"), F.col("m"))).collect()
    for (c, m), r in zip(cases, got):
        exact = 1 - sum(math.exp(-m) * m**k / math.factorial(k) for k in range(int(c)))
        assert r[0] == pytest.approx(exact, rel=1e-4)


def test_auc_with_ties_and_an_empty_side(spark):
    rows = [("a", 1, True), ("a", 1, False), ("a", 2, True), ("a", 0, False), ("b", 1, True)]
    got = {r.g: r.auc for r in rank_auc(spark.createDataFrame(rows, "g string, s long, p boolean"), "g", "s", "p").collect()}
    assert got == {"a": 0.875, "b": None}


def test_locality_of_silence(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([1.0, 3.0],)], "a array<double>")
    rows = df.select(*[v.alias(k) for k, v in locality(F.col("a")).items()]).collect()
    assert all(x is None for x in rows[0])
    assert (rows[1].peak_share, rows[1].win3, rows[1].half_peak) == (0.75, 1.0, 1)
    assert rows[1].gini == pytest.approx(0.25)


def test_queue_picks(spark):
    df = spark.createDataFrame([("q", s, i) for i, s in enumerate([3, 1, 2, 1])], "q string, step long, name long")
    fifo = [r.step for r in state.pick_blocks(df, "q", "name", "step", 2, drop_stale=False).collect()]
    assert sorted(fifo) == [1, 1]
    new = state.pick_blocks(df, "q", "name", "step", 2, drop_stale=True).collect()
    assert sorted(r.step for r in new if r.action == "take") == [2, 3] and sum(r.action == "stale" for r in new) == 2
    assert state.pick_blocks(df, "q", "name", "step", 9, drop_stale=False).count() == 0


def test_replay_pool_reuse_and_end():
    batches = iter([list(range(i, i + 5)) for i in range(0, 20, 5)])
    pool = state.ReplayPool(lambda: next(batches, None), capacity=10, reuse=2)
    drawn = [x for _ in range(8) for x in pool.draw(5, lambda row, uses: (uses, row))]
    assert set(drawn) == set(range(20)) and max(drawn.count(x) for x in drawn) <= 2
    assert len(pool.draw(5, lambda row, uses: (uses, row))) == 5


def test_aligned_records(spark):
    ok = spark.range(10).withColumnRenamed("id", "k")
    assert readers.aligned_records(ok, "k", 10).count() == 10
    with pytest.raises(Exception, match="not aligned"):
        readers.aligned_records(ok.where("k <> 3"), "k", 10).collect()


def test_mix_and_dense_ids(spark):
    a = spark.createDataFrame([(i, i % 3) for i in range(30)], "k long, f long")
    gone = spark.createDataFrame([("a", 0), ("a", 1)], "src_bank string, k long")
    out = bank.mix({"a": a, "b": a}, [bank.Source("a", n=10), bank.Source("b", families=(2,))], key="k", family="f", seed=1, exclude=gone)
    rows = bank.rekey(out, 5, "src_bank", "src_k").collect()
    assert sorted(r.vec_idx for r in rows) == list(range(20))
    assert not {(r.src_bank, r.src_k) for r in rows} & {("a", 0), ("a", 1)}


def test_publish_refuses_to_overwrite(spark, tmp_path):
    path = str(tmp_path / "bank")
    sinks.publish(spark.range(3), path)
    assert spark.read.parquet(path).count() == 3
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.publish(spark.range(3), path)


def test_library_does_not_import_the_llm_subpackage():
    import subprocess
    import sys

    code = "import girasol.plans, sys; assert not any(m.startswith('girasol.llm') for m in sys.modules)"
    subprocess.run([sys.executable, "-c", code], check=True)


def test_a_random_direction_is_made_once_a_row(spark):
    from girasol.functions import keys

    df = spark.range(1).select(vec.unit(keys.normals(3, F.lit(64), F.col("id"))).alias("v"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("md5(") == 1
    assert abs(sum(x * x for x in df.first().v) - 1) < 1e-9
