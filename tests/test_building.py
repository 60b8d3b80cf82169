"""Readers, resumable shards, moments, pools and calls: known answers, and numpy as the oracle."""

from __future__ import annotations

import json
import time

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from girasol.functions import tokens
from girasol.operators import leak, moments, select
from girasol.plans import QUERIES
from girasol.sources import readers, sinks
from girasol.streaming import state


@pytest.fixture(scope="module")
def vectors(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()
    return [r.vec_id for r in rows], np.array([r.label for r in rows]), np.array([r.embedding for r in rows], float)


def by_id(df, key="vec_id"):
    return {r[key]: r for r in df.collect()}


def test_json_lines_skip_what_is_malformed(spark, tmp_path):
    good = [{"doc_id": i, "text": "w " * (i * 10), "content": "" if i % 2 else "c " * 30} for i in range(6)]
    (tmp_path / "a.json").write_text("\n".join(map(json.dumps, good[:3])) + "\n{broken\n")
    (tmp_path / "b.json").write_text("\n".join(map(json.dumps, good[3:])))
    (tmp_path / "c.json").write_text("nothing\n")
    got = readers.jsonl_documents(spark, str(tmp_path), "doc_id long, text string, content string", least_tokens=25).collect()
    assert sorted((r.doc_id, r.file) for r in got) == [(0, "a.json"), (2, "a.json"), (3, "b.json"), (4, "b.json"), (5, "b.json")]


def test_shards_are_committed_once(spark, tmp_path):
    path = str(tmp_path / "store")
    df = spark.range(100).select("id", (F.col("id") % 5).alias("part"))
    assert {r.shard: r.kept for r in sinks.commit_shards(df.where("part < 2"), "part", "id", path).collect()} == {0: 20, 1: 20}
    df.where("part = 3").limit(4).withColumn("shard", F.col("part")).write.mode("append").partitionBy("shard").parquet(f"{path}/data")
    assert sinks.committed(spark, path).count() == 40
    again = df.withColumn("id", F.when(F.col("part") < 2, -F.col("id")).otherwise(F.col("id")))
    assert {r.shard: r.kept for r in sinks.commit_shards(again, "part", "id", path).collect()} == {i: 20 for i in range(5)}
    assert sorted(r.id for r in sinks.committed(spark, path).collect()) == list(range(100))
    assert sinks.commit_shards(df, "part", "id", path).count() == 5


def test_a_bank_of_other_vectors_is_not_finalised(spark):
    df = spark.createDataFrame([(0, 1, [3.0, 4.0]), (0, 2, [0.6, 0.8])], "shard int, vec_id long, v array<double>")
    ok = sinks.finalised(df.where("vec_id = 2"), "shard", "vec_id", "v", 1).collect()
    assert [(r.vec_id, r.vec_idx) for r in ok] == [(2, 0)]
    with pytest.raises(Exception, match="no unit"):
        sinks.finalised(df, "shard", "vec_id", "v", 1).collect()


def test_moments_by_key(spark):
    rng = np.random.default_rng(1)
    x, key = rng.normal(size=(90, 4)), rng.integers(0, 3, 90)
    rows = [(int(k) if k else None, v.tolist()) for k, v in zip(key, x)] + [(1, None)]
    df = spark.createDataFrame(rows, "k int, v array<double>").repartition(5)
    got = {r.k: r for r in moments.vector_moments(df, "v", "k").collect()}
    assert set(got) == {None, 1, 2}
    for k, r in got.items():
        own = x[key == (k or 0)]
        assert r.n == len(own) and np.allclose(r.s, own.sum(0)) and np.allclose(np.reshape(r.p, (4, 4)), own.T @ own)
    assert moments.vector_moments(df.where("false"), "v", "k").count() == 0


def test_whitened_rows_have_unit_covariance(spark, sf_dir, vectors):
    ids, _, x = vectors
    got = by_id(QUERIES["p3_zca_whiten"](spark, sf_dir))
    w = np.array([got[i].whitened for i in ids])
    values, u = np.linalg.eigh(np.cov(x.T, bias=True))
    want = (x - x.mean(0)) @ (u @ np.diag(1 / np.sqrt(np.maximum(values, 0) + 1e-5)) @ u.T)
    assert np.allclose(w, want, atol=1e-6)


def test_block_bases_and_coordinates(spark, sf_dir, vectors):
    ids, labels, x = vectors
    axes = {(r.label, r.component): r for r in QUERIES["p8_block_pca"](spark, sf_dir).collect()}
    coords = by_id(QUERIES["p9_block_coordinates"](spark, sf_dir))
    for label in set(labels.tolist()):
        own = x[labels == label]
        centred = own - own.mean(0)
        singular = np.linalg.svd(centred, compute_uv=False)[:4]
        for c, s in enumerate(singular):
            assert axes[label, c].singular == pytest.approx(s, abs=1e-6)
        if len(own) < 6:
            continue
        basis = np.array([axes[label, c].axis for c in range(4)])
        assert np.allclose(basis @ basis.T, np.eye(4), atol=1e-6)
        for i, row in zip(np.flatnonzero(labels == label), centred):
            r, c = coords[ids[i]], basis @ row
            back = c @ basis
            assert np.allclose(r.coords, c, atol=1e-6) and np.allclose(r.direction, back / (np.linalg.norm(back) + 1e-8), atol=1e-6)


def test_geometric_median(spark, sf_dir, vectors):
    x = vectors[2]
    now = x.mean(0)
    for _ in range(500):
        w = 1 / np.maximum(np.linalg.norm(x - now, axis=1), 1e-12)
        new = w @ x / w.sum()
        moved, now = np.linalg.norm(new - now), new
        if moved < 1e-5:
            break
    got = {r.dim: r.median for r in QUERIES["a38_geometric_median"](spark, sf_dir).collect()}
    assert np.allclose([got[i] for i in range(len(now))], now, atol=2e-4)


def test_projection_and_pull_back(spark, sf_dir, vectors):
    ids, _, x = vectors
    basis, _ = np.linalg.qr(np.random.default_rng(71).normal(size=(64, 8)))
    got = by_id(QUERIES["p7_subspace_projection"](spark, sf_dir))
    p = x @ basis @ basis.T
    share = np.linalg.norm(p, axis=1) / np.linalg.norm(x, axis=1)
    assert np.allclose([got[i].share for i in ids], share) and np.allclose([got[i].cos for i in ids], share)
    pulled = by_id(QUERIES["p11_lens_pullback"](spark, sf_dir))
    y = x @ (np.random.default_rng(72).normal(size=(64, 64)) / 8)
    assert np.allclose([pulled[i].direction for i in ids], y / np.linalg.norm(y, axis=1)[:, None])


def test_replayed_items_are_drawn_as_often_as_they_may(spark, sf_dir):
    events = [r[0] for r in spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id").where("user_id % 8 = 3").collect()]
    got = [r for r in QUERIES["st5_replay_stream"](spark, sf_dir).collect() if r.pool == 3]
    draws: dict = {}
    for r in got:
        draws.setdefault(r.draw, []).append(r.event_id)
    assert sorted(draws) == list(range(len(draws))) and all(len(d) == len(set(d)) == 16 for d in draws.values())
    times = {e: sum(e in d for d in draws.values()) for e in events}
    assert max(times.values()) <= 2
    # All but what the slots still hold has been drawn twice.
    assert sum(2 - n for n in times.values()) <= 2 * 64 + 16
    # The same by a plain loop over the files' items.
    whole = [r[0] for r in spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id").collect()]
    pool, k = state.ReplayPool(lambda: None, 64, 2), 0
    for part in range(3):
        pool.waiting += sorted(e for e in events if (e - min(whole)) * 3 // (max(whole) - min(whole) + 1) == part)
        while pool.waiting and len(pool.waiting) + len(pool._drawable()) >= 16:
            assert sorted(pool.draw(16, lambda x, n: (n, x))) == sorted(draws[k])
            pool.ended, k = False, k + 1
    assert k == len(draws)


def test_calls_that_fail_or_take_too_long_are_rows(spark):
    def call(x):
        if x == 1:
            raise KeyError("gone")
        time.sleep(5.0 if x == 2 else 0.0)
        return x

    def then(v):
        if v == 3:
            raise ValueError("no")
        return v * 10

    df = spark.createDataFrame([(i, float(i)) for i in range(5)], "k long, x double").coalesce(1)
    got = sorted((r.k, r.stage, r.value, r.error) for r in state.fan_out(df, "k", "x", call, seconds=1.5, then=then).collect())
    want = [(0, "call", 0.0, None), (0, "then", 0.0, None), (1, "call", None, "KeyError"), (2, "call", None, "TimeoutError"),
            (3, "call", 3.0, None), (3, "then", None, "ValueError"), (4, "call", 4.0, None), (4, "then", 40.0, None)]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_round_trips_have_all_reasons(spark, sf_dir):
    enc = tokens.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)

    def reason(w):
        back = enc.decode_bytes(w).decode("utf-8", "replace")
        if enc.max_token_value in w:
            return "special_id_in_window"
        return "blank" if len(back.strip()) < 3 else "ok" if enc.encode_ordinary(back) == w else "roundtrip_fail"

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40).collect()]
    rows += [(-1, None), (-2, ""), (-3, "\n \n" * 400), (-4, "\u4e16\u754c\U0001f600" * 60), (-5, "word " * 50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = tokens.round_trips(df, "doc_id", F.col("text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, chars=500).collect()
    want = []
    for d, t in rows:
        ids = enc.encode_ordinary(t) + [enc.max_token_value] if t is not None else []
        want += [(d, i // 16, len(ids[i : i + 16]), reason(ids[i : i + 16])) for i in range(0, len(ids), 16)]
    assert sorted(map(tuple, got)) == sorted(want) and {w[3] for w in want} == set(tokens.REASONS)


def test_a_shard_that_this_run_has_not_written_is_not_committed(spark, tmp_path):
    path = str(tmp_path / "store")
    df = spark.range(100).select("id", (F.col("id") % 5).alias("part"))
    df.where("part = 3").limit(4).withColumn("shard", F.col("part")).write.partitionBy("shard").parquet(f"{path}/data")
    assert {r.shard for r in sinks.commit_shards(df.where("part < 3"), "part", "id", path).collect()} == {0, 1, 2}
    assert sinks.committed(spark, path).count() == 60
    assert {r.shard: r.kept for r in sinks.commit_shards(df, "part", "id", path).collect()} == {i: 20 for i in range(5)}


def test_null_vectors_have_no_nearest_reference(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 1.0]), (3, [float("nan"), 1.0])]
    df = spark.createDataFrame(rows, "k long, v array<double>")
    refs = spark.createDataFrame([(7, [0.6, 0.8]), (8, None), (9, [1.0, 0.0])], "r long, v array<double>")
    for limit in (leak.BROADCAST_BYTES, 16):
        got = {r.k: (r.ref_id, r.cos) for r in leak.max_cosine(df, refs, "v", "k", "r", limit=limit).collect()}
        assert got == {0: (9, 1.0), 1: (None, None), 2: (7, 0.8), 3: (None, None)}
    assert {r.k for r in leak.similarity_guard(df, refs, "v", "k", "r", 0.9).collect()} == {1, 2, 3}


def test_nearest_rows_of_other_labels(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x, own = rng.integers(-2, 3, (200, 3)).astype(float), rng.integers(0, 6, 200)
    df = spark.createDataFrame([(i, int(g), v.tolist()) for i, (g, v) in enumerate(zip(own, x))] + [(900, 1, None), (901, None, [1.0, 1.0, 1.0])], "k long, g int, v array<double>")
    refs = spark.createDataFrame([(i, rng.normal(size=3).round(1).tolist()) for i in range(7)] + [(8, None)], "g int, v array<double>")
    want = sorted((r.g, i, n) for r in refs.where("v IS NOT NULL").collect() for n, i in enumerate(sorted(np.flatnonzero(own != r.g).tolist(), key=lambda i: (-round(float(x[i] @ np.array(r.v)), 9), i))[:3], 1))
    for rows, few in ((32_768, 4_096), (17, 2)):
        monkeypatch.setattr(leak, "BLOCK_ROWS", rows)
        monkeypatch.setattr(leak, "BLOCK_REFS", few)
        got = leak.nearest_rows(df, refs, "v", "k", "g", 3).collect()
        assert sorted((r.g, r["rank"]) for r in got) == sorted((g, n) for g, _, n in want)
        assert {(r.g, r["rank"]): round(r.cos, 6) for r in got} == {(g, n): round(float(x[i] @ np.array(refs.where(f"g = {g}").first().v)), 6) for g, i, n in want}


def test_moments_meet_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(moments, "FAN_IN", 2)
    x = np.arange(120, dtype=float).reshape(40, 3)
    df = spark.createDataFrame([(i % 3 if i % 3 else None, v.tolist()) for i, v in enumerate(x)], "k int, v array<double>").repartition(9)
    for r in moments.vector_moments(df, "v", "k").collect():
        own = x[np.arange(40) % 3 == (r.k or 0)]
        assert r.n == len(own) and np.allclose(r.s, own.sum(0)) and np.allclose(np.reshape(r.p, (3, 3)), own.T @ own)
    assert {r.k: r.n for r in moments.vector_means(df, "v", "k").collect()} == {None: 14, 1: 13, 2: 13}


def test_keys_with_too_few_negatives_fail(spark):
    df = spark.createDataFrame([(i % 3, i) for i in range(7)], "k long, i long")
    assert select.verified(df, "k", 1, "i", 2).count() == 6
    with pytest.raises(Exception, match="fewer than 3 rows for"):
        select.verified(df, "k", 1, "i", 3).collect()


def test_a_harvest_cuts_each_text_once(spark, sf_dir):
    from girasol.plans import QUERIES

    plan = QUERIES["u15_prefix_harvest"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 1 and plan.count("Relation [") == 1


def test_windows_are_tried_without_a_pool_of_threads(monkeypatch):
    enc = tokens.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    monkeypatch.setattr(type(enc), "encode_ordinary_batch", lambda *a, **k: pytest.fail("a batch call for short windows"))
    assert tokens.reasons(enc, [enc.encode_ordinary("word " * 9), [enc.max_token_value], enc.encode_ordinary(" ")]) == ["ok", "special_id_in_window", "blank"]
