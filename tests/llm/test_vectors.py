"""Hard negatives and whitening against brute force, and their odd rows."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from girasol.llm import hardneg, queries, whitening

SCHEMA = "vec_id long, label int, vector array<float>, id string, x int, part int"


def brute_negatives(rows, k=5, m=3):
    """Each window by itself, over all rows."""
    clean = {(i, l, tuple(math.floor(256 * c) for c in v)) for i, l, v in rows if i is not None and l is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)}
    width = max((len(v) for *_, v in clean), default=0)
    clean = [(i, l, v + (0,) * (width - len(v))) for i, l, v in clean]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, l, v in clean:
        if i % 50:
            continue
        first = lambda r: (-r[0], r[1])
        positives = sorted(((dot(v, w), j) for j, g, w in clean if g == l and j != i), key=first)[:k]
        others = sorted(((dot(v, w), j) for j, g, w in clean if g != l), key=first)
        for s, j in positives:
            inside = [(t, n) for t, n in others if 50 * s <= 100 * t <= 95 * s][:m]
            out += [(i, j, r, n, s, t) for r, (t, n) in enumerate(inside, 1)]
    return sorted(out)


def mined(spark, rows, **conf):
    df = spark.createDataFrame([(*r, "a", 1, 2) for r in rows], SCHEMA)
    return sorted(map(tuple, hardneg.mine(df, F.col("vec_id") % 50 == 0, **conf).collect()))


def test_negatives_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(3, 6))
    rows = [(i, int(rng.integers(0, 3)), (centres[rng.integers(0, 3)] + 0.4 * rng.normal(size=6)).astype(np.float32).tolist()) for i in range(400)]
    # Ties, repeated rows, repeated ids, short and empty vectors, and rows that take no part.
    rows += [(1000 + i, i % 2, rows[i][2]) for i in range(40)] + rows[:30] + [(50, 2, rows[7][2]), (100, 1, [])]
    rows += [(401, None, [1.0] * 6), (402, 1, None), (403, 1, [1.0, None]), (404, 1, [float("nan")] * 6), (405, 0, [float("inf")] * 6), (None, 1, [1.0] * 6), (450, 1, [0.5, 0.5])]
    want = brute_negatives(rows)
    assert len(want) > 30
    assert mined(spark, rows) == want
    # Many small blocks, and slices of a few anchors.
    for name, value in (("ROWS", 64), ("ANCHORS", 2), ("CELLS", 100)):
        monkeypatch.setattr(hardneg, name, value)
    assert mined(spark, rows) == want


def test_negatives_of_equal_and_of_large_vectors(spark):
    same = [(i, i % 2, [1.0, 0.5]) for i in range(200)]
    assert mined(spark, same) == brute_negatives(same) == []
    half = [(i, i % 2, [1.0 if i % 2 == 0 else 0.75]) for i in range(200)]
    assert mined(spark, half) == brute_negatives(half) != []
    large = [(i, i % 3, [float(2**18 + 64 * i), float(-i)]) for i in range(60)]
    assert mined(spark, large) == brute_negatives(large)
    with pytest.raises(Exception, match="does not fit a long"):
        mined(spark, [(i, 1, [1e15]) for i in (50, 51)])
    assert mined(spark, []) == [] and mined(spark, [(50, 1, [1.0])]) == []


def test_first_columns_of_scores_too_large_to_be_ranked_as_one_number():
    scores = np.array([[1 << 60, 5, 1 << 60, -(1 << 60)]])
    r, c = hardneg.firsts(scores, np.array([[True, True, True, False]]), 2)
    assert r.tolist() == [0, 0] and c.tolist() == [0, 2]


def spectrum(values, seed=0):
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))
    return (q * values) @ q.T


@pytest.mark.parametrize("values", [
    np.arange(1, 33) / 7, np.r_[1, 1 + 1e-9, 1 + 2e-9, 0.5, 0.5, np.linspace(0.1, 0.4, 11)], np.r_[1e6, 1, 1e-3, 1e-3, 0, 0], np.ones(9), np.r_[1, 1 + 1e-12, 1e-8, 1e-8],
], ids=["apart", "close", "wide", "equal", "closest"])
def test_refined_eigenvectors(values):
    a = spectrum(values)
    a = (a + a.T) / 2
    e, x = whitening.eigenvectors(a)
    top = np.abs(values).max()
    assert (np.diff(e) <= 1e-12 * top).all() and np.allclose(e, np.sort(values)[::-1], atol=4e-15 * top, rtol=0)
    assert np.abs(x.T @ x - np.eye(len(a))).max() < 2e-15 and np.abs(a @ x - x * e).max() < 4e-15 * top
    # Much better than where the iteration begins.
    rough = np.linalg.eigh(a.astype(np.float32))[1]
    assert np.abs(x.T @ a @ x - np.diag(e)).max() < 1e-6 * np.abs(rough.T @ a @ rough - np.diag(np.diag(rough.T @ a @ rough))).max() + 4e-15 * top


def whitened(spark, rows):
    df = spark.createDataFrame([(i, v, 1, "u") for i, v in rows], "vec_id long, vector array<float>, x int, whitened string").repartition(3)
    model = whitening.fit(df)
    return whitening.components_of(whitening.whiten(df, model, keep=["vec_id", "whitened"]), model, "vec_id").collect(), model


def test_whitening_equals_numpy(spark):
    rng = np.random.default_rng(9)
    x = (rng.normal(size=(300, 8)) @ rng.normal(size=(8, 8)) / 3).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    # A third of the rows are one vector; it counts once.
    rows += [(1000 + i, x[0].tolist()) for i in range(150)] + [(7, x[7].tolist()), (None, x[3].tolist()), (2000, x[1, :5].tolist())]
    bad = [(3001, None), (3002, [1.0, None]), (3003, [float("nan")] * 8), (3004, [float("-inf")] * 8)]
    got, model = whitened(spark, rows + bad)
    z = np.array([[math.floor(256 * c) for c in v + [0.0] * (8 - len(v))] for _, v in rows])
    listed = np.unique(z, axis=0)
    n, s = len(listed), listed.sum(0)
    e, u = np.linalg.eigh(np.cov(listed.T, bias=True))
    e, u = e[::-1][:4], u[:, ::-1][:, :4]
    want = (z - s / n) @ u / np.sqrt(e)
    sign = np.sign((u * model.components).sum(0))
    assert len(got) == 4 * len(rows) and {r.n for r in got} == {n} == {model.n}
    assert np.allclose(np.abs((u * model.components).sum(0)), 1, atol=1e-13)
    key = lambda i, c, d, w: (-1 if i is None else i, c, d, round(w, 9) + 0.0)
    ours = sorted(key(r.vec_id, r.component, r.deviation, r.whitened) for r in got)
    theirs = sorted(key(i, c + 1, int(((n * v - s) ** 2).sum()), w[c] * sign[c]) for (i, _), v, w in zip(rows, z, want) for c in range(4))
    assert [k[:3] for k in ours] == [k[:3] for k in theirs] and np.allclose([k[3] for k in ours], [k[3] for k in theirs], atol=1e-8)
    assert {r.identity_error for r in got} == {model.identity_error} and model.identity_error < 1e-10
    assert np.allclose(model.explained, e / np.trace(np.cov(listed.T, bias=True)), rtol=1e-12)


def test_whitening_of_few_equal_and_no_vectors(spark):
    got, model = whitened(spark, [(i, [1.0, 2.0, 3.0]) for i in range(5)])
    assert got == [] and model.n == 1 and model.identity_error is None
    got, model = whitened(spark, [(0, [1.0, 0.0]), (1, [0.0, 0.0])])
    assert [(r.vec_id, r.component, abs(round(r.whitened, 6)), r.explained) for r in sorted(got)] == [(0, 1, 1.0, 1.0), (1, 1, 1.0, 1.0)]
    assert whitened(spark, [])[0] == [] and whitened(spark, [(1, None), (2, [])])[0] == []
    got, _ = whitened(spark, [(0, [1e15, 0.0]), (1, [-1e15, 3.0]), (2, [5.0, 1.0])])
    assert {r.deviation for r in got} == {None} or all(r.deviation is None or r.deviation >= 0 for r in got)


def test_sums_meet_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    x = np.arange(60).reshape(20, 3)
    df = spark.createDataFrame([(v.tolist(),) for v in x], "x array<long>").repartition(9)
    got = whitening.product_sums(df, 3, lambda y: y.astype(float)).reshape(4, 3)
    assert np.allclose(got[0], x.sum(0)) and np.allclose(got[1:], x.T @ x)


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_embedding_whitening"])
def test_queries_run_over_the_whole_table(spark, sf_dir, name):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    got = queries.QUERIES[name](spark, sf_dir).collect()
    if name.startswith("op12"):
        assert {r.vec_id for r in got} == {r.vec_id for r in rows} and len(got) == 4 * len(rows)
    else:
        known = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding) for r in rows]
        assert sorted(map(tuple, got)) == brute_negatives(known)
