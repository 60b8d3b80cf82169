from __future__ import annotations

import numpy as np
import pytest

from girasol.operators.dip import dip, dip_test, distribution
from girasol.plans.metrics import a34_dip


def _counts(values):
    x, c = np.unique(np.asarray(values, float), return_counts=True)
    return x, np.cumsum(c).astype(float)


def _plain(values) -> float:
    """The dip with minorants and majorants read off every chord."""
    x, cum = _counts(values)
    low, lo, hi, found = cum - np.diff(cum, prepend=0), 0, len(x) - 1, 0.0

    def bound(y, best):
        out = []
        for i in range(lo, hi + 1):
            chords = [y[i]]
            for a in range(lo, i):
                for b in range(i + 1, hi + 1):
                    chords.append(y[a] + (y[b] - y[a]) * (x[i] - x[a]) / (x[b] - x[a]))
            out.append(best(chords))
        return np.array(out)

    while lo < hi:
        under, over = bound(low, min), bound(cum, max)
        here = range(lo, hi + 1)
        g = [i for i in here if abs(under[i - lo] - low[i]) < 1e-9]
        c = [i for i in here if abs(over[i - lo] - cum[i]) < 1e-9]
        gap = {i: over[i - lo] - under[i - lo] for i in here}
        best_g, best_c = max(g, key=lambda i: (gap[i], -i)), max(c, key=lambda i: (gap[i], -i))
        if gap[best_g] > gap[best_c] + 1e-9:
            a, b = best_g, min(i for i in c if i >= best_g)
        else:
            a, b = max(i for i in g if i <= best_c), best_c
        if max(gap[best_g], gap[best_c]) <= found + 1e-9:
            break
        found = max([found] + [cum[i] - under[i - lo] for i in range(lo, a)] + [over[i - lo] - low[i] for i in range(b + 1, hi + 1)])
        lo, hi = a, b
    return found / (2 * cum[-1])


def test_known_dips():
    assert dip(*_counts(range(10))) == pytest.approx(1 / 20)
    assert dip(*_counts([4.0] * 9)) == 0
    assert dip(*_counts([0] * 3 + [1] * 7)) == pytest.approx(0.15)
    assert dip(*_counts([0] * 5 + [1] * 5)) == pytest.approx(0.25)


@pytest.mark.parametrize("seed", range(6))
def test_dip_equals_the_plain_form(seed):
    rng = np.random.default_rng(seed)
    for values in (rng.random(24), np.concatenate([rng.normal(0, 1, 12), rng.normal(7, 1, 12)]), rng.integers(0, 6, 40), rng.exponential(size=20)):
        assert dip(*_counts(values)) == pytest.approx(_plain(values), abs=1e-9)


def test_dips_of_groups(spark):
    rng = np.random.default_rng(3)
    groups = {
        "two": np.concatenate([rng.normal(0, 1, 400), rng.normal(8, 1, 400)]).tolist(), "flat": rng.random(800).tolist(),
        "ties": rng.integers(0, 4, 300).astype(float).tolist(), "same": [2.0] * 5, "one": [1.0], "bad": [float("nan"), float("inf"), None], None: rng.normal(size=50).tolist(),
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("one", None), ("one", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r for r in dip_test(df, "g", "v", draws=200).collect()}
    assert set(got) == set(groups) - {"bad"}
    for g, r in got.items():
        assert (r.n, r.error) == (len(groups[g]), 0.0)
        assert r.dip == pytest.approx(dip(*_counts(groups[g])), abs=1e-12)
    assert got["two"].p < 0.02 and got["ties"].p < 0.02
    assert got["flat"].p > 0.05 and got["same"].p == got["one"].p == 1
    assert dip_test(df.where("false"), "g", "v").collect() == []


def test_few_cells_stay_within_the_error(spark):
    rng = np.random.default_rng(4)
    values = np.concatenate([rng.normal(0, 1, 3000), np.full(500, 2.5), rng.normal(5, 1, 2000)])
    df = spark.createDataFrame([("a", float(v)) for v in values], "g string, v double")
    thin = distribution(df, "g", "v", cells=64, rows=700)
    assert thin.count() <= 128
    r = dip_test(df, "g", "v", draws=50, cells=64).first()
    assert r.error == 1 / 64
    assert abs(r.dip - dip(*_counts(values))) <= r.error
    whole = sorted((x.v, x.cum) for x in distribution(df, "g", "v", rows=700).collect())
    assert whole == list(zip(*[a.tolist() for a in _counts(values)]))


def test_query_has_every_group(spark, sf_dir):
    got = {r.event_type: r.n for r in a34_dip(spark, sf_dir).collect()}
    want = {r["event_type"]: r["count"] for r in spark.read.parquet(f"{sf_dir}/events.parquet").where("value IS NOT NULL AND NOT isnan(value)").groupBy("event_type").count().collect()}
    assert got == want
