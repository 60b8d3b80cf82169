"""Bins and batches of whole tables against plain loops."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from girasol.operators import packing


def bins(rows, budget):
    out, now, held = {}, -1, 0
    for i, n in rows:
        if n is None or n > budget:
            continue
        if now < 0 or held + n > budget:
            now, held = now + 1, 0
        held += n
        out[i] = now
    return out


def batches(rows, budget, most):
    out, now, count, longest = {}, 0, 0, 0
    for i, n in sorted(rows, key=lambda r: (-(r[1] or 0), r[0])):
        n = n or 0
        if count and ((count + 1) * longest > budget or count >= most):
            now, count, longest = now + 1, 0, 0
        longest, count = max(longest, n), count + 1
        out[i] = now
    return out


def frame(spark, rows):
    shuffled = rows[:]
    random.Random(3).shuffle(shuffled)
    return spark.createDataFrame(shuffled, "i long, n long").repartition(3)


CASES = {
    "mixed": [(i, random.Random(i).randint(0, 12)) for i in range(700)],
    "long and short": [(i, 97 if i % 50 == 0 else 1) for i in range(600)],
    "a bin over many parts": [(i, 0 if 20 < i < 500 else 3) for i in range(600)],
    "none but zeros": [(i, 0) for i in range(200)],
    "each by itself": [(i, 100) for i in range(150)],
    "too long and missing": [(i, (None, 101, 40)[i % 3]) for i in range(90)],
    "one": [(5, 7)],
    "none": [],
}


@pytest.mark.parametrize("case,rows", [*((c, 41) for c in CASES), ("mixed", 100_000)])
def test_bins_equal_a_loop(spark, case, rows):
    got = packing.pack(frame(spark, CASES[case]), [F.col("i")], "n", 100, rows=rows).collect()
    assert {r.i: r.bin for r in got} == bins(CASES[case], 100) and len(got) == len({r.i for r in got})


@pytest.mark.parametrize("case,rows", [*((c, 41) for c in CASES), ("mixed", 100_000)])
def test_batches_equal_a_loop(spark, case, rows):
    got = packing.batch(frame(spark, CASES[case]), [F.col("i")], "n", 60, 8, rows=rows).collect()
    assert {r.i: r.batch for r in got} == batches(CASES[case], 60, 8) and len(got) == len(CASES[case])


def test_a_value_of_all_rows_is_split_over_parts(spark):
    df = spark.range(1000).select(F.lit(4).alias("n"), F.lit("same").alias("k"))
    table = packing.in_order(df, [F.col("k")], 100)
    sizes = [r["count"] for r in table.groupBy("_part").count().collect()]
    assert len(sizes) > 5 and max(sizes) < 400
    got = packing.summary(packing.pack(df, [F.col("k")], "n", 40, rows=100), "bin", "n").collect()
    assert len(got) == 100 and {(r["rows"], r.total, r.longest) for r in got} == {(10, 40, 4)}


def test_rows_carry_their_other_columns(spark):
    df = spark.createDataFrame([(i, f"text {i}", 30, [i]) for i in range(40)], "i long, text string, n int, c array<int>")
    got = packing.pack(df, [F.col("i")], "n", 100, rows=9).orderBy("i").collect()
    assert [(r.i, r.text, r.c, r.bin) for r in got] == [(i, f"text {i}", [i], i // 3) for i in range(40)]


def test_neighbours_reach_over_parts(spark):
    there = {i for i in range(5, 190) if i % 17 == 3 or 100 < i < 105}
    df = spark.createDataFrame([(i, i if i in there else None) for i in range(200)], "x long, p long").repartition(7)
    for rows in (8, 1000):
        for r in packing.neighbours(df, "x", "p", rows).collect():
            assert r.lo == max((i for i in there if i <= r.x), default=None) and r.hi == min((i for i in there if i >= r.x), default=None)


def test_interpolation_has_no_window_over_all_rows(spark, sf_dir):
    from girasol.plans import QUERIES

    plan = QUERIES["j17_interpolated_as_of"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    frames = [line for line in plan.splitlines() if "Window [" in line and "_in#" in line]
    assert frames and all("[_part#" in line for line in frames) and "unboundedfollowing" not in plan.lower()
