"""Pairs and triangles of units against plain counts; tokens larger than a block among them."""

from __future__ import annotations

import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from girasol.operators import cofire

rng = random.Random(5)
#: Token 0 has a third of all events.
BASKETS = {0: list(range(60)), **{t: rng.sample(range(60), rng.randint(0, 6)) for t in range(1, 41)}}
SCHEMA = "tok long, unit long, a double, i string"


@pytest.fixture(scope="module")
def events(spark):
    rows = [(t, u, float(u + t), "other") for t, units in BASKETS.items() for u in units]
    return spark.createDataFrame([*rows, (None, 3, 1.0, "x"), (7, None, 1.0, "x"), (None, None, 1.0, "x")], SCHEMA)


@pytest.mark.parametrize("block", [1, 7, 4096])
def test_pairs(events, block):
    expected, sums = Counter(), Counter()
    for t, units in BASKETS.items():
        for i, j in itertools.combinations(sorted(units), 2):
            expected[i, j] += 1
            sums[i, j] += i + t
    found = cofire.pair_counts(events, value="a", block=block).collect()
    assert {(r.i, r.j): r.C for r in found} == expected and len(found) == len(expected)
    assert {(r.i, r.j): r.S for r in found} == sums


@pytest.mark.parametrize("block", [7, 4096])
def test_triangles(events, block):
    pairs = Counter(p for units in BASKETS.values() for p in itertools.combinations(sorted(units), 2))
    expected = Counter(
        t for units in BASKETS.values() for t in itertools.combinations(sorted(units), 3)
        if all(pairs[p] >= 2 for p in itertools.combinations(t, 2))
    )
    found = cofire.triangles(events, 2, block=block).collect()
    assert expected and {(r.i, r.j, r.k): r.n for r in found} == expected and len(found) == len(expected)


def test_large_token_is_spread(events):
    """Of 60 units in blocks of about 7, no key of the join has more than a few blocks' pairs."""
    hot = cofire.event_pairs(events.where("tok = 0"), block=7)
    assert hot.count() == 60 * 59 // 2
    # xxhash64 deals 60 units into 9 blocks; a pair's key is the blocks of both.
    own = lambda c: F.pmod(F.xxhash64(c), F.lit(9))
    assert hot.groupBy(own("i"), own("j")).count().agg(F.max("count")).first()[0] < 300


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert cofire.pair_counts(none, value="a").isEmpty() and cofire.triangles(none, 1).isEmpty()
