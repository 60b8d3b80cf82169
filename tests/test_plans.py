"""Each registered query against its SQL in DuckDB."""

from __future__ import annotations

import decimal
import math
from pathlib import Path

import duckdb
import pytest

from girasol.plans import ORACLE_SQL, QUERIES


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 4)
    return v if v is None or isinstance(v, str) else float(v) if isinstance(v, int) else str(v)


@pytest.fixture(scope="session")
def duck(sf_dir):
    c = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    found = duck.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(found.columns)
    cols = sorted(df.columns)
    ours = sorted(str([plain(r[c]) for c in cols]) for r in df.collect())
    at = [found.columns.index(c) for c in cols]
    theirs = sorted(str([plain(r[i]) for i in at]) for r in found.fetchall())
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, sf_dir, name):
    QUERIES[name](spark, sf_dir).collect()


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
