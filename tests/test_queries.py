"""Every drawing query with SQL gives the same rows as its SQL in another engine."""

import math
import os
from collections import Counter

import duckdb
import pytest

from drawlake.plans import catalog


def normal(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return v


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{sf_dir}/{f}')")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, sf_dir, duck, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    want = duck.sql(catalog.ORACLES[name])
    names = sorted(want.columns)
    assert sorted(df.columns) == names
    a = Counter(tuple(normal(r[c]) for c in names) for r in df.collect())
    at = [want.columns.index(c) for c in names]
    b = Counter(tuple(normal(r[i]) for i in at) for r in want.fetchall())
    assert a == b


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns
    assert set(entry.oracle_sql()) <= set(entry.queries())
