"""Every query with SQL against DuckDB on the smallest tables; the others run."""

import math
import os

import __spark_entry__ as entry
import duckdb
import pytest
from loomdoc import plans

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    return c


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, int | float):
        return "nan" if math.isnan(v) else f"{float(v):.9g}"
    if isinstance(v, list | tuple):
        return str([plain(x) for x in v])
    return str(v)


@pytest.mark.parametrize("name", list(plans.QUERIES))
def test_query(spark, db, name):
    df = plans.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    if name in plans.SQL:
        want = db.sql(plans.SQL[name])
        assert sorted(want.columns) == cols
        at = [want.columns.index(c) for c in cols]
        assert got == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
