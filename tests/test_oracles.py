"""Every query with SQL against DuckDB on the smallest tables."""

import math
from datetime import date, datetime
from decimal import Decimal

import duckdb
import pytest

from veldspar.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, Decimal):
        return round(float(v), 6)
    if isinstance(v, datetime):
        return v.isoformat()
    if isinstance(v, date):
        return v.isoformat()
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", SQL)
def test_query_equals_sql(spark, sf, duck, name):
    df = catalog.queries()[name](spark, sf)
    want = duck.sql(SQL[name])
    names = sorted(df.columns)
    assert names == sorted(want.columns)
    at = [want.columns.index(n) for n in names]
    got = sorted(([plain(r[n]) for n in names] for r in df.collect()), key=repr)
    assert got == sorted(([plain(r[i]) for i in at] for r in want.fetchall()), key=repr)


def test_queries_without_sql_run(spark, sf):
    for name, run in catalog.queries().items():
        if name not in SQL:
            assert run(spark, sf).count() >= 0
