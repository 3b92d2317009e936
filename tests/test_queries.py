"""Every registered query against its SQL on the smallest tables."""

import glob
import math
import os
from collections import Counter
from decimal import Decimal

import duckdb
import pytest

from keepsieve.operators import catalog, queries  # noqa: F401


def plain(v):
    if isinstance(v, (float, Decimal)):
        return None if math.isnan(v) else round(float(v), 5)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def sql(data):
    con = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def check(spark, sql, data, run, text):
    df = run(spark, data)
    names = sorted(df.columns)
    rows = Counter(tuple(plain(r[c]) for c in names) for r in df.collect())
    if text:
        got = sql.sql(text)
        assert sorted(got.columns) == names
        at = [got.columns.index(c) for c in names]
        assert rows == Counter(tuple(plain(r[i]) for i in at) for r in got.fetchall())


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_core_query(spark, sql, data, name):
    check(spark, sql, data, catalog.QUERIES[name], catalog.SQL.get(name))


def test_entry(spark, data):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
