"""Every query with SQL against a second engine, on the smallest test data."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from marketloom.plans import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test data not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for f in os.listdir(DATA):
        con.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return con


def plain(v):
    if v is None or isinstance(v, (bool, str)):
        return v
    if isinstance(v, (float, decimal.Decimal)):
        return None if math.isnan(v) else round(float(v), 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return float(v) if isinstance(v, int) else v


def rows_of(rows, order):
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    got = df.select(*[f"`{c}`" for c in names]).collect()
    result = duck.execute(ORACLE_SQL[name])
    have = [x[0] for x in result.description]
    assert sorted(have) == names
    assert rows_of(got, range(len(names))) == rows_of(result.fetchall(), [have.index(c) for c in names])


def test_queries_without_sql_run(spark):
    for name in set(QUERIES) - set(ORACLE_SQL):
        assert QUERIES[name](spark, DATA).count() > 0
