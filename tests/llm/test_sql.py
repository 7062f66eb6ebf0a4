"""The registered queries of the training-data operators against their SQL, on the smallest test data."""

import os

import duckdb
import pytest

from marketloom.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test data not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in names) for r in df.collect()]
    result = duck.execute(ORACLE_SQL[name])
    have = [x[0] for x in result.description]
    assert sorted(have) == names
    assert sorted(got, key=str) == sorted((tuple(plain(r[have.index(c)]) for c in names) for r in result.fetchall()), key=str)
