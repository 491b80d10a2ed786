"""The driver contract: every store query equals its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__
from memlake import queries as own, queries_merge, queries_views

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


@pytest.mark.parametrize("name", sorted(own.ORACLES))
def test_query_equals_sql(spark, db, name):
    df = own.QUERIES[name](spark, SF)
    found = db.sql(own.ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(found.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    at = [found.columns.index(c) for c in columns]
    assert rows == sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(own.QUERIES) - set(own.ORACLES)))
def test_query_runs(spark, name):
    assert own.QUERIES[name](spark, SF).count() >= 0


def test_contract(spark):
    assert __spark_entry__.entry(spark).count() > 0
    names = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(names) and set(own.QUERIES) <= set(names)
