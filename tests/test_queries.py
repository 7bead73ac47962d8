"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from spoolglass import oracles
from spoolglass import queries as engine

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return f"{x:.9g}"
    if isinstance(x, list | tuple):
        return tuple(map(plain, x))
    return str(x)


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_matches_sql(spark, duck, name):
    df = engine.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    found = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    answer = duck.sql(oracles.oracle_sql()[name])
    assert sorted(answer.columns) == columns
    places = [answer.columns.index(c) for c in columns]
    assert found == sorted(tuple(plain(r[i]) for i in places) for r in answer.fetchall())
    assert found


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(oracles.oracle_sql()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
