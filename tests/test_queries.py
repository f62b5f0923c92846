"""Every registered query with SQL against DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from millrace.catalog import TABLES
from millrace.queries import QUERIES, SQL

DIR = "/root/testdata/sf0.001"


def _plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return v if isinstance(v, int) else str(v)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return connection


def test_every_query_has_sql():
    assert QUERIES.keys() == SQL.keys()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    names = sorted(df.columns)
    got = sorted((tuple(_plain(r[c]) for c in names) for r in df.collect()), key=repr)
    found = duck.execute(SQL[name])
    heads = [c[0] for c in found.description]
    assert sorted(heads) == names
    assert got == sorted((tuple(_plain(r[heads.index(c)]) for c in names) for r in found.fetchall()), key=repr)
