"""Every registered query with SQL against DuckDB on the same tables."""

import datetime as dt
import decimal
import glob
import os

import __spark_entry__ as entry
import duckdb
import pytest

QUERIES, SQL = entry.queries(), entry.oracle_sql()


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return str(v)
    if isinstance(v, dt.datetime):
        return v.isoformat()
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    ours = rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = duck.execute(SQL[name])
    theirs_columns = [c[0] for c in cursor.description]
    theirs = rows(theirs_columns, cursor.fetchall())
    assert sorted(df.columns) == sorted(theirs_columns)
    assert ours == theirs


def test_entry(spark):
    assert entry.entry(spark).count() > 0
