"""Every registered query with an SQL form against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


def plain(row):
    return tuple(None if v is None or isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v for v in row)


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql())))
def test_query_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, SMALL)
    rel = con.sql(entry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    assert {c: KINDS[k] for c, k in df.dtypes} == dict(zip(rel.columns, map(str, rel.types)))
    quoted = ", ".join('"' + c + '"' for c in columns)
    want = con.execute(f"SELECT {quoted} FROM ({entry.oracle_sql()[name]})").fetchall()
    got = [tuple(r) for r in df.select(*columns).collect()]
    assert sorted(map(plain, got), key=str) == sorted(map(plain, want), key=str)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
