"""Every registered query runs on the smallest tables; those with SQL give the same rows as DuckDB."""

import math
import os

import duckdb
import pytest

from docstrata.plans.catalogue import oracle_sql, queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = queries(), oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    return repr(float(value)) if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = rows(df.columns, df.collect())
    if name in ORACLES:
        result = duck.sql(ORACLES[name])
        assert sorted(df.columns) == sorted(result.columns)
        assert got == rows(result.columns, result.fetchall())


def test_entry_names():
    assert set(ORACLES) <= set(QUERIES) and "silver_outcome" in QUERIES
