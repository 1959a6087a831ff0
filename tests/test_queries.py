"""Queries against their SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from tessera import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else x + 0.0
    return float(x) if isinstance(x, int) and not isinstance(x, bool) else x


def rows(names, got):
    return sorted((tuple(plain(x) for x in r) for r in got), key=str)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query(spark, sql, name):
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    want = sql.execute(f"SELECT {', '.join(columns)} FROM ({registry.ORACLE_SQL[name]})").fetchall()
    assert rows(columns, df.select(*columns).collect()) == rows(columns, want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_others_run(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0
