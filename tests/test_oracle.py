"""Every registered query with SQL agrees with DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from quern.plans import registry

SF = "/root/testdata/sf0.001"
ORACLE = registry.oracle_sql()


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def plain(x):
    return float(f"{x:.9g}") if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_agrees(spark, tables, name):
    df = registry.queries()[name](spark, SF)
    names = sorted(df.columns)
    mine = sorted(repr([plain(r[n]) for n in names]) for r in df.collect())
    told = [d[0] for d in tables.execute(f"DESCRIBE {ORACLE[name]}").fetchall()]
    assert sorted(told) == names
    theirs = sorted(repr([plain(r[told.index(n)]) for n in names]) for r in tables.execute(ORACLE[name]).fetchall())
    assert mine == theirs


def test_rows_only_queries(spark):
    for name in sorted(set(registry.queries()) - set(ORACLE)):
        assert registry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["doc_id", "window", "source", "difficulty"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
