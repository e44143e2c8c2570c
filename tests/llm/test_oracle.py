"""Every registered query of the subpackage that has SQL agrees with DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from quern.llm import queries

SF = "/root/testdata/sf0.001"
ORACLE = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_agrees(spark, name):
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
    df = queries.queries()[name](spark, SF)
    names = sorted(df.columns)
    mine = sorted(repr([r[n] for n in names]) for r in df.collect())
    told = [d[0] for d in con.execute(f"DESCRIBE {ORACLE[name]}").fetchall()]
    assert sorted(told) == names
    theirs = sorted(repr([r[told.index(n)] for n in names]) for r in con.execute(ORACLE[name]).fetchall())
    assert mine == theirs
