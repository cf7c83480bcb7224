"""Queries against their SQL on the driver's smallest tables."""

import glob
import os

import duckdb
import pytest

from gridloom.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = queries.queries()[name](spark, SF)
    columns = ", ".join(f'"{c}"' for c in sorted(df.columns))
    want = con.sql(f"SELECT {columns} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(repr(tuple(r[c] for c in sorted(df.columns))) for r in df.collect()) == sorted(repr(tuple(r)) for r in want)
