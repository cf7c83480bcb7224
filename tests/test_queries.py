"""Every registered query against its SQL, on the driver's smallest tables."""

import glob
import os

import duckdb
import pytest

from gridloom import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    columns = ", ".join(f'"{c}"' for c in sorted(df.columns))
    want = duck.sql(f"SELECT {columns} FROM ({catalogue.oracle_sql()[name]})").fetchall()
    got = [tuple(r[c] for c in sorted(df.columns)) for r in df.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, map(tuple, want)))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0 and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
