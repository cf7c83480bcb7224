"""Percentiles of groups beyond the 10,000 values up to which percentile_approx is exact, and numbers without a task that sees all rows."""

import duckdb
from pyspark.sql import Window
from pyspark.sql import functions as F

from gridloom import catalogue
from gridloom.operators import ranking

CUSTOMERS = """SELECT i AS c_custkey, 'c' AS c_name, (i % 2)::INT AS c_nationkey, 0.0::DOUBLE AS c_acctbal,
  CASE WHEN i < 30000 THEN 'large' WHEN i < 30010 THEN 'ten' WHEN i < 30012 THEN 'two' WHEN i < 30013 THEN 'one' WHEN i < 30020 THEN 'no values' WHEN i < 30040 THEN 'equal' END AS c_mktsegment FROM range(30050) r(i)"""
ORDERS = """SELECT i AS o_orderkey, i AS o_custkey, 'O' AS o_orderstatus, '1-URGENT' AS o_orderpriority,
  CASE WHEN i BETWEEN 30013 AND 30019 OR i < 30000 AND i % 11 = 0 THEN NULL WHEN i BETWEEN 30020 AND 30039 THEN 5 ELSE ((i * 7919) % 100003 - 500) / 100 END::DOUBLE AS o_totalprice,
  CASE WHEN i < 29900 OR i >= 30000 THEN TIMESTAMP '1998-02-06' END AS o_orderdate FROM range(30050) r(i)"""


def test_percentiles_of_large_and_odd_groups(spark, tmp_path):
    con = duckdb.connect()
    tables = {"customer": CUSTOMERS, "orders": ORDERS, "region": "SELECT 0 AS r_regionkey, 'R' AS r_name", "nation": "SELECT i::INT AS n_nationkey, 'N' AS n_name, 0 AS n_regionkey FROM range(2) r(i)"}
    for name, sql in tables.items():
        con.sql(f"COPY ({sql}) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    columns = ["site", "month", "p50", "p90", "sites", "above_p90"]
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({catalogue.oracle_sql()['q_segment_percentiles']})").fetchall()
    got = [tuple(r) for r in catalogue.queries()["q_segment_percentiles"](spark, str(tmp_path)).select(*columns).collect()]
    assert len(got) == 30050 and set(got) == set(want)


def test_numbered_equals_row_number(spark):
    """Numbers by ranges are row_number()'s, also where one group or value holds most rows, keys are null, or nothing is there."""
    rows = [("a" if i % 4 else None if i % 8 else "b", 7 if i % 3 else i % 50, i) for i in range(5000)]
    df = spark.createDataFrame(rows, "g string, v int, id int")
    got = ranking.numbered(df, ["g"], [F.desc("v"), "id"], "n")
    want = df.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("v"), "id")))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want.collect())))
    assert sorted(r.n for r in ranking.numbered(df, [], [F.desc("v"), "id"], "n").collect()) == list(range(1, 5001))
    assert ranking.numbered(df.limit(0), ["g"], ["id"], "n").collect() == []


def test_places_equal_windows(spark):
    """Ranks made of places are Spark's own, with ties, nulls and groups of one row."""
    rows = [(["a", "b", None][i % 3] if i < 900 else f"one{i}", None if i % 17 == 0 else float(i * 7919 % 60) if i % 2 else 5.0, i) for i in range(905)]
    df = spark.createDataFrame(rows, "g string, v double, id int")
    out, p = ranking.place_by(df, ["g"], "v", ["id"], "t")
    up, w = Window.partitionBy("g").orderBy("v"), Window.partitionBy("g")
    down = w.orderBy(F.desc("v"))
    pairs = {
        "rank": (p.rank_down, F.rank().over(down)), "dense": (p.dense_rank_down, F.dense_rank().over(down)), "nth": (p.row_number_down, F.row_number().over(w.orderBy(F.desc("v"), "id"))),
        "percent": (p.percent_rank, F.percent_rank().over(up)), "cume": (p.cume_dist, F.cume_dist().over(up)),
        **{f"tile{n}": (p.tile(n), F.ntile(n).over(w.orderBy("v", "id"))) for n in (1, 4, 10, 450)},
    }
    got = {r.id: r for r in out.select("id", *(a.cast("double").alias(k) for k, (a, _) in pairs.items())).collect()}
    want = {r.id: r for r in df.select("id", *(b.cast("double").alias(k) for k, (_, b) in pairs.items())).collect()}
    assert got == want


def test_shares_are_taken_as_written(spark):
    """Least value that a share of the values reaches, by fractions, where doubles would count one too many."""
    from fractions import Fraction

    for n, q in ((100, 0.07), (100, 0.55), (25, 0.56), (25, 0.28), (50, 0.14), (10, 0.5), (1, 0.9)):
        df = spark.range(1, n + 1).select(F.lit("g").alias("g"), F.col("id").alias("v"))
        exact = -(-n * Fraction(str(q)) // 1)
        assert ranking.quantiles(df, ["g"], "v", {"q": q}, "rows").collect() == [("g", exact, n)]
        out, p = ranking.place_by(df, ["g"], "v", [], "t")
        assert [r.v for r in out.filter(p.share_reached(q)).collect()] == [exact]
