"""Windows in chunks against windows over whole series."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from gridloom.operators import long_series, series


def _series(spark, n=3000):
    r = random.Random(6)
    rows = [("long" if i % 3 else r.choice(["a", "b", None]), i * 2 + r.randrange(2), None if r.random() < 0.7 or 400 < i < 900 else r.randrange(100)) for i in range(n)]
    return spark.createDataFrame(rows + [("single", 1, None)], "site string, step long, v long")


def _rows(df):
    return sorted(map(repr, map(tuple, df.select(*sorted(df.columns)).collect())))


@pytest.mark.parametrize("size", (24, 25, 1000, 1 << 20))
def test_chunks_change_nothing(spark, size):
    df = _series(spark)
    w, c = series.along("site", "step"), long_series.along_chunk(["site"])
    made = lambda w: {"before": F.lag("v", 24).over(w), "after": F.lead("v", 3).over(w), "mean": F.avg("v").over(series.last_n(w, 7)), "nth": F.count(F.lit(1)).over(series.before(w, 24))}
    assert _rows(long_series.with_windows(df, ["site"], ["step"], made(c), 24, 3, size)) == _rows(df.withColumns(made(w)))
    assert _rows(long_series.forward_filled(df, ["site"], ["step"], "v", "f", size)) == _rows(df.withColumn("f", F.last("v", ignorenulls=True).over(series.so_far(w))))
    assert _rows(long_series.running_total(df, ["site"], ["step"], "v", "t", size)) == _rows(df.withColumn("t", F.sum("v").over(series.so_far(w))))


def test_islands_of_long_series(spark):
    df = _series(spark).withColumn("step", F.col("step") - F.col("step") % 2)
    assert _rows(long_series.islands(df, "site", F.floor(F.col("step") / 2))) == _rows(series.islands(df, "site", F.floor(F.col("step") / 2)))


def test_one_series_is_in_many_tasks(spark):
    df = spark.range(0, 40_000, 1, 4).select(F.lit("s").alias("site"), F.col("id").alias("step"), F.col("id").alias("v"))
    out = long_series.in_chunks(df, ["site"], ["step"], before=10, size=1000)
    per_chunk = out.groupBy("_chunk").agg(F.count(F.lit(1)).alias("n")).collect()
    assert len(per_chunk) == 41 and max(r.n for r in per_chunk) <= 1010  # the last holds a halo only
    assert long_series.running_total(df, ["site"], ["step"], "v", "t", 1000).filter("t <> step * (step + 1) div 2").isEmpty()
    with pytest.raises(ValueError):
        long_series.in_chunks(df, ["site"], ["step"], before=11, size=10)
    assert long_series.islands(df.limit(0), "site", F.col("step")).collect() == []
