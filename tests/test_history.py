"""The as-of join by ranges against the join by interval."""

import random
from datetime import date, timedelta

from pyspark.sql import functions as F

from gridloom.operators import history

DAY = date(2020, 1, 1)


def test_ranges_give_what_intervals_give(spark):
    """Keys of many versions and of none, holes between versions, facts before the first and after the last, at borders, repeated, and with null keys and days."""
    r = random.Random(4)
    versions = []
    for key, n in (("many", 900), ("few", 3), ("one", 1)):
        at = DAY
        for i in range(n):
            end = at + timedelta(days=r.randrange(1, 4))
            versions.append((key, at, None if i == n - 1 and key != "few" else end, f"{key}{i}", i))
            at = end + timedelta(days=r.choice([0, 0, 0, 2]))
    facts = [(r.choice(["many", "many", "few", "one", "none", None]), DAY + timedelta(days=r.randrange(-5, 2500)), i % 40) for i in range(3000)] + [("many", None, 1), ("many", DAY, 2), ("many", DAY, 2)]
    f, v = spark.createDataFrame(facts, "k string, day date, n int").repartition(3), spark.createDataFrame(versions, "k string, valid_from date, valid_to date, name string, version int")
    take = {"name": "name", "version": "site_version"}
    rows = lambda df: sorted(map(repr, map(tuple, df.select("k", "day", "n", "name", "site_version").collect())))
    want = rows(history.as_of_join(f, v, "k", F.col("day"), take))
    assert rows(history.as_of_by_ranges(f, v, "k", F.col("day"), take)) == want and len(set(want)) > 900
    assert rows(history.as_of_by_ranges(f, v.limit(0), "k", F.col("day"), take)) == rows(history.as_of_join(f, v.limit(0), "k", F.col("day"), take))
    assert history.as_of_by_ranges(f.limit(0), v, "k", F.col("day"), take).collect() == [] and history.most_versions(v, "k") == 900


def test_one_key_is_in_many_tasks(spark):
    """A site that has all 20,000 versions and all facts: no task has more than its range, and no fact meets more than a version."""
    v = spark.range(20_000).select(F.lit("s").alias("k"), F.timestamp_seconds(F.col("id") * 10).alias("valid_from"), F.timestamp_seconds(F.col("id") * 10 + 10).alias("valid_to"), "id")
    f = spark.range(30_000).select(F.lit("s").alias("k"), F.timestamp_seconds(F.col("id") * 7).alias("ts"), F.col("id").alias("n"))
    out = history.as_of_by_ranges(f, v, "k", F.col("ts"), {"id": "found"})
    assert out.filter("found is distinct from if(n * 7 >= 200000, null, n * 7 div 10)").count() == 0 and out.count() == 30_000
    text = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_range" in text and text.count("Join") == 1
