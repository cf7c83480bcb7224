"""Connected components of an undirected graph by alternating large-star and small-star steps.

Every step is a join of two written tables and an aggregation; what a round made is written to the shared folder and read back, so
no lineage grows, Spark can split the joins' skew, and no links come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import delete_quietly, materialise


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of links (a, b); root is the smallest node of its component."""
    spark = links.sparkSession
    edges, path = materialise(links.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:  # two steps alike: no link has moved
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if state.n == 0 or state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least, least_path = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m")), "least")
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        large, large_path = materialise(large, "large")
        small, small_path = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "small")
        hung = large.join(small, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new, new_path = materialise(hung.unionByName(small.select("u", F.col("m").alias("v"))).distinct(), "edges")
        for old in (path, least_path, large_path, small_path):
            delete_quietly(spark, old)
        edges, path = new, new_path
