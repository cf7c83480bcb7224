"""Tables: append, replace, keyed upsert.

Parquet tables have no MERGE; what is upserted becomes a keyed table there (see ``keyed``). A table format with MERGE of its own can be named in the
context instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession

from gridloom.context import RunContext
from gridloom.operators.keys import latest_per_key
from gridloom.sources import keyed

WITH_MERGE = ("delta", "iceberg")


def ensure_schema(spark: SparkSession, ctx: RunContext) -> None:
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {ctx.database}")


def exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name.replace("`", ""))


def append(df: DataFrame, name: str, ctx: RunContext) -> None:
    df.write.format(ctx.table_format).mode("append").saveAsTable(name)


def replace(df: DataFrame, name: str, ctx: RunContext, partition_by: Sequence[str] = ()) -> None:
    """The table holds df and has its schema afterwards."""
    if ctx.table_format not in WITH_MERGE and keyed.is_keyed(df.sparkSession, name):
        keyed.Keyed(df.sparkSession, name).drop()
    writer = df.write.format(ctx.table_format).mode("overwrite").option("overwriteSchema", "true")
    (writer.partitionBy(*partition_by) if partition_by else writer).saveAsTable(name)


def replace_partitions(df: DataFrame, name: str) -> None:
    """df takes the place of the table's partitions that it has rows of; the others stay. df must not read the table, and has its columns in its order."""
    conf, key = df.sparkSession.conf, "spark.sql.sources.partitionOverwriteMode"
    before = conf.get(key)
    conf.set(key, "dynamic")  # as an option of the write it doesn't reach tables of the catalog
    try:
        df.write.mode("overwrite").insertInto(name)
    finally:
        conf.set(key, before)


def upsert(spark: SparkSession, df: DataFrame, name: str, keys: Sequence[str], ctx: RunContext, newest_first: Sequence[Column] | None = None, repeated: bool = False, buckets: int = keyed.BUCKETS) -> None:
    """Rows of df replace those with equal keys (null equals null) and join the others; see keyed.upsert, which does it where the format has no MERGE.

    With newest_first a key keeps its newest row, whether df or the table has it.
    """
    if ctx.table_format not in WITH_MERGE:
        keyed.upsert(spark, df, name, keys, newest_first, repeated, buckets)
        return
    if not exists(spark, name):
        replace(df, name, ctx)
        return
    if newest_first:
        known = spark.table(name).join(df.select(*keys).distinct(), list(keys), "left_semi")
        df = latest_per_key(df.select(*known.columns).unionByName(known), keys, newest_first)
    on = " AND ".join(f"t.`{k}` <=> s.`{k}`" for k in keys)
    spark.sql(f"MERGE INTO {name} t USING {{source}} s ON {on} WHEN MATCHED THEN UPDATE SET * WHEN NOT MATCHED THEN INSERT *", source=df)
