"""Streaming ingest: the same files, found by a file stream whose checkpoint knows which it has read.

availableNow makes it a job that ends; rows go to the bronze table once each, as the batch ingest's do. Rows with keys go through
``upsert_stream``: a micro-batch that runs again after a failure gives the same table, since a key keeps its newest row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.context import RunContext
from gridloom.sources import storage
from gridloom.sources.feeds import raw_schema


def stream_csv(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("header", "true")
    reader = reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader
    return reader.csv(path).withColumn("_source_file", F.col("_metadata.file_path"))


def ingest_feed_stream(spark: SparkSession, ctx: RunContext, feed: str, checkpoint: str) -> None:
    stamped = stream_csv(spark, ctx.feed_path(feed), raw_schema(feed)).withColumns({"_ingested_at": F.current_timestamp(), "_batch_id": F.lit(ctx.run_id)})
    query = stamped.writeStream.format(ctx.table_format).option("checkpointLocation", f"{checkpoint}/{feed}").trigger(availableNow=True).toTable(ctx.table("bronze", feed))
    query.awaitTermination()


def upsert_stream(stream: DataFrame, ctx: RunContext, name: str, keys: Sequence[str], newest_first: Sequence[Column], checkpoint: str) -> None:
    """Upsert a stream's rows by key until it has none left. A key keeps its newest row of all batches, in whatever order these come."""

    def put(batch: DataFrame, _: int) -> None:
        storage.upsert(batch.sparkSession, batch, name, keys, ctx, newest_first)

    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
