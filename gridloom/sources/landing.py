"""Batch ingest of landed CSV files: each file once, with where it came from.

A ledger (ops_ingested_files) says which files a bronze table holds, so known files are listed but not read. A file is entered as
begun before its rows are written and as done afterwards; only files that an interrupted run left begun, or all where there is no ledger
yet, are looked up in the bronze table itself. Without a bronze table every file is new.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from gridloom.context import RunContext
from gridloom.sources import storage
from gridloom.sources.feeds import FEEDS, raw_schema


@dataclass(frozen=True)
class Ingested:
    feed: str
    rows: int
    files_ingested: int
    files_skipped: int


def read_csv(spark: SparkSession, path: str | list[str], feed: str) -> DataFrame:
    return spark.read.schema(raw_schema(feed)).option("header", "true").option("mode", "PERMISSIVE").csv(path).withColumn("_source_file", F.col("_metadata.file_path"))


def listed(spark: SparkSession, path: str) -> DataFrame:
    """path and _source_file of a folder's files; what is in them is not read."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("_metadata.file_path").alias("_source_file"))


def _literally(path: str) -> str:
    return re.sub(r"([\\\[\]{}*?])", r"\\\1", path)


def _enter(spark: SparkSession, ctx: RunContext, feed: str, files: Sequence[Row], state: str) -> None:
    rows = [(feed, f._source_file, state, ctx.run_id) for f in files]
    entries = spark.createDataFrame(rows, "feed string, _source_file string, state string, _batch_id string").withColumn("_entered_at", F.current_timestamp())
    storage.append(entries.coalesce(1), ctx.table("ops", "ingested_files"), ctx)


def _unread(spark: SparkSession, ctx: RunContext, feed: str, files: DataFrame) -> tuple[list[Row], list[Row]]:
    """(files to read, files that the bronze table holds although the ledger doesn't say so)."""
    name, ledger = ctx.table("bronze", feed), ctx.table("ops", "ingested_files")
    if not storage.exists(spark, name):
        return files.withColumn("in_doubt", F.lit(False)).collect(), []
    if storage.exists(spark, ledger):
        entered = spark.table(ledger).filter(F.col("feed") == feed).groupBy("_source_file").agg(F.max(F.col("state") == "done").alias("done"))
        open_ = files.join(entered, "_source_file", "left").filter(~F.coalesce("done", F.lit(False))).withColumn("in_doubt", F.col("done").isNotNull()).collect()
    else:
        open_ = files.withColumn("in_doubt", F.lit(True)).collect()
    doubtful = [(r._source_file,) for r in open_ if r.in_doubt]
    if not doubtful:
        return open_, []
    held = {r[0] for r in spark.table(name).select("_source_file").join(spark.createDataFrame(doubtful, "_source_file string"), "_source_file", "left_semi").distinct().collect()}
    return [r for r in open_ if r._source_file not in held], [r for r in open_ if r._source_file in held]


def ingest_feed(spark: SparkSession, ctx: RunContext, feed: str) -> Ingested:
    """Append the rows of files that the bronze table doesn't hold; an absent folder gives nothing."""
    name, folder = ctx.table("bronze", feed), ctx.feed_path(feed)
    try:
        files = listed(spark, folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return Ingested(feed, 0, 0, 0)
    new, held = _unread(spark, ctx, feed, files)
    skipped = files.count() - len(new)  # of the same listing, whatever lands meanwhile
    if held:
        _enter(spark, ctx, feed, held, "done")
    if not new:
        if not storage.exists(spark, name):  # an empty folder: the table is there all the same
            storage.append(_stamped(read_csv(spark, folder, feed), ctx), name, ctx)
        return Ingested(feed, 0, 0, skipped)
    _enter(spark, ctx, feed, new, "begun")
    written = Observation()
    storage.append(_stamped(read_csv(spark, [_literally(f.path) for f in new], feed), ctx).observe(written, F.count(F.lit(1)).alias("rows")), name, ctx)
    _enter(spark, ctx, feed, new, "done")
    return Ingested(feed, written.get["rows"], len(new), skipped)


def _stamped(rows: DataFrame, ctx: RunContext) -> DataFrame:
    return rows.withColumns({"_ingested_at": F.current_timestamp(), "_batch_id": F.lit(ctx.run_id)})


def ingest_all(spark: SparkSession, ctx: RunContext) -> list[Ingested]:
    return [ingest_feed(spark, ctx, feed) for feed in FEEDS]
