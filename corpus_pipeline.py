"""From documents to training shards: five stages, each over all that its predecessor kept.

1. quality: documents that the classifier scores below its threshold go.
2. dedup: one document of each group of near-duplicates stays, the one with the smallest doc_id.
3. decontaminate: spans that repeat benchmark items are cut; documents that are mostly such spans go.
4. mix: documents are sampled so that token shares of sources, languages and topics meet their targets.
5. shard: every document gets its virtual slot, shard and version of the slot map.

All stages but the last return the columns of documents. What a stage returns is written as Parquet and read again as the
next one's docs, in the session's shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import decontaminate as leaks
from gridloom.llm import mixing, order_minhash, quality, sharding
from gridloom.llm.common import scratch_path, table

SHARDS = 16

#: SQL can't express the classifier's updates, the sketches or the alignment; tests hold run() against a brute-force version.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Trained on the labelled part of documents; null and empty texts are scored like any other."""
    model = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    columns = docs.columns
    inner = docs.select(F.struct(*columns).alias("row"), "text")
    return quality.with_score(inner, model, "score").filter(F.col("score") >= quality.THRESHOLD).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return order_minhash.deduplicate(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return leaks.cut(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, targets=None)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    sizes, _ = sharding.slot_totals(sharding.sized(docs))
    path = scratch_path(spark, "slots")
    sharding.store(spark, sharding.deal(sizes, SHARDS), path)
    return sharding.assign(docs, sharding.load(spark, path))


STAGES = [
    ("quality", keep_quality),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", cut_benchmark),
    ("mix", mix_sources),
    ("shard", assign_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
