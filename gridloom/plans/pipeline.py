"""Stages in their order: generate, bronze, silver, gold, quality."""

from __future__ import annotations

import logging
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from gridloom.context import RunContext
from gridloom.plans import increment, marts, quality, refine
from gridloom.sources import landing, storage, synth
from gridloom.sources.feeds import FEEDS
from gridloom.sources.scratch import materialise

STAGES = ("generate", "bronze", "silver", "gold", "quality")
log = logging.getLogger(__name__)


def _put(df: DataFrame, ctx: RunContext, layer: str, name: str, by: Sequence[str] = ()) -> Observation | None:
    """Replace a table, and count on the way what fails its row rules."""
    gate = next((g for g in quality.GATES if (g.layer, g.table) == (layer, name)), None)
    df, seen = quality.watched(df, gate) if gate and quality.row_rules(gate) else (df, None)
    storage.replace(df, ctx.table(layer, name), ctx, by)
    return seen


def rebuild_silver(spark: SparkSession, ctx: RunContext) -> None:
    """Every silver table from all of bronze."""
    raw = lambda feed: spark.table(ctx.table("bronze", feed))
    loads = {feed: raw(feed).select(*increment.LOAD).distinct() for feed in FEEDS}
    held = {feed: materialise(df, "loads")[0] for feed, df in loads.items()}  # before their rows are read
    tables = {
        "meter_readings": (refine.readings(raw("meter_readings")), ("reading_date",)),
        "sites": (refine.sites(raw("sites")), ()),
        "weather": (refine.weather(raw("weather")), ()),
        "prices": (refine.prices(raw("prices")), ()),
        "generation_mix": (refine.generation(raw("generation_mix")), ()),
    }
    quality.note(spark, ctx, [_put(df, ctx, "silver", name, by) for name, (df, by) in tables.items()])
    _, rejected = refine.checked_readings(raw("meter_readings"))
    storage.replace(rejected, ctx.table("ops", "rejected_readings"), ctx)
    entered = reduce(DataFrame.unionByName, (df.select(F.lit(feed).alias("feed"), *increment.LOAD) for feed, df in held.items()))
    storage.replace(entered.coalesce(1), ctx.table("ops", "refined_loads"), ctx)


def run_silver(spark: SparkSession, ctx: RunContext, rebuild: bool = False) -> dict[str, int]:
    """What new loads change; everything where there is no silver yet, or where it shall be rebuilt."""
    if rebuild or not storage.exists(spark, ctx.table("ops", "refined_loads")):
        rebuild_silver(spark, ctx)
    else:
        increment.refresh_readings(spark, ctx)
        increment.refresh_sites(spark, ctx)
        for feed, build in (("weather", refine.weather), ("prices", refine.prices), ("generation_mix", refine.generation)):
            increment.refresh_whole(spark, ctx, feed, build)
    return {feed: spark.table(ctx.table("silver", feed)).count() for feed in FEEDS}


def run_gold(spark: SparkSession, ctx: RunContext) -> dict[str, int]:
    """Every mart anew. The as-of join that most of them read is written once as a table."""
    silver = lambda name: spark.table(ctx.table("silver", name))
    shared = ctx.table("silver", "readings_enriched")
    storage.replace(refine.with_site(silver("meter_readings"), silver("sites")), shared, ctx)
    inputs = marts.Inputs(silver("meter_readings"), spark.table(shared), silver("weather"), silver("prices"), silver("generation_mix"))
    quality.note(spark, ctx, [_put(mart.build(inputs), ctx, "gold", mart.name, mart.partition_by) for mart in marts.MARTS])
    return {mart.name: spark.table(ctx.table("gold", mart.name)).count() for mart in marts.MARTS}


def run_stage(spark: SparkSession, ctx: RunContext, stage: str, options: synth.Options | None = None):
    if stage not in STAGES:
        raise ValueError(f"no stage {stage!r}; there are {', '.join(STAGES)}")
    log.info("stage %s, run %s", stage, ctx.run_id)
    if stage == "generate":
        return synth.write_csv(synth.generate(options or synth.Options()), ctx.landing)
    storage.ensure_schema(spark, ctx)
    return {"bronze": landing.ingest_all, "silver": run_silver, "gold": run_gold, "quality": quality.enforce}[stage](spark, ctx)


def run_stages(spark: SparkSession, ctx: RunContext, stages: Sequence[str] = STAGES, options: synth.Options | None = None) -> dict:
    return {stage: run_stage(spark, ctx, stage, options) for stage in stages}
