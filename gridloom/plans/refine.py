"""From raw feeds to typed, de-duplicated, gap-aware tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import cleaning as c
from gridloom.functions.stats import pct_change, share_pct
from gridloom.operators.history import FEW, as_of_by_ranges, as_of_join, most_versions, to_versions
from gridloom.operators.keys import latest_per_key, split_rows
from gridloom.operators.series import along, forward_filled
from gridloom.sources.feeds import LINEAGE

RENEWABLE = ("solar", "wind", "hydro")
HEATING_BASE_C, COOLING_BASE_C = 18.0, 24.0
PEAK_HOURS = 4
TRACKED = ["site_name", "region", "customer_segment", "tariff_plan", "contracted_kw"]


def newest(*more):
    """Latest ingest first, then the file's name, so equal ingest times don't leave the choice open."""
    return [F.desc("_ingested_at"), *more, F.desc("_source_file")]


def typed_readings(raw: DataFrame) -> DataFrame:
    return raw.select(
        "reading_id",
        c.trimmed("site_id").alias("site_id"),
        c.to_timestamp("reading_ts").alias("reading_ts"),
        c.to_double("kwh_consumed").alias("kwh_consumed"),
        F.coalesce(c.to_double("kwh_exported"), F.lit(0.0)).alias("kwh_exported"),
        c.to_double("voltage_v").alias("voltage_v"),
        c.raised("quality_flag").alias("quality_flag"),
        *LINEAGE,
    )


def checked_readings(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected with reject_reason). A null consumption is valid; NaN, which Spark would let pass as large, is not."""
    return split_rows(
        typed_readings(raw),
        [
            ("missing_site_id", F.col("site_id").isNull() | (F.col("site_id") == "")),
            ("unparseable_timestamp", F.col("reading_ts").isNull()),
            ("not_a_number", F.isnan("kwh_consumed")),
            ("negative_consumption", F.col("kwh_consumed") < 0),
        ],
    )


def hourly(valid: DataFrame) -> DataFrame:
    """The newest reading of each site and hour."""
    return latest_per_key(valid.withColumn("reading_hour", F.date_trunc("hour", "reading_ts")), ["site_id", "reading_hour"], newest(F.desc("reading_id")))


def with_neighbours(hours: DataFrame, known: str | None = None) -> DataFrame:
    """hours with what depends on the rows before: filled values, gaps, changes. known: the filled value of rows for which it is settled already."""
    w = along("site_id", "reading_hour")
    given = F.col("kwh_consumed") if known is None else F.coalesce("kwh_consumed", known)
    apart = (F.unix_timestamp("reading_hour") - F.unix_timestamp(F.lag("reading_hour").over(w))) / 3600
    filled = hours.withColumns({"kwh_filled": F.coalesce(forward_filled(given, w), F.lit(0.0)), "gap_hours_before": F.greatest(apart - 1, F.lit(0.0)), "is_imputed": F.col("kwh_consumed").isNull()})
    at, previous = F.col("reading_hour"), F.lag("kwh_filled").over(w)
    calendar = {"reading_date": F.to_date(at), "hour_of_day": F.hour(at), "is_weekend": c.is_weekend(at)}
    return filled.withColumns(calendar | {"kwh_prev_hour": previous, "kwh_delta_vs_prev": F.col("kwh_filled") - previous})


def readings(raw: DataFrame) -> DataFrame:
    valid, _ = checked_readings(raw)
    return with_neighbours(hourly(valid))


def sites(raw: DataFrame) -> DataFrame:
    typed = raw.select(
        c.trimmed("site_id").alias("site_id"),
        c.trimmed("site_name").alias("site_name"),
        c.lowered("region").alias("region"),
        c.lowered("customer_segment").alias("customer_segment"),
        c.lowered("tariff_plan").alias("tariff_plan"),
        c.to_double("contracted_kw").alias("contracted_kw"),
        c.to_day("effective_from").alias("effective_from"),
        *LINEAGE,
    ).filter("site_id is not null and effective_from is not null")
    return to_versions(typed, "site_id", "effective_from", TRACKED, newest())


def with_site(facts: DataFrame, versions: DataFrame, time: str = "reading_hour") -> DataFrame:
    take = {"region": "region", "customer_segment": "customer_segment", "tariff_plan": "tariff_plan", "contracted_kw": "contracted_kw", "version": "site_version"}
    join = as_of_join if most_versions(versions, "site_id") <= FEW else as_of_by_ranges  # alike in what they give
    return join(facts, versions, "site_id", F.to_date(time), take)


def weather(raw: DataFrame) -> DataFrame:
    typed = raw.select(
        c.lowered("region").alias("region"),
        c.to_hour("observed_ts").alias("observed_hour"),
        *(c.to_double(x).alias(x) for x in ("temperature_c", "wind_speed_ms", "solar_irradiance_wm2", "humidity_pct")),
        *LINEAGE,
    ).filter("region is not null and observed_hour is not null")
    w = along("region", "observed_hour")
    filled = latest_per_key(typed, ["region", "observed_hour"], newest()).withColumn("temperature_c", forward_filled(F.col("temperature_c"), w))
    return filled.withColumns({
        "temperature_prev_day_c": F.lag("temperature_c", 24).over(w),
        "heating_degree_hours": F.greatest(F.lit(HEATING_BASE_C) - F.col("temperature_c"), F.lit(0.0)),
        "cooling_degree_hours": F.greatest(F.col("temperature_c") - F.lit(COOLING_BASE_C), F.lit(0.0)),
        "observed_date": F.to_date("observed_hour"),
    })


def prices(raw: DataFrame) -> DataFrame:
    typed = raw.select(
        c.lowered("region").alias("region"), c.lowered("market").alias("market"), c.to_hour("price_ts").alias("price_hour"), c.to_double("price_eur_mwh").alias("price_eur_mwh"), *LINEAGE
    ).filter("price_hour is not null and price_eur_mwh is not null")
    before = F.lag("price_eur_mwh").over(along(["region", "market"], "price_hour"))
    dated = latest_per_key(typed, ["region", "market", "price_hour"], newest()).withColumns({"price_date": F.to_date("price_hour"), "price_prev_hour": before})
    rank = F.rank().over(along(["region", "market", "price_date"], F.desc("price_eur_mwh")))
    return dated.withColumns({"price_change_pct": pct_change(F.col("price_eur_mwh"), F.col("price_prev_hour")), "price_rank_in_day": rank}).withColumn("is_peak_price_hour", F.col("price_rank_in_day") <= PEAK_HOURS)


def generation(raw: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    typed = raw.select(
        c.lowered("region").alias("region"), c.to_hour("generation_ts").alias("generation_hour"), c.lowered("source").alias("source"), c.to_double("generation_mw").alias("generation_mw"), *LINEAGE
    ).filter("generation_hour is not null and generation_mw is not null")
    latest = latest_per_key(typed, ["region", "generation_hour", "source"], newest())
    return latest.withColumn("region_total_mw", F.sum("generation_mw").over(Window.partitionBy("region", "generation_hour"))).withColumns({
        "share_pct": share_pct(F.col("generation_mw"), F.col("region_total_mw")),
        "is_renewable": F.col("source").isin(*RENEWABLE),
        "generation_date": F.to_date("generation_hour"),
    })
