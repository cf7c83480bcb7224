"""The raw feeds: names and order of their columns, all text, and keys of the refined tables."""

from __future__ import annotations

from pyspark.sql.types import StringType, StructField, StructType

# The feeds' columns in file order.
FEEDS = {
    "meter_readings": ["reading_id", "site_id", "reading_ts", "kwh_consumed", "kwh_exported", "voltage_v", "quality_flag"],
    "sites": ["site_id", "site_name", "region", "customer_segment", "tariff_plan", "contracted_kw", "effective_from"],
    "weather": ["region", "observed_ts", "temperature_c", "wind_speed_ms", "solar_irradiance_wm2", "humidity_pct"],
    "prices": ["region", "price_ts", "price_eur_mwh", "market"],
    "generation_mix": ["region", "generation_ts", "source", "generation_mw"],
}
LINEAGE = ["_source_file", "_ingested_at", "_batch_id"]
KEYS = {
    "meter_readings": ["site_id", "reading_hour"],
    "sites": ["site_id", "valid_from"],
    "weather": ["region", "observed_hour"],
    "prices": ["region", "market", "price_hour"],
    "generation_mix": ["region", "generation_hour", "source"],
}


def raw_schema(feed: str) -> StructType:
    return StructType([StructField(c, StringType(), True) for c in FEEDS[feed]])
