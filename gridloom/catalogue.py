"""Driver queries: every operator of the engine on the driver's tables, each with SQL that says the same.

Stand-ins: readings are events (site = user, value in kWh, events of type error lack a value); the mix is events by hour and type;
facts are orders with their customers' places; snapshots are orders as a customer's changing attributes. Money and measures have
two decimals at most and are summed as decimals, so sums don't depend on how rows are dealt out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions import cleaning, stats
from gridloom.operators import grouping, history, keys, long_series, ranking, series

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _dec(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(18,2)")


def _total(c: str | Column) -> Column:
    return F.sum(_dec(c)).cast("double")


def _long(**columns: Column) -> dict[str, Column]:
    return {k: v.cast("bigint") for k, v in columns.items()}


def _raw(spark: SparkSession, sf: str) -> DataFrame:
    e = _table(spark, sf, "events")
    return e.select(
        F.col("user_id").alias("site"), "event_id", "ts", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), F.when(F.col("event_type") != "error", F.col("value")).alias("kwh"), F.col("event_type").alias("flag")
    )


def _readings(spark: SparkSession, sf: str) -> DataFrame:
    return keys.latest_per_key(_raw(spark, sf), ["site", "hour"], [F.desc("ts"), F.desc("event_id")]).withColumns({
        "h": cleaning.hour_index(F.col("hour")), "day": F.to_date("hour"), "region": F.col("site") % 3
    })


def _days(spark: SparkSession, sf: str) -> DataFrame:
    return _readings(spark, sf).groupBy("site", "region", "day").agg(_total(F.coalesce("kwh", F.lit(0.0))).alias("kwh_total"), F.count(F.lit(1)).alias("hours"))


_R = """raw AS (
  SELECT user_id AS site, event_id, ts, date_trunc('hour', ts)::TIMESTAMP AS hour, CASE WHEN event_type <> 'error' THEN value END AS kwh, event_type AS flag FROM events
), r AS (
  SELECT * EXCLUDE (n), date_diff('day', DATE '1970-01-01', hour::DATE) * 24 + hour(hour) AS h, hour::DATE AS day, site % 3 AS region
  FROM (SELECT *, row_number() OVER (PARTITION BY site, hour ORDER BY ts DESC, event_id DESC) AS n FROM raw) WHERE n = 1
)"""
_D = _R + """, d AS (
  SELECT site, region, day, sum(coalesce(kwh, 0)::DECIMAL(18,2))::DOUBLE AS kwh_total, count(*) AS hours FROM r GROUP BY ALL
)"""


_M = """m AS (
  SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, event_type AS source, sum(value::DECIMAL(18,2))::DOUBLE AS mw FROM events GROUP BY ALL
)"""


def _mix(spark: SparkSession, sf: str) -> DataFrame:
    e = _table(spark, sf, "events")
    return e.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), F.col("event_type").alias("source")).agg(_total("value").alias("mw"))


def _facts(spark: SparkSession, sf: str) -> DataFrame:
    # The dimensions are TPC-H's smaller tables; Spark sizes them itself and broadcasts those under its threshold.
    place = _table(spark, sf, "nation").join(_table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    c = _table(spark, sf, "customer").join(place, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_mktsegment", "r_name")
    return _table(spark, sf, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_custkey").alias("site"), F.col("r_name").alias("region"), F.col("c_mktsegment").alias("segment"), F.col("o_orderpriority").alias("tariff"), F.col("o_totalprice").alias("kwh"),
        F.trunc(F.col("o_orderdate").cast("date"), "month").alias("month"),
    )


_F = """f AS (
  SELECT o_custkey AS site, r_name AS region, c_mktsegment AS segment, o_orderpriority AS tariff, o_totalprice AS kwh, date_trunc('month', o_orderdate)::DATE AS month
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""
_FM = _F + """, fm AS (SELECT site, region, segment, month, sum(kwh::DECIMAL(18,2))::DOUBLE AS total, count(*) AS n FROM f GROUP BY ALL)"""


def _fact_months(spark: SparkSession, sf: str) -> DataFrame:
    return _facts(spark, sf).groupBy("site", "region", "segment", "month").agg(_total("kwh").alias("total"), F.count(F.lit(1)).alias("n"))


@query("""SELECT event_id, TRY_CAST(v AS DOUBLE) AS as_double, TRY_CAST(t AS TIMESTAMP)::DATE AS as_day FROM (
  SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'n/a' ELSE event_id::VARCHAR END AS v, CASE WHEN event_id % 5 = 0 THEN 'not a date' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS t FROM events)""")
def q_safe_cast(spark, sf):
    text = _table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 7 == 0, "n/a").otherwise(F.col("event_id").cast("string")).alias("v"), F.when(F.col("event_id") % 5 == 0, "not a date").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("t"))
    return text.select("event_id", cleaning.to_double("v").alias("as_double"), cleaning.to_day("t").alias("as_day"))


@query("SELECT c_custkey, lower(trim('  ' || c_name || ' ')) AS lowered, upper(trim(c_mktsegment)) AS raised FROM customer")
def q_clean_projection(spark, sf):
    padded = _table(spark, sf, "customer").withColumn("c_name", F.concat(F.lit("  "), "c_name", F.lit(" ")))
    return padded.select("c_custkey", cleaning.lowered("c_name").alias("lowered"), cleaning.raised("c_mktsegment").alias("raised"))


@query("""SELECT reject_reason, count(*) AS n FROM (SELECT CASE WHEN event_id % 11 = 0 THEN 'missing_site' WHEN event_id % 13 = 0 THEN 'bad_time' WHEN value < 20 THEN 'low' END AS reject_reason FROM events) GROUP BY 1""")
def q_reject_reasons(spark, sf):
    valid, rejected = keys.split_rows(_table(spark, sf, "events"), [("missing_site", F.col("event_id") % 11 == 0), ("bad_time", F.col("event_id") % 13 == 0), ("low", F.col("value") < 20)])
    count = lambda df, reason: df.groupBy(reason.alias("reject_reason")).agg(F.count(F.lit(1)).alias("n"))
    return count(rejected, F.col("reject_reason")).unionByName(count(valid, F.lit(None).cast("string")))


@query(f"WITH {_R} SELECT site, hour, event_id, kwh, flag FROM r")
def q_dedupe_hour(spark, sf):
    return _readings(spark, sf).select("site", "hour", "event_id", "kwh", "flag")


@query(f"WITH {_R} SELECT site, hour, coalesce(last_value(kwh IGNORE NULLS) OVER (PARTITION BY site ORDER BY hour ROWS UNBOUNDED PRECEDING), 0.0) AS kwh_filled, kwh IS NULL AS is_imputed FROM r")
def q_forward_fill(spark, sf):
    filled = F.coalesce(series.forward_filled(F.col("kwh"), series.along("site", "hour")), F.lit(0.0))
    return _readings(spark, sf).select("site", "hour", filled.alias("kwh_filled"), F.col("kwh").isNull().alias("is_imputed"))


@query(f"WITH {_R} SELECT site, hour, greatest(coalesce(h - lag(h) OVER (PARTITION BY site ORDER BY h) - 1, 0), 0)::BIGINT AS gap_hours FROM r")
def q_gap_hours(spark, sf):
    gap = F.col("h") - F.lag("h").over(series.along("site", "h")) - 1
    return _readings(spark, sf).select("site", "hour", F.greatest(gap, F.lit(0)).cast("bigint").alias("gap_hours"))


@query(f"WITH {_R} SELECT site, hour, lag(kwh) OVER w AS before, (kwh::DECIMAL(18,2) - lag(kwh::DECIMAL(18,2)) OVER w)::DOUBLE AS delta FROM r WINDOW w AS (PARTITION BY site ORDER BY hour)")
def q_lag_delta(spark, sf):
    w = series.along("site", "hour")
    return _readings(spark, sf).select("site", "hour", F.lag("kwh").over(w).alias("before"), (_dec("kwh") - F.lag(_dec("kwh")).over(w)).cast("double").alias("delta"))


@query(f"WITH {_M} SELECT source, hour, mw, lag(mw, 24) OVER (PARTITION BY source ORDER BY hour) AS day_before FROM m")
def q_lag_24(spark, sf):
    return _mix(spark, sf).withColumn("day_before", F.lag("mw", 24).over(series.along("source", "hour")))


@query("SELECT event_id, hour(ts)::BIGINT AS hour_of_day, (dayofweek(ts) + 1)::BIGINT AS day_of_week, year(ts)::BIGINT AS year, dayofweek(ts) IN (0, 6) AS is_weekend, date_trunc('month', ts)::DATE AS month FROM events")
def q_calendar_parts(spark, sf):
    ts = F.col("ts")
    return _table(spark, sf, "events").select("event_id", *(v.alias(k) for k, v in _long(hour_of_day=F.hour(ts), day_of_week=F.dayofweek(ts), year=F.year(ts)).items()), cleaning.is_weekend(ts).alias("is_weekend"), cleaning.month_of(ts).alias("month"))


@query("SELECT event_id, greatest(18.0 - v, 0.0)::DOUBLE AS hdh, greatest(v - 24.0, 0.0)::DOUBLE AS cdh FROM (SELECT event_id, CASE WHEN event_type <> 'error' THEN value END::DOUBLE AS v FROM events)")
def q_degree_hours(spark, sf):
    v = F.when(F.col("event_type") != "error", F.col("value"))
    return _table(spark, sf, "events").select("event_id", F.greatest(F.lit(18.0) - v, F.lit(0.0)).alias("hdh"), F.greatest(v - F.lit(24.0), F.lit(0.0)).alias("cdh"))


@query(f"WITH {_M} SELECT *, (rank_in_day <= 4) AS is_peak FROM (SELECT source, hour, mw, rank() OVER (PARTITION BY source, hour::DATE ORDER BY mw DESC) AS rank_in_day FROM m)")
def q_intraday_rank(spark, sf):
    rank = F.rank().over(series.along(["source", F.to_date("hour")], F.desc("mw"))).cast("bigint")
    return _mix(spark, sf).withColumn("rank_in_day", rank).withColumn("is_peak", F.col("rank_in_day") <= 4)


@query(f"WITH {_M} SELECT hour, source, sum(mw::DECIMAL(18,2)) OVER w::DOUBLE AS total, round(mw / sum(mw::DECIMAL(18,2)) OVER w::DOUBLE, 6) AS share FROM m WINDOW w AS (PARTITION BY hour)")
def q_share_of_total(spark, sf):
    return _mix(spark, sf).withColumn("total", F.sum(_dec("mw")).over(Window.partitionBy("hour")).cast("double")).select("hour", "source", "total", F.round(F.try_divide("mw", "total"), 6).alias("share"))


@query(f"""WITH {_R}, d AS (
  SELECT site, day, sum(coalesce(kwh, 0)::DECIMAL(18,2)) AS t, max(kwh) AS peak, min(kwh) AS low, count(*) AS hours_observed, sum((kwh IS NULL)::INT)::BIGINT AS hours_imputed,
    arg_max(hour(hour), (coalesce(kwh, 0), -hour(hour)))::BIGINT AS peak_hour FROM r GROUP BY ALL)
SELECT site, day, t::DOUBLE AS kwh_total, peak AS kwh_peak, low AS kwh_min, hours_observed, hours_imputed, peak_hour, t::DOUBLE / hours_observed AS kwh_avg,
  lag(t) OVER w::DOUBLE AS kwh_prev_day, lag(t, 7) OVER w::DOUBLE AS kwh_prev_week, lead(t) OVER w::DOUBLE AS kwh_next_day,
  sum(t) OVER (w ROWS 6 PRECEDING)::DOUBLE / count(*) OVER (w ROWS 6 PRECEDING) AS kwh_ma_7, sum(t) OVER (PARTITION BY site, date_trunc('month', day) ORDER BY day ROWS UNBOUNDED PRECEDING)::DOUBLE AS kwh_mtd,
  row_number() OVER (PARTITION BY site, date_trunc('month', day) ORDER BY day) AS day_seq
FROM d WINDOW w AS (PARTITION BY site ORDER BY day)""")
def q_daily_kpis(spark, sf):
    """The flagship: one aggregation with the peak hour as argmax inside, then windows that share one exchange."""
    value = F.coalesce("kwh", F.lit(0.0))
    d = _readings(spark, sf).groupBy("site", "day").agg(
        F.sum(_dec(value)).alias("t"), F.max("kwh").alias("kwh_peak"), F.min("kwh").alias("kwh_min"), F.count(F.lit(1)).alias("hours_observed"), F.sum(F.col("kwh").isNull().cast("int")).alias("hours_imputed"),
        (-F.max(F.struct(value.alias("v"), (-F.hour("hour")).alias("h")))["h"]).cast("bigint").alias("peak_hour"),
    )
    w, month = series.along("site", "day"), series.along(["site", F.trunc("day", "month")], "day")
    week = series.last_n(w, 7)
    return d.select(
        "site", "day", F.col("t").cast("double").alias("kwh_total"), "kwh_peak", "kwh_min", "hours_observed", "hours_imputed", "peak_hour", (F.col("t").cast("double") / F.col("hours_observed")).alias("kwh_avg"),
        F.lag("t").over(w).cast("double").alias("kwh_prev_day"), F.lag("t", 7).over(w).cast("double").alias("kwh_prev_week"), F.lead("t").over(w).cast("double").alias("kwh_next_day"),
        (F.sum("t").over(week).cast("double") / F.count(F.lit(1)).over(week)).alias("kwh_ma_7"), F.sum("t").over(series.so_far(month)).cast("double").alias("kwh_mtd"), F.row_number().over(month).cast("bigint").alias("day_seq"),
    )


@query(f"""WITH {_D}, x AS (SELECT *, date_diff('day', DATE '1970-01-01', day) AS n, kwh_total::DECIMAL(18,2) AS t FROM d)
SELECT site, day, sum(t) OVER a::DOUBLE / count(*) OVER a AS by_rows, sum(t) OVER b::DOUBLE / count(*) OVER b AS by_days FROM x
WINDOW a AS (PARTITION BY site ORDER BY n ROWS 6 PRECEDING), b AS (PARTITION BY site ORDER BY n RANGE 6 PRECEDING)""")
def q_rows_vs_range(spark, sf):
    a, b = series.last_n(series.along("site", "day"), 7), series.last_days("site", "day", 7)
    mean = lambda w: F.sum(_dec("kwh_total")).over(w).cast("double") / F.count(F.lit(1)).over(w)
    return _days(spark, sf).select("site", "day", mean(a).alias("by_rows"), mean(b).alias("by_days"))


@query("""SELECT o_custkey, day, sum(t) OVER (PARTITION BY o_custkey, date_trunc('month', day) ORDER BY day ROWS UNBOUNDED PRECEDING)::DOUBLE AS mtd
FROM (SELECT o_custkey, o_orderdate::DATE AS day, sum(o_totalprice::DECIMAL(18,2)) AS t FROM orders GROUP BY ALL)""")
def q_mtd_running(spark, sf):
    d = _table(spark, sf, "orders").groupBy("o_custkey", F.to_date("o_orderdate").alias("day")).agg(F.sum(_dec("o_totalprice")).alias("t"))
    return d.select("o_custkey", "day", F.sum("t").over(series.so_far(series.along(["o_custkey", F.trunc("day", "month")], "day"))).cast("double").alias("mtd"))


@query(f"""WITH {_FM} SELECT site, month, total, n, lag(total) OVER w AS prev_month, lead(total) OVER w AS next_month, rank() OVER (PARTITION BY month, region ORDER BY total DESC) AS rank_in_region,
  dense_rank() OVER (PARTITION BY month ORDER BY total DESC) AS dense_rank_overall, row_number() OVER (PARTITION BY month ORDER BY total DESC, site) AS row_num,
  ntile(4) OVER (PARTITION BY month ORDER BY total, site) AS quartile, round(total / sum(total::DECIMAL(18,2)) OVER (PARTITION BY month, region)::DOUBLE, 6) AS share_of_region,
  first_value(site) OVER (PARTITION BY month, region ORDER BY total DESC, site) AS top_site, last_value(site) OVER (PARTITION BY month, region ORDER BY total DESC, site ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS bottom_site
FROM fm WINDOW w AS (PARTITION BY site ORDER BY month)""")
def q_monthly_kpis(spark, sf):
    w, region, down = series.along("site", "month"), Window.partitionBy("month", "region"), F.desc("total")
    placed, month = ranking.place_by(_fact_months(spark, sf), ["month"], "total", ["site"], "m")
    return placed.select(
        "site", "month", "total", "n", F.lag("total").over(w).alias("prev_month"), F.lead("total").over(w).alias("next_month"), F.rank().over(region.orderBy(down)).cast("bigint").alias("rank_in_region"),
        month.dense_rank_down.cast("bigint").alias("dense_rank_overall"), month.row_number_down.cast("bigint").alias("row_num"), month.tile(4).cast("bigint").alias("quartile"),
        F.round(F.col("total") / F.sum(_dec("total")).over(region).cast("double"), 6).alias("share_of_region"), F.first("site").over(region.orderBy(down, "site")).alias("top_site"), F.last("site").over(series.whole(region.orderBy(down, "site"))).alias("bottom_site"),
    )


@query(f"WITH {_FM} SELECT site, month, sum(total::DECIMAL(18,2)) OVER (PARTITION BY site, year(month) ORDER BY month ROWS UNBOUNDED PRECEDING)::DOUBLE AS ytd FROM fm")
def q_ytd(spark, sf):
    return _fact_months(spark, sf).select("site", "month", F.sum(_dec("total")).over(series.so_far(series.along(["site", F.year("month")], "month"))).cast("double").alias("ytd"))


@query(f"""WITH {_R}, x AS (SELECT site, day, hour, kwh, rank() OVER (PARTITION BY site, day ORDER BY kwh DESC NULLS LAST) AS rank_in_day, row_number() OVER (PARTITION BY site, day ORDER BY kwh DESC NULLS LAST, hour) AS nth,
  max(kwh) OVER (PARTITION BY site, day) AS day_peak, first_value(kwh) OVER v AS first_kwh, last_value(kwh) OVER v AS last_kwh FROM r
  WINDOW v AS (PARTITION BY site, day ORDER BY hour ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) SELECT * FROM x WHERE nth <= 3""")
def q_top3_per_group(spark, sf):
    day, down = ["site", "day"], F.desc_nulls_last("kwh")
    r, w = ranking.ranks(day, down, ["hour"]), series.whole(series.along(day, "hour"))
    return _readings(spark, sf).select("site", "day", "hour", "kwh", r["rank"].cast("bigint").alias("rank_in_day"), r["row_number"].cast("bigint").alias("nth"), F.max("kwh").over(w).alias("day_peak"), F.first("kwh").over(w).alias("first_kwh"), F.last("kwh").over(w).alias("last_kwh")).filter("nth <= 3")


@query("""SELECT o_orderkey, rank() OVER w AS rank, dense_rank() OVER w AS dense_rank, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority DESC, o_orderkey) AS row_number
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority DESC)""")
def q_rank_family(spark, sf):
    return _table(spark, sf, "orders").select("o_orderkey", *(v.cast("bigint").alias(k) for k, v in ranking.ranks(["o_custkey"], F.desc("o_orderpriority"), ["o_orderkey"]).items()))


@query(f"""WITH {_FM} SELECT site, month, round(percent_rank() OVER w, 4) AS percent_rank, round(cume_dist() OVER w, 4) AS cume_dist, ntile(10) OVER (PARTITION BY month ORDER BY total, site) AS tile,
  rank() OVER (PARTITION BY month, segment ORDER BY total DESC) AS rank_in_segment FROM fm WINDOW w AS (PARTITION BY month ORDER BY total)""")
def q_distribution(spark, sf):
    placed, month = ranking.place_by(_fact_months(spark, sf), ["month"], "total", ["site"], "m")
    in_segment = F.rank().over(series.along(["month", "segment"], F.desc("total"))).cast("bigint")
    return placed.select("site", "month", F.round(month.percent_rank, 4).alias("percent_rank"), F.round(month.cume_dist, 4).alias("cume_dist"), month.tile(10).cast("bigint").alias("tile"), in_segment.alias("rank_in_segment"))


@query(f"""WITH {_FM}, s AS (SELECT segment, month, quantile_disc(total, 0.5) AS p50, quantile_disc(total, 0.9) AS p90, count(*) AS sites FROM fm GROUP BY ALL)
SELECT site, month, p50, p90, sites, total > p90 AS above_p90 FROM fm LEFT JOIN s USING (segment, month)""")
def q_segment_percentiles(spark, sf):
    m = _fact_months(spark, sf)
    s = ranking.quantiles(m, ["segment", "month"], "total", {"p50": 0.5, "p90": 0.9}, "sites")
    return m.join(s, ["segment", "month"], "left").select("site", "month", "p50", "p90", "sites", (F.col("total") > F.col("p90")).alias("above_p90"))


@query(f"""WITH {_FM} SELECT site, month, first_value(total) OVER w AS first_total, last_value(total) OVER w AS last_total FROM fm WINDOW w AS (PARTITION BY site ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def q_first_last_value(spark, sf):
    w = series.whole(series.along("site", "month"))
    return _fact_months(spark, sf).select("site", "month", F.first("total").over(w).alias("first_total"), F.last("total").over(w).alias("last_total"))


@query("""SELECT event_id, lag(value, 24) OVER w AS earlier, sum(value::DECIMAL(18,2)) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)::DOUBLE AS last_7,
  last_value(CASE WHEN event_id % 50 = 0 THEN value END IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) AS filled, sum(value::DECIMAL(18,2)) OVER (w ROWS UNBOUNDED PRECEDING)::DOUBLE AS so_far
FROM events WINDOW w AS (ORDER BY ts, event_id)""")
def q_long_series(spark, sf):
    """All events as one series: windows in chunks of a few thousand rows, with halos and carries, so that no task has it whole."""
    one = _table(spark, sf, "events").select(F.lit("all").alias("series"), "event_id", "ts", "value", _dec("value").alias("exact"), F.when(F.col("event_id") % 50 == 0, F.col("value")).alias("rare"))
    key, order, size = ["series"], ["ts", "event_id"], 4096
    w = long_series.along_chunk(key)
    near = long_series.with_windows(one, key, order, {"earlier": F.lag("value", 24).over(w), "last_7": F.sum("exact").over(series.last_n(w, 7)).cast("double")}, before=24, size=size)
    filled = long_series.forward_filled(near, key, order, "rare", "filled", size)
    return long_series.running_total(filled, key, order, "exact", "total", size).select("event_id", "earlier", "last_7", "filled", F.col("total").cast("double").alias("so_far"))


_ISLANDS = f"""WITH {_R}, e AS (SELECT DISTINCT site, date_diff('day', DATE '1970-01-01', day) AS n FROM r WHERE flag = 'error'), i AS (
  SELECT site, min(n)::BIGINT AS first_step, max(n)::BIGINT AS last_step, count(*) AS steps FROM (SELECT *, n - row_number() OVER (PARTITION BY site ORDER BY n) AS g FROM e) GROUP BY site, g)"""


def _error_islands(spark: SparkSession, sf: str) -> DataFrame:
    e = _readings(spark, sf).filter("flag = 'error'").select("site", "day").distinct()
    return series.islands(e, "site", F.datediff("day", F.lit("1970-01-01").cast("date")).cast("bigint"))


@query(f"{_ISLANDS} SELECT * FROM i")
def q_zero_islands(spark, sf):
    return _error_islands(spark, sf)


_HOLES = "SELECT site, (b + 1)::BIGINT AS first_step, (n - 1)::BIGINT AS last_step, (n - b - 1)::BIGINT AS steps FROM (SELECT site, n, lag(n) OVER (PARTITION BY site ORDER BY n) AS b FROM (SELECT DISTINCT site, date_diff('day', DATE '1970-01-01', day) AS n FROM r)) WHERE n - b > 1"


def _day_holes(spark: SparkSession, sf: str) -> DataFrame:
    n = F.datediff("day", F.lit("1970-01-01").cast("date")).cast("bigint")
    d = _readings(spark, sf).select("site", n.alias("n")).distinct().withColumn("b", F.lag("n").over(series.along("site", "n")))
    return d.filter("n - b > 1").select("site", (F.col("b") + 1).alias("first_step"), (F.col("n") - 1).alias("last_step"), (F.col("n") - F.col("b") - 1).alias("steps"))


@query(f"WITH {_R} {_HOLES}")
def q_missing_holes(spark, sf):
    return _day_holes(spark, sf)


@query(f"""{_ISLANDS}, u AS (SELECT *, 'ERROR' AS kind FROM i UNION ALL SELECT *, 'MISSING' FROM ({_HOLES}))
SELECT *, dense_rank() OVER (PARTITION BY site ORDER BY steps DESC) AS by_length, row_number() OVER w AS seq, lead(first_step) OVER w - last_step - 1 AS until_next, first_step - lag(last_step) OVER w - 1 AS since_previous
FROM u WINDOW w AS (PARTITION BY site ORDER BY first_step, kind)""")
def q_outage_union(spark, sf):
    u = _error_islands(spark, sf).withColumn("kind", F.lit("ERROR")).unionByName(_day_holes(spark, sf).withColumn("kind", F.lit("MISSING")))
    w = series.along("site", ["first_step", "kind"])
    return u.withColumns(_long(by_length=F.dense_rank().over(series.along("site", F.desc("steps"))), seq=F.row_number().over(w), until_next=F.lead("first_step").over(w) - F.col("last_step") - 1, since_previous=F.col("first_step") - F.lag("last_step").over(w) - 1))


_COST = f"""WITH {_R}, p AS (
  SELECT user_id % 3 AS region, date_trunc('hour', ts)::TIMESTAMP AS hour, max(value)::DECIMAL(18,2) AS price FROM events WHERE event_type = 'purchase' GROUP BY ALL), c AS (
  SELECT site, r.region, day, sum(coalesce(kwh, 0)::DECIMAL(18,2) * price)::DOUBLE AS cost, sum(coalesce(kwh, 0)::DECIMAL(18,2))::DOUBLE AS kwh, sum((price IS NULL)::INT)::BIGINT AS hours_without_price
  FROM r LEFT JOIN p ON r.region = p.region AND r.hour = p.hour GROUP BY ALL)"""


def _cost(spark: SparkSession, sf: str) -> DataFrame:
    e = _table(spark, sf, "events").filter("event_type = 'purchase'")
    p = e.groupBy((F.col("user_id") % 3).alias("region"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(_dec(F.max("value")).alias("price"))
    kwh = _dec(F.coalesce("kwh", F.lit(0.0)))
    return _readings(spark, sf).join(p, ["region", "hour"], "left").groupBy("site", "region", "day").agg(F.sum(kwh * F.col("price")).cast("double").alias("cost"), F.sum(kwh).cast("double").alias("kwh"), F.sum(F.col("price").isNull().cast("int")).alias("hours_without_price"))


@query(f"{_COST} SELECT * FROM c")
def q_hourly_cost(spark, sf):
    return _cost(spark, sf)


@query("""SELECT l_suppkey, round(sum(l_quantity::DECIMAL(18,2) * l_extendedprice::DECIMAL(18,2))::DOUBLE / nullif(sum(l_quantity::DECIMAL(18,2))::DOUBLE, 0), 4) AS weighted_price FROM lineitem GROUP BY 1""")
def q_weighted_price(spark, sf):
    q = _dec("l_quantity")
    return _table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.round(F.sum(q * _dec("l_extendedprice")).cast("double") / F.nullif(F.sum(q).cast("double"), F.lit(0.0)), 4).alias("weighted_price"))


@query(f"""{_COST} SELECT site, day, rank() OVER (PARTITION BY site, date_trunc('month', day) ORDER BY cost DESC NULLS LAST) AS rank_in_month, ntile(4) OVER (PARTITION BY region, day ORDER BY cost NULLS FIRST, site) AS quartile, lag(cost) OVER (PARTITION BY site ORDER BY day) AS before FROM c""")
def q_cost_quartile(spark, sf):
    return _cost(spark, sf).select("site", "day", F.rank().over(series.along(["site", F.trunc("day", "month")], F.desc_nulls_last("cost"))).cast("bigint").alias("rank_in_month"), F.ntile(4).over(series.along(["region", "day"], [F.asc_nulls_first("cost"), "site"])).cast("bigint").alias("quartile"), F.lag("cost").over(series.along("site", "day")).alias("before"))


@query(f"""WITH {_R}, s AS (SELECT site, day, hour, kwh, avg(kwh) OVER w AS m, stddev_samp(kwh) OVER w AS sd, count(kwh) OVER w AS n FROM r WINDOW w AS (PARTITION BY site ORDER BY hour ROWS BETWEEN 168 PRECEDING AND 1 PRECEDING)), z AS (
  SELECT *, CASE WHEN n >= 24 AND sd > 0 THEN round((kwh - m) / sd, 3) END AS z FROM s)
SELECT site, hour, n AS baseline_rows, z AS z_score, CASE WHEN z > 0 THEN 'SPIKE' ELSE 'DROP' END AS kind, count(*) OVER (PARTITION BY site, day) AS in_day FROM z WHERE abs(z) > 2""")
def q_anomalies(spark, sf):
    z = series.z_scored(_readings(spark, sf), "kwh", series.along("site", "hour"), 168, 24).filter(F.abs("z_score") > 2)
    return z.select("site", "hour", "baseline_rows", "z_score", F.when(F.col("z_score") > 0, "SPIKE").otherwise("DROP").alias("kind"), F.count(F.lit(1)).over(Window.partitionBy("site", "day")).alias("in_day"))


@query("""WITH g AS (SELECT l_returnflag AS flag, date_trunc('month', l_shipdate)::DATE AS month, covar_samp(l_extendedprice, l_quantity) AS c, stddev_samp(l_extendedprice) AS sy, stddev_samp(l_quantity) AS sx, var_samp(l_quantity) AS vx, avg(l_extendedprice) AS my, avg(l_quantity) AS mx, count(*) AS n FROM lineitem GROUP BY ALL), h AS (
  SELECT flag, month, n, round(c / nullif(sx * sy, 0), 4) AS r, round(c / nullif(vx, 0), 4) AS slope, round(my - c / nullif(vx, 0) * mx, 3) AS intercept FROM g)
SELECT *, round(r - lag(r) OVER (PARTITION BY flag ORDER BY month), 4) AS shift, rank() OVER (PARTITION BY flag ORDER BY abs(r) DESC NULLS LAST) AS strength FROM h""")
def q_regression(spark, sf):
    of, line = ["flag", "month", "n"], stats.Line(F.col("m"))
    pairs = _table(spark, sf, "lineitem").withColumns({"flag": F.col("l_returnflag"), "month": cleaning.month_of(F.col("l_shipdate"))})
    h = pairs.groupBy("flag", "month").agg(F.count(F.lit(1)).alias("n"), stats.moments(F.col("l_quantity"), F.col("l_extendedprice")).alias("m"))
    h = h.select(*of, F.round(line.fit, 4).alias("r"), F.round(line.rise, 4).alias("slope"), F.round(line.at_zero, 3).alias("intercept"))
    return h.withColumns({"shift": F.round(F.col("r") - F.lag("r").over(series.along("flag", "month")), 4), "strength": F.rank().over(series.along("flag", F.abs("r").desc_nulls_last())).cast("bigint")})


_V = """s AS (SELECT o_custkey AS site, o_orderdate::DATE AS valid_from, o_orderpriority AS tariff, o_orderstatus AS status, row_number() OVER (PARTITION BY o_custkey, o_orderdate::DATE ORDER BY o_orderkey DESC) AS k FROM orders), h AS (
  SELECT *, sha256(concat_ws('||', coalesce(tariff, ''), coalesce(status, ''))) AS attr_hash FROM s WHERE k = 1), c AS (
  SELECT * FROM (SELECT *, lag(attr_hash) OVER (PARTITION BY site ORDER BY valid_from) AS b FROM h) WHERE b IS NULL OR b <> attr_hash), v AS (
  SELECT site, tariff, status, attr_hash, valid_from, lead(valid_from) OVER w AS valid_to, lead(valid_from) OVER w IS NULL AS is_current, row_number() OVER w AS version FROM c WINDOW w AS (PARTITION BY site ORDER BY valid_from))"""


def _versions(spark: SparkSession, sf: str) -> DataFrame:
    s = _table(spark, sf, "orders").select(F.col("o_custkey").alias("site"), F.to_date("o_orderdate").alias("effective"), F.col("o_orderpriority").alias("tariff"), F.col("o_orderstatus").alias("status"), "o_orderkey")
    return history.to_versions(s, "site", "effective", ["tariff", "status"], [F.desc("o_orderkey")]).withColumn("version", F.col("version").cast("bigint"))


@query(f"WITH {_V} SELECT * FROM v")
def q_scd2_build(spark, sf):
    return _versions(spark, sf)


@query(f"""WITH {_V} SELECT l_orderkey, l_linenumber, o_custkey AS site, v.tariff, v.version FROM lineitem JOIN orders ON l_orderkey = o_orderkey
LEFT JOIN v ON o_custkey = v.site AND l_shipdate::DATE >= v.valid_from AND l_shipdate::DATE < coalesce(v.valid_to, DATE '9999-12-31')""")
def q_as_of_join(spark, sf):
    f = _table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate").join(_table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("site")), "l_orderkey")
    return history.as_of_join(f, _versions(spark, sf), "site", F.to_date("l_shipdate"), {"tariff": "tariff", "version": "version"}).drop("l_shipdate")


@query("""WITH v AS (SELECT event_type, date_trunc('hour', ts)::TIMESTAMP AS hour, max(event_id) AS newest FROM events GROUP BY ALL)
SELECT e.event_id, v.newest FROM (SELECT event_id, event_type, (ts - INTERVAL 90 MINUTE)::TIMESTAMP AS at FROM events) e ASOF LEFT JOIN v ON e.event_type = v.event_type AND e.at >= v.hour""")
def q_as_of_many(spark, sf):
    """Five keys of a version for each hour: what an event's type had as its newest 90 minutes before."""
    e = _table(spark, sf, "events")
    hours = e.groupBy("event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("valid_from")).agg(F.max("event_id").alias("newest"))
    versions = hours.withColumn("valid_to", F.lead("valid_from").over(series.along("event_type", "valid_from")))
    return history.as_of_by_ranges(e.select("event_id", "event_type", "ts"), versions, "event_type", F.col("ts").cast("timestamp_ntz") - F.expr("INTERVAL 90 MINUTES"), {"newest": "newest"}).select("event_id", "newest")


@query(f"""WITH {_V} SELECT 'one_current' AS check_name, count(*) AS failing FROM (SELECT site FROM v GROUP BY 1 HAVING sum(is_current::INT) <> 1)
UNION ALL SELECT 'contiguous', count(*) FROM (SELECT valid_to, lead(valid_from) OVER (PARTITION BY site ORDER BY valid_from) AS n FROM v) WHERE valid_to <> n""")
def q_scd2_checks(spark, sf):
    v = _versions(spark, sf)
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("failing")).select(F.lit(name).alias("check_name"), "failing")
    return count(history.not_one_current(v, "site"), "one_current").unionByName(count(history.broken_chains(v, "site"), "contiguous"))


@query(f"""WITH {_F}, g AS (SELECT month, region, segment, tariff, grouping_id(month, region, segment, tariff)::BIGINT AS level, sum(kwh::DECIMAL(18,2)) AS t, count(DISTINCT site) AS sites FROM f
  GROUP BY GROUPING SETS ((month, region, segment, tariff), (month, region, segment), (month, region), (month)))
SELECT month, region, segment, tariff, level, t::DOUBLE AS total, sites, round(t::DOUBLE / max(CASE WHEN level = 7 THEN t END) OVER (PARTITION BY month)::DOUBLE, 6) AS share, rank() OVER (PARTITION BY month, level ORDER BY t DESC) AS rank_in_level FROM g""")
def q_grouping_sets(spark, sf):
    dims = ["region", "segment", "tariff"]
    sums = _facts(spark, sf).groupBy("month", *dims, "site").agg(F.sum(_dec("kwh")).alias("kwh"))  # before rows expand
    g = grouping.prefix_sets(sums, ["month"], dims, {"t": "sum(kwh)", "sites": "count(distinct site)"})
    level = F.col("grouping_level").cast("bigint")
    top = F.max(F.when(level == 7, F.col("t"))).over(Window.partitionBy("month")).cast("double")
    return g.select("month", "region", "segment", "tariff", level.alias("level"), F.col("t").cast("double").alias("total"), "sites", F.round(F.col("t").cast("double") / top, 6).alias("share"), F.rank().over(series.along(["month", "grouping_level"], F.desc("t"))).cast("bigint").alias("rank_in_level"))


_KINDS = ["click", "error", "purchase", "signup", "view"]


@query("SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, " + ", ".join(f"(sum(value::DECIMAL(18,2)) FILTER (event_type = '{k}'))::DOUBLE AS {k}_mw" for k in _KINDS) + " FROM events GROUP BY 1")
def q_pivot_mix(spark, sf):
    sums = grouping.pivot_sums(["hour"], "event_type", _KINDS, _dec("value"), "_mw")
    return _table(spark, sf, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(*sums).select("hour", *(F.col(f"{k}_mw").cast("double").alias(f"{k}_mw") for k in _KINDS))


@query(f"WITH {_M} SELECT hour, arg_min(source, (-mw, source)) AS dominant, arg_min(source, (mw, source)) AS smallest FROM m GROUP BY 1")
def q_dominant_source(spark, sf):
    first = lambda mw: F.min(F.struct(mw.alias("m"), F.col("source").alias("s")))["s"]
    return _mix(spark, sf).groupBy("hour").agg(first(-F.col("mw")).alias("dominant"), first(F.col("mw")).alias("smallest"))


@query(f"WITH {_M} SELECT source, hour, sum(mw::DECIMAL(18,2)) OVER w::DOUBLE / count(*) OVER w AS rolling FROM m WINDOW w AS (PARTITION BY source ORDER BY hour ROWS 23 PRECEDING)")
def q_rolling_24(spark, sf):
    w = series.last_n(series.along("source", "hour"), 24)
    return _mix(spark, sf).select("source", "hour", (F.sum(_dec("mw")).over(w).cast("double") / F.count(F.lit(1)).over(w)).alias("rolling"))


@query(f"WITH {_M} SELECT source, hour, ntile(10) OVER (PARTITION BY source, date_trunc('month', hour) ORDER BY mw, hour) AS decile, round(cume_dist() OVER (PARTITION BY source, date_trunc('month', hour) ORDER BY mw), 4) AS cume_dist FROM m")
def q_decile_in_month(spark, sf):
    s = ranking.spread(["source", F.trunc(F.col("hour").cast("date"), "month")], F.col("mw"), 10, ["hour"])
    return _mix(spark, sf).select("source", "hour", s["tile"].cast("bigint").alias("decile"), s["cume_dist"].alias("cume_dist"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate >= DATE '2001-06-01')")
def q_anti_join_new(spark, sf):
    seen = _table(spark, sf, "orders").filter(F.col("o_orderdate") >= F.lit("2001-06-01").cast("timestamp_ntz")).select(F.col("o_custkey").alias("c_custkey"))
    return keys.not_seen(_table(spark, sf, "customer").select("c_custkey", "c_name"), seen, "c_custkey")


@query(f"WITH {_R}, a AS (SELECT hour, max(mw) AS top FROM (SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, event_type, sum(value::DECIMAL(18,2))::DOUBLE AS mw FROM events WHERE event_type = 'view' GROUP BY ALL) GROUP BY 1) SELECT site, r.hour, kwh, top FROM r JOIN a ON r.hour = a.hour")
def q_inner_weather(spark, sf):
    return _readings(spark, sf).select("site", "hour", "kwh").join(_mix(spark, sf).filter("source = 'view'").groupBy("hour").agg(F.max("mw").alias("top")), "hour").select("site", "hour", "kwh", "top")


@query("""WITH t AS (SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 3 <> 0), s AS (SELECT o_orderkey, 'X' AS o_orderstatus FROM orders WHERE o_orderkey % 2 = 0)
SELECT * FROM s UNION ALL SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.o_orderkey = t.o_orderkey)""")
def q_upsert_result(spark, sf):
    """Through tables: create, then upsert by key."""
    from gridloom.sources import storage

    o = _table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    ctx, name = _own(spark, "silver", "upsert")
    storage.upsert(spark, o.filter("o_orderkey % 3 != 0"), name, ["o_orderkey"], ctx)
    storage.upsert(spark, o.filter("o_orderkey % 2 = 0").withColumn("o_orderstatus", F.lit("X")), name, ["o_orderkey"], ctx)
    return spark.table(name)


@query("SELECT user_id, hour, count(*) AS copies FROM (SELECT user_id, date_trunc('hour', ts)::TIMESTAMP AS hour FROM events) GROUP BY ALL HAVING count(*) > 1")
def q_dup_keys(spark, sf):
    return keys.duplicate_keys(_table(spark, sf, "events").select("user_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")), ["user_id", "hour"])


@query(f"""WITH {_D}, c AS (SELECT 'events_non_negative' AS check_name, count(*) AS failing_rows FROM events WHERE value < 0
UNION ALL SELECT 'events_high_values', count(*) FROM events WHERE value > 480
UNION ALL SELECT 'readings_unique', count(*) FROM (SELECT 1 FROM r GROUP BY site, hour HAVING count(*) > 1)
UNION ALL SELECT 'events_unique_hour', count(*) FROM (SELECT 1 FROM events GROUP BY user_id, date_trunc('hour', ts) HAVING count(*) > 1)
UNION ALL SELECT 'days_no_null', count(*) FROM d WHERE kwh_total IS NULL) SELECT *, failing_rows = 0 AS passed FROM c""")
def q_quality_ledger(spark, sf):
    e, r = _table(spark, sf, "events"), _readings(spark, sf)
    hourly = e.select("user_id", F.date_trunc("hour", "ts").alias("hour"))
    bad = {
        "events_non_negative": e.filter("value < 0"), "events_high_values": e.filter("value > 480"), "readings_unique": keys.duplicate_keys(r, ["site", "hour"]),
        "events_unique_hour": keys.duplicate_keys(hourly, ["user_id", "hour"]), "days_no_null": _days(spark, sf).filter("kwh_total is null"),
    }
    out = None
    for name, df in bad.items():
        row = df.agg(F.count(F.lit(1)).alias("failing_rows")).select(F.lit(name).alias("check_name"), "failing_rows", (F.col("failing_rows") == 0).alias("passed"))
        out = row if out is None else out.unionByName(row)
    return out


@query(f"WITH {_D} SELECT site, day, lag(kwh_total) OVER w IS NULL AS lacks_previous, row_number() OVER w AS nth FROM d WINDOW w AS (PARTITION BY site ORDER BY day)")
def q_first_row_null_lag(spark, sf):
    w = series.along("site", "day")
    return _days(spark, sf).select("site", "day", F.lag("kwh_total").over(w).isNull().alias("lacks_previous"), F.row_number().over(w).cast("bigint").alias("nth"))


def _landed(spark: SparkSession, sf: str, files: int | None = None) -> str:
    """Events as CSV files in the session's shared folder; so many files, each of some users' and times' events, where a number is given."""
    from gridloom.sources.scratch import scratch_path

    path = scratch_path(spark, "landed")
    events = _table(spark, sf, "events").select("event_id", "user_id", "event_type", F.col("value").cast("string"))
    events = events.repartition(files, F.xxhash64("event_id")) if files else events
    events.write.option("header", "true").csv(f"{path}/events")
    return path


def _own(spark: SparkSession, layer: str, name: str):
    """A context and the name of a table of this session's own, which isn't there yet."""
    from gridloom.context import RunContext
    from gridloom.sources import keyed

    ctx = RunContext("default", "")
    own = ctx.table(layer, f"{name}_{spark.sparkContext.applicationId.replace('-', '_')}")
    keyed.Keyed(spark, own).drop()
    return ctx, own


@query("SELECT event_id, user_id, event_type, value FROM events")
def q_stream_ingest(spark, sf):
    """Files become rows through a file stream that ends when it has read all; a second run adds none."""
    from gridloom.streaming.ingest import stream_csv

    path = _landed(spark, sf)
    for _ in range(2):
        stream = stream_csv(spark, f"{path}/events", "event_id string, user_id string, event_type string, value string").drop("_source_file")
        stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").option("path", f"{path}/bronze").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/bronze").select(F.col("event_id").cast("bigint"), F.col("user_id").cast("bigint"), "event_type", cleaning.to_double("value").alias("value"))


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def q_stream_upsert(spark, sf):
    """Each user's newest event, kept by key in a table that a stream upserts in five batches, which come in no order; a second run adds none."""
    from gridloom.streaming.ingest import stream_csv, upsert_stream

    path, (ctx, name) = _landed(spark, sf, files=5), _own(spark, "silver", "stream")
    for _ in range(2):
        stream = stream_csv(spark, f"{path}/events", "event_id string, user_id string, event_type string, value string", files_per_batch=1)
        typed = stream.select(F.col("user_id").cast("bigint"), F.col("event_id").cast("bigint"), "event_type")
        upsert_stream(typed, ctx, name, ["user_id"], [F.desc("event_id")], f"{path}/state")
    return spark.table(name)


_STREAMED = """e AS (
  SELECT DISTINCT user_id AS site, epoch_ms(ts) // 3600000 AS n FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL
), w AS (SELECT epoch_ms(max(ts)) - 6 * 3600000 AS watermark FROM events WHERE user_id IS NOT NULL), i AS (
  SELECT site, min(n)::BIGINT AS first_step, max(n)::BIGINT AS last_step, count(*) AS steps FROM (SELECT *, n - row_number() OVER (PARTITION BY site ORDER BY n) AS g FROM e) GROUP BY site, g
), f AS (SELECT i.* FROM i, w WHERE (last_step + 2) * 3600000 <= watermark)"""


@query(f"""WITH {_STREAMED} SELECT site, 'run' AS kind, first_step, last_step, steps FROM f
UNION ALL SELECT site, 'gap', b + 1, first_step - 1, first_step - b - 1 FROM (SELECT *, lag(last_step) OVER (PARTITION BY site ORDER BY first_step) AS b FROM f) WHERE b IS NOT NULL""")
def q_stream_runs(spark, sf):
    """Runs and gaps of each user's hours by a stateful stream, those that the watermark has made final; a second run adds none."""
    from gridloom.sources.scratch import scratch_path
    from gridloom.streaming.sessions import runs_and_gaps

    path, kinds = scratch_path(spark, "runs"), _table(spark, sf, "events").schema
    for _ in range(2):
        events = spark.readStream.schema(kinds).parquet(f"{sf}/event[s].parquet").select(F.col("user_id").alias("site"), "ts")
        runs_and_gaps(events, "site", "ts", "6 hours").writeStream.format("parquet").option("path", f"{path}/runs").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("site bigint, kind string, first_step bigint, last_step bigint, steps bigint").parquet(f"{path}/runs")


def _own_schema(spark: SparkSession, name: str):
    """A context whose schema is this session's own and empty, and whose landing folder is a new one."""
    from gridloom.context import RunContext
    from gridloom.sources.scratch import scratch_path
    from gridloom.sources.storage import ensure_schema

    ctx = RunContext(f"{name}_{spark.sparkContext.applicationId.replace('-', '_')}", scratch_path(spark, name))
    spark.sql(f"DROP SCHEMA IF EXISTS {ctx.database} CASCADE")
    ensure_schema(spark, ctx)
    return ctx


def _landed_mix(spark: SparkSession, sf: str):
    """A context of its own whose landing folder holds events as the feed generation_mix."""
    ctx = _own_schema(spark, "landed")
    mix = _table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("region"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("generation_ts"), F.col("event_type").alias("source"), F.col("value").cast("string").alias("generation_mw")
    )
    return ctx, mix


_MIX_ROWS = "SELECT user_id AS region, strftime(ts, '%Y-%m-%d %H:%M:%S') AS generation_ts, event_type AS source, value AS generation_mw FROM events"


def _mix_rows(spark: SparkSession, ctx) -> DataFrame:
    return spark.table(ctx.table("bronze", "generation_mix")).select(F.col("region").cast("bigint"), "generation_ts", "source", cleaning.to_double("generation_mw").alias("generation_mw"))


@query(_MIX_ROWS)
def q_ingest_feed(spark, sf):
    """The batch ingest, run again after more files have landed, and once more with nothing new."""
    from gridloom.sources import landing

    ctx, mix = _landed_mix(spark, sf)
    for part in (mix.filter("source = 'view'"), mix.filter("source is distinct from 'view'"), None):
        if part is not None:
            part.write.mode("append").option("header", "true").csv(ctx.feed_path("generation_mix"))
        landing.ingest_feed(spark, ctx, "generation_mix")
    return _mix_rows(spark, ctx)


@query(_MIX_ROWS)
def q_ingest_feed_stream(spark, sf):
    from gridloom.streaming.ingest import ingest_feed_stream

    ctx, mix = _landed_mix(spark, sf)
    mix.write.option("header", "true").csv(ctx.feed_path("generation_mix"))
    for _ in range(2):
        ingest_feed_stream(spark, ctx, "generation_mix", f"{ctx.landing}/state")
    return _mix_rows(spark, ctx)


@query("SELECT event_id, user_id, event_type, value, true AS has_source FROM events")
def q_csv_roundtrip(spark, sf):
    back = spark.read.schema("event_id string, user_id string, event_type string, value string").option("header", "true").csv(f"{_landed(spark, sf)}/events").withColumn("_source_file", F.col("_metadata.file_path"))
    return back.select(F.col("event_id").cast("bigint"), F.col("user_id").cast("bigint"), "event_type", cleaning.to_double("value").alias("value"), F.col("_source_file").endswith(".csv").alias("has_source"))


# The refined tables, marts and rules as users run them: feeds of text made of events and places, through refine, marts and quality.


def _feed(spark: SparkSession, sf: str) -> DataFrame:
    """Events as the text feed of meter readings; errors are outages without a value, and each user's hours are events."""
    e, text = _table(spark, sf, "events"), lambda c: F.col(c).cast("string")
    rows = e.select(
        text("event_id").alias("reading_id"), F.concat(F.lit(" U"), text("user_id")).alias("site_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("reading_ts"),
        F.when(F.col("event_type") == "error", "n/a").otherwise(text("value")).alias("kwh_consumed"), F.when(F.col("event_id") % 2 == 0, "1.5").alias("kwh_exported"),
        F.lit("230").alias("voltage_v"), F.when(F.col("event_type") == "error", "outage").otherwise("ok").alias("quality_flag"),
    )
    return rows.withColumns({"_source_file": F.lit("f"), "_ingested_at": F.lit("2025-01-01").cast("timestamp"), "_batch_id": F.lit("b")})


def _sites_feed(spark: SparkSession, sf: str) -> DataFrame:
    """Two versions of each user's place: the tariff changes in the middle of 2024."""
    users = _table(spark, sf, "events").select("user_id").distinct()
    day = F.explode(F.array(F.lit("2000-01-01"), F.lit("2024-01-05")))
    rows = users.select("user_id", day.alias("effective_from")).select(
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("site_id"), F.lit("s").alias("site_name"), F.concat(F.lit("R"), (F.col("user_id") % 3).cast("string")).alias("region"),
        F.concat(F.lit("G"), (F.col("user_id") % 4).cast("string")).alias("customer_segment"), F.concat(F.lit("T"), F.substring("effective_from", 1, 4)).alias("tariff_plan"),
        F.lit("400").alias("contracted_kw"), "effective_from",
    )
    return rows.withColumns({"_source_file": F.lit("f"), "_ingested_at": F.lit("2025-01-01").cast("timestamp"), "_batch_id": F.lit("b")})


def _silver(spark: SparkSession, sf: str) -> DataFrame:
    from gridloom.plans import refine

    return refine.readings(_feed(spark, sf))


def _enriched(spark: SparkSession, sf: str) -> DataFrame:
    from gridloom.plans import refine

    return refine.with_site(_silver(spark, sf), refine.sites(_sites_feed(spark, sf)))


def _plain(df: DataFrame, *columns: str) -> DataFrame:
    """Columns in types that both engines have: times without zone, whole numbers as bigint."""
    kinds = dict(df.dtypes)
    as_kind = {"timestamp": "timestamp_ntz", "int": "bigint"}
    return df.select(*(F.col(c).cast(as_kind[kinds[c]]) if kinds[c] in as_kind else F.col(c) for c in columns))


_S = """raw AS (
  SELECT event_id, user_id, 'U' || user_id AS site_id, date_trunc('hour', ts)::TIMESTAMP AS reading_hour, CASE WHEN event_type <> 'error' THEN value END AS kwh,
    CASE WHEN event_id % 2 = 0 THEN 1.5::DOUBLE ELSE 0.0::DOUBLE END AS kwh_exported, CASE WHEN event_type = 'error' THEN 'OUTAGE' ELSE 'OK' END AS quality_flag FROM events
), u AS (
  SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY site_id, reading_hour ORDER BY event_id::VARCHAR DESC) = 1
), f AS (
  SELECT *, coalesce(last_value(kwh IGNORE NULLS) OVER (PARTITION BY site_id ORDER BY reading_hour ROWS UNBOUNDED PRECEDING), 0.0) AS kwh_filled,
    greatest(date_diff('hour', lag(reading_hour) OVER (PARTITION BY site_id ORDER BY reading_hour), reading_hour) - 1, 0)::DOUBLE AS gap_hours_before FROM u
), s AS (
  SELECT *, CASE WHEN lag(reading_hour) OVER w IS NULL THEN 0.0::DOUBLE ELSE gap_hours_before END AS gap, lag(kwh_filled) OVER w AS kwh_prev_hour, reading_hour::DATE AS reading_date, hour(reading_hour) AS hour_of_day, isodow(reading_hour) >= 6 AS is_weekend,
    'r' || (user_id % 3) AS region, 'g' || (user_id % 4) AS customer_segment, CASE WHEN reading_hour::DATE < DATE '2024-01-05' THEN 't2000' ELSE 't2024' END AS tariff_plan
  FROM f WINDOW w AS (PARTITION BY site_id ORDER BY reading_hour)
)"""


_SILVER = ("site_id", "reading_hour", "kwh_filled", "is_imputed", "gap_hours_before", "kwh_prev_hour", "kwh_delta_vs_prev", "kwh_exported", "quality_flag", "reading_date", "hour_of_day", "is_weekend")


@query(f"""WITH {_S} SELECT site_id, reading_hour, kwh_filled, kwh IS NULL AS is_imputed, gap AS gap_hours_before, kwh_prev_hour, kwh_filled - kwh_prev_hour AS kwh_delta_vs_prev,
  kwh_exported, quality_flag, reading_date, hour_of_day, is_weekend FROM s""")
def q_silver_readings(spark, sf):
    return _plain(_silver(spark, sf), *_SILVER)


@query(_SQL["q_silver_readings"])
def q_silver_increment(spark, sf):
    """The same table by increments: a first load of most rows, then one of what came late, of all users and dates."""
    from gridloom.plans import pipeline
    from gridloom.sources import storage
    from gridloom.sources.feeds import FEEDS, LINEAGE

    ctx, late = _own_schema(spark, "increment"), F.pmod(F.xxhash64("reading_id"), F.lit(20)) == 0
    rows = _feed(spark, sf)
    for feed, columns in FEEDS.items():
        storage.append(rows.limit(0).select(*(F.lit(None).cast("string").alias(c) for c in columns), *LINEAGE), ctx.table("bronze", feed), ctx)
    for load, part in (("a", rows.filter(~late)), ("b", rows.filter(late))):
        storage.append(part.withColumn("_batch_id", F.lit(load)), ctx.table("bronze", "meter_readings"), ctx)
        pipeline.run_silver(spark, ctx)
    return _plain(spark.table(ctx.table("silver", "meter_readings")), *_SILVER)


@query("""WITH v AS (SELECT DISTINCT user_id FROM events)
SELECT 'U' || user_id AS site_id, 't' || year(d) AS tariff_plan, 'r' || (user_id % 3) AS region, d AS valid_from, CASE WHEN d = DATE '2000-01-01' THEN DATE '2024-01-05' END AS valid_to, d > DATE '2000-01-01' AS is_current
FROM v, (VALUES (DATE '2000-01-01'), (DATE '2024-01-05')) t(d)""")
def q_silver_sites(spark, sf):
    from gridloom.plans import refine

    return refine.sites(_sites_feed(spark, sf)).select("site_id", "tariff_plan", "region", "valid_from", "valid_to", "is_current")


@query(f"""WITH {_S}, z AS (
  SELECT site_id, reading_hour, date_diff('hour', TIMESTAMP '1970-01-01', reading_hour) - row_number() OVER (PARTITION BY site_id ORDER BY reading_hour) AS island FROM s WHERE kwh_filled <= 0 OR quality_flag = 'OUTAGE'
), k AS (
  SELECT site_id, 'ZERO_CONSUMPTION' AS streak_kind, min(reading_hour) AS streak_start, max(reading_hour) AS streak_end, count(*)::BIGINT AS streak_hours FROM z GROUP BY site_id, island
  UNION ALL SELECT site_id, 'MISSING_DATA', reading_hour - to_hours(gap::BIGINT), reading_hour - INTERVAL 1 HOUR, gap::BIGINT FROM s WHERE gap > 0
), o AS (
  SELECT *, dense_rank() OVER (PARTITION BY site_id ORDER BY streak_hours DESC)::BIGINT AS streak_rank_by_duration, row_number() OVER w::BIGINT AS streak_seq,
    date_diff('hour', streak_end, lead(streak_start) OVER w)::DOUBLE - 1 AS hours_until_next_streak, date_diff('hour', lag(streak_end) OVER w, streak_start)::DOUBLE - 1 AS hours_since_prev_streak
  FROM k WINDOW w AS (PARTITION BY site_id ORDER BY streak_start, streak_kind)
) SELECT *, streak_rank_by_duration = 1 AS is_longest_streak FROM o""")
def q_mart_outages(spark, sf):
    from gridloom.plans import marts

    columns = ("site_id", "streak_kind", "streak_start", "streak_end", "streak_hours", "streak_rank_by_duration", "streak_seq", "hours_until_next_streak", "hours_since_prev_streak", "is_longest_streak")
    return _plain(marts.outage_streaks(_silver(spark, sf)), *columns)


@query(f"""WITH {_S}, p AS (
  SELECT *, rank() OVER d::BIGINT AS rank_in_day, dense_rank() OVER d::BIGINT AS dense_rank_in_day, row_number() OVER (PARTITION BY site_id, reading_date ORDER BY kwh_filled DESC, reading_hour)::BIGINT AS row_number_in_day,
    max(kwh_filled) OVER t AS day_peak_kwh, first_value(kwh_filled) OVER t AS first_hour_kwh, last_value(kwh_filled) OVER t AS last_hour_kwh
  FROM s WINDOW d AS (PARTITION BY site_id, reading_date ORDER BY kwh_filled DESC), t AS (PARTITION BY site_id, reading_date ORDER BY reading_hour ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
) SELECT site_id, region, customer_segment, reading_hour, hour_of_day::BIGINT AS hour_of_day, kwh_filled, rank_in_day, dense_rank_in_day, row_number_in_day, day_peak_kwh,
  CASE WHEN day_peak_kwh > 0 THEN round(kwh_filled / day_peak_kwh * 100, 2) END AS pct_of_day_peak, first_hour_kwh, last_hour_kwh, kwh_filled > 400 AS is_over_contract FROM p WHERE row_number_in_day <= 3""")
def q_mart_peaks(spark, sf):
    from gridloom.plans import marts

    columns = ("site_id", "region", "customer_segment", "reading_hour", "hour_of_day", "kwh_filled", "rank_in_day", "dense_rank_in_day", "row_number_in_day", "day_peak_kwh", "pct_of_day_peak", "first_hour_kwh", "last_hour_kwh", "is_over_contract")
    return _plain(marts.peak_demand_hours(_enriched(spark, sf)), *columns)


@query(f"""WITH {_S}, b AS (
  SELECT *, avg(kwh_filled) OVER w AS m, stddev_samp(kwh_filled) OVER w AS sd, count(kwh_filled) OVER w AS n FROM s WINDOW w AS (PARTITION BY site_id ORDER BY reading_hour ROWS BETWEEN 168 PRECEDING AND 1 PRECEDING)
), y AS (SELECT *, lead(kwh_filled) OVER (PARTITION BY site_id ORDER BY reading_hour) AS kwh_next_hour, CASE WHEN n >= 24 AND sd > 0 THEN round((kwh_filled - m) / sd, 3) END AS z_score FROM b)
SELECT site_id, region, customer_segment, reading_hour, kwh_filled, kwh_prev_hour, kwh_next_hour, n::BIGINT AS baseline_rows, z_score, CASE WHEN z_score > 0 THEN 'SPIKE' ELSE 'DROP' END AS anomaly_kind,
  rank() OVER (PARTITION BY site_id, reading_date ORDER BY abs(z_score) DESC)::BIGINT AS anomaly_rank_in_day, count(*) OVER (PARTITION BY site_id, reading_date)::BIGINT AS anomalies_in_day, quality_flag
FROM y WHERE abs(z_score) > 1.5""")
def q_mart_anomalies(spark, sf):
    """Values of events are even, so the threshold is lower than the mart's own."""
    from gridloom.plans import marts

    columns = ("site_id", "region", "customer_segment", "reading_hour", "kwh_filled", "kwh_prev_hour", "kwh_next_hour", "baseline_rows", "z_score", "anomaly_kind", "anomaly_rank_in_day", "anomalies_in_day", "quality_flag")
    return _plain(marts.consumption_anomalies(_enriched(spark, sf), 1.5), *columns)


@query(f"""WITH {_S}, r AS (
  SELECT date_trunc('month', reading_hour)::DATE AS month_start, region, customer_segment, tariff_plan, sum(kwh_filled) AS k, count(DISTINCT site_id) AS site_count, grouping(region, customer_segment, tariff_plan) AS grouping_level
  FROM s GROUP BY GROUPING SETS ((1, region, customer_segment, tariff_plan), (1, region, customer_segment), (1, region), (1))
) SELECT month_start, region, customer_segment, tariff_plan, round(k, 3) AS kwh_total, site_count::BIGINT AS site_count,
  CASE grouping_level WHEN 0 THEN 'tariff' WHEN 1 THEN 'segment' WHEN 3 THEN 'region' ELSE 'month' END AS grain FROM r""")
def q_mart_rollup(spark, sf):
    from gridloom.plans import marts

    return _plain(marts.consumption_rollup_monthly(_enriched(spark, sf)), "month_start", "region", "customer_segment", "tariff_plan", "kwh_total", "site_count", "grain")


@query(f"""WITH {_S}, n AS (
  SELECT site_id, region, reading_date, round(sum(kwh_filled), 3) AS kwh_total, round(max(kwh_filled), 3) AS kwh_peak_hour, round(min(kwh_filled), 3) AS kwh_min_hour, round(sum(kwh_exported), 3) AS kwh_exported_total FROM s GROUP BY ALL
) SELECT *, lag(kwh_total) OVER (PARTITION BY site_id ORDER BY reading_date) AS kwh_prev_day FROM n""")
def q_mart_daily(spark, sf):
    from gridloom.plans import marts

    return _plain(marts.site_daily_consumption(_enriched(spark, sf)), "site_id", "region", "reading_date", "kwh_total", "kwh_peak_hour", "kwh_min_hour", "kwh_exported_total", "kwh_prev_day")


@query(f"""WITH {_S}, m AS (
  SELECT site_id, customer_segment, date_trunc('month', reading_hour)::DATE AS month_start, round(sum(kwh_filled), 3) AS kwh_total FROM s GROUP BY ALL
), g AS (
  SELECT customer_segment, month_start, quantile_disc(kwh_total, 0.5) AS segment_p50_kwh, quantile_disc(kwh_total, 0.9) AS segment_p90_kwh, count(*) AS segment_site_count FROM m GROUP BY ALL
), d AS (
  SELECT site_id, customer_segment, month_start, kwh_total, segment_p50_kwh, segment_p90_kwh, segment_site_count, round(cume_dist() OVER a, 4) AS cume_dist_all_sites, round(percent_rank() OVER a, 4) AS percent_rank_all_sites,
    ntile(10) OVER (PARTITION BY month_start ORDER BY kwh_total, site_id, customer_segment)::BIGINT AS decile_all_sites, round(cume_dist() OVER (PARTITION BY customer_segment, month_start ORDER BY kwh_total), 4) AS cume_dist_in_segment,
    rank() OVER (PARTITION BY customer_segment, month_start ORDER BY kwh_total DESC)::BIGINT AS rank_in_segment_desc,
    CASE WHEN segment_p50_kwh > 0 THEN round(kwh_total / segment_p50_kwh * 100, 2) END AS pct_of_segment_median, kwh_total > segment_p90_kwh AS is_above_segment_p90
  FROM m JOIN g USING (customer_segment, month_start) WINDOW a AS (PARTITION BY month_start ORDER BY kwh_total)
) SELECT *, decile_all_sites = 10 AS is_top_decile FROM d""")
def q_mart_distribution(spark, sf):
    """All columns of the mart, its percentiles exact."""
    from gridloom.plans import marts

    columns = ("site_id", "customer_segment", "month_start", "kwh_total", "segment_p50_kwh", "segment_p90_kwh", "segment_site_count", "cume_dist_all_sites", "percent_rank_all_sites", "decile_all_sites", "cume_dist_in_segment", "rank_in_segment_desc", "pct_of_segment_median", "is_above_segment_p90", "is_top_decile")
    return _plain(marts.consumption_distribution_monthly(_enriched(spark, sf)), *columns)


@query("""WITH e AS (SELECT user_id AS site_id, ts AS h FROM events)
SELECT 'silver_readings_unique_key' AS check_name, (SELECT count(*) FROM (SELECT 1 FROM e GROUP BY site_id, date_trunc('hour', h) HAVING count(*) > 1)) AS failing_rows
UNION ALL SELECT 'silver_readings_no_null_keys', 0 UNION ALL SELECT 'silver_readings_non_negative', (SELECT count(*) FROM events WHERE value < 50 AND event_type <> 'error')
UNION ALL SELECT 'silver_readings_hour_aligned', 0 UNION ALL SELECT 'silver_readings_imputed_are_filled', (SELECT count(*) FROM events WHERE event_type = 'error')
UNION ALL SELECT 'silver_sites_one_current', 0 UNION ALL SELECT 'silver_sites_contiguous', 0 UNION ALL SELECT 'silver_sites_unique_version', 0
UNION ALL SELECT 'gold_outages_positive_duration', 0 UNION ALL SELECT 'gold_peaks_rank_le_row_number', 0""")
def q_gate(spark, sf):
    """Rules of four tables: over readings that break some of them, and over what the engine made, which breaks none."""
    from functools import reduce

    from gridloom.plans import marts, quality, refine

    e = _table(spark, sf, "events").select(F.col("user_id").alias("site_id"), F.date_trunc("hour", "ts").alias("reading_hour"), F.when(F.col("event_type") != "error", F.col("value") - 50).alias("kwh_filled"))
    frames = [
        (e, ("silver", "meter_readings")),
        (refine.sites(_sites_feed(spark, sf)), ("silver", "sites")),
        (marts.outage_streaks(_silver(spark, sf)), ("gold", "outage_streaks")),
        (marts.peak_demand_hours(_enriched(spark, sf)), ("gold", "peak_demand_hours")),
    ]
    return reduce(DataFrame.unionByName, (quality.measured(df, quality.table_gate(*name)) for df, name in frames))
