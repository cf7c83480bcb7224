"""Plans that the engine counts on: few exchanges, pruned scans, no nested loops, early top-1."""

import os
import re

import pytest
from pyspark.sql import functions as F

from gridloom import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


def plan(spark, name):
    return catalogue.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def exchanges(text):
    return len(re.findall(r"Exchange hashpartitioning", text))


def test_latest_row_is_picked_before_the_shuffle(spark):
    text = plan(spark, "q_dedupe_hour")
    assert exchanges(text) == 1 and len(re.findall("WindowGroupLimit", text)) == 2


def test_daily_windows_share_an_exchange(spark):
    # dedupe, daily aggregation, and one for all windows
    assert exchanges(plan(spark, "q_daily_kpis")) == 3


def test_pivot_is_one_aggregation(spark):
    assert exchanges(plan(spark, "q_pivot_mix")) == 1


def test_point_in_time_join_is_no_nested_loop(spark):
    text = plan(spark, "q_as_of_join")
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(spark, "q_anti_join_new")
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(o_orderdate", text)
    assert re.search(r"ReadSchema: struct<c_custkey:bigint,c_name:string>", text)


def test_no_python_on_executors(spark):
    for name in catalogue.queries():
        if not name.startswith(("q_stream", "q_ingest")) and name not in ("q_csv_roundtrip", "q_upsert_result", "q_silver_increment"):
            assert not re.search("Python|Pandas|Arrow", plan(spark, name)), name


def test_no_window_sees_a_whole_month(spark, monkeypatch):
    """Ranks over all sites of a month take no task a month: no window goes by the month alone."""
    from gridloom.operators import ranking
    from gridloom.plans import marts

    facts = catalogue._fact_months(spark, SF).withColumns({"customer_segment": F.col("segment"), "site_id": F.col("site").cast("string"), "reading_hour": F.col("month").cast("timestamp"), "kwh_filled": F.col("total"), "kwh_exported": F.lit(0.0)})
    kept = []  # what is written on the way is planned there
    monkeypatch.setattr(ranking, "materialise", lambda df, tag, of=ranking.materialise: (kept.append(df), of(df, tag))[1])
    for built in (catalogue.queries()["q_monthly_kpis"](spark, SF), catalogue.queries()["q_distribution"](spark, SF), marts.site_monthly_kpis(facts), marts.consumption_distribution_monthly(facts)):
        kept.append(built)
    assert len(kept) == 4 + 2 * 5
    for df in kept:
        text = df._jdf.queryExecution().executedPlan().toString()
        for keys in re.findall(r"windowspecdefinition\(([^)]*?) (?:ASC|DESC)", text):
            names = re.findall(r"(\w+)#", keys)[:-1]  # the last is what the window is ordered by
            assert not names or "_range" in keys or set(names) - {"month", "month_start"}, keys
