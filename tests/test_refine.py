from datetime import date

from gridloom.plans import refine
from tests.conftest import by, raw, ts

D = "2025-01-01T"
READINGS = [
    ("R1", "S1", D + "00:00:00", "1.0", "0", "230", "OK"),
    ("R2", "S1", D + "01:03:00", "2.0", "0", "230", "OK"),
    ("R3", " S1 ", D + "01:00:00", "2.5", "0", "230", "restated"),
    ("R4", "S1", D + "02:00:00", None, "0", "230", "MISSING"),
    ("R5", "S1", D + "05:00:00", "4.0", "0", "230", "OK"),
    ("R6", "S1", D + "06:00:00", "-3", "0", "230", "OK"),
    ("R7", None, D + "06:00:00", "1", "0", "230", "OK"),
    ("R8", "S2", "not a date", "1", "0", "230", "OK"),
    ("R9", "S2", D + "00:00:00", None, "0", "230", "OK"),
    ("R10", "S2", D + "03:00:00", "NaN", None, "x", None),
]


def test_readings_latest_fill_and_gaps(spark):
    got = by(refine.readings(raw(spark, "meter_readings", READINGS)).collect(), "site_id", "reading_hour")
    assert len(got) == 5
    assert got["S1", ts(D + "00:00:00")].gap_hours_before == 0.0 and got["S1", ts(D + "00:00:00")].kwh_prev_hour is None
    r3 = got["S1", ts(D + "01:00:00")]
    assert (r3.reading_id, r3.quality_flag, r3.kwh_filled) == ("R3", "RESTATED", 2.5)
    r4 = got["S1", ts(D + "02:00:00")]
    assert (r4.kwh_filled, r4.is_imputed) == (2.5, True)
    r5 = got["S1", ts(D + "05:00:00")]
    assert (r5.gap_hours_before, r5.kwh_prev_hour, r5.kwh_delta_vs_prev, r5.hour_of_day, r5.is_weekend) == (2.0, 2.5, 1.5, 5, False)
    assert got["S2", ts(D + "00:00:00")].kwh_filled == 0.0


def test_rejected_readings_say_why(spark):
    _, rejected = refine.checked_readings(raw(spark, "meter_readings", READINGS))
    assert {r.reading_id: r.reject_reason for r in rejected.collect()} == {"R6": "negative_consumption", "R7": "missing_site_id", "R8": "unparseable_timestamp", "R10": "not_a_number"}


def _site(tariff, effective, at=None):
    row = ("S1", "One", "North", "residential", tariff, "6.9", effective)
    return (*row, ts(at)) if at else row


SITES = [
    _site("flat", "2024-01-01"),
    _site("flat", "2024-06-01"),
    _site("time_of_use", "2025-01-15", "2025-01-15T01:00"),
    _site("dynamic", "2025-01-15", "2025-01-16T01:00"),
    ("S2", "Two", "south", "commercial", "flat", "41.4", "2024-03-01"),
]


def test_versions_and_point_in_time(spark):
    versions = refine.sites(raw(spark, "sites", SITES))
    got = by(versions.collect(), "site_id", "version")
    assert len(got) == 3
    one, two = got["S1", 1], got["S1", 2]
    assert (one.tariff_plan, one.valid_from, one.valid_to, one.is_current, one.region) == ("flat", date(2024, 1, 1), date(2025, 1, 15), False, "north")
    assert (two.tariff_plan, two.valid_to, two.is_current) == ("dynamic", None, True)
    facts = spark.createDataFrame([("S1", ts("2025-01-10T12:00")), ("S1", ts("2025-01-15T00:00")), ("S1", ts("2023-12-31T23:00")), ("S9", ts("2025-01-10T00:00"))], "site_id string, reading_hour timestamp")
    joined = {(r.site_id, r.reading_hour.isoformat()): (r.tariff_plan, r.site_version) for r in refine.with_site(facts, versions).collect()}
    assert joined == {("S1", "2025-01-10T12:00:00"): ("flat", 1), ("S1", "2025-01-15T00:00:00"): ("dynamic", 2), ("S1", "2023-12-31T23:00:00"): (None, None), ("S9", "2025-01-10T00:00:00"): (None, None)}


def test_a_change_back_opens_a_third_version(spark):
    rows = [_site("flat", "2024-01-01"), _site("dynamic", "2024-02-01"), _site("flat", "2024-03-01")]
    assert refine.sites(raw(spark, "sites", rows)).count() == 3


def test_weather(spark):
    rows = [("north", D + "00:00:00", "10", "1", "0", "50"), ("north", D + "01:00:00", None, "1", "0", "50"), ("north", D + "02:00:00", "30", "1", "0", "50"), ("north", D + "02:00:00", "31", "1", "0", "50", ts("2025-02-02")), ("north", "2025-01-02T02:00:00", "20", "1", "0", "50")]
    got = by(refine.weather(raw(spark, "weather", rows)).collect(), "observed_hour")
    assert [got[ts(D + f"0{h}:00:00")].temperature_c for h in range(3)] == [10.0, 10.0, 31.0]
    assert got[ts(D + "00:00:00")].heating_degree_hours == 8.0 and got[ts(D + "02:00:00")].cooling_degree_hours == 7.0
    assert got[ts("2025-01-02T02:00:00")].temperature_prev_day_c is None


def test_prices_and_mix(spark):
    rows = [("south", D + f"0{h}:00:00", str(p), "day_ahead") for h, p in enumerate([50, 100, 100, 80, 70, 60])]
    got = [r for _, r in sorted(by(refine.prices(raw(spark, "prices", rows)).collect(), "price_hour").items())]
    assert [r.price_rank_in_day for r in got] == [6, 1, 1, 3, 4, 5]
    assert [h for h, r in enumerate(got) if r.is_peak_price_hour] == [1, 2, 3, 4] and got[1].price_change_pct == 100.0
    mix = [("north", D + "00:00:00", "solar", "100"), ("north", D + "00:00:00", "gas", "300"), ("south", D + "00:00:00", "wind", "50")]
    shares = by(refine.generation(raw(spark, "generation_mix", mix)).collect(), "source")
    assert [shares[s].share_pct for s in ("solar", "gas", "wind")] == [25.0, 75.0, 100.0]
    assert shares["solar"].is_renewable and not shares["gas"].is_renewable
