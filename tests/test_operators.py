"""Joins, timeline, coverage, records and explorer on hand-made rows."""

import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import rows
from tidepanel.functions.dates import local_today
from tidepanel.functions.stats import percent
from tidepanel.functions.status import BELOW, ELEVATED, HIGHER, MISSING, indicator_status, status_color
from tidepanel.operators import explore as ex
from tidepanel.operators import records as rec
from tidepanel.operators.coverage import coverage_by_year, coverage_rollup, coverage_table
from tidepanel.operators.dimension import hot_keys, join_dimension
from tidepanel.operators.joins import calendar, fill_calendar, inner_loader, join_domains, on_passing_days
from tidepanel.operators.timeline import combined_timeline, map_status, metric_series, site_day_cards


def d(text):
    return dt.date.fromisoformat(text)


def frame(spark, schema, *data):
    df = spark.createDataFrame(list(data), schema)
    days = [c for c in df.columns if c == "date_local"]
    return df.withColumns({c: F.to_date(c) for c in days}) if days else df


@pytest.fixture(scope="module")
def sites(spark):
    return frame(spark, "site_id string, name string", ("a", "Alpha"), ("b", "Beta"), ("c", "Gamma"))


HISTORY = "site_id string, date_local string, wind_speed_10m_max double, wave_height_max double"
FORECAST = HISTORY + ", forecast_vintage string"


def test_status_boundaries(spark):
    nan = float("nan")
    df = frame(
        spark,
        "i int, wave_height_max double, wind_speed_10m_max double",
        (0, 2.0, 1.0), (1, 1.99, 9.99), (2, 3.0, 1.0), (3, 0.1, 15.0), (4, None, 50.0), (5, nan, 50.0), (6, 50.0, nan), (7, 0.0, 10.0),
    )
    got = [r[1] for r in rows(df.select("i", indicator_status()))]
    assert got == [ELEVATED, BELOW, HIGHER, HIGHER, MISSING, MISSING, MISSING, ELEVATED]
    colors = frame(spark, "s string", (HIGHER,), (None,)).select(status_color(F.col("s"))).collect()
    assert colors[0][0] == [203, 69, 60, 230] and colors[1][0] == [148, 163, 184, 210]


def test_percent_rounds_half_to_even(spark):
    df = frame(spark, "p int, w int", (1, 32), (0, 0), (1, 8))
    assert [r[0] for r in df.select(percent(F.col("p"), F.col("w"), 2)).collect()] == [3.12, 0.0, 12.5]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.sets(st.integers(0, 9)), st.sets(st.integers(0, 9)))
def test_outer_join_keeps_every_key(weather_rows, left, right):
    def side(days, domain):
        data = [("a", f"2026-01-{i + 1:02d}", f"{domain}_reanalysis", "historical", True, 1.0) for i in days]
        df = weather_rows(data or [("a", None, "x", "x", True, 1.0)]).where("date_local is not null")
        return df.withColumnRenamed("wind_speed_10m_max", "w" if domain == "weather" else "m")

    joined = join_domains(side(left, "weather"), side(right, "marine"))
    counts = dict(rows(joined.groupBy("domain_match").count()))
    expected = {"both": len(left & right), "left_only": len(left - right), "right_only": len(right - left)}
    assert counts == {k: v for k, v in expected.items() if v}


def test_outer_join_flags_and_kinds(weather_rows, sites):
    weather = weather_rows([("a", "2026-01-01", "weather_reanalysis", "h", True, 1.0), ("b", "2026-01-01", "weather_reanalysis", "h", True, 1.0)])
    marine = weather_rows([("a", "2026-01-01", "marine_recent", "h", True, 1.0), ("z", "2026-01-01", "marine_reanalysis", "h", False, 1.0)])
    marine = marine.withColumnRenamed("wind_speed_10m_max", "wave_height_max")
    joined = join_domains(weather, marine, sites, "rev")
    got = rows(joined, "site_id", "source_kind", "complete_pair", "domain_match", "hf_revision")
    assert got == [
        ("a", "provisional_recent", True, "both", "rev"),
        ("b", "reanalysis", False, "left_only", "rev"),
        ("z", "reanalysis", False, "right_only", "rev"),
    ]
    assert rows(joined.where("name is null"), "site_id") == [("z",)]
    synthetic = join_domains(weather, marine.withColumn("is_synthetic", F.lit(True)), sites)
    assert dict(rows(synthetic, "site_id", "source_kind")) == {"a": "synthetic_demo", "b": "reanalysis", "z": "synthetic_demo"}


def test_shared_extra_columns_are_prefixed(weather_rows):
    weather = weather_rows([("a", "2026-01-01", "weather_reanalysis", "h", True, 1.0)])
    joined = join_domains(weather.withColumn("note", F.lit("w")), weather.drop("wind_speed_10m_max").withColumn("note", F.lit("m")))
    assert joined.select("weather_note", "marine_note").first()[:] == ("w", "m")


def test_large_dimension_salts_hot_keys_and_stays_equal(spark, sites):
    days = spark.range(200).select(
        F.when(F.col("id") < 150, "a").otherwise(F.when(F.col("id") < 190, "b").otherwise("zz")).alias("site_id"),
        F.expr("date_add(date'2026-01-01', cast(id as int))").alias("date_local"),
    )
    small = join_dimension(days, sites, "site_id")
    assert "BroadcastHashJoin" in small._jdf.queryExecution().toString()
    assert rows(hot_keys(days, "site_id", 100)) == [("a", True)]
    for how, expected in (("left", 200), ("inner", 190)):
        large = join_dimension(days, sites, "site_id", how, rows=1, hot_rows=100, salts=4)
        plain = days.join(sites, "site_id", how)
        assert large.columns == plain.columns and large.count() == expected
        assert large.exceptAll(plain).isEmpty() and plain.exceptAll(large).isEmpty()


def test_rows_without_a_key_spread_over_salts(spark, sites):
    days = spark.range(60).select(F.when(F.col("id") < 20, "a").alias("site_id"), "id")
    joined = join_dimension(days, sites, "site_id", rows=1, hot_rows=10, salts=4)
    assert joined.count() == 60 and joined.where("name is null").count() == 40


def test_joins_refuse_a_repeated_key(spark, sites, weather_rows):
    day = ("a", "2026-01-01", "weather_reanalysis", "h", True, 1.0)
    one, two = weather_rows([day]), weather_rows([day, day])
    twice = sites.unionByName(sites.limit(1))
    history = frame(spark, HISTORY, ("a", "2026-01-01", 1.0, 1.0), ("a", "2026-01-01", 2.0, 1.0))
    ahead = history.limit(0).withColumn("forecast_vintage", F.lit("h"))
    for broken in (
        join_domains(two, one),
        join_domains(one, two),
        join_domains(one, one, twice),
        join_dimension(one, twice, "site_id"),
        join_dimension(one, twice, "site_id", rows=1, hot_rows=1, salts=2),
        map_status(sites, history, ahead, "2026-01-01"),
        map_status(twice, history.limit(1), ahead, "2026-01-01"),
    ):
        with pytest.raises(Exception, match="more than once"):
            broken.collect()


def test_inner_loader_drops_marine_provenance(spark, sites):
    day = [("a", "2026-01-01"), ("q", "2026-01-01"), ("b", "2026-01-02")]
    weather = frame(spark, "site_id string, date_local string, model string, snapshot_id string", *[(*k, "era5", "h") for k in day])
    marine = frame(spark, "site_id string, date_local string, model string, snapshot_id string, wave double", *[(*k, "m", "h", 1.0) for k in day[:2]])
    loaded = inner_loader(weather, marine, sites)
    assert rows(loaded, "site_id", "model", "wave", F.coalesce("name", F.lit("-"))) == [("a", "era5", 1.0, "Alpha"), ("q", "era5", 1.0, "-")]


def test_timeline_rules(spark):
    history = frame(spark, HISTORY, ("a", "2026-01-01", 1.0, 1.0), ("b", "2026-01-02", 1.0, 1.0))
    forecasts = frame(
        spark, FORECAST,
        ("a", "2026-01-02", 2.0, 2.0, "v1"), ("a", "2026-01-03", 3.0, 3.0, "v1"), ("a", "2026-01-03", 4.0, None, "v2"),
    )
    by_day = rows(combined_timeline(history, forecasts), "site_id", "date_local", "wind_speed_10m_max")
    assert by_day == [("a", d("2026-01-01"), 1.0), ("a", d("2026-01-03"), 4.0), ("b", d("2026-01-02"), 1.0)]
    per_site = rows(combined_timeline(history, forecasts, per_site=True), "site_id", "date_local", "wind_speed_10m_max")
    assert per_site == [("a", d("2026-01-01"), 1.0), ("a", d("2026-01-02"), 2.0), ("a", d("2026-01-03"), 4.0), ("b", d("2026-01-02"), 1.0)]
    later = combined_timeline(history, forecasts, min_day="2026-01-04")
    assert later.count() == 2 and "forecast_vintage" in later.columns
    no_past = combined_timeline(history.limit(0), forecasts)
    assert no_past.count() == 2  # the latest vintage of each day only


def test_map_falls_back_per_day_and_card_per_site(spark, sites):
    history = frame(spark, HISTORY, ("a", "2026-01-01", 1.0, 9.0), ("a", "2026-01-02", 1.0, 1.0), ("b", "2026-01-02", 99.0, 1.0))
    forecasts = frame(spark, FORECAST, ("a", "2026-01-02", 1.0, 1.0, "v1"), ("a", "2026-01-02", 12.0, 1.0, "v2"))
    points = map_status(sites, history, forecasts, "2026-01-01", "2026-01-02")
    assert rows(points, "date_local", "site_id", "status") == [
        (d("2026-01-01"), "a", HIGHER), (d("2026-01-01"), "b", MISSING), (d("2026-01-01"), "c", MISSING),
        (d("2026-01-02"), "a", ELEVATED), (d("2026-01-02"), "b", MISSING), (d("2026-01-02"), "c", MISSING),
    ]
    one = map_status(sites, history, forecasts, "2026-01-03")
    assert one.count() == 3 and one.where(F.col("status") != MISSING).isEmpty() and "name" in one.columns
    cards = rows(site_day_cards(history, forecasts), "site_id", "date_local", "indicator_status", F.coalesce("forecast_vintage", F.lit("-")))
    assert cards == [("a", d("2026-01-01"), HIGHER, "-"), ("a", d("2026-01-02"), ELEVATED, "v2"), ("b", d("2026-01-02"), HIGHER, "-")]
    assert site_day_cards(history, forecasts, sites=["b"], dates=("2026-01-03", "2026-01-03")).isEmpty()


def test_series_bridge(spark):
    history = frame(
        spark, HISTORY,
        ("a", "2026-01-01", 1.0, 1.0), ("a", "2026-01-02", None, 1.0), ("b", "2026-01-05", 5.0, 1.0), ("c", "2026-01-01", 1.0, 1.0),
    )
    forecasts = frame(spark, FORECAST, ("a", "2026-01-03", 3.0, 1.0, "v1"), ("b", "2026-01-04", 4.0, 1.0, "v1"))
    series = metric_series(history, forecasts, "wind_speed_10m_max", "2026-01-01", "2026-01-31")
    assert rows(series.where("series = 'forecast'"), "site_id", "date_local", "value") == [
        ("a", d("2026-01-01"), 1.0), ("a", d("2026-01-03"), 3.0), ("b", d("2026-01-04"), 4.0),
    ]
    assert series.where("series = 'history'").count() == 4


DAILY = "site_id string, date_local string, weather_complete boolean, marine_complete boolean, complete_pair boolean"


def test_coverage_windows_and_rounding(spark, sites):
    daily = frame(spark, DAILY, ("a", "2024-02-29", True, True, True), ("a", "2025-01-01", True, False, False), ("a", "2026-01-01", True, True, True))
    report = coverage_by_year(daily, sites, "2024-01-29", "2025-01-01").cache()
    a = {r["year"]: r for r in report.where("site_id = 'a'").collect()}
    assert (a[2024]["expected_days"], a[2024]["paired_days"], a[2024]["coverage_pct"]) == (338, 1, 0.3)
    assert (a[2025]["expected_days"], a[2025]["available_rows"], a[2025]["paired_days"], a[2025]["coverage_pct"]) == (1, 1, 0, 0.0)
    assert report.count() == 6 and report.where("site_id = 'b' and available_rows <> 0").isEmpty()
    half = coverage_by_year(daily, sites, "2024-02-29", "2024-03-31").where("site_id = 'a'").first()
    assert (half["expected_days"], half["coverage_pct"]) == (32, 3.12)
    assert coverage_by_year(daily, sites, "2025-01-01", "2024-01-01").isEmpty()
    listed = coverage_by_year(daily, ["a", "b", "c"], "2024-01-29", "2025-01-01")
    assert listed.exceptAll(report).isEmpty() and listed.count() == report.count()
    assert rows(coverage_rollup(report)) == [(2024, 3 * 338, 1, 3 * 338 - 1), (2025, 3, 0, 3)]
    wide = coverage_table(report, [2024, 2025])
    assert wide.columns == ["site_id", "2024", "2025"] and wide.where("site_id = 'a'").first()["2024"] == 0.3


def test_coverage_default_end_is_yesterday(spark, sites):
    daily = frame(spark, DAILY, ("a", "2024-02-29", True, True, True))
    yesterday = spark.range(1).select(F.date_sub(local_today(), 1)).first()[0]
    report = coverage_by_year(daily, sites, dt.date(yesterday.year, 1, 1))
    assert rows(report.select("year", "expected_days").distinct()) == [(yesterday.year, yesterday.timetuple().tm_yday)]


CATCH = "site_id string, date_local string, species string, catch_weight_kg double"


@pytest.fixture(scope="module")
def catch(spark):
    return frame(
        spark, CATCH,
        ("a", "2026-01-05", "x", 10.0), ("a", "2026-01-06", "x", 0.0), ("a", "2026-04-01", "x", 5.0), ("b", "2026-04-01", "x", 0.0), ("b", "2026-04-02", "y", 2.0),
    )


def test_monthly_catch_shows_empty_months(catch):
    assert rows(rec.monthly_catch(catch).withColumn("catch_weight_kg", F.coalesce("catch_weight_kg", F.lit(-1.0)))) == [
        (d("2026-01-01"), 10.0), (d("2026-02-01"), -1.0), (d("2026-03-01"), -1.0), (d("2026-04-01"), 7.0),
    ]
    per_site = rec.monthly_catch(catch, ["site_id"])
    assert per_site.where("site_id = 'a'").count() == 4 and per_site.where("site_id = 'b'").count() == 1


def test_seasonal_and_shares(catch):
    got = {(r["species"], r["month"]): r for r in rec.seasonal_catch(catch).collect()}
    x = got["x", 1]
    assert (x["recorded_days"], x["positive_catch_days"], x["mean_recorded_kg"], x["positive_catch_pct_of_reported_days"]) == (2, 1, 5.0, 50.0)
    assert got["x", 4]["recorded_days"] == 1 and got["x", 4]["positive_catch_pct_of_reported_days"] == 100.0
    assert rows(rec.species_share(catch)) == [("x", 15.0), ("y", 2.0)]


def test_catch_semi_join_never_multiplies(spark, catch):
    passing = frame(spark, "site_id string, date_local string", ("a", "2026-01-05"), ("a", "2026-01-05"), ("b", "2026-04-02"))
    kept = on_passing_days(catch, passing)
    assert kept.agg(F.sum("catch_weight_kg")).first()[0] == 12.0 and kept.count() == 2 and kept.columns == catch.columns
    assert on_passing_days(catch, passing.limit(0)).count() == 5
    assert on_passing_days(catch, passing.limit(0), unrestricted_if_empty=False).isEmpty()


def test_calendar_gaps_and_lags(spark, sites):
    daily = frame(spark, HISTORY, ("a", "2026-01-01", 1.0, 1.0), ("a", "2026-01-03", 3.0, 1.0))
    filled = fill_calendar(daily, sites, "2026-01-01", "2026-01-03")
    assert filled.count() == 9 and filled.where("wind_speed_10m_max is null").count() == 7
    assert calendar(sites, "2026-01-02", "2026-01-01").isEmpty()
    lagged = rec.lagged(daily, "wind_speed_10m_max", [1, 2]).where("date_local = '2026-01-03'").first()
    assert lagged["wind_speed_10m_max_lag_1"] is None and lagged["wind_speed_10m_max_lag_2"] == 1.0


def test_monthly_totals_flag_open_months(spark):
    daily = frame(spark, "site_id string, date_local string, precipitation_sum double", *[("a", f"2026-02-{i:02d}", 1.0) for i in range(1, 29)], ("a", "2026-03-01", 2.0), ("b", "2026-02-01", None))
    got = {(r["site_id"], r["month"].month): (r["precipitation_sum"], r["incomplete_month"]) for r in rec.monthly_totals(daily).collect()}
    assert got == {("a", 2): (28.0, False), ("a", 3): (2.0, True), ("b", 2): (None, True)}


def test_circular_mean_wraps_north(spark):
    daily = frame(spark, "site_id string, wind double", ("a", 350.0), ("a", 20.0), ("b", 90.0))
    got = dict(rows(rec.mean_direction(daily, "wind").select("site_id", F.round("wind", 6))))
    assert got == {"a": 5.0, "b": 90.0}


def test_profiles(spark):
    assert rec.default_profiles(spark).where("verified_local_season = 'Not supplied'").count() == 8
    assert ex.in_categories(rec.default_profiles(spark), ["large_pelagic"]).count() == 4


def test_pages_agree_near_and_deep(spark):
    df = spark.range(1000).select(F.lit("a").alias("site_id"), F.expr("date_add(date'2020-01-01', cast(999 - id as int))").alias("date_local"), "id").repartition(7)
    for number in (1, 2, 11, 20):
        near, deep = ex.page(df, number, 50), ex.page(df, number, 50, heap_rows=0)
        assert [r["id"] for r in near.collect()] == [r["id"] for r in deep.collect()] == [1000 - 50 * (number - 1) - i for i in range(1, 51)]
    assert (ex.page_within(3, 2), ex.page_within(2, 2), ex.page_within(0, 2)) == (1, 2, 1)
    assert ex.page(df, 21, 50).isEmpty() and ex.page(df, 21, 50, heap_rows=0).isEmpty()
    assert ex.page_count(df, 250).first()[:] == (1000, 4) and ex.page_count(df.limit(0), 25).first()[:] == (0, 1)


def test_columns_sheet_and_bounds(spark, sites):
    df = frame(spark, HISTORY, ("a", "2026-01-01", 1.0, 1.0), ("a", "2026-02-15", 1.0, 1.0))
    assert ex.choose_columns(df, ["wave_height_max", "nope", "site_id"]).columns == ["wave_height_max", "site_id"]
    assert ex.choose_columns(df, []).columns == df.columns
    assert ex.date_bounds(df).first()[:] == (d("2026-01-01"), d("2026-02-15"), d("2026-01-17"), d("2026-01-01"))
    assert rows(ex.registry_sheet(sites.where("site_id = 'a'"))) == [("a", "name", "Alpha")]
    assert ex.named_sites(df, sites).select("name").distinct().first()[0] == "Alpha"
