"""Behaviour of the whole panel on a generated bundle."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import TODAY, rows
from panel_data import made_bundle
from tidepanel import coverage_by_year, daily_panel, explore, forecast_panel, timeline, view
from tidepanel.operators.explore import key_figures, quality_counters
from tidepanel.plans.panel import coverage, history_days
from tidepanel.specs import PRODUCTS


def test_synthetic_bundle_is_flagged(registry):
    bundle = made_bundle(registry, TODAY)
    for name in PRODUCTS:
        assert bundle.products[name].where(~F.col("is_synthetic")).isEmpty()
    assert daily_panel(bundle, as_of=TODAY).where("source_kind <> 'synthetic_demo'").isEmpty()


def test_synthetic_bundle_keeps_its_contract(registry):
    assert made_bundle(registry, TODAY, strict=True).is_demo


def test_prefers_reanalysis_and_excludes_today(bundle):
    daily = daily_panel(bundle, True, TODAY).cache()
    assert daily.count() == daily.select("site_id", "date_local").distinct().count()
    assert daily.agg(F.max("date_local")).first()[0] == dt.date(2026, 10, 8)
    assert rows(daily.where("date_local = '2026-10-02'").select("weather_model").distinct()) == [("era5",)]
    last = daily.where("date_local = '2026-10-08'")
    assert rows(last.select("weather_model", "source_kind").distinct()) == [("ecmwf_ifs025", "provisional_recent")]
    counters = quality_counters(daily).first()
    assert (counters["sites"], counters["duplicate_rows"], counters["incomplete_pairs"]) == (16, 0, 0)


def test_unmatched_rows_stay(bundle):
    marine = bundle.products["marine_reanalysis"]
    lost = marine.orderBy("site_id", "date_local").select("site_id", "date_local").limit(1)
    holed = bundle.with_products(marine_reanalysis=marine.join(lost, ["site_id", "date_local"], "left_anti"))
    row = daily_panel(holed, as_of=TODAY).join(lost, ["site_id", "date_local"]).first()
    assert row["domain_match"] == "left_only" and not row["marine_complete"]
    assert row["wave_height_max"] is None and row["source_kind"] == "reanalysis" and row["weather_complete"]


def test_forecast_vintages_stay_apart(bundle):
    twice = {
        name: bundle.products[name].unionByName(
            bundle.products[name].withColumn("snapshot_id", F.lit("2026-10-09T08:00:00Z"))
        )
        for name in ("weather_forecasts", "marine_forecasts")
    }
    joined = forecast_panel(bundle.with_products(**twice))
    assert joined.count() == 224
    assert joined.select("site_id", "date_local", "forecast_vintage").distinct().count() == 224
    assert {"weather_model", "marine_model"} <= set(joined.columns)
    assert not {"weather_snapshot_id", "snapshot_id"} & set(joined.columns)


def test_missing_forecasts_keep_the_schema(bundle):
    from dataclasses import replace

    past = {k: v for k, v in bundle.products.items() if k != "marine_forecasts"}
    empty = forecast_panel(replace(bundle, products=past))
    assert empty.isEmpty() and set(empty.dtypes) == set(forecast_panel(bundle).dtypes)
    assert view(replace(bundle, products=past), "forecasts", TODAY).columns == daily_panel(bundle, True, TODAY).columns


def test_coverage_counts_leap_and_absent_years(bundle):
    daily = daily_panel(bundle, as_of=TODAY)
    report = coverage_by_year(daily, bundle.sites, "2022-01-01", "2025-12-31").cache()
    assert report.count() == 16 * 4
    assert report.where("year = 2022").agg(F.sum("paired_days")).first()[0] == 0
    assert report.where("year = 2024").agg(F.sum("expected_days")).first()[0] == 16 * 366
    assert report.where("year = 2024 and coverage_pct <> 100").isEmpty()
    assert report.where("paired_days + missing_pair_days <> expected_days").isEmpty()
    direct = coverage(bundle, "2022-01-01", "2025-12-31", as_of=TODAY)
    assert direct.exceptAll(report).isEmpty() and direct.count() == report.count()


def test_timeline_spans_history_and_forecast(bundle):
    whole = timeline(bundle, TODAY).cache()
    assert whole.agg(F.min("date_local"), F.max("date_local")).first()[:] == (dt.date(2023, 10, 9), dt.date(2026, 10, 15))
    assert whole.groupBy("site_id", "date_local").count().where("count > 1").isEmpty()
    assert whole.where("site_id = 'galle'").count() == (dt.date(2026, 10, 15) - dt.date(2023, 10, 9)).days + 1
    # The cheap source of covered days agrees with the panel itself.
    panel = daily_panel(bundle, True, TODAY).select("date_local").distinct()
    assert history_days(bundle, True, TODAY).exceptAll(panel).isEmpty() and panel.exceptAll(history_days(bundle, True, TODAY)).isEmpty()


def test_views_and_key_figures(bundle):
    counts = {name: view(bundle, name, TODAY).count() for name in ("timeline", "past", "reanalysis", "forecasts")}
    assert counts == {"timeline": 16 * 1103, "past": 16 * 1096, "reanalysis": 16 * 1091, "forecasts": 112}
    figures = key_figures(bundle.products, view(bundle, "reanalysis", TODAY), bundle.sites, view(bundle, "past", TODAY)).first()
    assert figures.asDict() == {
        "raw_records": 2 * 16 * (1091 + 7 + 7),
        "merged_site_days": 16 * 1091,
        "sites": 16,
        "latest_past_day": dt.date(2026, 10, 8),
    }
    with pytest.raises(ValueError):
        view(bundle, "tomorrow")


def test_explorer_rules(bundle):
    daily = daily_panel(bundle, as_of=TODAY)
    dates = (dt.date(2025, 1, 1), dt.date(2025, 1, 31))
    assert explore(daily, ["galle"], dates, severity=[]).isEmpty()
    assert explore(daily, ["galle"], dates).count() == 31
    assert explore(daily, [], dates).isEmpty() and explore(daily, ["galle"], dates[:1]).isEmpty()


def test_key_filter_equals_filtering_the_result(bundle):
    asked = daily_panel(bundle, True, TODAY, sites=["galle"], dates=("2026-09-20", "2026-10-05"))
    after = daily_panel(bundle, True, TODAY).where("site_id = 'galle' and date_local between '2026-09-20' and '2026-10-05'")
    assert asked.count() == 16 and asked.exceptAll(after).isEmpty() and after.exceptAll(asked).isEmpty()
