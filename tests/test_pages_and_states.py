"""Indexed pages, rules counted while writing, coverage out of bitmaps, single-read series."""

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from conftest import TODAY, rows
from tidepanel import ContractError, daily_panel, forecast_panel
from tidepanel.contracts.guarded import checked_write, write_product
from tidepanel.contracts.validate import product_report, typed_product
from tidepanel.operators import coverage as cov
from tidepanel.operators.timeline import metric_series
from tidepanel.operators.pages import index_pages, open_pages
from tidepanel.sinks.export import export
from tidepanel.sources.scans import read_product
from tidepanel.specs import CONFIGURED_SITES, PRODUCTS


def test_pages_are_cut_from_one_sorted_copy(spark, tmp_path):
    df = spark.range(1000).select((F.col("id") % 7).cast("string").alias("site_id"), F.date_add(F.lit(dt.date(2026, 1, 1)), (F.col("id") / 7).cast("int")).alias("date_local"), "id")
    path = str(tmp_path / "pages")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        pages = index_pages(df, path=path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = [tuple(r) for r in df.orderBy("site_id", "date_local").collect()]
    assert pages.rows == 1000 and pages.count(300) == 4 and pages.count(1000) == 1
    before = sorted(p.name for p in tmp_path.rglob("*"))
    for number, size in ((1, 50), (7, 50), (20, 50), (4, 300), (1, 2000), (21, 50)):
        assert [tuple(r) for r in pages.page(spark, number, size).collect()] == want[(number - 1) * size : number * size]
    assert sorted(p.name for p in tmp_path.rglob("*")) == before
    assert len(pages.parts) > 1
    one = pages.page(spark, 1, 10)
    assert len(one.inputFiles()) == 1 < len(spark.read.parquet(f"{path}/rows").inputFiles())
    again = open_pages(spark, path)
    assert again == pages and again.place_of(("9", dt.date(2027, 1, 1))) == 1000 and again.place_of(("0", dt.date(2025, 1, 1))) == 0


def test_pages_of_nothing_and_of_clashing_names(spark):
    empty = index_pages(spark.range(0).selectExpr("id", "id as _x"), ["id"])
    assert empty.rows == 0 and empty.count(10) == 1 and empty.page(spark, 1, 10).columns == ["id", "_x"] and empty.page(spark, 1, 10).isEmpty()
    nulls = spark.createDataFrame([(None, 1), ("b", 2), ("a", 3)], "k string, rows int")
    assert [r[0] for r in index_pages(nulls, ["k"]).page(spark, 1, 5).collect()] == [None, "a", "b"]


def jobs_of(spark, work):
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "counted")
    try:
        result = work()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)), result
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_a_checked_write_counts_what_the_report_counts(spark, snapshot, tmp_path):
    spec = PRODUCTS["weather_recent"]
    good = read_product(spark, snapshot, "weather_recent")
    bad = good.withColumns(
        {"wind_speed_10m_max": F.when(F.col("site_id") == "galle", -1.0).otherwise(F.col("wind_speed_10m_max")), "pressure_msl_mean": F.lit("heavy")}
    )
    known = spark.createDataFrame([(s,) for s in CONFIGURED_SITES[1:]], "site_id string")
    for sites in (CONFIGURED_SITES, known):
        for name, df in (("good", good), ("bad", bad.union(bad))):
            folder = str(tmp_path / f"{name}-{type(sites).__name__}")
            done = checked_write(df, spec, folder, "weather", sites)
            want = product_report(df, spec, sites)
            assert rows(done.report, "rule", "column", "violations") == rows(want, "rule", "column", "violations")
            assert done.committed == want.where("violations > 0").isEmpty()
            left = sorted(p.name for p in (tmp_path / f"{name}-{type(sites).__name__}").iterdir() if not p.name.endswith(".crc"))
            assert left == (["weather"] if done.committed else [])
    back = write_product(good, spec, str(tmp_path / "w"), "weather")
    assert back.schema.simpleString() == typed_product(good, spec).schema.simpleString() and rows(back, "site_id", "date_local") == rows(good, "site_id", "date_local")
    with pytest.raises(FileExistsError):
        write_product(good, spec, str(tmp_path / "w"), "weather")
    with pytest.raises(ContractError) as caught:
        write_product(bad, spec, str(tmp_path / "v"), "weather")
    assert caught.value.code == "V7"
    assert checked_write(good.limit(0), spec, str(tmp_path / "e"), "weather").committed


def test_a_checked_write_reads_the_source_once(spark, snapshot, tmp_path):
    spec = PRODUCTS["weather_recent"]
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    source = read_product(spark, snapshot, "weather_recent")
    watched = source.mapInArrow(counted, source.schema)
    assert checked_write(watched, spec, str(tmp_path / "once"), "weather").committed
    assert read.value == source.count()


def test_coverage_out_of_merged_states(spark, bundle):
    daily = daily_panel(bundle, True, TODAY).withColumn("marine_complete", F.col("marine_complete") & (F.dayofmonth("date_local") % 5 != 0))
    daily = daily.withColumn("complete_pair", F.col("weather_complete") & F.col("marine_complete"))
    parts = [daily.where("date_local < '2025-03-15'"), daily.where("date_local >= '2025-03-01'"), daily.where("site_id = 'galle'"), daily.limit(0)]
    state = cov.merged_states(*map(cov.coverage_state, parts))
    assert state.count() == state.select("site_id", "month").distinct().count()
    for start, end in (("2010-01-01", "2026-10-08"), ("2024-02-10", "2026-08-31"), ("2024-12-31", "2025-01-01"), ("2025-05-05", "2025-05-05")):
        got, want = cov.coverage_from_state(state, bundle.sites, start, end), cov.coverage_by_year(daily, bundle.sites, start, end)
        assert rows(got, *want.columns) == rows(want)
    days = cov.monthly_days(state, "2025-01-01", "2025-01-31").where("site_id = 'galle'").first()
    assert days.available_rows == 31 and days.marine_days == 25


def test_an_export_runs_its_plan_once(spark, bundle, tmp_path):
    daily = daily_panel(bundle, as_of=TODAY).select("site_id", "date_local", "wave_height_max", "is_synthetic").cache()
    for fmt in ("csv", "json", "parquet"):
        read = spark.sparkContext.accumulator(0)

        def counted(batches, read=read):
            for batch in batches:
                read.add(batch.num_rows)
                yield batch

        path = export(daily.mapInArrow(counted, daily.schema), str(tmp_path), "daily", fmt, limit=1_000_000)
        assert read.value == daily.count() and path.endswith(f"/daily.{fmt}")


def test_a_series_reads_its_inputs_once(spark, bundle):
    history, ahead = daily_panel(bundle, True, TODAY), forecast_panel(bundle)
    series = metric_series(history, ahead, "wave_height_max", "2026-09-01", "2026-10-08", ["galle"])
    text = series._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in text.splitlines() if "FileScan parquet" in line and "date_local" in line]
    # Two products of the past and one of forecasts in each of two domains.
    assert len(scans) == 6
    got = rows(series, "series", "date_local")
    assert sum(s == "history" for s, _ in got) == 38 and sum(s == "forecast" for s, _ in got) == 8
