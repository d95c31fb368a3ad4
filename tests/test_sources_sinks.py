"""Scans, bundles and exports, through files."""

import datetime as dt
import shutil
from pathlib import Path

import pandas as pd
import pytest
from panel_data import made_bundle
from pyspark.sql import functions as F

from conftest import TODAY, rows
from tidepanel import ContractError, daily_panel, load_manifest, load_snapshot, validate_product
from tidepanel.plans.panel import explorer, export_view, publish, timeline
from tidepanel.sinks.export import export, write_panel
from tidepanel.sources.scans import product_of_file, read_product, read_records, read_registry, route
from tidepanel.contracts.validate import validate_records
from tidepanel.specs import PRODUCTS


def test_partition_folders_do_not_become_columns(spark, snapshot):
    df = read_product(spark, snapshot, "weather_recent")
    assert "year" not in df.columns and df.count() == 16 * 7
    assert read_product(spark, snapshot, "nothing") is None


def test_empty_product_folder_is_absent(spark, tmp_path):
    (tmp_path / "data" / "weather_recent").mkdir(parents=True)
    assert read_product(spark, str(tmp_path), "weather_recent") is None


def test_column_missing_from_one_shard_is_null_and_from_all_is_rejected(spark, snapshot, tmp_path):
    root = tmp_path / "s"
    shutil.copytree(snapshot, root)
    shard = spark.read.parquet(f"{snapshot}/data/weather_recent").drop("year", "precipitation_sum")
    moved = shard.withColumn("snapshot_id", F.lit("2026-10-08"))
    moved.write.parquet(f"{root}/data/weather_recent/extra")
    bundle = load_snapshot(spark, str(root))
    counts = dict(rows(bundle.products["weather_recent"].groupBy("complete_core").count()))
    assert counts == {True: 112, False: 112}
    # Complete records still win over the newer incomplete snapshot.
    assert daily_panel(bundle, True, TODAY).where("not weather_complete").isEmpty()
    shutil.rmtree(root / "data" / "weather_recent")
    shard.write.parquet(f"{root}/data/weather_recent")
    with pytest.raises(ContractError) as caught:
        load_snapshot(spark, str(root))
    assert caught.value.code == "V1"


def test_shards_may_hold_a_column_in_different_types(spark, snapshot, tmp_path):
    whole = spark.read.parquet(f"{snapshot}/data/marine_recent").drop("year")
    parts = {
        "a": whole.where("date_local < '2026-10-04'"),
        "b": whole.where("date_local = '2026-10-04'").withColumn("wave_period_max", F.col("wave_period_max").cast("long")),
        "c": whole.where("date_local > '2026-10-04'").withColumns(
            {"date_local": F.col("date_local").cast("string"), "wave_height_max": F.col("wave_height_max").cast("string")}
        ),
    }
    for name, df in parts.items():
        df.coalesce(1).write.parquet(f"{tmp_path}/data/marine_recent/{name}")
    merged = read_product(spark, str(tmp_path), "marine_recent")
    typed = validate_product(merged, PRODUCTS["marine_recent"])
    assert typed.schema["date_local"].dataType.simpleString() == "date"
    columns = ["site_id", "date_local", "wave_height_max", "wave_direction_dominant"]
    assert rows(typed, *columns) == rows(whole, *columns)
    assert typed.where("date_local = '2026-10-04' and wave_period_max <> floor(wave_period_max)").isEmpty()


def test_manifest_reads_only_listed_files(spark, snapshot):
    listed = [
        str(p.relative_to(snapshot)) for p in Path(snapshot, "data").rglob("*.parquet") if "weather_forecasts" not in str(p)
    ]
    assert set(route(listed + ["metadata/sites.csv", "data/unknown/x.parquet", "data/weather_recent/readme.md"])) == {
        "weather_reanalysis", "marine_reanalysis", "weather_recent", "marine_recent", "marine_forecasts",
    }
    assert set(route(["/data/old/data/weather_recent/year=2026/a.parquet"])) == {"weather_recent"}
    bundle = load_manifest(spark, snapshot, listed, "abc123")
    assert "weather_forecasts" not in bundle.products and bundle.revision == "abc123"
    assert daily_panel(bundle, as_of=TODAY).select("hf_revision").distinct().first()[0] == "abc123"
    with pytest.raises(ContractError):
        load_manifest(spark, snapshot, [p for p in listed if "marine_reanalysis" not in p], "abc123")


def test_product_from_file_path(spark, snapshot):
    df = spark.read.option("recursiveFileLookup", "true").option("mergeSchema", "true").parquet(f"{snapshot}/data")
    assert dict(rows(product_of_file(df).groupBy("product").count()))["marine_forecasts"] == 112


def test_csv_with_byte_order_mark(spark, tmp_path):
    path = tmp_path / "catch.csv"
    path.write_text(
        "﻿site_id,date_local,species,fish_category,catch_weight_kg,source,source_url\n"
        'galle,2026-10-01,balaya,large_pelagic,20.5,"Research, unit 1",https://example.org\n',
        encoding="utf-8",
    )
    df = validate_records(read_records(spark, str(path)), "catch")
    assert df.first()["catch_weight_kg"] == 20.5 and df.first()["source"] == "Research, unit 1"


def test_registry_extra_columns_ride_along(spark, snapshot, bundle):
    assert read_registry(spark, f"{snapshot}/metadata/sites.csv").count() == 16
    assert daily_panel(bundle, as_of=TODAY).where("coastal_sector is null").isEmpty()


@pytest.fixture(scope="module")
def three(spark, registry):
    bundle = made_bundle(registry, TODAY)
    picked = daily_panel(bundle, as_of=TODAY, sites=["galle"], dates=("2026-09-01", "2026-09-03"))
    holed = picked.withColumn("wave_height_max", F.when(F.col("date_local") != "2026-09-02", F.col("wave_height_max")))
    return spark.createDataFrame(holed.orderBy("date_local").collect(), holed.schema)


@pytest.mark.parametrize("fmt", ["CSV", "JSON", "Parquet"])
def test_export_roundtrip(spark, three, tmp_path, fmt):
    path = export(three, str(tmp_path), "daily", fmt)
    assert Path(path).name == f"SYNTHETIC_DEMO_daily.{fmt.lower()}"
    reader = {"CSV": lambda: spark.read.option("header", True).csv(path), "JSON": lambda: spark.read.json(path), "Parquet": lambda: spark.read.parquet(path)}
    back = reader[fmt]()
    assert back.count() == 3 and set(back.columns) == set(three.columns)
    assert rows(back.select(F.col("is_synthetic").cast("boolean"), "weather_model").distinct()) == [(True, "era5")]
    values = [(r[0], r[1]) for r in back.select(F.col("date_local").cast("string").substr(1, 10), F.col("wave_height_max").cast("double")).orderBy(F.col("date_local")).collect()]
    want = [(str(r[0]), r[1]) for r in three.select("date_local", "wave_height_max").collect()]
    assert values == want and values[1][1] is None
    text = "".join(p.read_text(encoding="utf-8") for p in sorted(Path(path).glob("part-*"))) if fmt != "Parquet" else ""
    if fmt == "CSV":
        assert text.startswith("﻿site_id,") and "2026-09-01" in text
    if fmt == "JSON":
        assert '"date_local":"2026-09-01T00:00:00.000"' in text and '"wave_height_max":null' in text


def test_csv_quotes_and_lists(spark, tmp_path):
    note = 'said "calm", then left'
    df = spark.createDataFrame([("a", note, [203, 69])], "site_id string, note string, color array<int>")
    path = export(df, str(tmp_path), "notes", "csv")
    part = next(Path(path).glob("part-*.csv"))
    assert pd.read_csv(part, encoding="utf-8-sig").iloc[0].to_dict() == {"site_id": "a", "note": note, "color": "[203,69]"}
    assert read_records(spark, path).first()[:] == ("a", note, "[203,69]")
    broken = tmp_path / "lines.csv"
    broken.write_text('site_id,note\na,"two\nlines"\n')
    assert read_records(spark, str(broken), multi_line=True).first()["note"] == "two\nlines"


def test_export_limit_and_formats(three, tmp_path):
    with pytest.raises(ContractError) as caught:
        export(three, str(tmp_path), "x", "csv", limit=2)
    assert caught.value.code == "V35"
    assert export(three, str(tmp_path), "x", "csv", limit=3)
    with pytest.raises(ValueError):
        export(three, str(tmp_path), "x", "xlsx")


def test_export_refuses_to_mix_synthetic_rows(three, tmp_path):
    mixed = three.withColumn("is_synthetic", F.col("date_local") != "2026-09-02")
    with pytest.raises(Exception, match="must not share"):
        export(mixed, str(tmp_path), "mixed", "parquet")
    assert not list(tmp_path.rglob("_SUCCESS"))


def test_panel_table_is_split_by_year_and_prunes(spark, bundle, tmp_path):
    write_panel(daily_panel(bundle, as_of=TODAY), str(tmp_path / "panel"))
    panel = spark.read.parquet(str(tmp_path / "panel"))
    assert {p.name for p in (tmp_path / "panel").glob("year=*")} == {f"year={y}" for y in (2023, 2024, 2025, 2026)}
    assert panel.where("year = 2024").count() == 16 * 366
    plan = panel.where("year = 2024 and site_id = 'galle'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "EqualTo(site_id,galle)" in plan


def test_publish_and_whole_timeline(spark, bundle, tmp_path):
    panel, coverage = publish(bundle, str(tmp_path), TODAY, "2023-01-01")
    assert spark.read.parquet(panel).count() == 16 * 1091
    report = spark.read.option("header", True).option("inferSchema", True).csv(coverage)
    assert report.count() == 16 * 4 and report.agg(F.sum("paired_days")).first()[0] == 16 * 1091
    path = export_view(bundle, "timeline", str(tmp_path), "parquet", TODAY)
    assert spark.read.parquet(path).count() == timeline(bundle, TODAY).count() and path.endswith("/timeline.parquet")


def test_explorer_over_a_bundle(bundle):
    dates = (dt.date(2026, 10, 1), dt.date(2026, 10, 12))
    assert explorer(bundle, "timeline", ["galle", "negombo"], dates, as_of=TODAY).count() == 24
    assert explorer(bundle, "forecasts", ["galle"], dates, as_of=TODAY).count() == 4
    assert explorer(bundle, "past", [], dates, as_of=TODAY).isEmpty()
    assert explorer(bundle, "past", ["galle"], dates, severity=[], as_of=TODAY).isEmpty()


def test_swapped_headers_are_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text("site_id,date_local,species\ngalle,2026-01-01,tuna\n")
    (tmp_path / "b.csv").write_text("species,site_id,date_local\ntuna,galle,2026-01-01\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_records(spark, str(tmp_path)).collect()


def test_short_rows_are_refused_whatever_is_read(spark, tmp_path):
    (tmp_path / "a.csv").write_text("site_id,date_local,species\ngalle,2026-01-01,tuna\ngalle,2026-01-02\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        read_records(spark, str(tmp_path)).select("site_id").collect()


def test_registry_texts_without_value(spark, tmp_path):
    (tmp_path / "s.csv").write_text("site_id,name\ngalle,NA\n")
    assert read_registry(spark, str(tmp_path)).first()["name"] is None
