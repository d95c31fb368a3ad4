"""Every rule rejects what it should and nothing else."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tidepanel import ContractError, cardinality_report, enforce, validate_product, validate_profiles, validate_records, validate_registry
from tidepanel.contracts.validate import product_report, registry_report
from tidepanel.sources.bundle import assemble
from tidepanel.specs import CONFIGURED_SITES, PRODUCTS

WEATHER, MARINE = PRODUCTS["weather_reanalysis"], PRODUCTS["marine_reanalysis"]
DERIVED = ("complete_core", "product", "is_synthetic")


@pytest.fixture(scope="module")
def weather(spark, bundle):
    """Two raw weather rows, held as local data so that each case is quick."""
    raw = bundle.products["weather_reanalysis"].drop(*DERIVED)
    picked = raw.where("site_id = 'galle' and date_local between '2025-01-01' and '2025-01-02'")
    return spark.createDataFrame(picked.collect(), picked.schema)


@pytest.fixture(scope="module")
def marine(spark, bundle):
    raw = bundle.products["marine_reanalysis"].drop(*DERIVED)
    picked = raw.where("site_id = 'galle' and date_local = '2025-01-01'")
    return spark.createDataFrame(picked.collect(), picked.schema)


def broken(df, column, value, spec=WEATHER):
    with pytest.raises(ContractError) as caught:
        validate_product(df.withColumn(column, value if hasattr(value, "cast") else F.lit(value)), spec)
    return caught.value.code


def test_good_rows_pass(weather, marine):
    typed = validate_product(weather, WEATHER)
    assert typed.where("complete_core and not is_synthetic and product = 'weather_reanalysis'").count() == 2
    assert validate_product(marine, MARINE).count() == 1
    assert typed.schema["precipitation_sum"].metadata["unit"] == "mm"


@pytest.mark.parametrize(
    "column,value,code",
    [
        ("snapshot_id", F.lit, "V2"),
        ("date_local", "2026/01/05", "V3"),
        ("date_local", "2026-1-5", "V3"),
        ("date_local", dt.datetime(2026, 1, 5, 6), "V3"),
        ("site_id", "atlantis", "V4"),
        ("model", "gfs", "V5"),
        ("precipitation_sum", "trace", "V7"),
        ("precipitation_sum", float("inf"), "V8"),
        ("wind_direction_10m_dominant", 999.0, "V9"),
        ("wind_direction_10m_dominant", -0.5, "V9"),
        ("precipitation_sum", -1.0, "V10"),
        ("wind_speed_10m_mean", -0.1, "V10"),
        ("temperature_2m_max", 61.0, "V11"),
        ("relative_humidity_2m_mean", 100.5, "V12"),
        ("precipitation_hours", 24.5, "V13"),
        ("pressure_msl_mean", 799.0, "V14"),
        ("temperature_2m_min", 55.0, "V15"),
    ],
)
def test_bad_values_are_rejected(weather, column, value, code):
    value = F.lit(None).cast("string") if value is F.lit else value
    assert broken(weather, column, value) == code


def test_range_ends_and_missing_values_are_allowed(weather):
    for column, value in [
        ("wind_direction_10m_dominant", 0.0),
        ("wind_direction_10m_dominant", 360.0),
        ("precipitation_hours", 24.0),
        ("pressure_msl_mean", 1100.0),
    ]:
        validate_product(weather.withColumn(column, F.lit(value)), WEATHER)
    gap = validate_product(weather.withColumn("precipitation_sum", F.lit(float("nan"))), WEATHER)
    assert gap.where("not complete_core and precipitation_sum is null").count() == 2
    # Reversed temperatures only count on complete rows.
    reversed_bounds = weather.withColumns({"temperature_2m_min": F.lit(55.0), "precipitation_sum": F.lit(None).cast("double")})
    validate_product(reversed_bounds, WEATHER)
    texts = weather.withColumns({"precipitation_sum": F.lit("1.5"), "date_local": F.col("date_local").cast("string")})
    assert validate_product(texts, WEATHER).agg(F.sum("precipitation_sum")).first()[0] == 3.0


def test_marine_bounds(marine):
    assert broken(marine, "wave_height_max", -1.0, MARINE) == "V10"
    assert broken(marine, "wave_direction_dominant", 361.0, MARINE) == "V9"


def test_duplicates_and_missing_columns(weather):
    with pytest.raises(ContractError, match="duplicate"):
        validate_product(weather.union(weather), WEATHER)
    with pytest.raises(ContractError, match="pressure_msl_mean"):
        validate_product(weather.drop("pressure_msl_mean"), WEATHER)


def test_report_counts_without_raising(weather):
    report = product_report(weather.withColumn("precipitation_sum", F.lit(-1.0)), WEATHER)
    assert rows(report.where("violations > 0")) == [("weather_reanalysis", "V10", "precipitation_sum", 2)]
    # A registry table instead of a list gives the same counts.
    known = weather.sparkSession.createDataFrame([("negombo",)], "site_id string")
    assert rows(product_report(weather, WEATHER, known).where("violations > 0")) == [("weather_reanalysis", "V4", "site_id", 2)]


def test_registry_rules(registry):
    assert validate_registry(registry).count() == 16
    cases = {
        "V16": registry.drop("lat_sea"),
        "V18": registry.withColumn("lat_sea", F.when(F.col("site_id") != "galle", F.col("lat_sea"))),
        "V19": registry.withColumn("lon_sea", F.lit(90.0)),
    }
    for code, bad in cases.items():
        with pytest.raises(ContractError) as caught:
            validate_registry(bad)
        assert caught.value.code == code
    other = registry.where("site_id <> 'galle'")
    swapped = other.union(other.where("site_id = 'chilaw'")).union(
        registry.where("site_id = 'galle'").withColumn("site_id", F.lit("atlantis"))
    )
    counts = dict(rows(registry_report(swapped).where("rule = 'V17'"), "column", "violations"))
    assert counts == {"duplicate site_id": 1, "unknown site_id": 1, "absent site_id": 1}


def test_bundle_needs_both_reanalysis_products(bundle, registry):
    raw = {name: df.drop(*DERIVED) for name, df in bundle.products.items()}
    for lost in ({"marine_reanalysis": None}, {"weather_reanalysis": raw["weather_reanalysis"].limit(0)}):
        parts = {k: v for k, v in {**raw, **lost}.items() if v is not None}
        with pytest.raises(ContractError) as caught:
            assemble(parts, registry, "r")
        assert caught.value.code == "V20"


CATCH = ("galle", "2026-10-01", "balaya", "large_pelagic", "20", "Research", "https://example.org")
CATCH_COLUMNS = ["site_id", "date_local", "species", "fish_category", "catch_weight_kg", "source", "source_url"]
OCEAN = ("galle", "2026-10-01", "28.1", "model_estimate", "Research", "https://example.org")
OCEAN_COLUMNS = ["site_id", "date_local", "sea_surface_temperature", "measurement_kind", "source", "source_url"]
PROFILE = ("balaya", "Skipjack tuna", "large_pelagic", "Not supplied", "Not supplied", "User reference", "https://example.org")
PROFILE_COLUMNS = ["species", "common_name", "fish_category", "depth_zone", "seasonal_note", "source", "source_url"]


def text_frame(spark, columns, *records):
    return spark.createDataFrame([tuple(r) for r in records], ", ".join(f"{c} string" for c in columns))


def changed(record, columns, **values):
    return tuple(values.get(c, v) for c, v in zip(columns, record))


def code_of(df, kind, **options):
    with pytest.raises(ContractError) as caught:
        validate_records(df, kind, **options)
    return caught.value.code


def test_catch_contract(spark):
    good = text_frame(spark, CATCH_COLUMNS, CATCH)
    typed = validate_records(good, "catch").first()
    assert typed["catch_weight_kg"] == 20.0 and typed["date_local"] == dt.date(2026, 10, 1) and not typed["is_synthetic"]
    for code, values in {
        "V24": {"site_id": "missing"},
        "V31": {"catch_weight_kg": ""},
        "V22": {"source": "NA"},
        "V25": {"date_local": "01/10/2026"},
        "V28": {"catch_weight_kg": "-1"},
        "V30": {"fish_category": "shellfish"},
    }.items():
        assert code_of(text_frame(spark, CATCH_COLUMNS, changed(CATCH, CATCH_COLUMNS, **values)), "catch") == code
    assert code_of(good.union(good), "catch") == "V26"
    assert code_of(good.drop("source"), "catch") == "V21"
    two = good.union(text_frame(spark, CATCH_COLUMNS, changed(CATCH, CATCH_COLUMNS, species="thora")))
    assert code_of(two, "catch", limit=1) == "V23"
    assert validate_records(two, "catch", limit=2).count() == 2


def test_ocean_contract(spark):
    good = text_frame(spark, OCEAN_COLUMNS, OCEAN)
    typed = validate_records(good, "ocean")
    assert typed.where("not is_synthetic").count() == 1
    assert typed.schema["sea_surface_temperature"].metadata["unit"] == "°C"
    for code, values in {
        "V29": {"sea_surface_temperature": "46"},
        "V28": {"sea_surface_temperature": "warm"},
        "V32": {"measurement_kind": "guess"},
    }.items():
        assert code_of(text_frame(spark, OCEAN_COLUMNS, changed(OCEAN, OCEAN_COLUMNS, **values)), "ocean") == code
    assert code_of(good.withColumn("salinity", F.lit("-1")), "ocean") == "V28"
    assert code_of(good.drop("sea_surface_temperature"), "ocean") == "V27"
    # An empty variable is allowed, and so is a sea colder than zero.
    assert validate_records(good.withColumn("sea_surface_temperature", F.lit("-4")).withColumn("salinity", F.lit("")), "ocean").count() == 1


def test_profile_contract(spark):
    good = text_frame(spark, PROFILE_COLUMNS, PROFILE)
    assert validate_profiles(good).count() == 1
    with pytest.raises(ContractError):
        validate_profiles(good.withColumn("source", F.lit("")))
    with pytest.raises(ContractError):
        validate_profiles(good.union(good))
    # The catalogue does not restrict its categories.
    assert validate_profiles(good.withColumn("fish_category", F.lit("shellfish"))).count() == 1


def test_cardinality(spark):
    left = spark.createDataFrame([(1,), (1,)], "k int")
    right = spark.createDataFrame([(1,)], "k int")
    enforce(cardinality_report(left, right, ["k"], "many_to_one"))
    with pytest.raises(ContractError):
        enforce(cardinality_report(left, right, ["k"]))


def test_configured_sites_are_sixteen():
    assert len(set(CONFIGURED_SITES)) == 16
