import datetime as dt
import os
import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]

from pyspark.sql import functions as F  # noqa: E402

from tidepanel.session import build_session  # noqa: E402
from tidepanel.sources.bundle import load_snapshot  # noqa: E402
from tidepanel.specs import CONFIGURED_SITES  # noqa: E402

from panel_data import made_products  # noqa: E402

TODAY = dt.date(2026, 10, 9)
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[4]",
        spark__sql__shuffle__partitions="4",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
        spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")),
        spark__driver__memory="4g",
        spark__sql__maxMetadataStringLength="10000",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(autouse=True)
def no_cached_plans(spark):
    """A frame cached by one test must not stand in for another test's plan."""
    yield
    spark.catalog.clearCache()


@pytest.fixture(scope="session")
def registry(spark):
    rows = [
        (s, f"Harbour {s}", "West" if i % 2 else "East", 6.0 + i / 10, 79.5 + i / 10, 6.0 + i / 10, 79.4 + i / 10)
        for i, s in enumerate(CONFIGURED_SITES)
    ]
    return spark.createDataFrame(
        rows, "site_id string, name string, coastal_sector string, lat_land double, lon_land double, lat_sea double, lon_sea double"
    )


@pytest.fixture(scope="session")
def snapshot(spark, registry, tmp_path_factory):
    """A published snapshot on disk: six products with year folders, and the registry."""
    root = tmp_path_factory.mktemp("snapshot")
    for name, df in made_products(registry, TODAY).items():
        df.withColumn("year", F.year("date_local")).repartition("year").write.partitionBy("year").parquet(f"{root}/data/{name}")
    (root / "metadata").mkdir()
    registry.toPandas().to_csv(root / "metadata" / "sites.csv", index=False)
    return str(root)


@pytest.fixture(scope="session")
def bundle(spark, snapshot):
    return load_snapshot(spark, snapshot)


def rows(df, *columns):
    picked = df.select(*columns) if columns else df
    return sorted(tuple(r) for r in picked.collect())


@pytest.fixture
def weather_rows(spark):
    """Hand-made typed weather records: (site, day, product, snapshot, complete, wind)."""

    def build(data):
        schema = (
            "site_id string, date_local string, product string, snapshot_id string, "
            "complete_core boolean, wind_speed_10m_max double"
        )
        df = spark.createDataFrame(data, schema).withColumn("date_local", F.to_date("date_local"))
        return df.withColumns({"model": F.lit("m"), "is_synthetic": F.lit(False)})

    return build
