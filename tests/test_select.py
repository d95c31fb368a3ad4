"""Best records, vintages and tie rules on hand-made rows."""

import datetime as dt
import itertools
from zoneinfo import ZoneInfo

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import rows
from tidepanel.functions.dates import horizon_start, local_today
from tidepanel.operators.select import best_records, known_at, latest_vintage

RE, NOW = "weather_reanalysis", "weather_recent"


def pick(df):
    return rows(best_records(df), "site_id", "date_local", "product", "snapshot_id")


def test_preference_order(weather_rows):
    day = dt.date(2026, 1, 1)
    data = [
        ("a", "2026-01-01", RE, "historical", False, 1.0),
        ("a", "2026-01-01", NOW, "historical", True, 2.0),
        ("b", "2026-01-01", RE, "historical", True, 1.0),
        ("b", "2026-01-01", NOW, "2026-02-01", True, 2.0),
        ("c", "2026-01-01", RE, "historical", False, 1.0),
        ("c", "2026-01-01", NOW, "2026-02-01", False, 2.0),
    ]
    assert pick(weather_rows(data)) == [
        ("a", day, NOW, "historical"),
        ("b", day, RE, "historical"),
        ("c", day, RE, "historical"),
    ]


def test_vintage_order_does_not_depend_on_row_order(weather_rows):
    labels = ["historical", "2026-10-08", "2026-10-09T08:00:00Z"]
    for order in itertools.permutations(labels):
        data = [("a", "2026-01-01", RE, label, True, 1.0) for label in order]
        assert pick(weather_rows(data))[0][3] == "2026-10-09T08:00:00Z"


def test_unreadable_labels_compare_as_text(weather_rows):
    data = [("a", "2026-01-01", RE, label, True, 1.0) for label in ("run-2", "run-1")]
    assert pick(weather_rows(data))[0][3] == "run-2"


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(
        st.tuples(
            st.sampled_from("abc"),
            st.sampled_from(["2026-01-01", "2026-01-02"]),
            st.sampled_from([RE, NOW]),
            st.sampled_from(["historical", "2026-01-05", "2026-01-06", "z"]),
            st.booleans(),
            st.floats(0, 10),
        ),
        min_size=1,
        max_size=20,
        unique_by=lambda r: r[:4],
    )
)
def test_one_row_per_key_whatever_the_partitions(weather_rows, data):
    df = weather_rows(data)
    one, many = pick(df.coalesce(1)), pick(df.repartition(5))
    assert one == many
    assert len(one) == len({r[:2] for r in data})

    def rank(r):
        parsed = r[3] if r[3].startswith("2026") else ""
        return (2 * r[4] + (r[2] == RE), parsed, r[3])

    best = {}
    for r in data:
        if r[:2] not in best or rank(r) > rank(best[r[:2]]):
            best[r[:2]] = r
    assert [(s, str(d), p, v) for s, d, p, v in one] == sorted((r[0], r[1], r[2], r[3]) for r in best.values())


def test_latest_vintage_by_text_or_instant(spark):
    df = spark.createDataFrame(
        [("a", "2026-10-09T08:00:00+05:00", 1), ("a", "2026-10-09T04:00:00Z", 2)], "site_id string, forecast_vintage string, v int"
    ).withColumn("date_local", F.lit(dt.date(2026, 10, 9)))
    assert latest_vintage(df).first()["v"] == 1
    assert latest_vintage(df, parse=True).first()["v"] == 2


def test_known_at_leaves_out_undated_labels(spark):
    df = spark.createDataFrame([("2026-10-01",), ("2026-10-03",), ("historical",)], "forecast_vintage string")
    assert rows(known_at(df, F.lit("2026-10-02").cast("timestamp"))) == [("2026-10-01",)]


def test_local_today_ignores_the_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ("UTC", "Pacific/Kiritimati", "America/Los_Angeles"):
            spark.conf.set("spark.sql.session.timeZone", name)
            expected = dt.datetime.now(ZoneInfo("Asia/Colombo")).date()
            assert spark.range(1).select(local_today()).first()[0] == expected
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_horizons(spark):
    end = F.lit(dt.date(2024, 2, 29))
    starts = spark.range(1).select(
        horizon_start("last_30_days", end), horizon_start("last_12_months", end), horizon_start("all_years", end)
    ).first()
    assert starts[:] == (dt.date(2024, 1, 31), dt.date(2023, 3, 1), dt.date(2021, 2, 28))
    with pytest.raises(ValueError):
        horizon_start("decade", end)
