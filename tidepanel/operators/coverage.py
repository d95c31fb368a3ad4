"""Coverage against the calendar that was expected."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.contracts.rules import known_frame
from tidepanel.contracts.validate import Known
from tidepanel.functions.dates import DayLike, as_day, local_today
from tidepanel.functions.stats import percent
from tidepanel.specs import DAY, SITE

COUNTS = ("available_rows", "weather_days", "marine_days", "paired_days")


def coverage_by_year(
    daily: DataFrame, sites: Known, start: DayLike = "2010-01-01", end: DayLike = None
) -> DataFrame:
    """Expected, available and paired days for every site and year, absent ones too.

    ``sites`` is a table with the sites expected, or a list of them.  The daily table is aggregated before it meets the spine, so only one row per
    site-year is shuffled to the join.
    """
    first = as_day(start)
    last = F.date_sub(local_today(), 1) if end is None else as_day(end)
    counts = (
        daily.where(F.col(DAY).between(first, last))
        .groupBy(SITE, F.year(DAY).alias("year"))
        .agg(
            F.count(F.lit(1)).alias("available_rows"),
            F.count_if("weather_complete").alias("weather_days"),
            F.count_if("marine_complete").alias("marine_days"),
            F.count_if("complete_pair").alias("paired_days"),
        )
    )
    return _against_calendar(counts, sites, start, end)


def _against_calendar(counts: DataFrame, sites: Known, start: DayLike, end: DayLike) -> DataFrame:
    """Counts of site-years beside the days that were expected."""
    first = as_day(start)
    last = F.date_sub(local_today(), 1) if end is None else as_day(end)
    years = F.when(F.year(first) <= F.year(last), F.sequence(F.year(first), F.year(last)))
    spine = known_frame(counts.sparkSession, sites).select(SITE, F.explode(years).alias("year"))
    lower = F.greatest(first, F.make_date("year", F.lit(1), F.lit(1)))
    upper = F.least(last, F.make_date("year", F.lit(12), F.lit(31)))
    expected = F.greatest(F.lit(0), F.datediff(upper, lower) + 1)
    report = spine.withColumn("expected_days", expected).join(counts, [SITE, "year"], "left")
    return report.na.fill(0, list(COUNTS)).withColumns(
        {
            "missing_pair_days": F.col("expected_days") - F.col("paired_days"),
            "coverage_pct": percent(F.col("paired_days"), F.col("expected_days"), 2),
        }
    )


#: Kinds of days that a state holds a bitmap of, and the condition each stands for.
DAYS_OF = {"available_rows": None, "weather_days": "weather_complete", "marine_days": "marine_complete", "paired_days": "complete_pair"}


def coverage_state(daily: DataFrame) -> DataFrame:
    """Per site and month one bitmap of days for each kind of day: bit ``d - 1`` stands for day ``d``.

    A state is a few whole numbers a month, and states of overlapping deliveries merge by OR, so a
    refresh reads the new rows and the stored states, never the rows before.
    """
    bit = F.expr(f"shiftleft(1, dayofmonth({DAY}) - 1)")
    masks = [F.bit_or(bit if flag is None else F.when(F.col(flag), bit).otherwise(0)).alias(name) for name, flag in DAYS_OF.items()]
    return daily.where(F.col(DAY).isNotNull()).groupBy(SITE, F.trunc(DAY, "month").alias("month")).agg(*masks)


def merged_states(*states: DataFrame) -> DataFrame:
    """One state out of several; partial states of one site-month meet after map-side merging."""
    every = reduce(DataFrame.unionByName, states)
    return every.groupBy(SITE, "month").agg(*[F.bit_or(name).alias(name) for name in DAYS_OF])


def monthly_days(state: DataFrame, start: DayLike, end: DayLike) -> DataFrame:
    """Number of days of each kind per site and month, of those from ``start`` to ``end``."""
    low = F.greatest(F.datediff(as_day(start), F.col("month")), F.lit(0))
    high = F.least(F.datediff(as_day(end), F.col("month")), F.lit(30))
    inside = state.withColumns({"_low": low, "_high": high}).where("_low <= _high")
    inside = inside.withColumn("_mask", F.expr("cast(shiftleft(1L, _high + 1) - shiftleft(1L, _low) as int)"))
    return inside.select(SITE, "month", *[F.bit_count(F.col(name).bitwiseAND(F.col("_mask"))).cast("long").alias(name) for name in DAYS_OF])


def coverage_from_state(state: DataFrame, sites: Known, start: DayLike = "2010-01-01", end: DayLike = None) -> DataFrame:
    """``coverage_by_year`` out of a state."""
    last = F.date_sub(local_today(), 1) if end is None else as_day(end)
    days = monthly_days(state, start, last)
    counts = days.groupBy(SITE, F.year("month").alias("year")).agg(*[F.sum(name).alias(name) for name in COUNTS])
    return _against_calendar(counts, sites, start, end)


def coverage_rollup(report: DataFrame) -> DataFrame:
    return report.groupBy("year").agg(
        *[F.sum(c).alias(c) for c in ("expected_days", "paired_days", "missing_pair_days")]
    )


def coverage_table(report: DataFrame, years: Sequence[int]) -> DataFrame:
    """One row per site and one coverage column per year."""
    return report.groupBy(SITE).pivot("year", list(years)).agg(F.first("coverage_pct"))
