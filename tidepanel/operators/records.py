"""Catch records, kept at their own grain of site, day and species."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.stats import circular_mean, percent
from tidepanel.specs import DAY, SITE, SPECIES_CATALOGUE

WEIGHT = "catch_weight_kg"


def species_share(catch: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return catch.groupBy(*by, "species").agg(F.sum(WEIGHT).alias(WEIGHT))


def monthly_catch(catch: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Every month from the first to the last, NULL where nothing was recorded.

    Months are summed first; each month then emits itself and the empty months up to
    the next one, so there is one scan and the window only sees one row per month.
    """
    month = F.trunc(DAY, "MM")
    totals = catch.groupBy(*by, month.alias("month")).agg(F.sum(WEIGHT).alias(WEIGHT))
    following = F.lead("month").over(Window.partitionBy(*by).orderBy("month"))
    last_empty = F.coalesce(F.add_months(following, -1), F.col("month"))
    run = totals.withColumn("_last", last_empty).withColumn(
        "_run", F.sequence("month", "_last", F.expr("interval 1 month"))
    )
    return run.select(*by, F.explode("_run").alias(DAY), "month", WEIGHT).select(
        *by, DAY, F.when(F.col(DAY) == F.col("month"), F.col(WEIGHT)).alias(WEIGHT)
    )


def seasonal_catch(catch: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Recorded and positive days and the mean weight per species and month of year."""
    report = catch.groupBy(*by, "species", F.month(DAY).alias("month")).agg(
        F.count_distinct(DAY).alias("recorded_days"),
        F.count_if(F.col(WEIGHT) > 0).alias("positive_catch_days"),
        F.avg(WEIGHT).alias("mean_recorded_kg"),
    )
    share = percent(F.col("positive_catch_days"), F.col("recorded_days"), 1)
    return report.withColumn("positive_catch_pct_of_reported_days", share)


def default_profiles(spark) -> DataFrame:
    """The market-label catalogue; depth and season stay unknown until documented."""
    rows = spark.createDataFrame(
        list(SPECIES_CATALOGUE), "local_market_name string, reference_group string, fish_category string"
    )
    unknown = F.lit("Not supplied")
    return rows.withColumns({"verified_local_depth_zone": unknown, "verified_local_season": unknown})


def documented_profiles(profiles: DataFrame) -> DataFrame:
    return profiles.withColumnsRenamed(
        {
            "species": "local_market_name",
            "common_name": "reference_group",
            "depth_zone": "documented_depth_zone",
            "seasonal_note": "documented_seasonal_note",
        }
    )


def monthly_totals(daily: DataFrame, metric: str = "precipitation_sum") -> DataFrame:
    """Monthly total per site with a flag for months that miss days; never across sites."""
    month = F.trunc(DAY, "MM")
    return (
        daily.groupBy(SITE, month.alias("month"))
        .agg(F.sum(metric).alias(metric), F.count(metric).alias("days_with_value"))
        .withColumn("incomplete_month", F.col("days_with_value") < F.dayofmonth(F.last_day("month")))
    )


def mean_direction(daily: DataFrame, metric: str, by: Sequence[str] = (SITE,)) -> DataFrame:
    return daily.groupBy(*by).agg(circular_mean(metric).alias(metric), F.count(metric).alias("days_with_value"))


def lagged(daily: DataFrame, metric: str, lags: Sequence[int]) -> DataFrame:
    """The metric some calendar days earlier; a gap gives NULL, not an older row.

    A site has at most one row per day, so a window over one site is bounded by the
    calendar, and all lags share its single shuffle.
    """
    by_day = Window.partitionBy(SITE).orderBy(F.unix_date(DAY))
    return daily.withColumns(
        {f"{metric}_lag_{k}": F.max(metric).over(by_day.rangeBetween(-k, -k)) for k in lags}
    )
