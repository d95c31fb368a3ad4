"""Row rules as boolean columns, and the one aggregate that counts all of them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.functions.values import day_unreadable, infinite, number, number_unreadable, outside
from tidepanel.specs import (
    DAY,
    FISH_CATEGORIES,
    LATITUDE,
    LONGITUDE,
    MEASUREMENT_KINDS,
    OCEAN_VARIABLES,
    PHYSICAL_BOUNDS,
    PROFILE_COLUMNS,
    RAW_KEY,
    SEA_SURFACE_RANGE,
    SITE,
    ProductSpec,
)

COORDINATES = ("lat_land", "lon_land", "lat_sea", "lon_sea")
REPORT_SCHEMA = "dataset string, rule string, column string, violations bigint"


@dataclass(frozen=True)
class RowRule:
    """``violated`` is true on the rows that break the rule."""

    code: str
    column: str
    violated: Column


def missing_columns(df: DataFrame, needed: Sequence[str]) -> list[str]:
    present = set(df.columns)
    return [name for name in needed if name not in present]


def _any(columns: Sequence[Column]) -> Column:
    return reduce(or_, columns)


def product_rules(df: DataFrame, spec: ProductSpec) -> list[RowRule]:
    """V2, V3, V5 and V7-V15 for a product, written against its raw columns."""
    rules = [RowRule("V2", key, F.col(key).isNull()) for key in RAW_KEY]
    rules.append(RowRule("V3", DAY, day_unreadable(df, DAY)))
    rules.append(RowRule("V5", "model", ~F.col("model").eqNullSafe(F.lit(spec.model))))
    for metric in spec.metrics:
        value = number(metric)
        rules.append(RowRule("V7", metric, number_unreadable(df, metric)))
        rules.append(RowRule("V8", metric, infinite(value)))
        rules += [
            RowRule(bound.code, metric, outside(value, bound.low, bound.high))
            for bound in PHYSICAL_BOUNDS
            if bound.covers(metric)
        ]
    if spec.ordered:
        low, middle, high = (number(name) for name in spec.ordered)
        complete = ~_any([number(m).isNull() for m in spec.metrics])
        rules.append(RowRule("V15", spec.ordered[1], complete & ((low > middle) | (middle > high))))
    return rules


def registry_rules() -> list[RowRule]:
    """V18-V19: coordinates are numbers inside the sampling region."""
    rules = []
    for name in COORDINATES:
        value = number(name)
        low, high = LATITUDE if name.startswith("lat") else LONGITUDE
        rules.append(RowRule("V18", name, value.isNull() | infinite(value)))
        rules.append(RowRule("V19", name, outside(value, low, high)))
    return rules


def _present_rules(code: str, columns: Sequence[str]) -> list[RowRule]:
    return [RowRule(code, name, F.col(name).isNull()) for name in columns]


CATCH_REQUIRED = (SITE, DAY, "species", "fish_category", "catch_weight_kg", "source", "source_url")
OCEAN_REQUIRED = (SITE, DAY, "measurement_kind", "source", "source_url")


def catch_rules(df: DataFrame) -> list[RowRule]:
    """V22, V25, V28, V30 and V31: an empty weight is not a zero weight."""
    weight = number("catch_weight_kg")
    return [
        *_present_rules("V22", [c for c in CATCH_REQUIRED if c != "catch_weight_kg"]),
        RowRule("V25", DAY, day_unreadable(df, DAY)),
        RowRule("V28", "catch_weight_kg", number_unreadable(df, "catch_weight_kg") | infinite(weight) | (weight < 0)),
        RowRule("V30", "fish_category", ~F.col("fish_category").isin(*FISH_CATEGORIES)),
        RowRule("V31", "catch_weight_kg", F.col("catch_weight_kg").isNull() | F.isnan(F.col("catch_weight_kg").try_cast("double"))),
    ]


def ocean_rules(df: DataFrame) -> list[RowRule]:
    """V22, V25, V28, V29 and V32; the variables themselves may be empty row by row."""
    rules = [*_present_rules("V22", OCEAN_REQUIRED), RowRule("V25", DAY, day_unreadable(df, DAY))]
    for name in OCEAN_VARIABLES:
        if name not in df.columns:
            continue
        value = number(name)
        broken = number_unreadable(df, name) | infinite(value)
        if name == "sea_surface_temperature":
            rules.append(RowRule("V28", name, broken))
            rules.append(RowRule("V29", name, outside(value, *SEA_SURFACE_RANGE)))
        else:
            rules.append(RowRule("V28", name, broken | (value < 0)))
    rules.append(RowRule("V32", "measurement_kind", ~F.col("measurement_kind").isin(*MEASUREMENT_KINDS)))
    return rules


def profile_rules() -> list[RowRule]:
    return _present_rules("V33", PROFILE_COLUMNS)


def _line(dataset: str, code: str, column: str, count: Column) -> Column:
    return F.struct(
        F.lit(dataset).alias("dataset"),
        F.lit(code).alias("rule"),
        F.lit(column).alias("column"),
        F.coalesce(count, F.lit(0)).cast("bigint").alias("violations"),
    )


def count_row_rules(df: DataFrame, dataset: str, rules: Sequence[RowRule]) -> DataFrame:
    """Violations of every row rule in a single map-side aggregate over ``df``."""
    counted = df.agg(*[F.count(F.when(rule.violated, 1)).alias(f"_{i}") for i, rule in enumerate(rules)])
    lines = [_line(dataset, rule.code, rule.column, F.col(f"_{i}")) for i, rule in enumerate(rules)]
    return counted.select(F.inline(F.array(*lines)))


def count_duplicates(df: DataFrame, dataset: str, code: str, keys: Sequence[str]) -> DataFrame:
    """Rows beyond the first of each key; partial counts keep a hot key small."""
    surplus = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.sum(F.col("_n") - 1).alias("_n"))
    return surplus.select(F.inline(F.array(_line(dataset, code, ",".join(keys), F.col("_n")))))


def known_frame(spark: SparkSession, known: DataFrame | Sequence[str]) -> DataFrame:
    if isinstance(known, DataFrame):
        return known.select(SITE).distinct()
    return spark.createDataFrame([(site,) for site in known], f"{SITE} string")


def count_unknown_sites(df: DataFrame, dataset: str, code: str, known: DataFrame) -> DataFrame:
    """Rows whose site is not registered.

    Sites are counted first, so the anti join sees one row per site however many
    rows a busy site owns, and either side may be large.
    """
    per_site = df.where(F.col(SITE).isNotNull()).groupBy(SITE).agg(F.count(F.lit(1)).alias("_n"))
    unknown = per_site.join(known, SITE, "left_anti").agg(F.sum("_n").alias("_n"))
    return unknown.select(F.inline(F.array(_line(dataset, code, SITE, F.col("_n")))))


def count_missing_sites(sites: DataFrame, dataset: str, code: str, known: DataFrame) -> DataFrame:
    """Configured sites the registry lacks."""
    absent = known.join(sites.select(SITE).distinct(), SITE, "left_anti").agg(F.count(F.lit(1)).alias("_n"))
    return absent.select(F.inline(F.array(_line(dataset, code, SITE, F.col("_n")))))


def count_over_limit(df: DataFrame, dataset: str, code: str, limit: int | None) -> DataFrame:
    """Rows beyond ``limit``; 0 when the frame is within it or no limit is set."""
    if limit is None:
        return df.sparkSession.range(1).select(F.inline(F.array(_line(dataset, code, "*", F.lit(0).cast("long")))))
    over = df.agg(F.greatest(F.count(F.lit(1)) - F.lit(limit), F.lit(0)).alias("_n"))
    return over.select(F.inline(F.array(_line(dataset, code, "*", F.col("_n")))))
