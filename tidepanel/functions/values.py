"""Reading loosely typed columns without losing the fact that a value was bad."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Cell texts that mean "no value" in uploaded CSV files.
MISSING_TEXTS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)

INFINITY = float("inf")


def is_text(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.StringType)


def number(name: str) -> Column:
    """Double value of a column; unreadable text and NaN become NULL."""
    return F.nanvl(F.col(name).try_cast("double"), F.lit(None).cast("double"))


def number_unreadable(df: DataFrame, name: str) -> Column:
    """True where a text is present but is not a number; other types always read."""
    if not is_text(df, name):
        return F.lit(False)
    return F.col(name).isNotNull() & F.col(name).try_cast("double").isNull()


def day(df: DataFrame, name: str) -> Column:
    """Date value of a column; texts must be written ``yyyy-MM-dd``."""
    if is_text(df, name):
        return F.try_to_date(F.col(name), "yyyy-MM-dd")
    return F.to_date(F.col(name))


def day_unreadable(df: DataFrame, name: str) -> Column:
    """True where the value is present but is not a whole calendar day."""
    value = F.col(name)
    if is_text(df, name):
        return value.isNotNull() & F.try_to_date(value, "yyyy-MM-dd").isNull()
    if isinstance(df.schema[name].dataType, T.DateType):
        return F.lit(False)
    return value.isNotNull() & (F.date_trunc("day", value) != value)


def outside(value: Column, low: float | None, high: float | None) -> Column:
    """Violates the closed range; NULL never does, infinities are reported apart."""
    below = F.lit(False) if low is None else (value < F.lit(low)) & (value > F.lit(-INFINITY))
    above = F.lit(False) if high is None else (value > F.lit(high)) & (value < F.lit(INFINITY))
    return below | above


def infinite(value: Column) -> Column:
    return F.abs(value) == F.lit(INFINITY)


def blank_to_null(df: DataFrame) -> DataFrame:
    """Text cells that mean "no value" become NULL in every text column."""
    return df.select(
        *[
            F.when(~F.col(f.name).isin(*MISSING_TEXTS), F.col(f.name)).alias(f.name)
            if isinstance(f.dataType, T.StringType)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )
