"""One row per key: best record and latest vintage."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.dates import DayLike, as_day, vintage_instant
from tidepanel.specs import DAY, PANEL_KEY, SITE, SNAPSHOT, VINTAGE


def top_row(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key.

    ``row_number() = 1`` lets Spark cut every map task down to one row per key
    before the shuffle, so a key with a third of all rows sends one row per task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_position", F.row_number().over(window)).where("_position = 1").drop("_position")


def before(df: DataFrame, as_of: DayLike) -> DataFrame:
    """Strictly past days."""
    return df.where(F.col(DAY) < as_day(as_of))


def on_keys(
    df: DataFrame, sites: Iterable | None = None, dates: tuple[DayLike, DayLike] | None = None
) -> DataFrame:
    """Key filter that reaches the scan: apply it before any window or outer join."""
    if sites is not None:
        df = df.where(F.col(SITE).isin(*sites))
    if dates is not None:
        df = df.where(F.col(DAY).between(as_day(dates[0]), as_day(dates[1])))
    return df


def preference_rank() -> Column:
    """Complete beats incomplete, then reanalysis beats provisional."""
    reanalysis = F.col("product").endswith("reanalysis")
    return F.col("complete_core").cast("int") * 2 + reanalysis.cast("int")


def best_records(df: DataFrame, tie_breakers: Sequence[str] = ()) -> DataFrame:
    """Best record per site-day from overlapping products and snapshots.

    Order: preference rank, then parsed vintage with unreadable labels last, then the
    label itself.  ``tie_breakers`` make the order total where snapshots repeat.
    """
    order = [
        preference_rank().desc(),
        vintage_instant().desc_nulls_last(),
        F.col(SNAPSHOT).desc(),
        *[F.col(name).desc() for name in tie_breakers],
    ]
    return top_row(df, PANEL_KEY, order)


def vintage_order(parse: bool = False) -> list[Column]:
    """Latest label first, by its text or, with ``parse``, by the instant it names."""
    text = F.col(VINTAGE).desc()
    return [vintage_instant(VINTAGE).desc_nulls_last(), text] if parse else [text]


def latest_vintage(
    df: DataFrame, keys: Sequence[str] = PANEL_KEY, parse: bool = False, tie_breakers: Sequence[str] = ()
) -> DataFrame:
    """Latest forecast vintage per key."""
    return top_row(df, keys, [*vintage_order(parse), *[F.col(name).desc() for name in tie_breakers]])


def known_at(df: DataFrame, origin: Column, label: str = VINTAGE) -> DataFrame:
    """Rows whose vintage had been issued by ``origin``; undated labels are not known."""
    return df.where(vintage_instant(label) <= origin)
