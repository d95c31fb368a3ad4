"""History and forecasts side by side: timeline, map day, site-day card, series."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.dates import DayLike, as_day
from tidepanel.functions.status import MISSING, indicator_status, status_color
from tidepanel.operators.dimension import one_per_key
from tidepanel.operators.joins import calendar
from tidepanel.operators.select import latest_vintage, on_keys, top_row, vintage_order
from tidepanel.specs import DAY, PANEL_KEY, SITE


def distinct_days(df: DataFrame) -> DataFrame:
    """Days of a frame.  DATE holds at most 366 values a year, so the set is bounded
    by the calendar and not by the data."""
    return df.select(DAY).distinct()


def without_days(df: DataFrame, days: DataFrame) -> DataFrame:
    """Rows on other days than ``days`` (see :func:`distinct_days` for the size bound).

    Joining by shuffle would send each of the few days to one task.
    """
    return df.join(F.broadcast(days), DAY, "left_anti")


def combined_timeline(
    history: DataFrame,
    forecasts: DataFrame,
    history_days: DataFrame | None = None,
    per_site: bool = False,
    min_day: DayLike = None,
    parse_vintage: bool = False,
) -> DataFrame:
    """History followed by the latest forecast of each day that history lacks.

    By default a day counts as covered for every site as soon as one site has it;
    ``per_site`` asks site by site.  ``min_day`` keeps stale forecasts out.
    ``history_days`` is a cheaper source of the covered days than ``history`` itself.
    """
    ahead = forecasts if min_day is None else forecasts.where(F.col(DAY) >= as_day(min_day))
    if per_site:
        return _first_choice(history, ahead, forecast_first=False, parse=parse_vintage)
    days = distinct_days(history if history_days is None else history_days)
    ahead = latest_vintage(without_days(ahead, days), parse=parse_vintage)
    return history.unionByName(ahead, allowMissingColumns=True)


def _first_choice(history: DataFrame, ahead: DataFrame, forecast_first: bool, parse: bool = False) -> DataFrame:
    """Per site-day the latest forecast or the history row, whichever kind comes first.

    One window over both kinds replaces a latest-vintage window and an anti join.
    """
    both = history.withColumn("_ahead", F.lit(0)).unionByName(
        ahead.withColumn("_ahead", F.lit(1)), allowMissingColumns=True
    )
    kind = F.col("_ahead").desc() if forecast_first else F.col("_ahead").asc()
    return top_row(both, PANEL_KEY, [kind, *vintage_order(parse)]).drop("_ahead")


def site_day_cards(
    history: DataFrame,
    forecasts: DataFrame,
    wave_limit: float = 2.0,
    wind_limit: float = 10.0,
    sites: Iterable | None = None,
    dates: tuple[DayLike, DayLike] | None = None,
) -> DataFrame:
    """Per site-day: the latest forecast vintage, else history, never an older day."""
    past, ahead = on_keys(history, sites, dates), on_keys(forecasts, sites, dates)
    cards = _first_choice(past, ahead, forecast_first=True)
    return cards.withColumn("indicator_status", indicator_status(wave_limit, wind_limit))


def with_ocean(cards: DataFrame, ocean: DataFrame) -> DataFrame:
    """Ocean measurements of the same site-day beside each card."""
    extra = ocean.withColumnsRenamed({c: f"ocean_{c}" for c in ("source", "source_url", "is_synthetic") if c in ocean.columns})
    return cards.join(extra, list(PANEL_KEY), "left")


def map_status(
    sites: DataFrame,
    history: DataFrame,
    forecasts: DataFrame,
    start: DayLike,
    end: DayLike = None,
    wave_limit: float = 2.0,
    wind_limit: float = 10.0,
    forecast_days: DataFrame | None = None,
) -> DataFrame:
    """Every site's status and colour on each day from ``start`` to ``end``.

    The query fails when a site or a site's day comes twice.  A day on which any site has a forecast is drawn from forecasts only.  The covered
    days are at most the days asked for, which bounds the broadcast; ``forecast_days``
    is a cheaper source of them than the joined ``forecasts``.
    """
    window = (start, start if end is None else end)
    ahead = on_keys(forecasts, dates=window)
    covered = ahead if forecast_days is None else on_keys(forecast_days, dates=window)
    past = without_days(on_keys(history, dates=window), distinct_days(covered))
    chosen = latest_vintage(ahead).unionByName(past, allowMissingColumns=True)
    status = chosen.select(*PANEL_KEY, indicator_status(wave_limit, wind_limit).alias("status"))
    keep = [c for c in sites.columns if c != SITE]
    points = calendar(one_per_key(sites, [SITE], "the registry"), *window, keep=keep)
    points = points.join(one_per_key(status, PANEL_KEY, "the map"), list(PANEL_KEY), "left")
    points = points.withColumn("status", F.coalesce("status", F.lit(MISSING)))
    return points.withColumn("color", status_color(F.col("status")))


def metric_series(
    history: DataFrame,
    forecasts: DataFrame,
    metric: str,
    start: DayLike,
    end: DayLike,
    sites: Iterable | None = None,
) -> DataFrame:
    """(site, day, value, series) with the forecast line joined to the last past point.

    A site's last past value is repeated in its forecast series when it precedes the
    first forecast day.  Both inputs are read once.  A site has one row a day in either, so the
    calendar bounds what the window over a site holds.
    """
    past = on_keys(history, sites, (start, end)).select(*PANEL_KEY, F.col(metric).alias("value"), F.lit("history").alias("series"))
    ahead = latest_vintage(on_keys(forecasts, sites)).select(*PANEL_KEY, F.col(metric).alias("value"), F.lit("forecast").alias("series"))
    is_past = F.col("series") == "history"
    present = is_past & F.col("value").isNotNull() & ~F.isnan("value")
    of_site = Window.partitionBy(SITE)
    ends = {"_last": F.max(F.when(present, F.col(DAY))).over(of_site), "_first": F.min(F.when(~is_past, F.col(DAY))).over(of_site)}
    bridge = present & (F.col(DAY) == F.col("_last")) & (F.col("_last") < F.col("_first"))
    series = F.when(bridge, F.array(F.lit("history"), F.lit("forecast"))).otherwise(F.array("series"))
    return past.unionByName(ahead).withColumns(ends).select(*PANEL_KEY, "value", F.explode(series).alias("series"))
