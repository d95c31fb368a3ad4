"""Calendar expressions: local today, vintages, presets."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidepanel.specs import LOCAL_ZONE, SNAPSHOT

DayLike = dt.date | str | Column | None


def local_today(zone: str = LOCAL_ZONE) -> Column:
    """Calendar date in ``zone`` right now, whatever the session time zone is."""
    return F.to_date(F.convert_timezone(None, F.lit(zone), F.localtimestamp()))


def as_day(value: DayLike) -> Column:
    """A date column from a date, an ISO text, a column, or today when absent."""
    if value is None:
        return local_today()
    if isinstance(value, Column):
        return value
    if isinstance(value, dt.datetime):
        value = value.date()
    return F.lit(value if isinstance(value, dt.date) else dt.date.fromisoformat(str(value)[:10]))


def vintage_instant(name: str = SNAPSHOT) -> Column:
    """Instant named by a vintage label, NULL for a free label such as ``historical``.

    Every row is read on its own, so the outcome does not depend on its neighbours.
    """
    return F.try_to_timestamp(F.col(name))


def horizon_start(preset: str, end: Column, first: Column | None = None) -> Column:
    """First day of a display horizon that ends on ``end``."""
    if preset == "last_30_days":
        return F.date_sub(end, 29)
    if preset == "last_12_months":
        return F.date_add(F.add_months(end, -12), 1)
    if preset == "all_years":
        fallback = F.add_months(end, -36)
        return fallback if first is None else F.coalesce(first, fallback)
    raise ValueError(f"unknown horizon {preset!r}")


def default_start(first: Column, last: Column, days: int) -> Column:
    """Start of the last ``days`` days of a frame, never before its first day."""
    return F.greatest(first, F.date_sub(last, days - 1))


EXPLORER_DAYS = 30
EXPORT_DAYS = 61
