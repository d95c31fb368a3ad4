"""Small statistics used by several reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent(part: Column, whole: Column, digits: int) -> Column:
    """``100 * part / whole`` rounded half to even; 0 when ``whole`` is 0."""
    share = F.lit(100.0) * part / F.nullif(whole, F.lit(0))
    return F.coalesce(F.bround(share, digits), F.lit(0.0))


def circular_mean(name: str) -> Column:
    """Mean direction in [0, 360) of a column in degrees, as an aggregate."""
    angle = F.radians(F.col(name))
    mean = F.degrees(F.atan2(F.avg(F.sin(angle)), F.avg(F.cos(angle))))
    return F.pmod(mean + F.lit(360.0), F.lit(360.0))
