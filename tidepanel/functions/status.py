"""Display classification of a wave and a wind value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Status texts, from worst to unknown, and their RGBA colours.
HIGHER = "Higher values"
ELEVATED = "Elevated values"
BELOW = "Below display thresholds"
MISSING = "Missing indicators"
STATUSES = (HIGHER, ELEVATED, BELOW, MISSING)
STATUS_RGBA = {
    HIGHER: (203, 69, 60, 230),
    ELEVATED: (221, 161, 54, 230),
    BELOW: (0, 127, 122, 230),
    MISSING: (148, 163, 184, 210),
}
HIGHER_FACTOR = 1.5


def indicator_status(
    wave_limit: float = 2.0,
    wind_limit: float = 10.0,
    wave: str = "wave_height_max",
    wind: str = "wind_speed_10m_max",
) -> Column:
    """First match wins: missing input, 1.5 x a limit, a limit, below both."""
    height, speed = F.col(wave), F.col(wind)
    unknown = height.isNull() | speed.isNull() | F.isnan(height) | F.isnan(speed)

    def reaches(factor: float) -> Column:
        return (height >= F.lit(wave_limit * factor)) | (speed >= F.lit(wind_limit * factor))

    return (
        F.when(unknown, F.lit(MISSING))
        .when(reaches(HIGHER_FACTOR), F.lit(HIGHER))
        .when(reaches(1.0), F.lit(ELEVATED))
        .otherwise(F.lit(BELOW))
    )


def status_color(status: Column) -> Column:
    """RGBA array of a status; an absent status takes the colour of a missing one."""
    pairs = []
    for text, rgba in STATUS_RGBA.items():
        pairs += [F.lit(text), F.array(*[F.lit(part) for part in rgba])]
    return F.create_map(*pairs)[F.coalesce(status, F.lit(MISSING))]
