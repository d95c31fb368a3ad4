"""Point-in-time join: for each request the latest vintage that had been issued by its own origin."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.dates import vintage_instant
from tidepanel.specs import PANEL_KEY, VINTAGE

#: Days of vintages and requests of one key that are swept together.
SLICE_DAYS = 32
_CARRIED, _ISSUED, _ASKED = 0, 1, 2


def as_of_join(
    requests: DataFrame,
    vintages: DataFrame,
    origin: str = "origin",
    label: str = VINTAGE,
    keys: Sequence[str] = PANEL_KEY,
    tie_breakers: Sequence[str] = (),
    slice_days: int = SLICE_DAYS,
) -> DataFrame:
    """Each request (keys, ``origin``, other columns) with the latest vintage of its key issued by then.

    Vintages and requests of a key become one stream sorted by time, and a running value hands every
    request the vintage before it: no pair is ever formed, whatever the number of origins.  A key is
    swept in slices of time, so that one with most rows spreads over many tasks; a slice begins with the
    vintage that the earlier ones end with, found among one row per slice.

    Every request stays, repeated ones too, with NULLs where no vintage was known or its key or origin is
    NULL.  Undated labels are never known.  A vintage issued at the origin itself is known; of several at
    one instant the last by label, then by ``tie_breakers``, counts.  Columns of ``vintages`` that
    ``requests`` has too, beside the keys, are left out.
    """
    keys = [*keys]
    payload = [c for c in vintages.columns if c not in requests.columns]
    rest = [c for c in requests.columns if c not in keys]
    order = ["_at", "_label", *[f"_tie{i}" for i in range(len(tie_breakers))]]

    def slice_of(at: str) -> Column:
        return F.floor(F.unix_micros(at) / F.lit(slice_days * 86_400_000_000)).alias("_slice")

    issued = vintages.select(
        *keys, vintage_instant(label).alias("_at"), F.col(label).cast("string").alias("_label"),
        *[F.col(c).alias(f"_tie{i}") for i, c in enumerate(tie_breakers)], F.struct(*payload).alias("_vintage"),
    )
    issued = issued.dropna(subset=["_at", *keys]).select("*", slice_of("_at"))
    asked = requests.select(*keys, F.col(origin).cast("timestamp").alias("_at"), F.struct(*rest).alias("_request")).select("*", slice_of("_at"))

    # What each slice ends with, and which slices are asked about.
    last = issued.groupBy(*keys, "_slice").agg(F.max_by("_vintage", F.struct(*order)).alias("_vintage"))
    slices = asked.groupBy(*keys, "_slice").agg(F.lit(True).alias("_wanted"))
    earlier = Window.partitionBy(*keys).orderBy("_slice").rangeBetween(Window.unboundedPreceding, -1)
    ends = last.unionByName(slices, allowMissingColumns=True).withColumn("_before", F.last("_vintage", ignorenulls=True).over(earlier))
    carried = ends.where("_wanted and _before is not null").select(*keys, "_slice", F.col("_before").alias("_vintage"), F.lit(_CARRIED).alias("_kind"))

    stream = (
        issued.withColumn("_kind", F.lit(_ISSUED))
        .unionByName(asked.withColumn("_kind", F.lit(_ASKED)), allowMissingColumns=True)
        .unionByName(carried, allowMissingColumns=True)
    )
    # A carried row has no instant and so comes first.
    sweep = Window.partitionBy(*keys, "_slice").orderBy(F.col("_at").asc_nulls_first(), "_kind", *order[1:]).rowsBetween(Window.unboundedPreceding, 0)
    swept = stream.withColumn("_found", F.last("_vintage", ignorenulls=True).over(sweep)).where(F.col("_kind") == _ASKED)
    found = F.when(F.col("_at").isNotNull(), F.col("_found"))
    taken = [F.col(c) if c in keys else F.col("_request")[c].alias(c) for c in requests.columns]
    return swept.select(*taken, *[found[c].alias(c) for c in payload])
