"""Explorer: filters, column choice, pages, key figures."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.dates import EXPLORER_DAYS, EXPORT_DAYS, DayLike, as_day, default_start, horizon_start
from tidepanel.functions.status import indicator_status
from tidepanel.operators.dimension import join_dimension
from tidepanel.operators.select import on_keys
from tidepanel.session import scratch_path
from tidepanel.specs import DAY, PANEL_KEY, SITE, VINTAGE

#: Rows that a task may hand to the one that cuts a near page.
HEAP_ROWS = 2_000


def explore(
    df: DataFrame,
    sites: Iterable | None,
    dates: Sequence[DayLike],
    severity: Iterable[str] | None = None,
    wave_limit: float = 2.0,
    wind_limit: float = 10.0,
) -> DataFrame:
    """Site, day and severity filter.

    ``severity=None`` asks for every status and ``[]`` for none; no sites or an
    incomplete date range select nothing.  Statuses are judged on the rows of ``df``,
    so choose best records before this filter.
    """
    sites = list(sites or [])
    if not sites or len(dates) != 2:
        return df.where(F.lit(False))
    rows = on_keys(df, sites, (dates[0], dates[1]))
    if "wave_height_max" not in df.columns:
        return rows
    rows = rows.withColumn("indicator_status", indicator_status(wave_limit, wind_limit))
    return rows if severity is None else rows.where(F.col("indicator_status").isin(*severity))


def in_categories(df: DataFrame, categories: Iterable[str]) -> DataFrame:
    return df.where(F.col("fish_category").isin(*categories))


def choose_columns(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """The wanted columns that exist, in the asked order; all of them when none is asked."""
    return df.select(*[c for c in wanted if c in df.columns]) if wanted else df


def sort_keys(df: DataFrame) -> list[str]:
    """The columns that make a row of a panel, forecast or catch frame unique."""
    return [c for c in (*PANEL_KEY, VINTAGE, "species") if c in df.columns]


def page_count(df: DataFrame, size: int) -> DataFrame:
    """Matching rows and pages (at least one)."""
    rows = F.count(F.lit(1))
    return df.agg(rows.alias("rows"), F.greatest(F.lit(1), F.ceil(rows / F.lit(size))).cast("bigint").alias("pages"))


def page_within(number: int, pages: int) -> int:
    """The asked page, or the first one when it does not exist."""
    return number if 1 <= number <= pages else 1


def page(
    df: DataFrame, number: int, size: int, keys: Sequence[str] | None = None, heap_rows: int = HEAP_ROWS
) -> DataFrame:
    """One page in key order; ``keys`` must order the rows totally.

    Early pages, up to ``heap_rows``, come from small per-task heaps.  A page further on
    is cut out of a range-sorted copy by position, so no task holds the rows before it.
    """
    order = list(keys or sort_keys(df))
    skip = (number - 1) * size
    if skip + size <= heap_rows:
        return df.orderBy(*order).offset(skip).limit(size)
    return _deep_page(df, order, skip, size)


def _deep_page(df: DataFrame, order: list[str], skip: int, size: int) -> DataFrame:
    """Rows ``skip .. skip + size - 1`` of the sorted frame.

    The sorted copy is written to the shared folder, so positions stay fixed when an
    executor is lost, and the page itself reads only the files that hold it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "sorted")
    # The id holds the partition number above bit 33 and the position below it.
    (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_id", F.monotonically_increasing_id())
        .withColumns({"_part": F.shiftright("_id", 33), "_pos": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))})
        .drop("_id")
        .write.parquet(path)
    )
    located = spark.read.parquet(path)
    sizes = located.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).orderBy("_part").collect()
    wanted, base = [], 0
    for row in sizes:  # one entry per partition, not per row
        low, high = max(skip, base), min(skip + size, base + row["_n"])
        if low < high:
            wanted.append((row["_part"], low - base, high - base))
        base += row["_n"]
    if not wanted:
        return df.where(F.lit(False))
    hit = reduce(
        lambda a, b: a | b,
        [(F.col("_part") == p) & (F.col("_pos") >= low) & (F.col("_pos") < high) for p, low, high in wanted],
    )
    return located.where(hit).drop("_part", "_pos").orderBy(*order)


def key_figures(products: Mapping[str, DataFrame], merged: DataFrame, sites: DataFrame, past: DataFrame) -> DataFrame:
    """Raw rows over all products, merged rows, sites and the latest past day."""
    raw = reduce(DataFrame.unionAll, [df.select(F.lit(1).alias("_one")) for df in products.values()])
    parts = [
        raw.agg(F.count(F.lit(1)).alias("raw_records")),
        merged.agg(F.count(F.lit(1)).alias("merged_site_days")),
        sites.agg(F.count(F.lit(1)).alias("sites")),
        past.agg(F.max(DAY).alias("latest_past_day")),
    ]
    one = parts[0].sparkSession.range(1)
    return one.select(*[part.scalar().alias(part.columns[0]) for part in parts])


def quality_counters(daily: DataFrame) -> DataFrame:
    """Rows, sites, surplus rows per site-day and incomplete pairs of a daily table."""
    surplus = daily.groupBy(*PANEL_KEY).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(~F.col("complete_pair")).alias("_open")
    )
    return surplus.agg(
        F.sum("_n").alias("rows"),
        F.count_distinct(SITE).alias("sites"),
        F.sum(F.col("_n") - 1).alias("duplicate_rows"),
        F.sum("_open").alias("incomplete_pairs"),
    )


def date_bounds(df: DataFrame) -> DataFrame:
    """First and last day with the default explorer and export starts."""
    bounds = df.agg(F.min(DAY).alias("first_day"), F.max(DAY).alias("last_day"))
    first, last = F.col("first_day"), F.col("last_day")
    return bounds.withColumns(
        {
            "explorer_start": default_start(first, last, EXPLORER_DAYS),
            "export_start": default_start(first, last, EXPORT_DAYS),
        }
    )


def horizons(df: DataFrame, as_of: DayLike = None) -> DataFrame:
    """Start of each display horizon; all of them end on the day before ``as_of``."""
    end = F.date_sub(as_day(as_of), 1)
    bounds = df.agg(F.min(DAY).alias("first_day"))
    return bounds.select(
        end.alias("end_day"),
        *[
            horizon_start(preset, end, F.col("first_day")).alias(preset)
            for preset in ("last_30_days", "last_12_months", "all_years")
        ],
    )


def registry_sheet(sites: DataFrame) -> DataFrame:
    """Registry in long form: (site, column, value as text)."""
    columns = [c for c in sites.columns if c != SITE]
    texts = sites.select(SITE, *[F.col(c).cast("string").alias(c) for c in columns])
    return texts.unpivot([SITE], columns, "column", "value")


def named_sites(df: DataFrame, sites: DataFrame) -> DataFrame:
    """Display name beside each site id."""
    return join_dimension(df, sites.select(SITE, "name"), SITE)
