"""Key figures out of Parquet footers: rows and range of days of every shard, without reading a row.

Footers are read in tasks and kept as a table in the shared folder.  A shard whose footer can't
tell its days (no statistics, days as texts or timestamps, an old calendar) is read for them, in
the columns it takes, so figures always cover every shard.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.functions.dates import EXPLORER_DAYS, EXPORT_DAYS, DayLike, as_day, default_start
from tidepanel.functions.values import day
from tidepanel.session import scratch_path
from tidepanel.sources.scans import footer_source, product_folder, read_shards, shard_reader, with_tails
from tidepanel.specs import DAY, PRODUCTS

_SHAPE = "path string, rows long, first date, last date, known boolean"
#: Fixed value: the footer entry of files whose days follow the old calendar.
_OLD_CALENDAR = b"org.apache.spark.legacyDateTime"


def _range_of(source: pa.NativeFile, column: str) -> tuple[int, dt.date | None, dt.date | None, bool]:
    """Rows, first and last day of a file, and whether its footer tells these days."""
    footer = pq.read_metadata(source)
    places = [i for i in range(footer.num_columns) if footer.schema.column(i).path == column]
    if not places or not footer.num_rows:
        return footer.num_rows, None, None, True
    (place,) = places
    if footer.schema.column(place).logical_type.type != "DATE" or _OLD_CALENDAR in (footer.metadata or {}):
        return footer.num_rows, None, None, False
    ends: list[dt.date] = []
    for group in map(footer.row_group, range(footer.num_row_groups)):
        facts = group.column(place).statistics
        if facts is not None and facts.has_null_count and facts.null_count == group.num_rows:
            continue
        if facts is None or not facts.has_min_max:
            return footer.num_rows, None, None, False
        ends += [facts.min, facts.max]
    return footer.num_rows, min(ends, default=None), max(ends, default=None), True


def _ranges(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    types = [pa.string(), pa.int64(), pa.date32(), pa.date32(), pa.bool_()]
    for batch in batches:
        found = []
        for path, tail in zip(batch.column("path").to_pylist(), batch.column("tail").to_pylist()):
            try:
                with footer_source(path, tail) as source:
                    found.append((path, *_range_of(source, column)))
            except (OSError, pa.ArrowException):
                if tail is not None:
                    raise
                found.append((path, None, None, None, False))
        arrays = [pa.array([row[i] for row in found], kind) for i, kind in enumerate(types)]
        yield pa.RecordBatch.from_arrays(arrays, names=["path", "rows", "first", "last", "known"])


def shard_ranges(spark: SparkSession, *paths: str, column: str = DAY) -> DataFrame:
    """(path, rows, first, last, known) of every shard below some paths, kept in the shared folder.

    ``rows`` always holds; ``known`` tells whether ``first`` and ``last`` do.  A shard without the
    column, or with nulls alone, has no days and is known.
    """

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _ranges(batches, column)

    path = scratch_path(spark, "shard-ranges")
    files = shard_reader(spark).format("binaryFile").load([*paths])
    files.select("path", F.lit(None).cast("binary").alias("tail")).mapInArrow(ranges, _SHAPE).write.parquet(f"{path}/opened")
    opened = spark.read.schema(_SHAPE).parquet(f"{path}/opened")
    unread = [row["path"] for row in opened.where("rows is null").select("path").collect()]
    if not unread:
        return opened
    # Stores that only Spark's readers know.
    with_tails(spark, unread).mapInArrow(ranges, _SHAPE).write.parquet(f"{path}/handed")
    return opened.where("rows is not null").union(spark.read.schema(_SHAPE).parquet(f"{path}/handed"))


def snapshot_figures(spark: SparkSession, root: str, as_of: DayLike = None, products: Iterable[str] = tuple(PRODUCTS)) -> DataFrame:
    """Shards, rows, first and last day and last day before ``as_of`` of each product of a snapshot.

    Only shards with days on both sides of ``as_of``, and those whose footers tell no days, are read,
    in one column.  A product without shards has no row; one without days has nulls.
    """
    products, limit = tuple(products), as_day(as_of)
    name = F.regexp_extract("path", f"/{product_folder(products)}", 1).alias("product")
    shards = shard_ranges(spark, f"{root}/data").select(name, "*").where("product <> ''")
    before = F.when(F.col("last") < limit, F.col("last"))
    told = shards.select("product", F.lit(1).alias("shards"), "rows", "first", "last", before.alias("past"))
    across = F.col("known") & (F.col("first") < limit) & (F.col("last") >= limit)
    asked = shards.where(~F.col("known") | across).groupBy("product", "known").agg(F.collect_list("path").alias("paths")).collect()
    parts = [told]
    for row in asked:  # two entries a product at most
        rows = read_shards(spark, *row["paths"], each=lambda df: df.select(day(df, DAY).alias(DAY)))
        if row["known"]:
            rows = rows.where(F.col(DAY) < limit)
        ends = rows.agg(F.min(DAY).alias("first"), F.max(DAY).alias("last"), F.max(F.when(F.col(DAY) < limit, F.col(DAY))).alias("past"))
        parts.append(ends.select(F.lit(row["product"]).alias("product"), F.lit(0).alias("shards"), F.lit(0).cast("long").alias("rows"), "first", "last", "past"))
    return reduce(DataFrame.union, parts).groupBy("product").agg(
        F.sum("shards").alias("shards"),
        F.sum("rows").alias("raw_records"),
        F.min("first").alias("first_day"),
        F.max("last").alias("last_day"),
        F.max("past").alias("latest_past_day"),
    )


def snapshot_bounds(figures: DataFrame) -> DataFrame:
    """Raw rows, range of days and default starts over all products of :func:`snapshot_figures`."""
    whole = figures.agg(
        F.coalesce(F.sum("raw_records"), F.lit(0)).alias("raw_records"),
        F.min("first_day").alias("first_day"),
        F.max("last_day").alias("last_day"),
        F.max("latest_past_day").alias("latest_past_day"),
    )
    first, last = F.col("first_day"), F.col("last_day")
    return whole.withColumns(
        {"explorer_start": default_start(first, last, EXPLORER_DAYS), "export_start": default_start(first, last, EXPORT_DAYS)}
    )
