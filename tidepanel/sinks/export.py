"""Writing panels and exports as distributed files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel.contracts.validate import ContractError
from tidepanel.operators.explore import sort_keys
from tidepanel.session import scratch_path
from tidepanel.specs import DAY

SYNTHETIC_PREFIX = "SYNTHETIC_DEMO_"
BOM = "﻿"
FORMATS = ("csv", "json", "parquet")


def check_limit(df: DataFrame, limit: int | None) -> None:
    """Raise when the frame has more than ``limit`` rows; counts at most one row more."""
    if limit is not None and df.limit(limit + 1).count() > limit:
        raise ContractError("export", "V35", f"more than {limit} rows")


def _uniform(df: DataFrame, synthetic: bool) -> DataFrame:
    """Fail the write on the first row whose synthetic flag differs, so nothing is published."""
    if "is_synthetic" not in df.columns:
        return df
    mixed = F.raise_error(F.lit("synthetic and real rows must not share an export")).cast("boolean")
    flag = F.col("is_synthetic")
    return df.withColumn("is_synthetic", F.when(flag.eqNullSafe(F.lit(synthetic)), flag).otherwise(mixed))


def is_synthetic(df: DataFrame) -> bool:
    """The flag of the first row; the write itself then holds every row to it."""
    if "is_synthetic" not in df.columns:
        return False
    row = df.select("is_synthetic").first()
    return bool(row and row[0])


def _copied(df: DataFrame) -> DataFrame:
    path = scratch_path(df.sparkSession, "export")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def export_path(folder: str, name: str, fmt: str, synthetic: bool) -> str:
    return f"{folder.rstrip('/')}/{SYNTHETIC_PREFIX if synthetic else ''}{name}.{fmt}"


def _days_as(df: DataFrame, convert) -> DataFrame:
    days = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DateType)]
    return df.withColumns({c: convert(F.col(c)).alias(c) for c in days}) if days else df


def _flat(df: DataFrame) -> DataFrame:
    """Array cells as JSON text, since CSV has no arrays."""
    arrays = [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)]
    return df.withColumns({c: F.to_json(c) for c in arrays}) if arrays else df


def export(
    df: DataFrame,
    folder: str,
    name: str,
    fmt: str,
    synthetic: bool | None = None,
    limit: int | None = None,
    mode: str = "errorifexists",
    ordered: bool = True,
) -> str:
    """Write one export and return its path.

    CSV holds ISO days and a byte-order mark, JSON one record per line with ISO
    timestamps and explicit nulls, Parquet is Snappy.  ``limit`` refuses larger frames.
    ``ordered`` range-sorts the rows by key, so the files read in key order.

    The frame's own plan runs once: what must be known before the write, and the sample that a
    range sort draws, come from a copy in the shared folder.
    """
    fmt = fmt.lower()
    if fmt not in FORMATS:
        raise ValueError(f"unknown export format {fmt!r}")
    keys = sort_keys(df) if ordered else []
    if keys or limit is not None or synthetic is None:
        df = _copied(df)
    check_limit(df, limit)
    flag = is_synthetic(df) if synthetic is None else synthetic
    rows = _uniform(df.orderBy(*keys) if keys else df, flag)
    path = export_path(folder, name, fmt, flag)
    if fmt == "csv":
        rows = _flat(_days_as(rows, lambda c: F.date_format(c, "yyyy-MM-dd")))
        marked = rows.toDF(BOM + rows.columns[0], *rows.columns[1:])
        marked.write.mode(mode).option("header", True).option("escape", '"').csv(path)
    elif fmt == "json":
        rows = _days_as(rows, lambda c: c.cast("timestamp_ntz"))
        rows.write.mode(mode).option("ignoreNullFields", "false").json(path)
    else:
        rows.write.mode(mode).option("compression", "snappy").parquet(path)
    return path


def write_panel(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Panel table by year, sorted by its key inside each file.

    The adaptive plan splits a large year and gathers small ones, so files are even
    however the years differ; readers prune by year, then by row-group statistics.
    """
    placed = df.withColumn("year", F.year(DAY)).hint("rebalance", F.col("year"))
    (
        placed.sortWithinPartitions("year", *sort_keys(df))
        .write.mode(mode)
        .partitionBy("year")
        .option("compression", "snappy")
        .parquet(path)
    )
