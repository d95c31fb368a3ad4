"""Joining a dimension to a long table, whatever the dimension's size and the key's skew."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.session import scratch_path

BROADCAST_ROWS = 100_000
HOT_ROWS = 10_000_000
SALTS = 1024
SALT, HOT = "_salt", "_hot"


def one_per_key(df: DataFrame, on: Sequence[str], what: str) -> DataFrame:
    """``df`` as it is; the query fails when a key comes twice.

    The rows are numbered within their key.  A frame that is already partitioned and sorted by the key
    is neither moved nor sorted for it, and no key's rows are gathered.
    """
    keys = ", ".join(on)
    place = F.row_number().over(Window.partitionBy(*on).orderBy(*on))
    broken = F.raise_error(F.lit(f"{what} holds a key ({keys}) more than once")).cast("boolean")
    rows = df.withColumn("_place", place)
    return rows.where(F.when(F.col("_place") > 1, broken).otherwise(F.lit(True))).drop("_place")


def fits_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Counts at most ``rows + 1`` rows, so the check stays cheap on a large frame."""
    return df.limit(rows + 1).count() <= rows


def hot_keys(df: DataFrame, on: str, rows: int = HOT_ROWS) -> DataFrame:
    """Keys that own more than ``rows`` rows: at most ``count / rows`` of them."""
    counts = df.groupBy(on).agg(F.count(F.lit(1)).alias("_n"))
    return counts.where(F.col("_n") > rows).select(on, F.lit(True).alias(HOT))


def join_dimension(
    df: DataFrame,
    dimension: DataFrame,
    on: str,
    how: str = "left",
    rows: int = BROADCAST_ROWS,
    hot_rows: int = HOT_ROWS,
    salts: int = SALTS,
) -> DataFrame:
    """Left or inner join to a dimension; the query fails when the dimension repeats a key.

    A dimension counted to be small is broadcast, so the long table does not move.
    Beyond that both sides are shuffled, and only the hot keys are salted: their rows
    spread over ``salts`` tasks and only their dimension rows are repeated.  The hot keys are
    counted once and kept in the shared folder.  Rows without a key match nothing and are spread too.
    """
    if fits_broadcast(dimension, rows):
        # counted to be small: one task checks it, without a shuffle
        return df.join(F.broadcast(one_per_key(dimension.coalesce(1), [on], "the dimension")), on, how)
    single = one_per_key(dimension, [on], "the dimension")
    counted = hot_keys(df, on, hot_rows)
    path = scratch_path(df.sparkSession, "hot-keys")
    counted.write.parquet(path)
    hot = F.broadcast(df.sparkSession.read.schema(counted.schema).parquet(path))
    spread = F.pmod(F.xxhash64(*df.columns), F.lit(salts)).cast("int")
    salted = df.join(hot, on, "left").withColumn(SALT, F.when(F.col(HOT) | F.col(on).isNull(), spread).otherwise(F.lit(0))).drop(HOT)
    salt = F.when(F.col(HOT), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    copies = single.join(hot, on, "left").withColumn(SALT, F.explode(salt)).drop(HOT)
    return salted.join(copies, [on, SALT], how).drop(SALT)
