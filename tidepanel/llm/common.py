"""Helpers shared by the operators: shared-folder tables, folds, text batches for Arrow tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.session import scratch_path

#: Bytes of rows that a Python worker is handed at once; a longer row comes alone.
BATCH_BYTES = 4 << 20
#: One of this many folds is never learnt from.
FOLDS = 5


def kept(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_small_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session that hands Python workers batches bounded by bytes: thousands of long texts are no batch."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def held_out(doc_id: Column) -> Column:
    """Whether a document belongs to the fold that training never sees (a NULL id does)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def sampled(df: DataFrame, bound: int, key: str = "doc_id") -> DataFrame:
    """At most ``bound`` rows, the first ones in the order of a hash of ``key``."""
    return df.orderBy(F.xxhash64(F.lit(17), F.col(key)), F.col(key)).limit(bound)


def texts_of(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def byte_chunks(column: pa.Array, target: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Consecutive texts as UTF-8 bytes: (index of the first, bytes, offsets), about ``target`` bytes each.

    A NULL text counts as empty.  A longer text makes a chunk of its own; none is cut.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    n = len(column)
    if n == 0:
        return
    _, index, data = column.buffers()
    ends = np.frombuffer(index, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + target, "right")) - 1)
        last = min(last, n)
        yield first, raw[ends[first] : ends[last]], ends[first : last + 1] - ends[first]
        first = last
