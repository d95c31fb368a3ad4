"""Pages of a result that is sorted once: an index of row counts and key bounds tells which files hold a page."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidepanel.operators.explore import sort_keys
from tidepanel.session import scratch_path

_PART, _POSITION = "_part", "_position"


@dataclass(frozen=True)
class Pages:
    """A sorted copy below ``path`` and its index: one entry per part, not per row."""

    path: str
    order: tuple[str, ...]
    schema: StructType
    parts: tuple[Row, ...]

    @property
    def rows(self) -> int:
        return sum(part["rows"] for part in self.parts)

    def count(self, size: int) -> int:
        """Pages of this size, one at least."""
        return max(1, -(-self.rows // size))

    def page(self, spark: SparkSession, number: int, size: int) -> DataFrame:
        """Rows of one page in key order; reads the files that hold it and writes nothing."""
        return self.rows_between(spark, (number - 1) * size, number * size)

    def rows_between(self, spark: SparkSession, first: int, last: int) -> DataFrame:
        """Rows at the places ``first`` to ``last - 1`` of the whole order."""
        wanted, base = [], 0
        for part in self.parts:
            low, high = max(first, base), min(last, base + part["rows"])
            if low < high:
                wanted.append((part[_PART], low - base, high - base))
            base += part["rows"]
        return self._cut(spark, wanted)

    def place_of(self, key: Sequence) -> int:
        """Rows in the parts that end before ``key``: a lower bound of its place, from the index alone."""
        return sum(part["rows"] for part in self.parts if tuple(part["last"]) < tuple(key))

    def _cut(self, spark: SparkSession, wanted: Sequence[tuple[int, int, int]]) -> DataFrame:
        folders = [f"{self.path}/rows/{_PART}={part}" for part, _, _ in wanted]
        if not folders:
            return spark.createDataFrame([], self.schema)
        reader = spark.read.option("basePath", f"{self.path}/rows").schema(_placed(self.schema))
        hits = [(F.col(_PART) == part) & F.col(_POSITION).between(low, high - 1) for part, low, high in wanted]
        return reader.parquet(*folders).where(reduce(lambda a, b: a | b, hits)).select(*self.schema.names).orderBy(*self.order)


def _placed(schema: StructType) -> StructType:
    return StructType([*schema.fields, StructField(_POSITION, LongType()), StructField(_PART, LongType())])


def index_pages(df: DataFrame, keys: Sequence[str] | None = None, path: str | None = None) -> Pages:
    """Sort a result once and index it; ``keys`` must order its rows totally.

    The copy goes to the shared folder, so places stay fixed when an executor is lost and
    other sessions can open it by its path.
    """
    order = tuple(keys or sort_keys(df))
    spark = df.sparkSession
    path = path or scratch_path(spark, "pages")
    # The id holds the partition's number above bit 33 and the place in it below.
    number = F.monotonically_increasing_id()
    (
        df.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("_id", number)
        .withColumns({_PART: F.shiftright("_id", 33), _POSITION: F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))})
        .drop("_id")
        .write.partitionBy(_PART).parquet(f"{path}/rows")
    )
    ends = F.struct(*order)
    # An empty result has no part, so the schema can't be read back from files.
    written = spark.read.schema(_placed(df.schema)).parquet(f"{path}/rows")
    index = written.groupBy(_PART).agg(F.count(F.lit(1)).alias("rows"), F.min(ends).alias("first"), F.max(ends).alias("last"))
    index.repartition(1).sortWithinPartitions(_PART).write.parquet(f"{path}/index")
    spark.createDataFrame([(list(order), df.schema.json())], "keys array<string>, columns string").write.parquet(f"{path}/names")
    return open_pages(spark, path)


def open_pages(spark: SparkSession, path: str) -> Pages:
    """The pages of a result that was indexed before."""
    names = spark.read.parquet(f"{path}/names").first()
    parts = spark.read.parquet(f"{path}/index").orderBy(_PART).collect()
    return Pages(path, tuple(names["keys"]), StructType.fromJson(json.loads(names["columns"])), tuple(parts))
