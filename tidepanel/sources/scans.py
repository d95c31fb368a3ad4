"""Reading products, the registry and optional records."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager
from functools import reduce

import pyarrow as pa
import pyarrow.parquet as pq
from py4j.protocol import Py4JJavaError
from pyarrow.fs import FileSystem
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import DataType, NumericType, StructType

from tidepanel.functions.values import blank_to_null
from tidepanel.specs import PRODUCTS

_ABSENT = {"PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"}


def shard_reader(spark: SparkSession, merge: bool = False) -> DataFrameReader:
    """Shards as one table: partition folders are ignored, other files left out."""
    return (
        spark.read.option("mergeSchema", str(merge).lower())
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.parquet")
    )


def read_shards(spark: SparkSession, *paths: str, each: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """All shards of a product, columns merged by name; ``each`` is applied to every scan."""
    try:
        return each(shard_reader(spark, True).parquet(*paths))
    except (PySparkException, Py4JJavaError) as error:
        if "CANNOT_MERGE_SCHEMAS" not in str(error):
            raise
        return _shards_of_mixed_types(spark, *paths, each=each)


def _tail() -> Column:
    """The footer of a Parquet file with the eight bytes after it, which hold its length from the low byte on."""
    size = "concat(" + ", ".join(f"hex(substring(content, cast(length as int) - {7 - i}, 1))" for i in (3, 2, 1, 0)) + ")"
    return F.expr(f"substring(content, cast(length - 7 - cast(conv({size}, 16, 10) as long) as int), cast(conv({size}, 16, 10) as int) + 8)")


def _schema_of(source: pa.NativeFile) -> str:
    """A file's schema as Spark's JSON: as Spark wrote it, or translated from Parquet's own."""
    schema = pq.read_schema(source)
    written = (schema.metadata or {}).get(b"org.apache.spark.sql.parquet.row.metadata")
    return written.decode() if written else from_arrow_schema(schema).json()


@contextmanager
def footer_source(path: str, tail: bytes | None) -> Iterator[pa.NativeFile]:
    """A file that a task opens by itself, or the end of one that Spark has read."""
    if tail is not None:
        yield pa.BufferReader(tail)
        return
    files, name = FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
    with files.open_input_file(name) as source:
        yield source


def _footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        paths, schemas = batch.column("path"), []
        for path, tail in zip(paths.to_pylist(), batch.column("tail").to_pylist()):
            try:
                with footer_source(path, tail) as source:
                    schemas.append(_schema_of(source))
            except (OSError, pa.ArrowException):
                if tail is not None:
                    raise
                schemas.append(None)
        yield pa.RecordBatch.from_arrays([paths, pa.array(schemas, pa.string())], names=["path", "schema"])


def with_tails(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Files with their ends, read by Spark."""
    return spark.read.format("binaryFile").load([*paths]).select("path", _tail().alias("tail"))


def schemas_of(spark: SparkSession, *paths: str) -> dict[str, list[str]]:
    """Files of each distinct schema (Spark's JSON) below some paths, their footers read in tasks.

    Two jobs at most, whatever the number of files: tasks open files themselves, and where they
    can't, since only Spark's readers know the store, Spark reads those files and hands over their ends.
    """
    files = shard_reader(spark).format("binaryFile").load([*paths])
    shape = "path string, schema string"
    # Paths become rows; a file's bytes aren't read for them.
    listed = files.select("path", F.lit(None).cast("binary").alias("tail")).mapInArrow(_footers, shape)
    found = listed.groupBy("schema").agg(F.collect_list("path").alias("paths")).collect()
    unread = [path for row in found if row["schema"] is None for path in row["paths"]]
    groups = {row["schema"]: row["paths"] for row in found if row["schema"] is not None}
    if unread:
        ends = with_tails(spark, unread).mapInArrow(_footers, shape)
        for row in ends.groupBy("schema").agg(F.collect_list("path").alias("paths")).collect():
            groups.setdefault(row["schema"], []).extend(row["paths"])
    return {schema: sorted(group) for schema, group in sorted(groups.items())}


def _shards_of_mixed_types(spark: SparkSession, *paths: str, each: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Union of shards that hold a column in different types, one scan per distinct schema.

    Numbers meet as double and anything else as text, which the contract then reads.
    """
    groups = schemas_of(spark, *paths)
    frames = [each(shard_reader(spark).schema(StructType.fromJson(json.loads(key))).parquet(*files)) for key, files in groups.items()]
    kinds: dict[str, set[DataType]] = {}
    for df in frames:
        for field in df.schema:
            kinds.setdefault(field.name, set()).add(field.dataType)
    common = {
        name: "double" if all(isinstance(kind, NumericType) for kind in found) else "string"
        for name, found in kinds.items()
        if len(found) > 1
    }
    cast = [df.withColumns({c: F.col(c).cast(common[c]) for c in df.columns if c in common}) for df in frames]
    return reduce(lambda left, right: left.unionByName(right, allowMissingColumns=True), cast)


def read_product(spark: SparkSession, root: str, product: str) -> DataFrame | None:
    """Every shard below ``root/data/<product>``; ``None`` when there is none."""
    try:
        return read_shards(spark, f"{root}/data/{product}")
    except AnalysisException as error:
        if error.getCondition() in _ABSENT:
            return None
        raise


def read_snapshot(spark: SparkSession, root: str, products: Iterable[str] = tuple(PRODUCTS)) -> dict[str, DataFrame]:
    found = {name: read_product(spark, root, name) for name in products}
    return {name: df for name, df in found.items() if df is not None}


def product_folder(products: Iterable[str]) -> str:
    """Pattern of a product's folder in a path; other ``data`` folders above it do not match."""
    return f"data/({'|'.join(map(re.escape, products))})/"


def route(paths: Iterable[str], products: Iterable[str] = tuple(PRODUCTS)) -> dict[str, list[str]]:
    """Manifest paths grouped by the product folder they lie in; other files are left out."""
    shard = re.compile(rf"(?:^|/){product_folder(products)}.*\.parquet$")
    groups: dict[str, list[str]] = {}
    for path in paths:
        if hit := shard.search(path):
            groups.setdefault(hit.group(1), []).append(path)
    return groups


def read_manifest(
    spark: SparkSession, paths: Iterable[str], root: str = "", products: Iterable[str] = tuple(PRODUCTS)
) -> dict[str, DataFrame]:
    """Exactly the listed shards of one revision, whatever else the folders hold."""
    prefix = f"{root.rstrip('/')}/" if root else ""
    return {
        name: read_shards(spark, *[prefix + path for path in group])
        for name, group in route(paths, products).items()
    }


def product_of_file(df: DataFrame, products: Iterable[str] = tuple(PRODUCTS)) -> DataFrame:
    """Product name taken from each row's file path, for scans over several products."""
    return df.withColumn("product", F.regexp_extract(F.col("_metadata.file_path"), f"/{product_folder(products)}", 1))


def read_routed(spark: SparkSession, root: str, products: Iterable[str] = tuple(PRODUCTS)) -> DataFrame:
    """Every shard of a snapshot in one frame, its product told by its folder."""
    return read_shards(spark, f"{root}/data", each=lambda df: product_of_file(df, products))


def read_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Header CSV with every cell as text; contracts decide what is a number or a date.

    Every file of a folder must have the same header; one with other names or another order is refused,
    as is a row with too few or too many cells, whichever columns are read.  Quotes inside a quoted cell
    are doubled.  ``multi_line`` allows line breaks in cells at the price of one task per file.
    """
    reader = spark.read.option("header", True).option("mode", "FAILFAST").option("escape", '"')
    reader = reader.option("enforceSchema", False).option("columnPruning", False)
    return reader.option("multiLine", multi_line).csv(path)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Registry CSV, texts that mean no value as NULL; the contract turns its coordinate texts into numbers."""
    return blank_to_null(read_csv(spark, path))


def read_records(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Catch, ocean or profile CSV before its contract."""
    return read_csv(spark, path, multi_line)
