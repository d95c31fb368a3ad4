"""Pinned revisions of a snapshot: which shards it held, and proof that they are still the same.

A commit writes a table of all shards (path below the root, size, SHA-256 digest, rows) to
``revisions/<name>`` in one step; a name is used once.  Loading a revision reads exactly the
listed shards, whatever was added since, after tasks have compared each with its entry.
Digests are made where the bytes are read, so a shard must fit into a task's memory.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidepanel.contracts.validate import ContractError
from tidepanel.sinks.pointer import Folder
from tidepanel.sources.bundle import Bundle, assemble
from tidepanel.sources.scans import read_manifest, read_registry

#: Where commits and the registry lie below a snapshot's root.
REVISIONS, REGISTRY = "revisions", "metadata/sites.csv"
_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]*")


def _below(root: str, path: str) -> Column:
    """A file's path below the root; schemes and hosts in front of it don't matter."""
    bare = re.sub(r"^[a-z][a-z0-9+.-]*:(//[^/]*)?", "", root).rstrip("/")
    return F.expr(f"substring({path}, instr({path}, '{bare}/') + {len(bare) + 1})")


def _files(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load([*paths])


def _facts(files: DataFrame, root: str) -> DataFrame:
    return files.select(_below(root, "path").alias("path"), F.col("length").alias("size"), F.sha2("content", 256).alias("digest"))


def shards_of(spark: SparkSession, root: str) -> DataFrame:
    """path, size, digest and rows of every shard, and of the registry (no rows)."""
    shards = _files(spark, f"{root}/data").where(F.col("path").endswith(".parquet"))
    # Footers tell the rows of a file when no column is asked for.
    empty = spark.read.schema(StructType([])).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{root}/data")
    rows = empty.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("rows"))
    rows = rows.select(_below(root, "url_decode(replace(file, '+', '%2B'))").alias("path"), "rows")
    found = _facts(shards, root).join(rows, "path", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    if Folder(spark, root).exists(REGISTRY):
        found = found.union(_facts(_files(spark, f"{root}/{REGISTRY}"), root).withColumn("rows", F.lit(None).cast("long")))
    return found


def revisions(spark: SparkSession, root: str) -> list[str]:
    """Names of the committed revisions."""
    return [name for name in Folder(spark, root).names(REVISIONS) if _NAME.fullmatch(name)]


def commit_revision(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Pin what the snapshot holds now; a name that is taken, or that no folder can have, is refused."""
    folder = Folder(spark, root)
    if not _NAME.fullmatch(name) or folder.exists(f"{REVISIONS}/{name}"):
        raise ContractError("revision", "S2", f"{name!r} is no new name")
    draft = f"{REVISIONS}/.draft-{uuid.uuid4().hex}"
    shards_of(spark, root).repartition(1).sortWithinPartitions("path").write.parquet(f"{root}/{draft}")
    try:
        folder.move(draft, f"{REVISIONS}/{name}")
    except Exception as error:
        folder.delete(draft)
        raise ContractError("revision", "S2", f"{name!r} was committed by another writer") from error
    return revision_files(spark, root, name)


def revision_files(spark: SparkSession, root: str, name: str) -> DataFrame:
    if not Folder(spark, root).exists(f"{REVISIONS}/{name}"):
        raise ContractError("revision", "S2", f"no revision {name!r}")
    return spark.read.schema("path string, size long, digest string, rows long").parquet(f"{root}/{REVISIONS}/{name}")


def revision_faults(spark: SparkSession, root: str, name: str, digests: bool = True) -> DataFrame:
    """(path, fault) of every listed file that is ``lost``, or differs in ``size`` or ``digest``.

    ``digests=False`` compares what a listing tells, without reading a shard.
    """
    listed = revision_files(spark, root, name)
    there = _files(spark, f"{root}/data", *([f"{root}/{REGISTRY}"] if Folder(spark, root).exists(REGISTRY) else []))
    found = there.select(_below(root, "path").alias("path"), F.col("length").alias("_size"))
    faults = listed.join(found, "path", "left")
    lost, resized = F.col("_size").isNull(), F.col("_size") != F.col("size")
    report = faults.select("path", F.when(lost, "lost").when(resized, "size").alias("fault")).where("fault is not null")
    if not digests:
        return report
    # Only files whose size still agrees are read; a scan takes files by name, so the driver knows them in any case.
    same = [r["path"] for r in faults.where(F.col("_size") == F.col("size")).select("path").collect()]
    if not same:
        return report
    read = _facts(_files(spark, *[f"{root}/{path}" for path in same]), root)
    changed = read.join(listed.select("path", F.col("digest").alias("_digest")), "path").where("digest <> _digest")
    return report.union(changed.select("path", F.lit("digest").alias("fault")))


def read_revision(spark: SparkSession, root: str, name: str, digests: bool = True) -> dict[str, DataFrame]:
    """The products of a pinned revision, refused if a listed file is lost or has changed."""
    faults = revision_faults(spark, root, name, digests).orderBy("path").limit(5).collect()
    if faults:
        raise ContractError("revision", "S2", f"{name}: " + ", ".join(f"{f.path} ({f.fault})" for f in faults))
    paths = [r.path for r in revision_files(spark, root, name).select("path").collect()]
    return read_manifest(spark, paths, root)


def load_revision(spark: SparkSession, root: str, name: str, strict: bool = True, digests: bool = True) -> Bundle:
    """The bundle of a pinned revision, with the registry it was committed with."""
    products = read_revision(spark, root, name, digests)
    return assemble(products, read_registry(spark, f"{root}/{REGISTRY}"), name, source=root, strict=strict)
