"""Session settings and the shared scratch folder."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(app: str = "tidepanel", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the plans are written for.

    Shuffles start with many partitions and AQE joins small ones, so that none grows to tens of
    GB on a large cluster; a ``local`` master keeps Spark's own number.  Callers override any of it through ``conf``.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.parquet.filterPushdown": "true",
        "spark.ui.enabled": "false",
    }
    if not (master or "").startswith("local"):
        settings["spark.sql.adaptive.coalescePartitions.initialPartitionNum"] = "4096"
    settings.update({key.replace("__", "."): value for key, value in conf.items()})
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def pin_utc(spark: SparkSession) -> None:
    """Vintage texts without a zone mean UTC, so the session must read them as UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")


@functools.cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="tidepanel-")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only for local sessions."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder every executor can reach")
    return _local_root()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{scratch_root(spark)}/tidepanel/{label}-{uuid.uuid4().hex}"
