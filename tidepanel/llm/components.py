"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import kept


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    return both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).filter("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("low"))
    return (
        down.join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        .unionByName(low.select("u", F.col("low").alias("v")))
        .filter("u <> v")
        .distinct()
    )


def components(links: DataFrame) -> DataFrame:
    """(node, component): each node with links, and the smallest node of its component.

    ``links`` has columns ``a`` and ``b`` of one type.  Neighbours are never gathered: every step
    aggregates and joins, each result is a table in the shared folder, and only a count and a
    checksum reach the driver.  The number of steps grows with the logarithm of the nodes.
    """
    edges = kept(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state[0] == 0 or state == seen:
            break
        seen = state
        edges = kept(_small(_large(edges)), "edges")
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
