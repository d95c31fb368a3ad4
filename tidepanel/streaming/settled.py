"""Best-record tables bucketed by site-day, so that domains are joined without a shuffle.

``settle`` copies a store's best records into one Parquet table that is hashed into buckets by
(site, day) and sorted inside them::

    settled/<name>/    one file per bucket
    settled-head       text: folder, number of buckets, columns, and the batch of every period in it

Two stores settled into the same number of buckets meet bucket by bucket.  Batches that came
after it make their periods stale; these are read from the store's own folders and joined by
themselves, so a shuffle moves what changed since, not the table.  A period holds whole days and
the key holds the day, so fresh and stale periods never share a key.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidepanel.operators.joins import join_domains
from tidepanel.sinks.pointer import Folder
from tidepanel.specs import PANEL_KEY
from tidepanel.streaming.ingest import BATCH, PART, PanelStore

TEXT, TABLES = "settled-head", "settled"


def settle(spark: SparkSession, store: PanelStore, buckets: int) -> None:
    """Write the store's present best records as one bucketed table and make it the valid one.

    ``buckets`` should leave a bucket at some hundred MB; keys are unique, so a busy site or day
    spreads over all of them.  The text is replaced in one step: a run that fails leaves the
    earlier table valid.  A store without rows is refused.
    """
    state = store.state(spark)
    best = store.best_of(spark, state, sorted(state["best"]))
    if best is None:
        raise FileNotFoundError(f"no batch has reached {store.root}")
    rows = best.drop(BATCH)
    name = f"tidepanel_{uuid.uuid4().hex}"
    (
        rows.repartition(buckets, *PANEL_KEY)
        .write.bucketBy(buckets, *PANEL_KEY).sortBy(*PANEL_KEY)
        .format("parquet").option("path", f"{store.root}/{TABLES}/{name}").saveAsTable(name)
    )
    text = {"name": name, "buckets": buckets, "best": state["best"], "schema": rows.schema.json()}
    Folder(spark, store.root).write(TEXT, text)


def settled_state(spark: SparkSession, store: PanelStore) -> dict | None:
    """The valid bucketed table's text; None for a store that was never settled."""
    return Folder(spark, store.root).read(TEXT)


def stale_periods(state: dict, settled: dict) -> set[str]:
    """Periods that a batch has touched since the table was written."""
    return {part for part, batch in state["best"].items() if settled["best"].get(part) != batch}


def settled_table(spark: SparkSession, store: PanelStore, settled: dict) -> DataFrame:
    """The bucketed table; a session that doesn't know it registers the folder first."""
    name, keys = settled["name"], ", ".join(PANEL_KEY)
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in StructType.fromJson(json.loads(settled["schema"])))
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) "
            f"INTO {settled['buckets']} BUCKETS LOCATION '{store.root}/{TABLES}/{name}'"
        )
    return spark.table(name)


def expire_settled(spark: SparkSession, store: PanelStore) -> int:
    """Drop the bucketed tables that are no longer valid; returns their number."""
    folder, settled = Folder(spark, store.root), settled_state(spark, store)
    old = [name for name in folder.names(TABLES) if settled is None or name != settled["name"]]
    for name in old:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        folder.delete(f"{TABLES}/{name}")
    return len(old)


def join_settled(
    spark: SparkSession,
    weather: PanelStore,
    marine: PanelStore,
    sites: DataFrame | None,
    revision: str,
    choose: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> DataFrame | None:
    """The daily panel of two settled stores; None when a table is missing or buckets or periods differ.

    ``choose`` picks the rows of each side before the join.
    """
    stores = (weather, marine)
    tables = [settled_state(spark, store) for store in stores]
    if None in tables or tables[0]["buckets"] != tables[1]["buckets"] or weather.period != marine.period:
        return None
    states = [store.state(spark) for store in stores]
    stale = sorted(set().union(*map(stale_periods, states, tables)))
    whole = [settled_table(spark, store, text) for store, text in zip(stores, tables)]
    # The calendar bounds the periods, not the data.
    fresh = [(df.where(~F.col(PART).isin(*stale)) if stale else df).drop(PART) for df in whole]
    joined = join_domains(*map(choose, fresh), sites, revision)
    if not stale:
        return joined
    since = []
    for store, state, like in zip(stores, states, fresh):
        rows = store.best_of(spark, state, stale)
        # A store that has none of these periods adds its columns alone.
        since.append(like.where(F.lit(False)) if rows is None else rows.drop(PART, BATCH))
    return joined.unionByName(join_domains(*map(choose, since), sites, revision), allowMissingColumns=True)
