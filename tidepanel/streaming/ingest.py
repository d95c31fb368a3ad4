"""Structured Streaming ingest: archive new shards, refuse repeats, refresh best records.

Layout below one shared folder::

    raw/batch=<n>/part=<period>/    accepted rows of each micro-batch
    keys/batch=<n>/part=<period>/   128-bit hashes of their raw keys, sorted, with Bloom filters
    repeats/batch=<n>/              raw keys delivered more than once, with counts
    best/batch=<n>/part=<period>/   best records of a period, as of the batch that last touched it
    states/<n>, head                which of these folders are valid after batch n, and the newest n
    checkpoint/                     stream progress

A batch asks the keys of its own periods for repeats and merges its rows with the stored
best records of these periods; archived rows are not read again.  It writes into folders of
its own and becomes valid by one small text, ``head``, replaced in one step.  A reader takes
every period as one batch left it; a batch that runs again after a failure starts from the
state before it and leaves the same tables.
No watermark is used: a newer snapshot of an old day is normal and must count.
"""

from __future__ import annotations

import operator
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tidepanel.contracts.validate import (
    ContractError,
    Known,
    enforce,
    require_columns,
    row_report,
    typed_product,
)
from tidepanel.functions.dates import DayLike, as_day
from tidepanel.operators.select import best_records, on_keys, top_row
from tidepanel.session import pin_utc
from tidepanel.sinks.pointer import Folder
from tidepanel.sources.scans import product_of_file
from tidepanel.specs import CONFIGURED_SITES, DAY, PRODUCTS, RAW_KEY, ProductSpec

PART, BATCH, FILE = "part", "batch", "_file"


# The leading letter keeps partition values text when Spark infers their type.
PERIODS = {"month": "'m'yyyy-MM", "day": "'d'yyyy-MM-dd"}


#: Rows up to which a batch's keys are handed to the index scan as a list, and lists of keys a period may have.
PUSHED_KEYS, KEY_RUNS = 500, 16


@contextmanager
def pushed_lists(spark: SparkSession) -> Iterator[None]:
    """Lists of up to ``PUSHED_KEYS`` values reach Parquet scans as they are, not as a range."""
    name = "spark.sql.parquet.pushdown.inFilterThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, str(PUSHED_KEYS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def by_period(df: DataFrame) -> DataFrame:
    """Periods gathered into few files; the adaptive plan splits one that is too large."""
    return df.hint("rebalance", F.col(PART))


@dataclass(frozen=True)
class PanelStore:
    """Archive, key index and best-record table of one domain.

    ``period`` is what a late record makes the store write anew: months suit a small
    panel, days one whose months are terabytes.
    """

    root: str
    raw_key: Sequence[str] = RAW_KEY
    tie_breakers: Sequence[str] = ()
    strict: bool = False
    period: str = "month"

    @property
    def raw(self) -> str:
        return f"{self.root}/raw"

    @property
    def best(self) -> str:
        return f"{self.root}/best"

    @property
    def keys(self) -> str:
        return f"{self.root}/keys"

    @property
    def repeats(self) -> str:
        return f"{self.root}/repeats"

    # -- reading ------------------------------------------------------------------------

    def state(self, spark: SparkSession, before: int | None = None) -> dict:
        """Valid folders, on request as they were before a batch."""
        folder = Folder(spark, self.root)
        state = folder.read("head")
        while state is not None and before is not None and state["batch"] >= before:
            state = None if state["before"] is None else folder.read(f"states/{state['before']}")
        return state or {"batch": None, "best": {}, "keys": {}, "raw": [], "repeats": []}

    def _valid(self, spark: SparkSession, table: str, folders: Sequence[str], schema: StructType | str | None = None) -> DataFrame | None:
        """The valid folders of a table; with a schema no footer is read for it."""
        if not folders:
            return None
        reader = spark.read.option("basePath", table)
        return (reader if schema is None else reader.schema(schema)).parquet(*[f"{table}/{folder}" for folder in folders])

    def best_of(self, spark: SparkSession, state: dict, parts: Iterable[str]) -> DataFrame | None:
        """Best records of some periods, None where none is stored."""
        return self._valid(spark, self.best, [f"{BATCH}={state['best'][p]}/{PART}={p}" for p in parts if p in state["best"]])

    def keys_of(self, spark: SparkSession, state: dict, parts: Iterable[str]) -> DataFrame | None:
        """The key index of some periods."""
        folders = [f"{BATCH}={b}/{PART}={p}" for p in parts for b in state["keys"].get(p, [])]
        return self._valid(spark, self.keys, folders, f"k1 long, k2 long, {BATCH} int, {PART} string")

    def read_best(self, spark: SparkSession, dates: tuple[DayLike, DayLike] | None = None) -> DataFrame:
        """Best records, on request of a range of days, which also picks the folders to read."""
        state = self.state(spark)
        best = self.best_of(spark, state, sorted(state["best"]))
        if best is None:
            raise FileNotFoundError(f"no batch has reached {self.root}")
        if dates is not None:
            low, high = (F.date_format(as_day(day), PERIODS[self.period]) for day in dates)
            best = on_keys(best.where(F.col(PART).between(low, high)), dates=dates)
        return best.drop(PART, BATCH)

    def read_raw(self, spark: SparkSession) -> DataFrame:
        """Every accepted row of every delivery."""
        raw = self._valid(spark, self.raw, [f"{BATCH}={b}" for b in self.state(spark)["raw"]])
        if raw is None:
            raise FileNotFoundError(f"no batch has reached {self.root}")
        return raw.drop(PART, BATCH)

    def read_repeats(self, spark: SparkSession) -> DataFrame:
        """Raw keys that came more than once in or after a batch: copies in it, and how many of them were accepted."""
        found = self._valid(spark, self.repeats, [f"{BATCH}={b}" for b in self.state(spark)["repeats"]])
        if found is not None:
            return found
        counts = [F.lit(0).cast("long").alias("copies"), F.lit(0).alias("accepted"), F.lit(0).alias(BATCH)]
        return self.read_raw(spark).select(*self.raw_key, *counts).where(F.lit(False))

    # -- a batch ------------------------------------------------------------------------

    def absorb(self, rows: DataFrame, batch: int) -> None:
        """Archive one batch of typed rows and refresh the periods it touches.

        A row with a null in its raw key is refused with its batch: no period or earlier
        delivery could be found for it.
        """
        spark = rows.sparkSession
        rows = rows.withColumn(PART, F.date_format(DAY, PERIODS[self.period]))
        blank = reduce(operator.or_, [F.col(k).isNull() for k in self.raw_key])
        # The calendar bounds the periods of a batch, whatever its number of rows.
        found = rows.agg(F.max(blank).alias("blank"), F.collect_set(PART).alias("parts"), F.count(F.lit(1)).alias("rows")).first()
        if found["blank"]:
            raise ContractError("stream", "V2", f"batch {batch}")
        if not found["rows"]:
            return
        state, parts = self.state(spark, batch), sorted(found["parts"])
        counts = self._archive(spark, rows, batch, state, parts, found["rows"])
        state = {**state, "before": state["batch"], "batch": batch}
        if counts["repeated"]:
            self._list_repeats(spark, rows, batch)
            state["repeats"] = [*state["repeats"], batch]
        if counts["accepted"]:
            touched = self._valid(spark, self.raw, [f"{BATCH}={batch}"]).drop(BATCH)
            state["keys"] = self._index(spark, touched, batch, state, parts)
            state["best"] = self._refresh(spark, touched, batch, state, parts)
            state["raw"] = [*state["raw"], batch]
        folder = Folder(spark, self.root)
        folder.write(f"states/{batch}", state)
        folder.write("head", state)

    def hashed(self, rows: DataFrame) -> DataFrame:
        """Rows with the two halves of their raw key's 128-bit hash."""
        return rows.withColumns({"k1": F.xxhash64(*self.raw_key), "k2": F.xxhash64(F.lit(1), *self.raw_key)})

    def unseen(self, rows: DataFrame, state: dict, parts: Sequence[str], few: Sequence[int] | None = None) -> DataFrame:
        """Hashed rows whose raw key is in no earlier batch.

        ``few``: the first halves of all keys of a small batch.  They reach the scan of the
        index, whose Bloom filters then tell which files need to be opened.
        """
        known = self.keys_of(rows.sparkSession, state, parts)
        if known is None:
            return rows
        if few is not None:
            known = known.where(F.col("k1").isin(*few))
        return rows.join(known.select("k1", "k2"), ["k1", "k2"], "left_anti")

    def _archive(self, spark: SparkSession, rows: DataFrame, batch: int, state: dict, parts: Sequence[str], size: int) -> dict:
        """Write the first row of each raw key that no earlier batch brought."""
        keys = [*self.raw_key]
        rest = [c for c in rows.columns if c not in keys]
        # Of equal keys one row stays; each task sends one for a key that owns most rows.  The rows
        # are then dealt by the hashes that the index is joined on.
        one = top_row(self.hashed(rows), ["k1", "k2"], [F.xxhash64(*rest)])
        few = None
        if size <= PUSHED_KEYS and state["keys"]:
            few = [r["k1"] for r in self.hashed(rows).select("k1").distinct().collect()]
        with pushed_lists(spark):
            accepted = self.unseen(one, state, parts, few)
            path = f"{self.raw}/{BATCH}={batch}"
            by_period(accepted.select(rows.columns)).write.mode("overwrite").partitionBy(PART).parquet(path)
        # Footers alone tell the number of rows.
        written = spark.read.schema(rows.schema).parquet(path).count()
        repeated = size > written
        if self.strict and repeated:
            Folder(spark, self.root).delete(f"raw/{BATCH}={batch}")
            raise ContractError("stream", "V6", f"batch {batch}")
        return {"accepted": written, "repeated": repeated}

    def _list_repeats(self, spark: SparkSession, rows: DataFrame, batch: int) -> None:
        keys = [*self.raw_key]
        copies = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"))
        taken = spark.read.schema(rows.schema).parquet(f"{self.raw}/{BATCH}={batch}").select(*keys, F.lit(1).alias("_taken"))
        repeats = copies.join(taken, keys, "left").withColumn("accepted", F.coalesce("_taken", F.lit(0))).drop("_taken")
        repeats.where("copies > accepted").write.mode("overwrite").parquet(f"{self.repeats}/{BATCH}={batch}")

    def _index(self, spark: SparkSession, touched: DataFrame, batch: int, state: dict, parts: Sequence[str]) -> dict:
        """Add a batch's keys; a period with many short lists of keys has them merged into one."""
        new = self.hashed(touched).select(PART, "k1", "k2")
        merged = [p for p in parts if len(state["keys"].get(p, [])) >= KEY_RUNS]
        if merged:
            new = new.unionByName(self.keys_of(spark, state, merged).select(PART, "k1", "k2"))
        (
            by_period(new).sortWithinPartitions(PART, "k1").write.mode("overwrite").partitionBy(PART)
            .option("parquet.bloom.filter.enabled#k1", "true").option("parquet.bloom.filter.adaptive.enabled", "true")
            .parquet(f"{self.keys}/{BATCH}={batch}")
        )
        return {**state["keys"], **{p: [batch] if p in merged else [*state["keys"].get(p, []), batch] for p in parts}}

    def _refresh(self, spark: SparkSession, touched: DataFrame, batch: int, state: dict, parts: Sequence[str]) -> dict:
        """Best of the stored best records and the new rows; other periods stay as they are."""
        stored = self.best_of(spark, state, parts)
        if stored is not None:
            touched = stored.drop(BATCH).unionByName(touched, allowMissingColumns=True)
        best = by_period(best_records(touched, self.tie_breakers))
        best.write.mode("overwrite").partitionBy(PART).parquet(f"{self.best}/{BATCH}={batch}")
        return {**state["best"], **dict.fromkeys(parts, batch)}

    def expire(self, spark: SparkSession, keep: int = 2) -> int:
        """Delete folders that the last ``keep`` states do not name; returns their number.

        At least the newest state and the one before it must stay: a batch may run again.
        """
        folder, states = Folder(spark, self.root), []
        state = folder.read("head")
        while state is not None and len(states) < max(2, keep):
            states.append(state)
            state = None if state["before"] is None else folder.read(f"states/{state['before']}")
        named = {("best", b, p) for s in states for p, b in s["best"].items()}
        named |= {("keys", b, p) for s in states for p, runs in s["keys"].items() for b in runs}
        gone = 0
        for table in ("best", "keys"):
            for run in folder.names(table):
                for part in folder.names(f"{table}/{run}"):
                    if part.startswith(f"{PART}=") and (table, int(run.removeprefix(f"{BATCH}=")), part.removeprefix(f"{PART}=")) not in named:
                        folder.delete(f"{table}/{run}/{part}")
                        gone += 1
        return gone


def stream_into(
    shards: DataFrame, store: PanelStore, prepare: Callable[[DataFrame], DataFrame]
) -> StreamingQuery:
    """Run everything that is available through ``prepare`` into the store, then stop."""
    pin_utc(shards.sparkSession)
    return (
        shards.writeStream.foreachBatch(lambda rows, batch: store.absorb(prepare(rows), batch))
        .option("checkpointLocation", f"{store.root}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def shard_stream(spark: SparkSession, path: str, schema: StructType | str, files_per_batch: int = 1000) -> DataFrame:
    """New Parquet files below ``path``, each row with the file it came from."""
    return (
        spark.readStream.schema(schema)
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.parquet")
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(path)
        .withColumn(FILE, F.col("_metadata.file_path"))
    )


def product_schema(specs: Iterable[ProductSpec]) -> str:
    """Fixed schema of a domain's shards, which a streaming read needs up front."""
    metrics = dict.fromkeys(m for spec in specs for m in spec.metrics)
    keys = [f"{k} {'date' if k == DAY else 'string'}" for k in RAW_KEY]
    return ", ".join([*keys, *[f"{m} double" for m in metrics]])


def ingest_domain(
    spark: SparkSession,
    root: str,
    domain: str,
    store: PanelStore,
    known: Known = CONFIGURED_SITES,
    files_per_batch: int = 1000,
    kinds: Sequence[str] = ("reanalysis", "recent"),
) -> StreamingQuery:
    """Stream a domain's products of some kinds below ``root/data`` into ``store``.

    Past products share a store, which keeps their best record; forecasts take one of
    their own, whose raw rows are the vintages.

    A fixed schema would fill an absent column with nulls, so the columns of each
    batch's files are read again and checked; their number is ``files_per_batch``.
    """
    specs = [PRODUCTS[f"{domain}_{kind}"] for kind in kinds]
    path = f"{root}/data/{{{','.join(s.name for s in specs)}}}"
    shards = product_of_file(shard_stream(spark, path, product_schema(specs), files_per_batch))

    def prepare(rows: DataFrame) -> DataFrame:
        session = rows.sparkSession
        typed = []
        for spec in specs:
            part = rows.where(F.col("product") == spec.name)
            files = [r[FILE] for r in part.select(FILE).distinct().collect()]
            if not files:
                continue
            present = session.read.option("mergeSchema", "true").option("recursiveFileLookup", "true").parquet(*files)
            require_columns(present, spec.name, "V1", spec.required)
            part = part.drop(FILE, "product")
            enforce(row_report(part, spec, known))
            typed.append(typed_product(part, spec))
        return reduce(DataFrame.unionByName, typed)

    return stream_into(shards, store, prepare)
