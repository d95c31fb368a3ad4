"""Streaming ingest: equal to batch, repeatable, late data, repeats, contracts."""

import pytest
from pyspark.sql import functions as F

from conftest import TODAY, rows
from tidepanel.operators.select import best_records
from tidepanel.plans.panel import daily_from_stores, daily_panel, forecast_panel, forecasts_from_stores, past_products
from tidepanel.sources.scans import read_product
from tidepanel.sinks.pointer import Folder
from tidepanel.streaming.ingest import PanelStore, ingest_domain, pushed_lists
from tidepanel.streaming.settled import expire_settled, settle, settled_state

COLUMNS = ("site_id", "date_local", "product", "model", "snapshot_id", "complete_core", "wave_height_max")


@pytest.fixture
def drop_zone(spark, snapshot, tmp_path):
    """Shards can be added to a copy of the snapshot's marine products."""
    root = tmp_path / "in"
    for name in ("marine_reanalysis", "marine_recent"):
        recent = read_product(spark, snapshot, name).where("date_local >= '2026-08-01'")
        recent.coalesce(1).write.parquet(f"{root}/data/{name}/first")
    return str(root)


def run(spark, root, store, **options):
    ingest_domain(spark, root, "marine", store, **options).awaitTermination()


def test_stream_equals_batch_and_late_snapshots_win(spark, bundle, drop_zone, tmp_path):
    store = PanelStore(str(tmp_path / "store"))
    run(spark, drop_zone, store, files_per_batch=1)
    batch = best_records(past_products(bundle, "marine", True, "2027-01-01").where("date_local >= '2026-08-01'"))
    assert rows(store.read_best(spark), *COLUMNS) == rows(batch, *COLUMNS)
    assert store.read_repeats(spark).isEmpty()

    late = read_product(spark, drop_zone, "marine_reanalysis").where("date_local = '2026-08-15'")
    late = late.withColumns({"snapshot_id": F.lit("2026-10-08"), "wave_height_max": F.col("wave_height_max") + 1})
    late.coalesce(1).write.parquet(f"{drop_zone}/data/marine_reanalysis/late")
    run(spark, drop_zone, store)
    best = store.read_best(spark)
    assert best.count() == batch.count()
    changed = best.where("date_local = '2026-08-15'")
    assert changed.where("snapshot_id <> '2026-10-08'").isEmpty() and changed.count() == 16
    assert best.where("date_local = '2026-08-16' and snapshot_id <> 'historical'").isEmpty()


def test_repeated_batch_changes_nothing(spark, bundle, tmp_path):
    store = PanelStore(str(tmp_path / "store"))
    typed = bundle.products["marine_recent"]
    store.absorb(typed.where("date_local < '2026-10-06'"), 0)
    store.absorb(typed.where("date_local >= '2026-10-05'"), 1)
    before = rows(store.read_best(spark), *COLUMNS), rows(store.read_repeats(spark), "site_id", "copies", "accepted")
    store.absorb(typed.where("date_local >= '2026-10-05'"), 1)
    assert (rows(store.read_best(spark), *COLUMNS), rows(store.read_repeats(spark), "site_id", "copies", "accepted")) == before
    assert spark.read.parquet(store.raw).count() == 112
    assert [r[1:] for r in before[1]] == [(1, 0)] * 16


@pytest.mark.parametrize("period", ["month", "day"])
def test_batch_of_repeats_only(spark, bundle, tmp_path, period):
    store = PanelStore(str(tmp_path / "store"), period=period)
    typed = bundle.products["marine_recent"]
    store.absorb(typed, 0)
    store.absorb(typed, 1)
    store.absorb(typed.where("site_id = 'galle'").withColumn("snapshot_id", F.lit("2026-10-20")), 2)
    assert spark.read.parquet(store.raw).count() == 119 and store.read_best(spark).count() == 112
    assert store.read_best(spark).where("snapshot_id = '2026-10-20'").count() == 7
    assert store.read_repeats(spark).where("batch = 1 and copies = 1 and accepted = 0").count() == 112
    two = store.read_best(spark, ("2026-10-03", "2026-10-04"))
    assert two.count() == 32
    assert "PartitionFilters: [isnotnull(part" in two._jdf.queryExecution().executedPlan().toString()


def test_repeats_are_listed_and_strict_refuses_them(spark, bundle, tmp_path):
    typed = bundle.products["marine_recent"].where("site_id = 'galle'")
    store = PanelStore(str(tmp_path / "a"))
    store.absorb(typed.unionAll(typed), 0)
    assert rows(store.read_repeats(spark), "copies", "accepted") == [(2, 1)] * 7
    assert store.read_best(spark).count() == 7
    strict = PanelStore(str(tmp_path / "b"), strict=True)
    with pytest.raises(ValueError, match="duplicate"):
        strict.absorb(typed.unionAll(typed), 0)


def test_contract_holds_in_the_stream(spark, drop_zone, tmp_path):
    good = read_product(spark, drop_zone, "marine_recent")
    bad = good.withColumns({"snapshot_id": F.lit("x"), "wave_height_max": F.lit(-1.0)})
    bad.coalesce(1).write.parquet(f"{drop_zone}/data/marine_recent/bad")
    with pytest.raises(Exception, match="V10"):
        run(spark, drop_zone, PanelStore(str(tmp_path / "s1")))
    narrow = str(tmp_path / "narrow")
    good.drop("wave_period_max").coalesce(1).write.parquet(f"{narrow}/data/marine_recent")
    with pytest.raises(Exception, match="wave_period_max"):
        run(spark, narrow, PanelStore(str(tmp_path / "s2")))


def test_stores_give_the_batch_panels(spark, bundle, snapshot, tmp_path):
    def stores(kinds):
        made = []
        for domain in ("weather", "marine"):
            store = PanelStore(str(tmp_path / f"{domain}-{kinds[0]}"))
            ingest_domain(spark, snapshot, domain, store, kinds=kinds).awaitTermination()
            made.append(store)
        return made

    streamed = daily_from_stores(*stores(("reanalysis", "recent")), bundle.sites, bundle.revision, TODAY)
    batch = daily_panel(bundle, True, TODAY).select(streamed.columns)
    assert streamed.exceptAll(batch).isEmpty() and batch.exceptAll(streamed).isEmpty()
    ahead = forecasts_from_stores(*stores(("forecasts",)), bundle.sites, bundle.revision)
    assert ahead.count() == 112 and set(ahead.columns) == set(forecast_panel(bundle).columns)


def scanned(df):
    return {path.split("/store/")[1].split("/")[0] for path in df.inputFiles()}


def test_a_batch_reads_no_archived_rows(spark, bundle, tmp_path):
    store = PanelStore(str(tmp_path / "store"))
    typed = bundle.products["marine_recent"].where("date_local < '2026-10-06'")
    store.absorb(typed, 0)
    state = store.state(spark)
    asked = store.unseen(store.hashed(spark.createDataFrame(typed.limit(5).collect(), typed.schema)), state, sorted(state["best"]))
    assert scanned(asked) == {"keys"}
    index = store.keys_of(spark, state, sorted(state["best"]))
    assert scanned(index) == {"keys"} and set(index.columns) == {"k1", "k2", "part", "batch"}
    assert scanned(store.read_best(spark)) == {"best"}
    # What the archive holds doesn't matter to a later batch.
    for file in (tmp_path / "store" / "raw" / "batch=0").rglob("*.parquet"):
        file.write_bytes(b"not read")
    store.absorb(bundle.products["marine_recent"], 1)
    assert store.read_best(spark).count() == 112 and store.read_repeats(spark).count() == typed.count()


def test_bloom_filters_spare_the_index(spark, bundle, tmp_path):
    """Keys that the index doesn't hold, though within its range, make the scan read no row."""
    store = PanelStore(str(tmp_path / "store"))
    store.absorb(bundle.products["marine_reanalysis"].where("date_local >= '2026-06-01'"), 0)
    state = store.state(spark)
    index = store.keys_of(spark, state, sorted(state["keys"]))
    some = sorted(r.k1 for r in index.collect())
    between = [a + (b - a) // 2 for a, b in zip(some[10:200], some[11:201])]

    def read_rows(values):
        with pushed_lists(spark):
            found = index.where(F.col("k1").isin(*values))
            assert found.count() == len(set(values) & set(some))
            plan = found._jdf.queryExecution().executedPlan()
            found.collect()
            while "Scan" not in plan.nodeName():
                plan = plan.children().apply(0) if plan.children().size() else plan.executedPlan()
            return plan.metrics().apply("numOutputRows").value()

    assert read_rows(some[:5]) >= 5
    assert read_rows(between) < len(some) / 2


def test_jobs_of_a_batch(spark, bundle, tmp_path):
    store = PanelStore(str(tmp_path / "store"))
    typed = bundle.products["marine_recent"].cache()
    typed.count()
    store.absorb(typed.where("date_local < '2026-10-06'"), 0)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("batch", "one batch")
    try:
        store.absorb(typed.where("date_local >= '2026-10-06'"), 1)
        jobs = len(tracker.getJobIdsForGroup("batch"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 20


def test_readers_see_whole_batches_only(spark, bundle, tmp_path, monkeypatch):
    """A batch that dies before its last step leaves the tables as they were, and runs again."""
    store = PanelStore(str(tmp_path / "store"))
    typed = bundle.products["marine_recent"]
    newer = typed.withColumns({"snapshot_id": F.lit("2026-10-20"), "wave_height_max": F.col("wave_height_max") + 1})
    store.absorb(typed, 0)
    before = rows(store.read_best(spark), *COLUMNS)
    opened = store.read_best(spark)
    write = Folder.write

    def lost(folder, name, value):
        if name == "head":
            raise OSError("lost")
        write(folder, name, value)

    monkeypatch.setattr(Folder, "write", lost)
    with pytest.raises(OSError):
        store.absorb(newer, 1)
    assert rows(store.read_best(spark), *COLUMNS) == before and store.read_raw(spark).count() == 112
    monkeypatch.undo()
    store.absorb(newer, 1)
    assert rows(opened, *COLUMNS) == before
    assert store.read_best(spark).where("snapshot_id <> '2026-10-20'").isEmpty() and store.read_raw(spark).count() == 224
    assert store.expire(spark) == 0
    store.absorb(newer.withColumn("snapshot_id", F.lit("2026-10-21")), 2)
    store.absorb(newer.withColumn("snapshot_id", F.lit("2026-10-22")), 3)
    assert store.expire(spark) > 0 and store.read_best(spark).count() == 112


def test_short_key_lists_are_merged(spark, bundle, tmp_path, monkeypatch):
    monkeypatch.setattr("tidepanel.streaming.ingest.KEY_RUNS", 2)
    store = PanelStore(str(tmp_path / "store"))
    typed = bundle.products["marine_recent"]
    for batch in range(4):
        store.absorb(typed.withColumn("snapshot_id", F.lit(f"2026-10-2{batch}")), batch)
    assert max(map(len, store.state(spark)["keys"].values())) <= 2
    store.absorb(typed.withColumn("snapshot_id", F.lit("2026-10-20")), 4)
    assert store.read_raw(spark).count() == 4 * 112 and store.read_repeats(spark).where("accepted = 0").count() == 112


def same(left, right):
    right = right.select(left.columns)
    return left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.fixture
def settled_stores(spark, bundle, tmp_path):
    stores = []
    for domain in ("weather", "marine"):
        store = PanelStore(str(tmp_path / domain))
        store.absorb(past_products(bundle, domain, True, TODAY).where("date_local >= '2026-03-01'"), 0)
        settle(spark, store, 8)
        stores.append(store)
    return stores


def test_settled_stores_are_joined_without_a_shuffle(spark, bundle, settled_stores, monkeypatch):
    panel = daily_from_stores(*settled_stores, bundle.sites, bundle.revision, TODAY)
    assert shuffles(panel) == 0 and "Bucketed: true" in panel._jdf.queryExecution().executedPlan().toString()
    assert same(panel, daily_panel(bundle, True, TODAY, dates=("2026-03-01", TODAY)))
    # Another session doesn't know the tables.
    for store in settled_stores:
        spark.sql(f"drop table {settled_state(spark, store)['name']}")
    again = daily_from_stores(*settled_stores, bundle.sites, bundle.revision, TODAY)
    assert shuffles(again) == 0 and same(again, panel)


def test_what_came_after_settling_is_shuffled_alone(spark, bundle, settled_stores):
    weather, marine = settled_stores
    old = bundle.products["marine_reanalysis"]
    changed = old.where("date_local between '2026-04-10' and '2026-04-12'").withColumns(
        {"snapshot_id": F.lit("2026-10-20"), "wave_height_max": F.col("wave_height_max") + 1}
    )
    # A period that both tables hold, and one that neither does.
    marine.absorb(changed.unionByName(old.where("date_local = '2026-02-03'")), 1)
    panel = daily_from_stores(weather, marine, bundle.sites, bundle.revision, TODAY)
    assert shuffles(panel) == 2
    plain = daily_from_stores(weather, marine, bundle.sites, bundle.revision, TODAY, ("2000-01-01", TODAY))
    assert same(panel, plain) and panel.where("marine_snapshot_id = '2026-10-20'").count() == 48
    assert panel.where("date_local = '2026-02-03' and domain_match = 'right_only'").count() == 16
    settle(spark, marine, 8)
    assert expire_settled(spark, marine) == 1
    whole = daily_from_stores(weather, marine, bundle.sites, bundle.revision, TODAY)
    assert same(whole, plain)


def test_unequal_tables_are_joined_as_before(spark, bundle, settled_stores, tmp_path):
    weather, marine = settled_stores
    expected = daily_panel(bundle, True, TODAY, dates=("2026-03-01", TODAY))
    settle(spark, marine, 4)
    assert same(daily_from_stores(weather, marine, bundle.sites, bundle.revision, TODAY), expected)
    with pytest.raises(FileNotFoundError):
        settle(spark, PanelStore(str(tmp_path / "empty")), 8)
