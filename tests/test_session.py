"""Scratch folders, and the adaptive plan under a hot key."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tidepanel.operators.joins import on_passing_days
from tidepanel.operators.select import best_records
from tidepanel.session import scratch_path, scratch_root


def fake(master, folder=None):
    conf = SimpleNamespace(get=lambda key, default=None: folder or default)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))


def test_scratch_folder_comes_from_the_session(spark):
    assert scratch_root(fake("yarn", "hdfs://shared/scratch/")) == "hdfs://shared/scratch"
    with pytest.raises(RuntimeError):
        scratch_root(fake("yarn"))
    assert scratch_root(fake("local[2]")) == scratch_root(fake("local[4]"))
    assert scratch_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


@pytest.fixture
def small_partitions(spark):
    """Thresholds shrunk so that a test-sized hot key counts as skew."""
    wanted = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20kb",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20kb",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1kb",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def hot_catch(spark, rows=60_000):
    """Catch records of which two thirds lie on one site-day."""
    hot = F.col("id") % 3 != 0
    return spark.range(0, rows, 1, 8).select(
        F.when(hot, "galle").otherwise(F.concat(F.lit("s"), F.col("id") % 400)).alias("site_id"),
        F.when(hot, F.lit("2026-01-01")).otherwise("2026-01-02").cast("date").alias("date_local"),
        F.concat(F.lit("species "), "id").alias("species"),
        F.lit(1.0).alias("catch_weight_kg"),
    )


def test_a_hot_site_day_is_split_in_the_catch_join(spark, small_partitions):
    catch = hot_catch(spark)
    passing = catch.select("site_id", "date_local").where("site_id <> 's3'").distinct()
    kept = on_passing_days(catch, passing)
    total = kept.agg(F.sum("catch_weight_kg")).first()[0]
    assert total == catch.where("site_id <> 's3'").count()
    kept.write.format("noop").mode("overwrite").save()
    rows = kept.collect()
    assert len(rows) == total
    assert "skew=true" in kept._jdf.queryExecution().executedPlan().toString()


def test_a_hot_site_day_sends_one_row_per_task_to_the_selection(spark, weather_rows):
    df = spark.range(0, 40_000, 1, 8).select(
        F.concat(F.lit("galle"), F.col("id") % 1).alias("site_id"),
        F.date_add(F.lit("2026-01-01").cast("date"), (F.col("id") % 1).cast("int")).alias("date_local"),
        F.lit("weather_reanalysis").alias("product"),
        F.concat(F.lit("run-"), F.format_string("%06d", "id")).alias("snapshot_id"),
        F.lit(True).alias("complete_core"),
    )
    best = best_records(df)
    assert [r["snapshot_id"] for r in best.collect()] == ["run-039999"]
    plan = best._jdf.queryExecution().executedPlan()
    text = plan.toString()
    assert "Partial" in text and text.index("Final") < text.index("Partial")
