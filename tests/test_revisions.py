"""Pinned revisions, footers read in tasks, as-of joins."""

import datetime as dt
import shutil
import uuid
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from conftest import rows
from tidepanel import ContractError
from tidepanel.operators.asof import as_of_join
from tidepanel.sources import scans
from tidepanel.sources.revisions import commit_revision, load_revision, read_revision, revision_faults, revision_files, revisions
from tidepanel.sources.scans import read_product, schemas_of


@pytest.fixture
def copied(snapshot, tmp_path):
    shutil.copytree(snapshot, tmp_path / "snap +ü")
    return tmp_path / "snap +ü"


def test_a_revision_stays_as_it_was_committed(spark, copied):
    root = str(copied)
    files = commit_revision(spark, root, "r1").collect()
    shards = [f for f in files if f.path.endswith(".parquet")]
    assert {f.path for f in files} == {str(p.relative_to(copied)) for p in copied.rglob("*.parquet") if "revisions" not in p.parts} | {"metadata/sites.csv"}
    assert sum(f.rows for f in shards) == sum(spark.read.parquet(str(d)).count() for d in (copied / "data").iterdir())
    first = load_revision(spark, root, "r1")
    days = first.products["weather_recent"].count()
    more = read_product(spark, root, "weather_recent").withColumn("snapshot_id", F.lit("2026-10-20"))
    more.write.parquet(f"{root}/data/weather_recent/later")
    commit_revision(spark, root, "r2")
    assert revisions(spark, root) == ["r1", "r2"]
    assert load_revision(spark, root, "r1").products["weather_recent"].count() == days
    assert load_revision(spark, root, "r2").products["weather_recent"].count() == 2 * days
    for taken in ("r1", "../x", ""):
        with pytest.raises(ContractError):
            commit_revision(spark, root, taken)
    with pytest.raises(ContractError):
        revision_files(spark, root, "r3")


def test_changed_and_lost_shards_are_refused(spark, copied):
    root = str(copied)
    commit_revision(spark, root, "r1")
    shards = sorted((copied / "data").rglob("*.parquet"))
    one, two = shards[0], shards[-1]
    data = bytearray(one.read_bytes())
    data[10] ^= 1
    one.write_bytes(data)
    two.unlink()
    for crc in (one.with_name(f".{one.name}.crc"),):
        crc.unlink(missing_ok=True)
    assert rows(revision_faults(spark, root, "r1")) == sorted([(str(one.relative_to(copied)), "digest"), (str(two.relative_to(copied)), "lost")])
    assert rows(revision_faults(spark, root, "r1", digests=False)) == [(str(two.relative_to(copied)), "lost")]
    with pytest.raises(ContractError, match="lost"):
        read_revision(spark, root, "r1")
    one.write_bytes(bytes(data) + b"x")
    assert rows(revision_faults(spark, root, "r1", digests=False))[0][1] == "size"


def jobs_of(spark, work):
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "counted")
    try:
        result = work()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)), result
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_footers_cost_the_same_jobs_for_any_number_of_files(spark, snapshot, tmp_path):
    whole = read_product(spark, snapshot, "marine_recent")
    text = whole.withColumn("wave_period_max", F.col("wave_period_max").cast("string"))
    costs = []
    for n in (2, 9):
        root = f"{tmp_path}/{n}/data/marine_recent"
        whole.repartition(n).write.parquet(f"{root}/a")
        text.repartition(n).write.parquet(f"{root}/b")
        jobs, groups = jobs_of(spark, lambda: schemas_of(spark, root))
        assert sorted(map(len, groups.values())) == [n, n]
        costs.append(jobs)
    assert costs[0] == costs[1] <= 2


def test_ends_of_files_tell_the_same_schemas(spark, snapshot):
    """Where tasks can't open a store, Spark reads the files and hands over their ends."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{snapshot}/data")
    ends = files.select("path", scans._tail().alias("tail"))
    assert ends.where("length(tail) > 100000").isEmpty()
    found = ends.mapInArrow(scans._footers, "path string, schema string").collect()
    assert {r.schema for r in found} == set(schemas_of(spark, f"{snapshot}/data"))
    lost = ends.limit(3).select(F.concat(F.lit("nowhere:"), "path").alias("path"), F.lit(None).cast("binary").alias("tail"))
    assert [r.schema for r in lost.mapInArrow(scans._footers, "path string, schema string").collect()] == [None] * 3


def test_as_of_join_against_a_loop(spark):
    import random

    draw = random.Random(3)
    label = lambda day: draw.choice(["historical", f"2020-01-{day:02d}", f"2020-01-{day:02d} 06:00:00", f"2020-01-{day:02d}T06:00:00Z"])
    issued = [(draw.choice(["a", "b", "hot", None]), dt.date(2020, 2, draw.randint(1, 2)), label(draw.randint(1, 28)), i, f"k{i % 5}") for i in range(300)]
    issued += [("hot", dt.date(2020, 2, 1), f"2020-01-{d:02d}", 1000 + d, "x") for d in range(1, 29)] * 3
    asked = [(draw.choice(["a", "b", "hot", "none", None]), dt.date(2020, 2, draw.randint(1, 2)), draw.choice([None, dt.datetime(2020, 1, draw.randint(1, 28), draw.choice([0, 6]))]), i) for i in range(200)]
    asked += asked[:20]
    vintages = spark.createDataFrame(issued, "site_id string, date_local date, forecast_vintage string, value int, tie string")
    requests = spark.createDataFrame(asked, "site_id string, date_local date, origin timestamp, id int")

    def instant(text):
        try:
            return dt.datetime.fromisoformat(text.replace("Z", ""))
        except ValueError:
            return None

    want = []
    for site, day, origin, i in asked:
        known = [(instant(v), v, tie, value) for s, d, v, value, tie in issued if s == site and s is not None and d == day and origin and instant(v) and instant(v) <= origin]
        best = max(known, key=lambda k: k[:3] + (k[3],)) if known else None
        want.append((str(site), day, str(origin), i, *((best[1], best[3], best[2]) if best else (None, None, None))))
    for days in (1, 5, 400):
        got = as_of_join(requests, vintages, tie_breakers=("tie", "value"), slice_days=days)
        assert got.columns == ["site_id", "date_local", "origin", "id", "forecast_vintage", "value", "tie"]
        assert sorted(map(repr, [(str(r[0]), r[1], str(r[2]), *r[3:]) for r in got.collect()])) == sorted(map(repr, want))
    plan = as_of_join(requests, vintages, tie_breakers=("tie",))._jdf.queryExecution().toString()
    assert "Join" not in plan
    assert as_of_join(requests.limit(0), vintages).count() == 0 and as_of_join(requests, vintages.limit(0)).where("value is not null").count() == 0


def test_written_schemas_are_sparks_own(spark, snapshot):
    groups = schemas_of(spark, f"{snapshot}/data/weather_recent")
    file = next(Path(snapshot, "data", "weather_recent").rglob("*.parquet"))
    assert len(groups) == 1 and b"row.metadata" in b"".join(pq.read_schema(file).metadata)
