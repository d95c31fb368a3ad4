"""Key figures out of footers: no row read, whatever footers can't tell is read."""

import datetime as dt
import shutil
import struct
import types

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from conftest import TODAY
from tidepanel.sources import footers
from tidepanel.sources.footers import shard_ranges, snapshot_bounds, snapshot_figures
from tidepanel.sources.scans import read_snapshot


def by_rows(spark, root, as_of):
    found = {}
    for name, df in read_snapshot(spark, root).items():
        day = F.col("date_local").cast("date")
        found[name] = tuple(df.agg(F.count("*"), F.min(day), F.max(day), F.max(F.when(day < F.lit(as_of), day))).first())
    return found


def by_footers(spark, root, as_of):
    columns = ("raw_records", "first_day", "last_day", "latest_past_day")
    return {r["product"]: tuple(r[c] for c in columns) for r in snapshot_figures(spark, root, as_of).collect()}


@pytest.fixture
def copied(snapshot, tmp_path):
    shutil.copytree(snapshot, tmp_path / "snap ü")
    return tmp_path / "snap ü"


@pytest.mark.parametrize("as_of", [TODAY, dt.date(2025, 3, 3), dt.date(1990, 1, 1)])
def test_figures_equal_those_of_the_rows(spark, copied, as_of):
    assert by_footers(spark, str(copied), as_of) == by_rows(spark, str(copied), as_of)


def test_no_row_is_read(spark, copied):
    """Pages that nobody could decode don't matter while no shard has days on both sides of the limit."""
    limit = dt.date(2100, 1, 1)
    expected = by_rows(spark, str(copied), limit)
    for file in copied.rglob("data/**/*.parquet"):
        data = bytearray(file.read_bytes())
        (length,) = struct.unpack("<I", data[-8:-4])
        data[4 : len(data) - 8 - length] = bytes(len(data) - 12 - length)
        file.write_bytes(data)
        (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
    assert by_footers(spark, str(copied), limit) == expected


def test_shards_whose_footers_do_not_tell(spark, copied):
    folder = copied / "data" / "weather_recent"
    days = [dt.date(2031, 5, 1), dt.date(2001, 2, 3)]
    odd = pa.table({"site_id": ["galle", "galle"], "date_local": pa.array(days, pa.date32())})
    pq.write_table(odd, folder / "bare.parquet", write_statistics=False)
    pq.write_table(odd.set_column(1, "date_local", pa.array(["2032-01-01", "no day"])), folder / "texts.parquet")
    pq.write_table(odd.set_column(1, "date_local", pa.array([None, None], pa.date32())), folder / "nulls.parquet")
    pq.write_table(odd.drop_columns(["date_local"]), folder / "narrow.parquet")
    pq.write_table(odd.slice(0, 0), folder / "empty.parquet")
    known = {r.path.rsplit("/", 1)[1]: (r.rows, r.first, r.known) for r in shard_ranges(spark, str(folder)).collect()}
    assert [known[f"{n}.parquet"] for n in ("bare", "texts", "nulls", "narrow", "empty")] == [
        (2, None, False), (2, None, False), (2, None, True), (2, None, True), (0, None, True)
    ]
    found = by_footers(spark, str(copied), TODAY)["weather_recent"]
    assert found[1:3] == (dt.date(2001, 2, 3), dt.date(2032, 1, 1)) and found[0] == 112 + 8


def test_stores_that_only_spark_knows(spark, copied, monkeypatch):
    expected = by_footers(spark, str(copied), TODAY)
    opened = footers.footer_source

    def refuse(path, tail):
        if tail is None:
            raise OSError(path)
        return opened(path, tail)

    # The function handed to the tasks carries this module's names along.
    ranges = footers._ranges
    monkeypatch.setattr(footers, "_ranges", _by_value(ranges, refuse))
    assert by_footers(spark, str(copied), TODAY) == expected


def _by_value(ranges, refuse):
    names = {**ranges.__globals__, "footer_source": refuse, "__name__": "__main__"}
    made = types.FunctionType(ranges.__code__, names, "ranges")
    made.__module__ = "__main__"
    return made


def test_empty_snapshot_and_bounds(spark, copied, tmp_path):
    (tmp_path / "none" / "data" / "weather_recent").mkdir(parents=True)
    figures = snapshot_figures(spark, str(tmp_path / "none"), TODAY)
    assert figures.isEmpty()
    assert tuple(snapshot_bounds(figures).first()) == (0, None, None, None, None, None)
    whole = snapshot_bounds(snapshot_figures(spark, str(copied), TODAY)).first()
    assert whole.explorer_start == whole.last_day - dt.timedelta(29) and whole.latest_past_day < TODAY
