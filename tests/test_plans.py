"""Physical plans: what reaches the scan, how many shuffles, and what never appears."""

import re

import pytest

from conftest import SF, TODAY
from tidepanel import daily_panel
from tidepanel.operators.explore import page
from tidepanel.operators.select import best_records
from tidepanel.plans.panel import history
from workload.queries import REGISTERED


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_daily_panel_needs_one_shuffle_per_domain(bundle):
    text = plan(daily_panel(bundle, True, TODAY))
    assert len(re.findall(r"\bExchange hashpartitioning", text)) == 2
    assert text.count("BroadcastExchange") == 1 and "SortMergeJoin" in text and "FullOuter" in text


def test_selection_cuts_each_task_before_the_shuffle(bundle):
    text = plan(history(bundle, "weather", True, TODAY))
    assert re.search(r"row_number\(\), 1, Final[\s\S]*Exchange[\s\S]*row_number\(\), 1, Partial", text)


def test_key_filters_reach_both_scans(bundle):
    text = plan(daily_panel(bundle, as_of=TODAY, sites=["galle"], dates=("2026-01-01", "2026-02-01")))
    pushed = re.findall(r"PushedFilters: \[([^\]]*)\]", text)
    data = [p for p in pushed if "date_local" in p]
    assert len(data) == 2 and all("EqualTo(site_id,galle)" in p and "GreaterThanOrEqual(date_local,2026-01-01)" in p for p in data)


def test_unused_metrics_are_not_read(bundle):
    text = plan(daily_panel(bundle, as_of=TODAY).select("site_id", "date_local", "wave_height_max"))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert any("wave_height_max" in s for s in schemas) and not any("pressure" in s and "wave_height_max" in s for s in schemas)
    marine = next(s for s in schemas if "wave_height_max" in s)
    assert "site_id" in marine and "model" not in marine


def test_shallow_page_keeps_small_heaps(bundle):
    assert "TakeOrderedAndProject" in plan(page(daily_panel(bundle, as_of=TODAY), 2, 50))


SLOW = {"stream_equals_batch", "stream_repeats", "export_roundtrip", "snapshot_scan", "explorer_deep_page"}


@pytest.mark.parametrize("name", sorted(set(REGISTERED) - SLOW))
def test_no_cross_product_and_no_row_udf(spark, name):
    text = REGISTERED[name](spark, SF)._jdf.queryExecution().toString()
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "Join Cross", "BatchEvalPython", "FlatMapGroups"):
        assert operator not in text


def test_best_records_is_pure_sql(bundle):
    text = plan(best_records(bundle.products["weather_reanalysis"]))
    assert "Python" not in text
