"""From a bundle to the daily panel, the forecast panel and the explorer's views."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.contracts.validate import typed_product
from tidepanel.functions.dates import DayLike, as_day
from tidepanel.operators.coverage import coverage_by_year
from tidepanel.operators.explore import explore
from tidepanel.operators.joins import join_domains
from tidepanel.operators.select import before, best_records, on_keys
from tidepanel.operators.timeline import combined_timeline
from tidepanel.sinks.export import export, export_path, write_panel
from tidepanel.sources.bundle import Bundle
from tidepanel.specs import DAY, PRODUCTS
from tidepanel.streaming.ingest import PanelStore
from tidepanel.streaming.settled import join_settled

Dates = tuple[DayLike, DayLike] | None
VIEWS = ("timeline", "past", "reanalysis", "forecasts")


def past_products(bundle: Bundle, domain: str, include_recent: bool, as_of: DayLike) -> DataFrame:
    """Reanalysis, and on request provisional rows, strictly before ``as_of``."""
    names = [f"{domain}_reanalysis"] + ([f"{domain}_recent"] if include_recent else [])
    frames = [bundle.products[name] for name in names if name in bundle.products]
    return before(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames), as_of)


def history(
    bundle: Bundle,
    domain: str,
    include_recent: bool = False,
    as_of: DayLike = None,
    sites: Iterable | None = None,
    dates: Dates = None,
) -> DataFrame:
    """Best past record per site-day of one domain."""
    return best_records(on_keys(past_products(bundle, domain, include_recent, as_of), sites, dates))


def daily_panel(
    bundle: Bundle,
    include_recent: bool = False,
    as_of: DayLike = None,
    sites: Iterable | None = None,
    dates: Dates = None,
) -> DataFrame:
    """Joined daily table.

    ``sites`` and ``dates`` are applied to both domains before selection and join:
    a key filter on the outer join's result would not reach the scans.
    """
    domains = [history(bundle, d, include_recent, as_of, sites, dates) for d in ("weather", "marine")]
    return join_domains(*domains, bundle.sites, bundle.revision)


def _empty(bundle: Bundle, name: str) -> DataFrame:
    spec = PRODUCTS[name]
    columns = [f"{k} {'date' if k == DAY else 'string'}" for k in spec.raw_key]
    columns += [f"{m} double" for m in spec.metrics]
    return typed_product(bundle.sites.sparkSession.createDataFrame([], ", ".join(columns)), spec)


def forecast_panel(bundle: Bundle, sites: Iterable | None = None, dates: Dates = None) -> DataFrame:
    """Joined forecasts, one row per vintage; empty with the same columns when unpublished."""
    names = ("weather_forecasts", "marine_forecasts")
    published = all(name in bundle.products for name in names)
    frames = [bundle.products[name] if published else _empty(bundle, name) for name in names]
    weather, marine = (on_keys(df, sites, dates) for df in frames)
    return join_domains(weather, marine, bundle.sites, bundle.revision, forecast=True)


def daily_from_stores(
    weather: PanelStore, marine: PanelStore, sites: DataFrame, revision: str, as_of: DayLike = None, dates: Dates = None
) -> DataFrame:
    """Daily panel of two incrementally kept best-record tables; nothing is selected again.

    Stores settled into equal buckets are joined without a shuffle, but for what came since.
    A range of days is read from the stores' periods, which it picks.
    """
    spark = sites.sparkSession
    if dates is None:
        joined = join_settled(spark, weather, marine, sites, revision, lambda df: before(df, as_of))
        if joined is not None:
            return joined
    domains = [before(store.read_best(spark, dates), as_of) for store in (weather, marine)]
    return join_domains(*domains, sites, revision)


def forecasts_from_stores(weather: PanelStore, marine: PanelStore, sites: DataFrame, revision: str) -> DataFrame:
    """Forecast panel of two incrementally kept forecast archives."""
    spark = sites.sparkSession
    return join_domains(weather.read_raw(spark), marine.read_raw(spark), sites, revision, forecast=True)


def history_days(bundle: Bundle, include_recent: bool = True, as_of: DayLike = None) -> DataFrame:
    """Days of the daily panel, read from one raw column: selection and join keep them all."""
    parts = [past_products(bundle, d, include_recent, as_of).select(DAY) for d in ("weather", "marine")]
    return parts[0].union(parts[1]).distinct()


def timeline(bundle: Bundle, as_of: DayLike = None, sites: Iterable | None = None, dates: Dates = None, **options) -> DataFrame:
    """Past panel with provisional rows, followed by the latest forecasts."""
    return combined_timeline(
        daily_panel(bundle, True, as_of, sites, dates),
        forecast_panel(bundle, sites, dates),
        history_days=history_days(bundle, True, as_of),
        **options,
    )


def view(bundle: Bundle, name: str, as_of: DayLike = None, sites: Iterable | None = None, dates: Dates = None) -> DataFrame:
    """One of the explorer's products; only the chosen plan is built.

    An unpublished forecast view is an empty frame with the past panel's columns.
    """
    if name == "timeline":
        return timeline(bundle, as_of, sites, dates)
    if name in ("past", "reanalysis"):
        return daily_panel(bundle, name == "past", as_of, sites, dates)
    if name == "forecasts":
        if {"weather_forecasts", "marine_forecasts"} <= set(bundle.products):
            return forecast_panel(bundle, sites, dates)
        return daily_panel(bundle, True, as_of, sites, dates).where(F.lit(False))
    raise ValueError(f"unknown view {name!r}; choose one of {', '.join(VIEWS)}")


def explorer(
    bundle: Bundle,
    name: str,
    sites: Iterable,
    dates: Dates,
    severity: Iterable[str] | None = None,
    wave_limit: float = 2.0,
    wind_limit: float = 10.0,
    as_of: DayLike = None,
) -> DataFrame:
    """A filtered view: keys are cut before selection, statuses judged on the best records."""
    sites = list(sites)
    cut = view(bundle, name, as_of, sites, dates) if sites else view(bundle, name, as_of)
    return explore(cut, sites, dates, severity, wave_limit, wind_limit)


def coverage(
    bundle: Bundle, start: DayLike, end: DayLike, include_recent: bool = False, as_of: DayLike = None
) -> DataFrame:
    """Coverage of a window, which also bounds what is read of both domains."""
    daily = daily_panel(bundle, include_recent, as_of, dates=(start, end))
    return coverage_by_year(daily, bundle.sites, start, end)


def export_view(bundle: Bundle, name: str, folder: str, fmt: str, as_of: DayLike = None, limit: int | None = None) -> str:
    """A whole view as one export, named by its provenance."""
    return export(view(bundle, name, as_of), folder, name, fmt, synthetic=bundle.is_demo, limit=limit)


def publish(bundle: Bundle, folder: str, as_of: DayLike = None, start: DayLike = "2010-01-01") -> tuple[str, str]:
    """Reanalysis panel as Parquet and its coverage report as CSV, which reads the written panel."""
    panel = export_path(folder, "daily_reanalysis", "parquet", bundle.is_demo)
    write_panel(daily_panel(bundle, as_of=as_of), panel)
    spark = bundle.sites.sparkSession
    end = None if as_of is None else F.date_sub(as_day(as_of), 1)
    report = coverage_by_year(spark.read.parquet(panel), bundle.sites, start, end)
    return panel, export(report, folder, "coverage", "csv", synthetic=bundle.is_demo)
