"""Registered queries: every operator over the driver's whole tables.

Days leave as ISO text, so both engines hand over the same values.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidepanel.contracts import guarded
from tidepanel.contracts import validate as C
from tidepanel.functions.status import ELEVATED, HIGHER, indicator_status
from tidepanel.operators import coverage as cov
from tidepanel.operators import explore as ex
from tidepanel.operators import joins, records, select
from tidepanel.operators import timeline as tl
from tidepanel.operators.asof import as_of_join
from tidepanel.operators.pages import index_pages
from tidepanel.plans.panel import VIEWS, daily_from_stores, export_view, publish, view
from tidepanel.session import pin_utc, scratch_path
from tidepanel.sinks.export import export
from tidepanel.sources.bundle import Bundle, load_snapshot
from tidepanel.sources.footers import snapshot_bounds, snapshot_figures as figures_of
from tidepanel.sources.revisions import commit_revision, read_revision, revision_files, revisions
from tidepanel.sources.scans import read_manifest, read_product, read_records, read_registry, read_routed
from tidepanel.specs import DAY, PANEL_KEY, RAW_KEY, SITE, SNAPSHOT, VINTAGE
from tidepanel.streaming.ingest import PanelStore, ingest_domain, shard_stream, stream_into
from tidepanel.streaming.settled import settle
from workload import adapters as a

Query = Callable[[SparkSession, str], DataFrame]
REGISTERED: dict[str, Query] = {}

# Display limits and dates used by queries and their SQL partners.
EVENT_LIMIT = 10.0
AS_OF = dt.date(2000, 1, 1)
EVENT_START, EVENT_END = dt.date(2024, 1, 1), dt.date(2024, 1, 30)
EXPLORED_SITES = (3, 7, 12, 18, 24)
SETTLED_BUCKETS = 16
COVER_START, COVER_END = dt.date(1995, 3, 15), dt.date(2001, 12, 31)


def registered(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        pin_utc(spark)
        return iso(query(spark, sf_dir))

    run.__name__, run.__doc__ = query.__name__, query.__doc__
    REGISTERED[query.__name__] = run
    return run


def iso(df: DataFrame) -> DataFrame:
    """Days as ``yyyy-MM-dd`` text."""
    return df.select(
        *[F.col(f.name).cast("string").alias(f.name) if isinstance(f.dataType, T.DateType) else F.col(f.name) for f in df.schema]
    )


def best_weather(spark, sf_dir, **keys) -> DataFrame:
    return select.best_records(select.on_keys(a.weather_raw(spark, sf_dir), **keys), a.TIE)


def best_marine(spark, sf_dir, **keys) -> DataFrame:
    return select.best_records(select.on_keys(a.marine_raw(spark, sf_dir), **keys), a.TIE)


def daily(spark, sf_dir, registry: DataFrame | None = None, **keys) -> DataFrame:
    """Daily table; ``sites`` and ``dates`` filter both domains before selection."""
    domains = [best(spark, sf_dir, **keys) for best in (best_weather, best_marine)]
    return joins.join_domains(*domains, registry, "driver")


def reanalysis_only_of(raw: DataFrame) -> DataFrame:
    past = select.before(raw.where(F.col("product").endswith("reanalysis")), AS_OF)
    return select.best_records(past, a.TIE)


DAILY_COLUMNS = (
    *PANEL_KEY,
    "domain_match",
    "weather_record_key",
    "marine_record_key",
    "weather_product",
    "marine_product",
    "weather_complete",
    "marine_complete",
    "complete_pair",
    "precipitation_sum",
    "wind_speed_10m_max",
    "wave_height_max",
    "source_kind",
    "is_synthetic",
)


# -- selection ----------------------------------------------------------------------


@registered
def best_record_weather(spark, sf_dir):
    columns = [*PANEL_KEY, "product", SNAPSHOT, "complete_core", "precipitation_sum", "wind_speed_10m_max", "record_key"]
    return best_weather(spark, sf_dir).select(*columns)


@registered
def best_record_marine(spark, sf_dir):
    return best_marine(spark, sf_dir).select(*PANEL_KEY, "product", "complete_core", "wave_height_max", "record_key")


@registered
def reanalysis_only(spark, sf_dir):
    return reanalysis_only_of(a.weather_raw(spark, sf_dir)).select(*PANEL_KEY, SNAPSHOT, "complete_core", "record_key")


@registered
def latest_vintage(spark, sf_dir):
    return select.latest_vintage(a.event_forecasts(spark, sf_dir))


@registered
def asof_vintage(spark, sf_dir):
    """Latest dated snapshot that had been issued by the middle of 2020."""
    raw = a.weather_raw(spark, sf_dir).withColumnRenamed(SNAPSHOT, VINTAGE)
    known = select.known_at(raw, F.lit("2020-06-15").cast("timestamp"))
    chosen = select.latest_vintage(known, parse=True, tie_breakers=a.TIE)
    return chosen.select(*PANEL_KEY, VINTAGE, "precipitation_sum", "record_key")


@registered
def asof_origins(spark, sf_dir):
    """Every order's day is an origin: the latest dated snapshot of its nation's weather on that day, of those issued by the same day of 2020."""
    customer = a.table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias(SITE))
    orders = a.table(spark, sf_dir, "orders")
    asked = orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        SITE, F.col("o_orderdate").cast("date").alias(DAY), "o_orderkey",
        F.make_date(F.lit(2020), F.month("o_orderdate"), F.least(F.dayofmonth("o_orderdate"), F.lit(28))).cast("timestamp").alias("origin"),
    )
    raw = a.weather_raw(spark, sf_dir).withColumnRenamed(SNAPSHOT, VINTAGE).select(*PANEL_KEY, VINTAGE, "precipitation_sum", "record_key")
    found = as_of_join(asked, raw, tie_breakers=a.TIE)
    return found.select("o_orderkey", SITE, DAY, F.col("origin").cast("date").alias("origin"), VINTAGE, "precipitation_sum", "record_key")


# -- joins --------------------------------------------------------------------------


@registered
def daily_outer_join(spark, sf_dir):
    return daily(spark, sf_dir).select(*DAILY_COLUMNS)


@registered
def registry_enriched(spark, sf_dir):
    return daily(spark, sf_dir, a.nation_sites(spark, sf_dir)).select(*DAILY_COLUMNS, "name", "sector")


@registered
def domain_match_counts(spark, sf_dir):
    return daily(spark, sf_dir).groupBy("domain_match").agg(F.count(F.lit(1)).alias("site_days"))


@registered
def source_kind_mix(spark, sf_dir):
    return daily(spark, sf_dir).groupBy("source_kind", "complete_pair").agg(F.count(F.lit(1)).alias("site_days"))


@registered
def forecast_outer_join(spark, sf_dir):
    joined = joins.join_domains(
        a.event_weather(spark, sf_dir), a.event_marine(spark, sf_dir), a.customer_sites(spark, sf_dir), "driver", forecast=True
    )
    return joined.select(
        *PANEL_KEY, VINTAGE, "domain_match", "wind_speed_10m_max", "wave_height_max", "complete_pair", "source_kind", "name"
    )


@registered
def simple_inner_loader(spark, sf_dir):
    weather = reanalysis_only_of(a.weather_raw(spark, sf_dir)).select(*PANEL_KEY, "model", SNAPSHOT, "precipitation_sum")
    marine = reanalysis_only_of(a.marine_raw(spark, sf_dir)).select(*PANEL_KEY, "model", SNAPSHOT, "wave_height_max")
    registry = a.nation_sites(spark, sf_dir)
    return joins.inner_loader(weather, marine, registry, (SITE, "name", "sector"))


@registered
def dense_calendar(spark, sf_dir):
    filled = joins.fill_calendar(best_marine(spark, sf_dir), a.nation_sites(spark, sf_dir), COVER_START, COVER_END, ["name"])
    return filled.select(*PANEL_KEY, "name", "wave_height_max", F.col("record_key").isNull().alias("gap"))


# -- timeline, map and cards ---------------------------------------------------------


@registered
def combined_timeline(spark, sf_dir):
    history, forecasts = a.event_history(spark, sf_dir), a.event_forecasts(spark, sf_dir)
    return tl.combined_timeline(history, forecasts, history_days=a.event_history_days(spark, sf_dir))


@registered
def timeline_per_site(spark, sf_dir):
    history = a.event_history(spark, sf_dir)
    return tl.combined_timeline(history, a.event_forecasts(spark, sf_dir), per_site=True, min_day="2024-01-18")


@registered
def day_map_status(spark, sf_dir):
    """Every customer's status on every event day."""
    points = tl.map_status(
        a.customer_sites(spark, sf_dir),
        a.event_history(spark, sf_dir),
        a.event_forecasts(spark, sf_dir),
        EVENT_START,
        EVENT_END,
        EVENT_LIMIT,
        EVENT_LIMIT,
        forecast_days=a.event_forecast_days(spark, sf_dir),
    )
    return points.withColumn("color", F.array_join("color", ","))


@registered
def site_day_card(spark, sf_dir):
    return tl.site_day_cards(a.event_history(spark, sf_dir), a.event_forecasts(spark, sf_dir), EVENT_LIMIT, EVENT_LIMIT)


@registered
def ocean_cards(spark, sf_dir):
    """Marine records by customer and day with the ocean record of the same site-day."""
    orders = a.table(spark, sf_dir, "orders")
    cards = orders.groupBy(F.col("o_custkey").alias(SITE), F.col("o_orderdate").cast("date").alias(DAY)).agg(
        F.max("o_orderkey").alias("last_order")
    )
    return tl.with_ocean(cards, a.ocean(spark, sf_dir))


@registered
def series_bridge(spark, sf_dir):
    return tl.metric_series(
        a.event_history(spark, sf_dir),
        a.event_forecasts(spark, sf_dir),
        "wind_speed_10m_max",
        EVENT_START,
        "2024-01-17",
    )


# -- coverage -------------------------------------------------------------------------


def _coverage(spark, sf_dir) -> DataFrame:
    rows = daily(spark, sf_dir, dates=(COVER_START, COVER_END))
    return cov.coverage_by_year(rows, a.nation_sites(spark, sf_dir), COVER_START, COVER_END)


@registered
def coverage_by_year(spark, sf_dir):
    return _coverage(spark, sf_dir)


@registered
def coverage_year_rollup(spark, sf_dir):
    return cov.coverage_rollup(_coverage(spark, sf_dir))


@registered
def coverage_pivot(spark, sf_dir):
    years = range(COVER_START.year, COVER_END.year + 1)
    table = cov.coverage_table(_coverage(spark, sf_dir), years)
    return table.withColumnsRenamed({str(y): f"y{y}" for y in years})


# -- explorer --------------------------------------------------------------------------


@registered
def indicator_mix(spark, sf_dir):
    rows = daily(spark, sf_dir).withColumn("status", indicator_status())
    return rows.groupBy("status", "source_kind").agg(F.count(F.lit(1)).alias("site_days"))


def _explored(spark, sf_dir, sites=range(25)) -> DataFrame:
    keys = {"sites": sites, "dates": ("1996-01-01", "1999-12-31")}
    return ex.explore(daily(spark, sf_dir, **keys), **keys, severity=[HIGHER, ELEVATED])


@registered
def explorer_filter(spark, sf_dir):
    wanted = [*PANEL_KEY, "source_kind", "precipitation_sum", "wind_speed_10m_max", "wave_height_max", "indicator_status", "absent"]
    return ex.choose_columns(_explored(spark, sf_dir, EXPLORED_SITES), wanted)


@registered
def explorer_page(spark, sf_dir):
    return ex.page(daily(spark, sf_dir), 3, 100).select(*PANEL_KEY, "domain_match", "precipitation_sum")


@registered
def explorer_deep_page(spark, sf_dir):
    return ex.page(daily(spark, sf_dir), 21, 250, heap_rows=0).select(*PANEL_KEY, "domain_match", "precipitation_sum")


@registered
def explorer_pages(spark, sf_dir):
    return ex.page_count(_explored(spark, sf_dir), 250)


@registered
def kpis(spark, sf_dir):
    weather, marine = a.weather_raw(spark, sf_dir), a.marine_raw(spark, sf_dir)
    reanalysis = joins.join_domains(reanalysis_only_of(weather), reanalysis_only_of(marine), None, "driver")
    past = select.before(weather.select(DAY).union(marine.select(DAY)), AS_OF)
    return ex.key_figures({"weather": weather, "marine": marine}, reanalysis, a.nation_sites(spark, sf_dir), past)


@registered
def quality_counters(spark, sf_dir):
    return ex.quality_counters(daily(spark, sf_dir))


@registered
def date_bounds(spark, sf_dir):
    days = a.weather_raw(spark, sf_dir).select(DAY).union(a.marine_raw(spark, sf_dir).select(DAY))
    return ex.date_bounds(days)


@registered
def horizons(spark, sf_dir):
    return ex.horizons(a.marine_raw(spark, sf_dir), "2000-03-01")


@registered
def metadata_sheet(spark, sf_dir):
    return ex.registry_sheet(a.supplier_sites(spark, sf_dir))


@registered
def named_site_days(spark, sf_dir):
    counts = a.ocean(spark, sf_dir).groupBy(SITE).agg(F.count(F.lit(1)).alias("days"))
    return ex.named_sites(counts, a.customer_sites(spark, sf_dir)).orderBy("name")


# -- records ------------------------------------------------------------------------------


@registered
def catch_semi(spark, sf_dir):
    return joins.on_passing_days(a.catch(spark, sf_dir), _explored(spark, sf_dir))


@registered
def catch_by_category(spark, sf_dir):
    return ex.in_categories(a.catch(spark, sf_dir), ["small_pelagic", "demersal"])


@registered
def species_share(spark, sf_dir):
    return records.species_share(a.catch(spark, sf_dir), [SITE])


@registered
def monthly_with_gaps(spark, sf_dir):
    """Catches by species and site, with the months that have none."""
    return records.monthly_catch(a.catch(spark, sf_dir), [SITE, "species"])


@registered
def monthly_total(spark, sf_dir):
    return records.monthly_catch(a.catch(spark, sf_dir))


@registered
def seasonal(spark, sf_dir):
    catch = a.catch(spark, sf_dir).withColumn("catch_weight_kg", F.greatest(F.lit(0.0), F.col("catch_weight_kg") - 20))
    return records.seasonal_catch(catch)


@registered
def species_profiles(spark, sf_dir):
    return records.documented_profiles(a.profiles(spark, sf_dir))


@registered
def monthly_totals_flagged(spark, sf_dir):
    return records.monthly_totals(best_weather(spark, sf_dir))


@registered
def circular_mean(spark, sf_dir):
    mean = records.mean_direction(best_weather(spark, sf_dir), "wind_direction_10m_dominant")
    return mean.withColumn("wind_direction_10m_dominant", F.round("wind_direction_10m_dominant", 4))


@registered
def lagged_metric(spark, sf_dir):
    lagged = records.lagged(best_marine(spark, sf_dir), "wave_height_max", [1, 7])
    return lagged.select(*PANEL_KEY, "wave_height_max", "wave_height_max_lag_1", "wave_height_max_lag_7")


# -- contracts ------------------------------------------------------------------------------


@registered
def contract_report(spark, sf_dir):
    return C.product_report(a.dirty_weather(spark, sf_dir), a.DIRTY_SPEC, a.registered_suppliers(spark, sf_dir))


@registered
def typed_product(spark, sf_dir):
    """Completeness after unreadable texts have become missing values."""
    typed = C.typed_product(a.dirty_weather(spark, sf_dir), a.DIRTY_SPEC)
    return typed.groupBy("model", "complete_core", "product", "is_synthetic").agg(
        F.count(F.lit(1)).alias("records"), F.count("precipitation_sum").alias("with_rain"), F.count(DAY).alias("dated")
    )


@registered
def registry_contract(spark, sf_dir):
    return C.registry_report(a.supplier_sites(spark, sf_dir), a.registered_suppliers(spark, sf_dir))


@registered
def catch_contract(spark, sf_dir):
    return C.records_report(a.dirty_catch(spark, sf_dir), "catch", a.registered_suppliers(spark, sf_dir), 5000)


@registered
def ocean_contract(spark, sf_dir):
    return C.records_report(a.dirty_ocean(spark, sf_dir), "ocean", a.registered_customers(spark, sf_dir), 200_000)


@registered
def profile_contract(spark, sf_dir):
    return C.profiles_report(a.profiles(spark, sf_dir), 1000)


@registered
def duplicate_keys(spark, sf_dir):
    return C.cardinality_report(a.weather_raw(spark, sf_dir), a.marine_raw(spark, sf_dir), PANEL_KEY)


# -- sources and sinks ------------------------------------------------------------------------


@registered
def export_roundtrip(spark, sf_dir):
    """The daily table through each format and back."""
    folder = scratch_path(spark, "export")
    panel = f"{folder}/panel"
    daily(spark, sf_dir).select(*DAILY_COLUMNS).write.parquet(panel)
    rows = spark.read.parquet(panel)
    paths = {fmt: export(rows, folder, "daily", fmt) for fmt in ("csv", "json", "parquet")}
    back = {
        "csv": spark.read.option("header", True).csv(paths["csv"]),
        "json": spark.read.schema("date_local string, precipitation_sum double, complete_pair boolean").json(paths["json"]),
        "parquet": spark.read.parquet(paths["parquet"]),
    }
    parts = [
        df.select(
            F.lit(fmt).alias("format"),
            F.col(DAY).cast("string").substr(1, 10).alias("day"),
            F.col("precipitation_sum").cast("double").alias("rain"),
            F.col("complete_pair").cast("boolean").alias("pair"),
        )
        for fmt, df in back.items()
    ]
    return reduce(DataFrame.union, parts).groupBy("format").agg(
        F.count(F.lit(1)).alias("records"),
        F.min("day").alias("first_day"),
        F.max("day").alias("last_day"),
        F.sum("rain").alias("rain"),
        F.count_if("pair").alias("pairs"),
    )


@registered
def records_csv(spark, sf_dir):
    """Catch records written as CSV, read back as text, checked and typed."""
    folder = scratch_path(spark, "records")
    catch = a.catch(spark, sf_dir).withColumns(
        {SITE: F.col(SITE).cast("string"), "source": F.lit("ledger, unit 1"), "source_url": F.lit("https://example.org")}
    )
    back = read_records(spark, export(catch, folder, "catch", "csv", ordered=False))
    known = a.nation_sites(spark, sf_dir).select(F.col(SITE).cast("string").alias(SITE))
    typed = C.validate_records(back, "catch", known, limit=None)
    return typed.groupBy("fish_category", "source", "is_synthetic").agg(
        F.count(F.lit(1)).alias("records"), F.sum("catch_weight_kg").alias("catch_weight_kg"), F.max(DAY).alias("last_day")
    )


@registered
def snapshot_scan(spark, sf_dir):
    """Shards written per product, some without the wind column, some with it as text, read back three ways."""
    root = scratch_path(spark, "snapshot")
    raw = a.weather_raw(spark, sf_dir).drop("product").withColumn("year", F.year(DAY))
    early, late = (raw.where(kind).hint("rebalance", F.col("year")) for kind in ("model = 'era5'", "model <> 'era5'"))
    early.where("year < 1995").write.partitionBy("year").parquet(f"{root}/data/weather_reanalysis/first")
    early.where("year >= 1995").withColumn("wind_speed_10m_max", F.col("wind_speed_10m_max").cast("string")).write.partitionBy("year").parquet(f"{root}/data/weather_reanalysis/third")
    late.drop("wind_speed_10m_max").write.partitionBy("year").parquet(f"{root}/data/weather_reanalysis/second")
    late.write.partitionBy("year").parquet(f"{root}/data/weather_recent")
    names = ("weather_reanalysis", "weather_recent")
    whole = read_routed(spark, root)
    listed = [path[path.index("/data/") + 1 :] for path in whole.inputFiles()]
    readers = {
        "scan": {name: read_product(spark, root, name) for name in names},
        "manifest": read_manifest(spark, [path for path in listed if "/second/" not in path], root),
    }
    parts = [
        df.select(F.lit(reader).alias("reader"), F.lit(name).alias("product"), "wind_speed_10m_max", DAY)
        for reader, products in readers.items()
        for name, df in products.items()
    ]
    parts.append(whole.select(F.lit("path").alias("reader"), "product", "wind_speed_10m_max", DAY))
    return reduce(DataFrame.unionByName, parts).groupBy("reader", "product").agg(
        F.count(F.lit(1)).alias("records"), F.count("wind_speed_10m_max").alias("with_wind"), F.max(DAY).alias("last_day")
    )


@registered
def pinned_revisions(spark, sf_dir):
    """Two revisions of one growing snapshot, each read as it was committed."""
    root = scratch_path(spark, "pinned")
    raw = a.weather_raw(spark, sf_dir).drop("product")
    raw.where("model = 'era5'").write.parquet(f"{root}/data/weather_reanalysis/first")
    commit_revision(spark, root, "r1")
    raw.where("model <> 'era5'").write.parquet(f"{root}/data/weather_reanalysis/second")
    raw.where("model <> 'era5'").write.parquet(f"{root}/data/weather_recent")
    commit_revision(spark, root, "r2")
    parts = []
    for name in revisions(spark, root):
        rows = revision_files(spark, root, name).agg(F.sum("rows")).first()[0]
        for product, df in read_revision(spark, root, name).items():
            parts.append(df.select(F.lit(name).alias("revision"), F.lit(rows).alias("committed_rows"), F.lit(product).alias("product"), "precipitation_sum", DAY))
    return reduce(DataFrame.unionByName, parts).groupBy("revision", "committed_rows", "product").agg(
        F.count(F.lit(1)).alias("records"), F.sum("precipitation_sum").alias("rain"), F.max(DAY).alias("last_day")
    )


# -- bundles ------------------------------------------------------------------------------------


def _written_snapshot(spark, sf_dir) -> str:
    """A snapshot folder: shards of six products and the registry as CSV."""
    root = scratch_path(spark, "bundle")
    for name, df in a.bundle_products(spark, sf_dir).items():
        df.write.parquet(f"{root}/data/{name}")
    a.bundle_sites(spark, sf_dir).repartition(1).write.option("header", True).csv(f"{root}/metadata/sites.csv")
    return root


def _loaded(spark, sf_dir) -> Bundle:
    return load_snapshot(spark, _written_snapshot(spark, sf_dir), "given", known=a.bundle_sites(spark, sf_dir))


@registered
def strict_bundle(spark, sf_dir):
    """A snapshot loaded strictly: every rule holds, products are typed, the registry comes from its CSV."""
    bundle = _loaded(spark, sf_dir)
    facts = [F.count(F.lit(1)).alias("records"), F.count_if("complete_core").alias("complete"), F.count_distinct(SITE).alias("sites")]
    parts = [df.groupBy("product").agg(*facts) for df in bundle.products.values()]
    registry = bundle.sites.agg(F.count(F.lit(1)).alias("records"), F.count("lat_sea").alias("complete"), F.count_distinct(SITE).alias("sites"))
    return reduce(DataFrame.unionByName, [*parts, registry.withColumn("product", F.lit("registry"))])


@registered
def panel_views(spark, sf_dir):
    """The explorer's four products of one bundle."""
    bundle = _loaded(spark, sf_dir)
    parts = []
    for name in VIEWS:
        rows = view(bundle, name, AS_OF)
        facts = [F.count(F.lit(1)).alias("records"), F.count_distinct(*PANEL_KEY).alias("site_days"), F.min(DAY).alias("first_day"), F.max(DAY).alias("last_day")]
        parts.append(rows.agg(*facts).withColumn("view", F.lit(name)))
    return reduce(DataFrame.unionByName, parts)


@registered
def publish_coverage(spark, sf_dir):
    """The published panel's coverage report, read back from its CSV."""
    panel, report = publish(_loaded(spark, sf_dir), scratch_path(spark, "published"), AS_OF, "1993-06-15")
    rows = spark.read.parquet(panel).agg(F.count(F.lit(1))).scalar()
    back = spark.read.option("header", True).csv(report)
    names = [c for c in back.columns if c.endswith("site_id")]
    whole = [F.col(c).cast("long").alias(c) for c in ("year", "expected_days", "available_rows", "weather_days", "marine_days", "paired_days", "missing_pair_days")]
    return back.select(F.col(names[0]).alias(SITE), *whole, F.col("coverage_pct").cast("double").alias("coverage_pct"), rows.alias("panel_rows"))


@registered
def view_export(spark, sf_dir):
    """A whole view exported as one CSV and read back: its name tells that it isn't synthetic, its lines are in key order."""
    bundle = _loaded(spark, sf_dir)
    path = export_view(bundle, "timeline", scratch_path(spark, "whole"), "csv", AS_OF, limit=1_000_000_000)
    lines = spark.read.option("header", True).csv(path)
    site = next(c for c in lines.columns if c.endswith("site_id"))
    # Files are numbered as they follow each other.
    place = lines.select(F.col(site).alias(SITE), DAY, F.col("_metadata.file_name").alias("file"))
    ends = place.groupBy("file").agg(F.min(F.struct(SITE, DAY)).alias("first"), F.max(F.struct(SITE, DAY)).alias("last"), F.count(F.lit(1)).alias("n"))
    gap = ends.withColumn("_before", F.lag("last").over(Window.orderBy("file"))).where("_before >= first")
    return ends.agg(F.sum("n").alias("records"), F.min("first").getField(DAY).alias("first_day"), F.max("last").getField(SITE).alias("last_site")).withColumns(
        {"name": F.lit(path.rsplit("/", 1)[1]), "unordered_files": gap.agg(F.count(F.lit(1))).scalar()}
    )


@registered
def registry_csv(spark, sf_dir):
    """The registry's CSV with texts that mean no value, checked and typed."""
    root = scratch_path(spark, "registry")
    key = F.col(SITE).cast("int")
    texts = a.supplier_sites(spark, sf_dir).withColumn("coastal_sector", F.when(key % 3 == 0, "NA").when(key % 3 == 1, "").otherwise(F.col("coastal_sector")))
    texts.write.option("header", True).csv(root)
    back = read_registry(spark, root)
    report = C.registry_report(back, a.registered_suppliers(spark, sf_dir)).agg(F.sum("violations")).scalar()
    return C.typed_registry(back).select(SITE, "name", "coastal_sector", F.round("lat_land", 6).alias("lat_land"), "lon_sea", report.alias("violations"))


@registered
def snapshot_figures(spark, sf_dir):
    """Shards' rows and ranges of days by product and as a whole, out of their footers."""
    figures = figures_of(spark, _written_snapshot(spark, sf_dir), AS_OF).drop("shards")
    whole = snapshot_bounds(figures).withColumn("product", F.lit("snapshot"))
    return whole.unionByName(figures, allowMissingColumns=True)


# -- rules on the way, states, pages ------------------------------------------------------------


@registered
def checked_write(spark, sf_dir):
    """The contract counted while the product is written; broken rules withhold the commit."""
    done = guarded.checked_write(a.dirty_weather(spark, sf_dir), a.DIRTY_SPEC, scratch_path(spark, "checked"), "weather", a.registered_suppliers(spark, sf_dir))
    return done.report.withColumn("committed", F.lit(done.committed))


@registered
def coverage_from_states(spark, sf_dir):
    """Coverage out of the merged bitmaps of two overlapping deliveries."""
    rows = daily(spark, sf_dir, dates=(COVER_START, COVER_END))
    halves = [cov.coverage_state(rows.where(part)) for part in ("month(date_local) <= 7", "month(date_local) >= 6")]
    return cov.coverage_from_state(cov.merged_states(*halves), a.nation_sites(spark, sf_dir), COVER_START, COVER_END)


@registered
def explorer_indexed_pages(spark, sf_dir):
    """Two pages out of one index, each row with its place."""
    pages = index_pages(daily(spark, sf_dir).select(*PANEL_KEY, "domain_match", "precipitation_sum"))
    first, size = Window.orderBy(*PANEL_KEY), 250
    parts = [
        pages.page(spark, number, size).withColumns({"page": F.lit(number), "place": F.row_number().over(first)}) for number in (2, 21)
    ]
    return reduce(DataFrame.unionByName, parts).withColumn("pages", F.lit(pages.count(size)).cast("long"))


# -- streaming --------------------------------------------------------------------------------


def _deliver(spark, sf_dir, label: str, **options) -> PanelStore:
    """Weather records arriving in two deliveries, each taken in by its own stream run."""
    root = scratch_path(spark, label)
    raw = a.weather_raw(spark, sf_dir)
    store = PanelStore(f"{root}/store", tie_breakers=a.TIE, **options)
    for delivery in ("precipitation_sum < 26", "precipitation_sum >= 26"):
        raw.where(delivery).write.mode("append").parquet(f"{root}/in")
        shards = shard_stream(spark, f"{root}/in", raw.schema, files_per_batch=10_000)
        stream_into(shards, store, lambda rows: rows.drop("_file")).awaitTermination()
    return store


@registered
def stream_equals_batch(spark, sf_dir):
    """Best records kept up to date by a stream of deliveries."""
    store = _deliver(spark, sf_dir, "stream", raw_key=(*RAW_KEY, "record_key"))
    columns = [*PANEL_KEY, "product", SNAPSHOT, "complete_core", "precipitation_sum", "wind_speed_10m_max", "record_key"]
    return store.read_best(spark).select(*columns)


@registered
def domain_ingest(spark, sf_dir):
    """A domain's shards streamed under their contract into a store, whose best records are read by product."""
    root = _written_snapshot(spark, sf_dir)
    store = PanelStore(f"{root}/store")
    ingest_domain(spark, root, "weather", store, known=a.bundle_sites(spark, sf_dir)).awaitTermination()
    facts = [F.count(F.lit(1)).alias("site_days"), F.count_if("complete_core").alias("complete"), F.min(DAY).alias("first_day"), F.max(DAY).alias("last_day")]
    return store.read_best(spark).groupBy("product", "model").agg(*facts)


@registered
def stream_repeats(spark, sf_dir):
    """Raw keys delivered again: rows accepted and refused over all deliveries."""
    store = _deliver(spark, sf_dir, "repeats")
    refused = store.read_repeats(spark).agg(F.sum(F.col("copies") - F.col("accepted")).alias("refused"))
    accepted = store.read_raw(spark).agg(F.count(F.lit(1)).alias("accepted"))
    return spark.range(1).select(accepted.scalar().alias("accepted"), refused.scalar().alias("refused"))


@registered
def settled_join(spark, sf_dir):
    """Daily table of two bucketed best-record tables and of what was delivered after them."""
    root, stores = scratch_path(spark, "settled"), []
    late = "month(date_local) = 6 and year(date_local) >= 1997"
    for name, raw in (("weather", a.weather_raw(spark, sf_dir)), ("marine", a.marine_raw(spark, sf_dir))):
        store = PanelStore(f"{root}/{name}", raw_key=(*RAW_KEY, "record_key"), tie_breakers=a.TIE)
        store.absorb(raw.where(f"not ({late})"), 0)
        settle(spark, store, SETTLED_BUCKETS)
        store.absorb(raw.where(late), 1)
        stores.append(store)
    return daily_from_stores(*stores, a.nation_sites(spark, sf_dir), "driver", "2100-01-01").select(*DAILY_COLUMNS)
