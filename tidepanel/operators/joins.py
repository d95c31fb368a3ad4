"""Domain joins that keep unmatched rows and the provenance of both sides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.dates import as_day
from tidepanel.operators.dimension import join_dimension, one_per_key
from tidepanel.specs import DAY, FORECAST_KEY, PANEL_KEY, SITE, SNAPSHOT, VINTAGE

PROVENANCE = {
    "model": "model",
    SNAPSHOT: "snapshot_id",
    "product": "product",
    "complete_core": "complete",
    "is_synthetic": "synthetic",
}
REVISION = "hf_revision"


def _side(df: DataFrame, domain: str, keys: Sequence[str], shared: set[str]) -> DataFrame:
    names = {old: f"{domain}_{new}" for old, new in PROVENANCE.items() if old in df.columns and old not in keys}
    names.update({c: f"{domain}_{c}" for c in shared if c not in names})
    return df.withColumnsRenamed(names).withColumn(f"_{domain}", F.lit(True))


def join_domains(
    weather: DataFrame,
    marine: DataFrame,
    sites: DataFrame | None = None,
    revision: str = "unversioned",
    forecast: bool = False,
    domains: tuple[str, str] = ("weather", "marine"),
) -> DataFrame:
    """Full outer join of two domains on site-day (and vintage), enriched by the registry.

    Both sides must be unique on the key, or the query fails: :func:`best_records` makes them so, and the
    contract's raw-key rule does for forecasts.  Columns that both domains have beyond
    the key are prefixed by their domain.
    """
    keys = list(FORECAST_KEY if forecast else PANEL_KEY)
    if forecast:
        weather = weather.withColumnRenamed(SNAPSHOT, VINTAGE)
        marine = marine.withColumnRenamed(SNAPSHOT, VINTAGE)
    shared = (set(weather.columns) & set(marine.columns)) - set(keys)
    left, right = domains
    weather, marine = one_per_key(weather, keys, left), one_per_key(marine, keys, right)
    joined = _side(weather, left, keys, shared).join(_side(marine, right, keys, shared), keys, "full_outer")
    match = (
        F.when(F.col(f"_{left}") & F.col(f"_{right}"), F.lit("both"))
        .when(F.col(f"_{left}"), F.lit("left_only"))
        .otherwise(F.lit("right_only"))
    )
    joined = joined.withColumn("domain_match", match).drop(f"_{left}", f"_{right}")
    if sites is not None:
        joined = join_dimension(joined, sites, SITE)
    flags = [f"{d}_{flag}" for d in domains for flag in ("complete", "synthetic")]
    joined = joined.withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in flags})
    joined = joined.withColumns(
        {
            "complete_pair": F.col(f"{left}_complete") & F.col(f"{right}_complete"),
            "is_synthetic": F.col(f"{left}_synthetic") | F.col(f"{right}_synthetic"),
            REVISION: F.lit(revision),
        }
    )
    return joined.withColumn("source_kind", _source_kind(domains, forecast))


def _source_kind(domains: tuple[str, str], forecast: bool):
    """Synthetic wins, then forecast, then provisional if either side is provisional."""
    kind = F.when(F.col("is_synthetic"), F.lit("synthetic_demo"))
    if forecast:
        return kind.otherwise(F.lit("forecast"))
    recent = [F.col(f"{d}_product").eqNullSafe(F.lit(f"{d}_recent")) for d in domains]
    return kind.when(recent[0] | recent[1], F.lit("provisional_recent")).otherwise(F.lit("reanalysis"))


# The registry columns of the simple loader.
LOADER_REGISTRY = (
    SITE,
    "name",
    "admin_district",
    "fisheries_district",
    "coastal_sector",
    "lat_land",
    "lon_land",
    "lat_sea",
    "lon_sea",
)


def inner_loader(
    weather: DataFrame, marine: DataFrame, sites: DataFrame, registry: Sequence[str] = LOADER_REGISTRY
) -> DataFrame:
    """The simple loader: inner join without marine provenance, plus registry columns.

    Unmatched rows vanish and repeated snapshots multiply, so feed it one record per
    site-day.  Rows of unregistered sites stay.
    """
    plain = marine.drop("model", SNAPSHOT)
    joined = weather.join(plain, list(PANEL_KEY), "inner")
    return join_dimension(joined, sites.select(*[c for c in registry if c in sites.columns]), SITE)


def on_passing_days(records: DataFrame, passing: DataFrame, unrestricted_if_empty: bool = True) -> DataFrame:
    """Records on the site-days of ``passing``; a semi join never repeats a record.

    With ``unrestricted_if_empty`` an empty ``passing`` frame restricts nothing: the
    records' own keys then stand in for the passing ones.  Both sides of the join are
    plain shuffles, so the adaptive plan can split a site-day that owns most records; an
    aggregate of the keys, which would spare the second scan, keeps it from that.
    """
    keys = passing.select(*PANEL_KEY)
    if unrestricted_if_empty:
        keys = keys.union(records.select(*PANEL_KEY).where(~keys.exists()))
    return records.join(keys, list(PANEL_KEY), "left_semi")


def fill_calendar(df: DataFrame, sites: DataFrame, start, end, keep: Sequence[str] = ()) -> DataFrame:
    """A row for every site and day, so absent days stay visible gaps."""
    return calendar(sites, start, end, keep).join(df, list(PANEL_KEY), "left")


def calendar(sites: DataFrame, start, end, keep: Sequence[str] = ()) -> DataFrame:
    """Site-days from ``start`` to ``end``, generated next to each site's row."""
    days = F.when(as_day(start) <= as_day(end), F.sequence(as_day(start), as_day(end)))
    return sites.select(SITE, *keep, F.explode(days).alias(DAY))
