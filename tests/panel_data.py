"""A small panel for tests: plain values by hash, one record per site-day of each product."""

import datetime as dt

from pyspark.sql import functions as F

from tidepanel.sources.bundle import assemble
from tidepanel.specs import PRODUCTS, SNAPSHOT, SPECIES_CATALOGUE


def days_of(kind, today):
    """First and last day that a kind of product covers."""
    if kind == "forecasts":
        return today, today + dt.timedelta(days=6)
    if kind == "recent":
        return today - dt.timedelta(days=7), today - dt.timedelta(days=1)
    return today - dt.timedelta(days=3 * 365 + 1), today - dt.timedelta(days=6)


def metric(name):
    """Between 0 and 3 above a level that keeps every bound and the order of temperatures."""
    level = 1000 if name.startswith("pressure") else 12 if name.endswith("_max") else 4 if name.endswith("_min") else 8
    return (level + F.pmod(F.xxhash64("site_id", "date_local", F.lit(name)), F.lit(300)) / 100).alias(name)


def spread(sites, first, last):
    days = F.explode(F.sequence(F.lit(first), F.lit(last))).alias("date_local")
    return sites.select("site_id", days)


def made_products(sites, today):
    out = {}
    for name, spec in PRODUCTS.items():
        label = today.isoformat() if spec.kind == "forecasts" else "historical"
        metrics = [metric(m) for m in spec.metrics]
        out[name] = spread(sites, *days_of(spec.kind, today)).select("site_id", "date_local", *metrics, F.lit(spec.model).alias("model"), F.lit(label).alias(SNAPSHOT))
    return out


def made_bundle(sites, today, strict=False):
    past = spread(sites, today - dt.timedelta(days=30), today - dt.timedelta(days=1))
    said = {"source": F.lit("made for tests"), "source_url": F.lit("test://made"), "is_synthetic": F.lit(True)}
    species, _, category = SPECIES_CATALOGUE[0]
    catch = past.select("*", F.lit(species).alias("species"), F.lit(category).alias("fish_category"), F.lit(20.5).alias("catch_weight_kg")).withColumns(said)
    ocean = past.select("*", F.lit(28.5).alias("sea_surface_temperature"), F.lit("observation").alias("measurement_kind")).withColumns(said)
    return assemble(made_products(sites, today), sites, "SYNTHETIC_DEMO", source="synthetic", strict=strict, synthetic=True, ocean=ocean, catch=catch)
