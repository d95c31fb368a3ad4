"""A bundle: validated lazy products, the registry, and where they came from."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from tidepanel.contracts.validate import (
    ContractError,
    Known,
    enforce,
    product_report,
    registry_report,
    typed_product,
    typed_registry,
    union_reports,
)
from tidepanel.session import pin_utc
from tidepanel.sources.scans import read_manifest, read_registry, read_snapshot
from tidepanel.specs import CONFIGURED_SITES, PRODUCTS, ProductSpec

NEEDED = ("weather_reanalysis", "marine_reanalysis")


def _now() -> str:
    return dt.datetime.now(dt.timezone.utc).isoformat()


@dataclass(frozen=True)
class Bundle:
    products: dict[str, DataFrame]
    sites: DataFrame
    revision: str
    source: str | None = None
    last_modified: str | None = None
    loaded_at_utc: str = field(default_factory=_now)
    is_demo: bool = False
    ocean: DataFrame | None = None
    catch: DataFrame | None = None

    def with_products(self, **products: DataFrame) -> "Bundle":
        return replace(self, products={**self.products, **products})


def assemble(
    products: Mapping[str, DataFrame],
    sites: DataFrame,
    revision: str,
    source: str | None = None,
    last_modified: str | None = None,
    strict: bool = True,
    known: Known = CONFIGURED_SITES,
    specs: Mapping[str, ProductSpec] = PRODUCTS,
    synthetic: bool = False,
    **extra: DataFrame,
) -> Bundle:
    """Validate and type everything; both reanalysis products must hold rows.

    ``strict=False`` only checks the schemas and stays lazy: run the reports of
    :mod:`tidepanel.contracts.validate` alongside when the data was checked at ingest.
    """
    pin_utc(sites.sparkSession)
    if strict:
        for name in NEEDED:
            if name not in products or products[name].isEmpty():
                raise ContractError("bundle", "V20", name)
        reports = [product_report(df, specs[name], known) for name, df in products.items()]
        enforce(union_reports([*reports, registry_report(sites, known)]))
    typed = {name: typed_product(df, specs[name], synthetic) for name, df in products.items()}
    return Bundle(
        products=typed,
        sites=typed_registry(sites),
        revision=revision,
        source=source,
        last_modified=last_modified,
        is_demo=synthetic,
        **extra,
    )


def load_snapshot(
    spark: SparkSession, root: str, revision: str = "local_snapshot", strict: bool = True, known: Known = CONFIGURED_SITES
) -> Bundle:
    """A downloaded snapshot: ``data/<product>/**.parquet`` and ``metadata/sites.csv``."""
    return assemble(
        read_snapshot(spark, root),
        read_registry(spark, f"{root}/metadata/sites.csv"),
        revision,
        source=root,
        strict=strict,
        known=known,
    )


def load_manifest(
    spark: SparkSession, root: str, paths: list[str], revision: str, last_modified: str | None = None, strict: bool = True
) -> Bundle:
    """The listed files of one pinned revision below ``root``."""
    return assemble(
        read_manifest(spark, paths, root),
        read_registry(spark, f"{root}/metadata/sites.csv"),
        revision,
        source=root,
        last_modified=last_modified,
        strict=strict,
    )
