"""Contracts: a lazy violation report, a strict check, and the typed frame."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.contracts import rules as R
from tidepanel.functions.values import blank_to_null, day, number
from tidepanel.specs import (
    CONFIGURED_SITES,
    DAY,
    OCEAN_VARIABLES,
    PROFILE_COLUMNS,
    SITE,
    VARIABLES,
    ProductSpec,
)

Known = DataFrame | Sequence[str]

# Rule meanings, in the order in which a strict check reports them.
RULE_TEXT = {
    "V1": "required columns are missing",
    "V2": "null in the raw key",
    "V3": "date is not a whole calendar day written yyyy-MM-dd",
    "V4": "unknown site",
    "V5": "unexpected model",
    "V6": "duplicate raw keys",
    "V7": "text that is not a number",
    "V8": "infinite value",
    "V9": "direction outside 0 to 360",
    "V10": "negative amount",
    "V11": "temperature outside -90 to 60",
    "V12": "humidity outside 0 to 100",
    "V13": "hours outside 0 to 24",
    "V14": "pressure outside 800 to 1100",
    "V15": "temperatures are not min <= mean <= max",
    "V16": "registry columns are missing",
    "V17": "registry sites are not exactly the configured ones",
    "V18": "coordinate is not a finite number",
    "V19": "coordinate outside the sampling region",
    "V20": "a reanalysis product is absent or empty",
    "V21": "record columns are missing",
    "V22": "required record value is empty",
    "V23": "too many records",
    "V24": "unknown harbour",
    "V25": "record date is not a calendar day written yyyy-MM-dd",
    "V26": "duplicate record keys",
    "V27": "no supported ocean variable",
    "V28": "record value is not a finite non-negative number",
    "V29": "sea surface temperature outside -5 to 45",
    "V30": "unknown fish category",
    "V31": "missing catch weight is not zero catch",
    "V32": "unknown measurement kind",
    "V33": "profile columns or values are missing",
    "V34": "profiles are not unique or too many",
    "V35": "export is over its row limit",
    "V-J": "join side has duplicate keys",
    "S2": "pinned revision is not what was committed",
}
_ORDER = {code: position for position, code in enumerate(RULE_TEXT)}


class ContractError(ValueError):
    """A dataset broke a rule; ``code`` names it."""

    def __init__(self, dataset: str, code: str, detail: str) -> None:
        super().__init__(f"{dataset}: {RULE_TEXT[code]} ({code}; {detail})")
        self.dataset, self.code = dataset, code


def union_reports(parts: Sequence[DataFrame]) -> DataFrame:
    """Several reports as one, so that one action runs their scans side by side."""
    return reduce(DataFrame.unionByName, parts)


def enforce(report: DataFrame) -> None:
    """Raise for the first broken rule; the report has one row per rule and column."""
    broken = report.where("violations > 0").collect()
    if broken:
        row = min(broken, key=lambda r: (_ORDER[r["rule"]], r["column"]))
        raise ContractError(row["dataset"], row["rule"], f"{row['column']}: {row['violations']} rows")


def require_columns(df: DataFrame, dataset: str, code: str, needed: Sequence[str]) -> None:
    absent = R.missing_columns(df, needed)
    if absent:
        raise ContractError(dataset, code, ", ".join(absent))


def _row_and_site_parts(
    df: DataFrame, dataset: str, rules: list[R.RowRule], code: str, known: Known
) -> list[DataFrame]:
    """Row rules plus the site rule, which joins their scan when the sites are a short list."""
    if isinstance(known, DataFrame):
        return [
            R.count_row_rules(df, dataset, rules),
            R.count_unknown_sites(df, dataset, code, R.known_frame(df.sparkSession, known)),
        ]
    return [R.count_row_rules(df, dataset, [*rules, R.RowRule(code, SITE, ~F.col(SITE).isin(*known))])]


# -- products ---------------------------------------------------------------------


def product_report(df: DataFrame, spec: ProductSpec, known: Known = CONFIGURED_SITES) -> DataFrame:
    """V2-V15 of a raw product as rows of (dataset, rule, column, violations)."""
    require_columns(df, spec.name, "V1", spec.required)
    keyed = df.withColumn(DAY, day(df, DAY))
    return union_reports(
        [
            *_row_and_site_parts(df, spec.name, R.product_rules(df, spec), "V4", known),
            R.count_duplicates(keyed, spec.name, "V6", spec.raw_key),
        ]
    )


def row_report(df: DataFrame, spec: ProductSpec, known: Known = CONFIGURED_SITES) -> DataFrame:
    """The product contract without raw-key uniqueness, which a stream checks across batches."""
    return union_reports(_row_and_site_parts(df, spec.name, R.product_rules(df, spec), "V4", known))


def _described(metric: str, column):
    name, unit = VARIABLES.get(metric, (metric, ""))
    return column.alias(metric, metadata={"description": name, "unit": unit})


def typed_product(df: DataFrame, spec: ProductSpec, synthetic: bool = False) -> DataFrame:
    """Typed product with ``complete_core``, ``product`` and ``is_synthetic``."""
    require_columns(df, spec.name, "V1", spec.required)
    typed = df.select(
        *[
            day(df, c).alias(c) if c == DAY else _described(c, number(c)) if c in spec.metrics else F.col(c)
            for c in df.columns
        ]
    )
    complete = reduce(lambda a, b: a & b, [F.col(m).isNotNull() for m in spec.metrics])
    return typed.withColumns(
        {
            "complete_core": complete,
            "product": F.lit(spec.name),
            "is_synthetic": F.lit(synthetic),
        }
    )


def validate_product(
    df: DataFrame, spec: ProductSpec, known: Known = CONFIGURED_SITES, synthetic: bool = False
) -> DataFrame:
    """Typed product, or :class:`ContractError` for the first broken rule."""
    enforce(product_report(df, spec, known))
    return typed_product(df, spec, synthetic)


# -- registry ---------------------------------------------------------------------

REGISTRY_REQUIRED = (SITE, "name", *R.COORDINATES)


def registry_report(sites: DataFrame, known: Known = CONFIGURED_SITES) -> DataFrame:
    """V17-V19: unknown, duplicate or absent sites, and coordinates."""
    require_columns(sites, "sites", "V16", REGISTRY_REQUIRED)
    configured = R.known_frame(sites.sparkSession, known)
    return union_reports(
        [
            R.count_duplicates(sites, "sites", "V17", [SITE]).withColumn("column", F.lit("duplicate site_id")),
            R.count_unknown_sites(sites, "sites", "V17", configured).withColumn("column", F.lit("unknown site_id")),
            R.count_missing_sites(sites, "sites", "V17", configured).withColumn("column", F.lit("absent site_id")),
            R.count_row_rules(sites, "sites", R.registry_rules()),
        ]
    )


def typed_registry(sites: DataFrame) -> DataFrame:
    require_columns(sites, "sites", "V16", REGISTRY_REQUIRED)
    return sites.withColumns({name: number(name) for name in R.COORDINATES})


def validate_registry(sites: DataFrame, known: Known = CONFIGURED_SITES) -> DataFrame:
    enforce(registry_report(sites, known))
    return typed_registry(sites)


# -- optional records -------------------------------------------------------------


def records_report(
    df: DataFrame, kind: str, known: Known = CONFIGURED_SITES, limit: int | None = None
) -> DataFrame:
    """V21-V32 of catch or ocean records; ``limit=None`` lifts the row limit."""
    if kind == "catch":
        require_columns(df, kind, "V21", R.CATCH_REQUIRED)
        rules, keys = R.catch_rules(df), [SITE, DAY, "species"]
    elif kind == "ocean":
        require_columns(df, kind, "V21", R.OCEAN_REQUIRED)
        if not set(OCEAN_VARIABLES) & set(df.columns):
            raise ContractError(kind, "V27", ", ".join(OCEAN_VARIABLES))
        rules, keys = R.ocean_rules(df), [SITE, DAY]
    else:
        raise ValueError(f"unknown record kind {kind!r}")
    parts = [
        *_row_and_site_parts(df, kind, rules, "V24", known),
        R.count_duplicates(df.withColumn(DAY, day(df, DAY)), kind, "V26", keys),
        R.count_over_limit(df, kind, "V23", limit),
    ]
    return union_reports(parts)


def validate_records(
    df: DataFrame, kind: str, known: Known = CONFIGURED_SITES, limit: int | None = None
) -> DataFrame:
    """Typed catch or ocean records at their own grain."""
    raw = blank_to_null(df)
    enforce(records_report(raw, kind, known, limit))
    numeric = ["catch_weight_kg"] if kind == "catch" else [v for v in OCEAN_VARIABLES if v in raw.columns]
    typed = [
        day(raw, c).alias(c) if c == DAY else _described(c, number(c)) if c in numeric else F.col(c)
        for c in raw.columns
        if c != "is_synthetic"
    ]
    return raw.select(*typed, F.lit(False).alias("is_synthetic"))


def profiles_report(df: DataFrame, limit: int | None = None) -> DataFrame:
    """V33-V34 of a species catalogue."""
    require_columns(df, "profiles", "V33", PROFILE_COLUMNS)
    parts = [
        R.count_row_rules(df, "profiles", R.profile_rules()),
        R.count_duplicates(df, "profiles", "V34", ["species"]),
        R.count_over_limit(df, "profiles", "V34", limit),
    ]
    return union_reports(parts)


def validate_profiles(df: DataFrame, limit: int | None = None) -> DataFrame:
    raw = blank_to_null(df)
    enforce(profiles_report(raw, limit))
    return raw


# -- joins ------------------------------------------------------------------------


def cardinality_report(
    left: DataFrame, right: DataFrame, keys: Sequence[str], kind: str = "one_to_one"
) -> DataFrame:
    """Duplicate keys on the sides that ``one_to_one`` or ``many_to_one`` forbids."""
    if kind not in ("one_to_one", "many_to_one"):
        raise ValueError(f"unknown cardinality {kind!r}")
    parts = [R.count_duplicates(right, "right", "V-J", keys)]
    if kind == "one_to_one":
        parts.insert(0, R.count_duplicates(left, "left", "V-J", keys))
    return union_reports(parts)

