"""Rules counted while the typed product is written; a broken one withholds the commit."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tidepanel.contracts import rules as R
from tidepanel.contracts.validate import Known, enforce, require_columns, typed_product, union_reports
from tidepanel.sinks.pointer import Folder
from tidepanel.specs import CONFIGURED_SITES, SITE, ProductSpec


@dataclass(frozen=True)
class Checked:
    """What a checked write found, and whether it published anything."""

    report: DataFrame
    path: str
    committed: bool


def checked_write(
    df: DataFrame, spec: ProductSpec, folder: str, name: str, known: Known = CONFIGURED_SITES, synthetic: bool = False
) -> Checked:
    """Type and write a raw product to ``folder/name`` if it breaks no rule.

    The source is read once: V2 to V15 are counted on its rows on their way into a draft.  Uniqueness
    and, for sites in a table, V4 need groups, which read only the key columns of the draft.  The
    draft becomes ``folder/name`` in one step, or is deleted.  An existing ``folder/name`` is refused.
    """
    require_columns(df, spec.name, "V1", spec.required)
    spark = df.sparkSession
    place = Folder(spark, folder)
    if place.exists(name):
        raise FileExistsError(f"{folder}/{name}")
    rules = R.product_rules(df, spec)
    if not isinstance(known, DataFrame):
        rules.append(R.RowRule("V4", SITE, ~F.col(SITE).isin(*known)))
    counts = Observation()
    watched = df.observe(counts, F.count(F.lit(1)).alias("rows"), *[F.count(F.when(rule.violated, 1)).alias(f"_{i}") for i, rule in enumerate(rules)])
    draft = f".draft-{uuid.uuid4().hex}"
    typed = typed_product(watched, spec, synthetic)
    typed.write.parquet(f"{folder}/{draft}")
    written = spark.read.schema(typed.schema).parquet(f"{folder}/{draft}")
    # A plan known to give no row has no counts either.
    found = {} if written.isEmpty() else counts.get
    lines = [(spec.name, rule.code, rule.column, found.get(f"_{i}", 0)) for i, rule in enumerate(rules)]
    parts = [R.count_duplicates(written, spec.name, "V6", spec.raw_key)]
    if isinstance(known, DataFrame):
        parts.append(R.count_unknown_sites(written, spec.name, "V4", R.known_frame(spark, known)))
    lines += [tuple(row) for row in union_reports(parts).collect()]
    report = spark.createDataFrame(lines, R.REPORT_SCHEMA)
    committed = not any(line[3] for line in lines)
    if committed:
        place.move(draft, name)
    else:
        place.delete(draft)
    return Checked(report, f"{folder}/{name}", committed)


def write_product(
    df: DataFrame, spec: ProductSpec, folder: str, name: str, known: Known = CONFIGURED_SITES, synthetic: bool = False
) -> DataFrame:
    """The typed product read back from ``folder/name``, or :class:`ContractError` for the first broken rule."""
    done = checked_write(df, spec, folder, name, known, synthetic)
    enforce(done.report)
    return df.sparkSession.read.schema(typed_product(df, spec, synthetic).schema).parquet(done.path)
