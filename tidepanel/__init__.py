"""Daily multi-source panel analytics on PySpark."""

from tidepanel.contracts.validate import (
    ContractError,
    cardinality_report,
    enforce,
    product_report,
    profiles_report,
    records_report,
    registry_report,
    validate_product,
    validate_profiles,
    validate_records,
    validate_registry,
)
from tidepanel.functions.status import indicator_status, status_color
from tidepanel.operators.coverage import coverage_by_year, coverage_rollup, coverage_table
from tidepanel.operators.explore import explore, page, page_count
from tidepanel.operators.joins import inner_loader, join_domains, on_passing_days
from tidepanel.operators.records import monthly_catch, seasonal_catch, species_share
from tidepanel.operators.select import best_records, latest_vintage
from tidepanel.operators.timeline import combined_timeline, map_status, metric_series, site_day_cards
from tidepanel.plans.panel import daily_panel, forecast_panel, timeline, view
from tidepanel.session import build_session
from tidepanel.sinks.export import export, write_panel
from tidepanel.sources.bundle import Bundle, assemble, load_manifest, load_snapshot

