"""User-level calls (dashboard load, drill-down, exports, filter lookups) composed from the operators."""

from ..operators.lookups import companies, salespersons, teams
from .dashboard import (
    dashboard_summary, download_drilldown, download_excel, get_dashboard_data, get_drilldown_data,
    materialized_bundle,
)

__all__ = ["companies", "dashboard_summary", "download_drilldown", "download_excel", "get_dashboard_data",
           "get_drilldown_data", "materialized_bundle", "salespersons", "teams"]
