"""The dashboard's user-level calls, composed from the operators.

Each call resolves the clock once and returns lazy DataFrames (or writes
files); nothing is collected to the driver.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame

from ..functions.expressions import as_date
from ..operators.aging import bundle, split_bundle
from ..operators.drilldown import drilldown
from ..operators.filters import Filters
from ..operators.totals import kpi_labels, kpi_summary, kpi_table, report_with_totals
from ..schema import DIMENSION_ORDER
from ..session import scratch_path
from ..sinks import write_drilldown, write_reports
from ..sources.catalog import Catalog


class Reports(dict):
    """The reports by dimension, in label order; ``unordered`` has them without the sort, for totals and KPIs."""

    unordered: dict[str, DataFrame]


def _filters(filters, default_company: int | None = None) -> Filters:
    """Filters of a call; ``default_company`` is the caller's company, used when none is selected."""
    return filters if isinstance(filters, Filters) else Filters.from_mapping(filters, default_company)


def materialized_bundle(cat: Catalog, filters=None, as_of: dt.date | str | None = None,
                        path: str | None = None) -> DataFrame:
    """The stacked four-report bundle, computed once and stored in the shared folder.

    Written as a parquet table below the session's shared checkpoint
    directory (or ``path``) and read back: one job, one fact scan, and the
    lineage is cut, so a lost executor never recomputes the fact scan and
    the four reports, totals and KPIs are cheap reads of it. (A reliable
    ``Dataset.checkpoint`` would compute the plan twice -- once for the
    eager count and once more to write the checkpoint files.)
    """
    spark = cat_spark(cat)
    target = path or scratch_path(spark, "bundle")
    bundle(cat, _filters(filters), as_date(as_of)).write.parquet(target)
    return spark.read.parquet(target)


def get_dashboard_data(cat: Catalog, filters=None, as_of: dt.date | str | None = None,
                       materialize: bool = True, default_company: int | None = None) -> Reports:
    """``{payment_terms, item_category, customer, buyer}`` ageing reports (SNK-1).

    With ``materialize=False`` the four DataFrames share one lazy plan
    (each action would rescan the fact); use that to compose further.
    """
    f, day = _filters(filters, default_company), as_date(as_of)
    stacked = materialized_bundle(cat, f, day) if materialize else bundle(cat, f, day)
    reports = Reports(split_bundle(stacked))
    reports.unordered = split_bundle(stacked, ordered=False)
    return reports


def dashboard_summary(reports: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """KPIs (row, table, card labels) and every report with its totals row."""
    reports = getattr(reports, "unordered", reports)
    kpis = kpi_summary(reports["payment_terms"])
    out = {"kpis": kpis, "kpi_table": kpi_table(kpis), "kpi_labels": kpi_labels(kpis)}
    for d, r in reports.items():
        out[f"{d}_with_totals"] = report_with_totals(r, d)
    return out


def get_drilldown_data(cat: Catalog, filters, group_type: str | None, group_value: str | None,
                       bucket: str | None, as_of: dt.date | str | None = None,
                       null_group: bool = False, default_company: int | None = None) -> DataFrame:
    return drilldown(cat, _filters(filters, default_company), group_type, group_value, bucket, as_of, null_group)


def download_excel(cat: Catalog, filters=None, as_of: dt.date | str | None = None,
                   path: str | None = None, fmt: str = "parquet", default_company: int | None = None) -> str:
    """Export the dashboard (reports with totals, KPI summary); returns the export directory."""
    day = as_date(as_of)
    target = path or scratch_path(cat_spark(cat), "export")
    return write_reports(bundle(cat, _filters(filters, default_company), day), target, day, fmt, dimensions=DIMENSION_ORDER)


def download_drilldown(cat: Catalog, filters, group_type, group_value, bucket,
                       as_of: dt.date | str | None = None, path: str | None = None,
                       fmt: str = "parquet", default_company: int | None = None) -> str:
    detail = drilldown(cat, _filters(filters, default_company), group_type, group_value, bucket, as_of, with_total=True)
    target = path or scratch_path(cat_spark(cat), "drilldown")
    return write_drilldown(detail, target, group_value, bucket, fmt, group_type=group_type)


def cat_spark(cat: Catalog):
    spark = getattr(cat, "spark", None)
    if spark is None:
        from pyspark.sql import SparkSession
        spark = SparkSession.getActiveSession()
    return spark
