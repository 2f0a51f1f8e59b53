"""Totals rows, KPI summary and the column layouts of the reports.

All of these work on the (small) rounded report DataFrames: one row per
label. They never touch the fact table again, so a dashboard load costs
one fact scan however many of them are asked for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import ident, thousands_label
from ..schema import (
    DIMENSION_ORDER, DIMENSIONS, EXPORT_METRIC_COLS, KPI_ROWS, KPI_SOURCES, METRIC_COLS, SCREEN_METRIC_COLS,
    TOTAL_WORD,
)


def _zsum(c: str, alias: str) -> Column:
    """Sum with NULL as 0, and 0 (not NULL) over no rows, as the screen's totals start at 0."""
    return F.expr(f"coalesce(sum(coalesce({ident(c)}, 0)), 0) AS {ident(alias)}")


def totals_row(report: DataFrame, metrics: Sequence[str] = METRIC_COLS) -> DataFrame:
    """One row: the sum of each *rounded* metric column, NULL as 0 (S8, S20)."""
    return report.agg(*[_zsum(c, c) for c in metrics])


def seeded(df: DataFrame, keys: Sequence[str], seeds: Sequence[tuple]) -> DataFrame:
    """``df`` with ``_seed = 0`` plus one marked row (``_seed = 1``, every other column NULL)
    per key tuple in ``seeds``.

    Grouping sets over no rows produce no group at all; a seed makes every
    requested total group exist (with sums of 0) even for an empty input,
    while the detail set drops it again. One literal row per group, no
    second pass over the data.
    """
    spark = df.sparkSession
    out = df.selectExpr("*", "0 AS _seed")
    for values in seeds:
        given = dict(zip(keys, values))
        row = [F.lit(given.get(f.name)).cast(f.dataType).alias(f.name) for f in df.schema.fields]
        # one row, one task
        out = out.unionByName(spark.range(0, 1, 1, 1).select(*row, F.lit(1).alias("_seed")))
    return out


def _with_total_sets(df: DataFrame, keys: list[str], label: str, totals_first: bool,
                     seeds: Sequence[tuple]) -> DataFrame:
    """Rows of ``df`` (unique per ``keys + [label]``) plus one ``Total`` row per ``keys`` group.

    One aggregate over ``GROUPING SETS ((keys, label, _seed), (keys))``: the
    detail sets are the rows themselves (label is unique), the other set
    is the totals row. Rows are told apart by ``grouping_id``, never by a
    NULL label, because NULL is a real group. The report is read once, so
    a totals row never costs a second scan of the fact table; the seed rows
    (see ``seeded``) make the totals exist, as zeros, for empty reports.
    """
    df = seeded(df, keys, seeds)
    sets = [[*keys, label, "_seed"], list(keys)]
    aggs = []
    for c in METRIC_COLS:
        aggs.append(F.expr(f"sum({ident(c)}) AS {ident('_r_' + c)}"))
        aggs.append(_zsum(c, "_t_" + c))
    all_keys = [*keys, label, "_seed"]
    gid = f"grouping_id({', '.join(ident(k) for k in all_keys)})"
    g = df.groupingSets([[F.col(k) for k in s] for s in sets], *all_keys).agg(*aggs, F.expr(f"{gid} AS _gid"))
    g = g.where(F.expr("NOT (_gid = 0 AND _seed = 1)"))
    pos_total = 0 if totals_first else 2
    return g.selectExpr(
        *[ident(k) for k in keys],
        f"CASE WHEN _gid = 0 THEN {ident(label)} ELSE '{TOTAL_WORD}' END AS {ident(label)}",
        *[f"CASE WHEN _gid = 0 THEN {ident('_r_' + c)} ELSE {ident('_t_' + c)} END AS {ident(c)}"
          for c in METRIC_COLS],
        "CASE WHEN _gid = 0 THEN 'row' ELSE 'total' END AS row_type",
        f"CASE WHEN _gid = 0 THEN 1 ELSE {pos_total} END AS row_order",
    )


def report_with_totals(report: DataFrame, dimension: str, totals_first: bool = True) -> DataFrame:
    """``Total`` row stacked on a report (REP-10, SET-1).

    Position is carried by ``row_type`` (``total`` / ``row``) and
    ``row_order`` (0 for the total when it comes first, 2 when last), not
    by physical order, so it survives a shuffle or a write.
    """
    return _with_total_sets(report, [], DIMENSIONS[dimension].label, totals_first, [()])


def bundle_with_totals(stacked: DataFrame, totals_first: bool = True,
                       dimensions: Sequence[str] = DIMENSION_ORDER) -> DataFrame:
    """Every report of a stacked bundle with its own ``Total`` row, in one pass."""
    return _with_total_sets(stacked, ["dimension"], "label", totals_first, [(d,) for d in dimensions])


def kpi_summary(payment_terms_report: DataFrame) -> DataFrame:
    """The six dashboard KPIs, from the payment-terms report only (S9), as one row."""
    return payment_terms_report.agg(*[_zsum(src, name) for name, (src, _) in KPI_SOURCES.items()])


def kpi_table(kpis: DataFrame) -> DataFrame:
    """Summary sheet as rows ``position, section, metric, value`` (RSH-2)."""
    stacked = F.inline(F.array(*[
        F.struct(F.lit(pos).alias("position"), F.lit(section).alias("section"),
                 F.lit(metric).alias("metric"), F.col(src).cast("bigint").alias("value"))
        for pos, section, metric, src in KPI_ROWS]))
    return kpis.select(stacked)


def kpi_labels(kpis: DataFrame) -> DataFrame:
    """Card texts: each KPI in thousands with the card's digits and a ``K`` (EXP-11)."""
    return kpis.select(*[thousands_label(F.col(name), digits).alias(name)
                         for name, (_, digits) in KPI_SOURCES.items()])


def layout(report: DataFrame, dimension: str, order: str = "screen") -> DataFrame:
    """Column order presets (RSH-3): ``query`` (balances, values, totals),
    ``export`` (interleaved, totals last) or ``screen`` (totals first, interleaved)."""
    cols = {"query": METRIC_COLS, "export": EXPORT_METRIC_COLS, "screen": SCREEN_METRIC_COLS}[order]
    extra = [c for c in ("row_type", "row_order") if c in report.columns]
    return report.select(DIMENSIONS[dimension].label, *cols, *extra)
