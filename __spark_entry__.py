"""

Every query reads the driver's parquet tables through the canonical
mapping of FIXTURES.md section 3 (``DriverCatalog`` in Spark, the same
mapping as SQL CTEs for DuckDB), with ``as_of`` fixed so results do not
depend on the wall clock. Rounded metrics are ``bigint`` and unrounded
exact sums are cast to ``double`` at the very end, identically on both
sides.
"""

from __future__ import annotations

import datetime as dt
import importlib.util
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfage.operators import aging, drilldown as dd, lookups, rollup, totals
from shelfage.operators.filters import Filters
from shelfage.plans import download_drilldown, get_dashboard_data
from shelfage.schema import DIMENSIONS, EXPORT_METRIC_COLS, KPI_ROWS, KPI_SOURCES, METRIC_COLS, TOTAL_WORD
from shelfage.session import scratch_path
from shelfage.sinks import numbered, read_detail, read_report, read_summary, write_reports
from shelfage.sources.checks import key_report
from shelfage.sources.driver_tables import DUCKDB_CANONICAL_CTES, DUCKDB_EDGE_CTES, DriverCatalog

# the training-data operators, where they are installed (a folder left without its modules does not count)
if getattr(importlib.util.find_spec("shelfage.llm"), "origin", None):
    from shelfage.llm import queries as training_data
else:
    training_data = None
if training_data is not None and importlib.util.find_spec("corpus_pipeline") is not None:
    import corpus_pipeline
else:
    corpus_pipeline = None

AS_OF = dt.date(2001, 7, 15)
EARLIER = dt.date(2001, 3, 2)          # a second clock for the rollup
REFRESH_FROM = dt.date(2001, 5, 20)    # in the middle of a month
SMOKE_DIR = "/root/testdata/sf0.001"

# Selections used by the parameterised queries (values present in the data).
COMPANY = 1
SALESPERSON = 3
TEAM = 7
PT_VALUE = '{"fr_FR": "5-LOW"}'
ITEM_VALUE = "PROMO"
# the age buckets, by hand: the queries take theirs from the package, the oracles from here
BUCKETS = (("0-5", 0, 5), ("6-10", 6, 10), ("11-15", 11, 15), ("16-20", 16, 20), ("21-25", 21, 25), ("26-30", 26, 30), ("30+", 31, None))
CUSTOMER_VALUE = "Customer#000000370"
BUYER_VALUE = "Brand#1"
SEARCH_USERS = "#0000000"
SEARCH_TEAMS = "nation_2"


def _cat(spark: SparkSession, sf_dir: str) -> DriverCatalog:
    return DriverCatalog(spark, sf_dir)


def _unrounded(df: DataFrame, keep: list[str]) -> DataFrame:
    return df.select(*keep, *[F.col(c).cast("double").alias(c) for c in df.columns if c not in keep])


# ---------------------------------------------------------------- Spark side
def entry(spark: SparkSession) -> DataFrame:
    """Flagship: dashboard ageing by payment term, company 1 (REP-4) at sf0.001."""
    return aging.aging_report(_cat(spark, SMOKE_DIR), "payment_terms", Filters(COMPANY), AS_OF)


def _report(dim: str, filters: Filters):
    return lambda spark, d: aging.aging_report(_cat(spark, d), dim, filters, AS_OF)


def _plain(dim: str):
    label = DIMENSIONS[dim].label
    return lambda spark, d: _unrounded(aging.plain_report(_cat(spark, d), dim, AS_OF), [label])


def _drill(group_type, group_value, bucket, filters=Filters(COMPANY), null_group=False):
    def q(spark, d):
        df = dd.drilldown(_cat(spark, d), filters, group_type, group_value, bucket, AS_OF, null_group)
        return df.withColumn("Qty", F.col("Qty").cast("double"))
    return q


def _long_cube(spark, d):
    cube = aging.long_cube(_cat(spark, d), Filters(COMPANY), AS_OF)
    return cube.select("dimension", "label", "bucket", F.col("balance").cast("double").alias("balance"),
                       F.col("value").cast("double").alias("value"))


def _bundle(spark, d):
    return aging.bundle(_cat(spark, d), Filters(COMPANY), AS_OF)


def _bundle_filtered(spark, d):
    return aging.bundle(_cat(spark, d), Filters(COMPANY, SALESPERSON, TEAM), AS_OF)


def _with_totals(dim: str, totals_first: bool = True, order: str = "query"):
    def q(spark, d):
        rep = aging.aging_report(_cat(spark, d), dim, Filters(COMPANY), AS_OF, ordered=False)
        return totals.layout(totals.report_with_totals(rep, dim, totals_first), dim, order)
    return q


def _kpis(spark, d):
    return totals.kpi_summary(aging.aging_report(_cat(spark, d), "payment_terms", Filters(COMPANY), AS_OF))


def _drill_with_total(spark, d):
    detail = dd.drilldown(_cat(spark, d), Filters(COMPANY), "buyer", BUYER_VALUE, "Value_30+", AS_OF,
                          with_total=True)
    return detail.withColumn("Qty", F.col("Qty").cast("double"))


def _export(spark, d):
    return write_reports(aging.bundle(_cat(spark, d), Filters(COMPANY), AS_OF), scratch_path(spark, "export"), AS_OF,
                         dimensions=list(DIMENSIONS))


def _export_roundtrip(dim: str):
    """A written report read back, its rows numbered in the order they were written in."""
    return lambda spark, d: numbered(read_report(spark, _export(spark, d), dim))


def _drill_export_roundtrip(spark, d):
    out = download_drilldown(_cat(spark, d), {"company_id": COMPANY}, "payment_terms", PT_VALUE, "Value_30+", AS_OF,
                             scratch_path(spark, "drill-export"))
    return numbered(read_detail(spark, out)).withColumn("Qty", F.col("Qty").cast("double"))


def _dashboard_default_company(spark, d):
    return get_dashboard_data(_cat(spark, d), {}, AS_OF, default_company=3)["buyer"]


def _edge_cat(spark, d):
    """The same tables with undated lines, times of day and product names in two JSON key orders."""
    return DriverCatalog(spark, d, edge=True)


def _edge_drill(bucket, **kw):
    def q(spark, d):
        return dd.drilldown(_edge_cat(spark, d), Filters(COMPANY), "payment_terms", "Total", bucket, AS_OF, **kw).withColumn("Qty", F.col("Qty").cast("double"))
    return q


def _rollup(filters: Filters, as_of: dt.date = AS_OF, edge: bool = False):
    def q(spark, d):
        cat = DriverCatalog(spark, d, edge=edge)
        root = rollup.build_rollup(cat, spark, scratch_path(spark, "rollup"))
        return rollup.bundle_from_rollup(cat, spark, root, filters, as_of)
    return q


def _rollup_refreshed(spark, d):
    """Built on a fact whose lines after REFRESH_FROM are missing, then refreshed for the (company, month) partitions that have such lines."""
    cat = _cat(spark, d)
    root = rollup.build_rollup(_Before(cat, REFRESH_FROM), spark, scratch_path(spark, "rollup"))
    late = cat.table("operation_details", ["company_id", "action_date"]).where(F.col("action_date") >= F.lit(REFRESH_FROM)) \
        .selectExpr("company_id", f"{rollup.month_sql('action_date')} AS month").distinct().collect()   # companies x months
    rollup.refresh(cat, spark, root, [(r.company_id, r.month) for r in late])
    return rollup.bundle_from_rollup(cat, spark, root, Filters(COMPANY), AS_OF)


class _Before(DriverCatalog):
    """A catalog as it was before a day."""

    def __init__(self, cat: DriverCatalog, day: dt.date):
        super().__init__(cat.spark, cat.sf_dir)
        self.day = day

    def table(self, name, columns=None):
        df = super().table(name, columns)
        return df.where(F.col("action_date") < F.lit(self.day)) if name == "operation_details" else df


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    c1 = Filters(COMPANY)
    q: dict[str, Callable[[SparkSession, str], DataFrame]] = {
        # REP-1..3: stand-alone reports (all companies, unrounded)
        "aging_plain_payment_terms": _plain("payment_terms"),
        "aging_plain_item": _plain("item_category"),
        "aging_plain_customer": _plain("customer"),
        # REP-4..7: dashboard reports, company 1
        "aging_payment_terms": _report("payment_terms", c1),
        "aging_item_category": _report("item_category", c1),
        "aging_customer": _report("customer", c1),
        "aging_buyer": _report("buyer", c1),
        # FLT-5, FLT-6, S15
        "aging_payment_terms_salesperson": _report("payment_terms", Filters(COMPANY, salesperson_id=SALESPERSON)),
        "aging_item_team": _report("item_category", Filters(COMPANY, team_id=TEAM)),
        "aging_customer_salesperson_team": _report("customer", Filters(COMPANY, SALESPERSON, TEAM)),
        "aging_buyer_salesperson_team": _report("buyer", Filters(COMPANY, SALESPERSON, TEAM)),
        # FLT-4: falsy company -> default company (here 3)
        "aging_default_company": _report("customer", Filters.from_mapping({"company_id": 0}, default_company=3)),
        # AGG-8, RSH-1
        "aging_long_cube": _long_cube,
        "aging_bundle_one_pass": _bundle,
        "aging_bundle_salesperson_team": _bundle_filtered,
        # REP-8: bucket selectors (group 'Total' = all groups)
        "drill_total": _drill("payment_terms", "Total", "Total_Balance"),
    }
    for i, (name, _, _) in enumerate(BUCKETS):
        prefix = "Balance_" if i % 2 == 0 else "Value_"
        key = "drill_bucket_" + name.replace("-", "_").replace("+", "_plus")
        q[key] = _drill("payment_terms", "Total", prefix + name)
    q.update({
        # FLT-10..13: group selectors
        "drill_payment_term": _drill("payment_terms", PT_VALUE, "Total_Value"),
        "drill_item": _drill("item_category", ITEM_VALUE, "Total_Balance"),
        "drill_customer": _drill("customer", CUSTOMER_VALUE, "Total_Balance"),
        "drill_buyer": _drill("buyer", BUYER_VALUE, "Balance_30+"),
        "drill_salesperson_team": _drill("customer", "Total", "Value_30+", Filters(COMPANY, SALESPERSON, TEAM)),
        # FLT-14, S17, S18
        "drill_group_total_bypass": _drill("customer", None, "Balance_6-10"),
        "drill_unknown_group_type": _drill("warehouse", "X", "Value_11-15"),
        "drill_default_company": _drill("item_category", ITEM_VALUE, "Balance_30+",
                                        Filters.from_mapping({"company_id": None}, default_company=3)),
        "drill_null_group": _drill("payment_terms", None, "Total_Balance", null_group=True),
        # REP-11
        "drill_with_total": _drill_with_total,
        # REP-10, RSH-3
        **{f"report_with_totals_{d}": _with_totals(d) for d in DIMENSIONS},
        "export_layout_totals_first": _with_totals("buyer", True, "screen"),
        "export_layout_totals_last": _with_totals("buyer", False, "export"),
        # REP-9, RSH-2, EXP-11
        "kpi_summary": _kpis,
        "kpi_table": lambda spark, d: totals.kpi_table(_kpis(spark, d)),
        "kpi_labels": lambda spark, d: totals.kpi_labels(_kpis(spark, d)),
        # REP-12..14
        "lookup_companies": lambda spark, d: lookups.companies(_cat(spark, d)),
        "lookup_salespersons": lambda spark, d: lookups.salespersons(_cat(spark, d)),
        "lookup_salespersons_search": lambda spark, d: lookups.salespersons(_cat(spark, d), SEARCH_USERS),
        "lookup_teams": lambda spark, d: lookups.teams(_cat(spark, d), COMPANY),
        "lookup_teams_search": lambda spark, d: lookups.teams(_cat(spark, d), COMPANY, SEARCH_TEAMS),
        "lookup_teams_no_company": lambda spark, d: lookups.teams(_cat(spark, d), None),
        # SNK-2..4
        "export_roundtrip": _export_roundtrip("customer"),
        **{f"export_roundtrip_{dim}": _export_roundtrip(dim) for dim in DIMENSIONS},
        "export_summary": lambda spark, d: read_summary(spark, _export(spark, d)),
        "drill_export_roundtrip": _drill_export_roundtrip,
        "dashboard_default_company": _dashboard_default_company,
        # undated lines and times of day (EXP-2), JSON equality (AGG-9)
        "edge_bundle": lambda spark, d: aging.bundle(_edge_cat(spark, d), Filters(COMPANY), AS_OF),
        "edge_drill_json": _edge_drill("Total_Balance"),
        "edge_drill_bucket": _edge_drill("Balance_0-5"),
        # the day-grain rollup answers as the bundle does
        "rollup_bundle": _rollup(Filters(COMPANY)),
        "rollup_bundle_earlier": _rollup(Filters(COMPANY), EARLIER),
        "rollup_bundle_salesperson_team": _rollup(Filters(COMPANY, SALESPERSON, TEAM)),
        "rollup_bundle_edge": _rollup(Filters(COMPANY), edge=True),
        "rollup_refreshed": _rollup_refreshed,
        # key checks of the catalog
        "key_report": lambda spark, d: key_report(_cat(spark, d)),
    })
    if training_data is not None:
        q.update(training_data.queries())
    if corpus_pipeline is not None:
        q["pipeline"] = corpus_pipeline.run
    return q


# ---------------------------------------------------------------- SQL side
_AGE = f"(DATE '{AS_OF.isoformat()}' - CAST(od.action_date AS DATE))"
_PT_LABEL = "COALESCE(apt.name ->> 'en_US', CAST(apt.name AS VARCHAR))"
_PROD_LABEL = "COALESCE(pt.name ->> 'en_US', CAST(pt.name AS VARCHAR))"
_BASE_WHERE = "od.next_operation = 'FG Packing' AND od.state NOT IN ('done', 'closed') AND od.fg_balance > 0"

# label expression and joins of each dimension (reference query text)
_DIM_SQL = {
    "payment_terms": (_PT_LABEL, "LEFT JOIN sale_order so ON od.oa_id = so.id "
                                 "LEFT JOIN account_payment_term apt ON so.payment_term_id = apt.id"),
    "item_category": ("od.fg_categ_type", "LEFT JOIN sale_order so ON od.oa_id = so.id"),
    "customer": ("rp.name", "LEFT JOIN sale_order so ON od.oa_id = so.id "
                            "LEFT JOIN res_partner rp ON so.partner_id = rp.id"),
    "buyer": ("od.buyer_name", "LEFT JOIN sale_order so ON od.oa_id = so.id"),
}


def _with(body: str) -> str:
    return f"WITH {DUCKDB_CANONICAL_CTES.strip()}\n{body}"


def _cond(lo: int, hi: int | None) -> str:
    return f"{_AGE} BETWEEN {lo} AND {hi}" if hi is not None else f"{_AGE} > {lo - 1}"


def _metric_sql(rounded: bool) -> list[str]:
    def wrap(expr: str) -> str:
        return f"CAST(ROUND({expr}, 0) AS BIGINT)" if rounded else f"CAST({expr} AS DOUBLE)"
    out = [wrap(f"SUM(CASE WHEN {_cond(lo, hi)} THEN od.fg_balance ELSE 0 END)") + f' AS "Balance_{n}"'
           for n, lo, hi in BUCKETS]
    out += [wrap(f"SUM(CASE WHEN {_cond(lo, hi)} THEN od.fg_balance * od.price_unit ELSE 0 END)") + f' AS "Value_{n}"'
            for n, lo, hi in BUCKETS]
    out += [wrap("SUM(od.fg_balance)") + ' AS "Total_Balance"',
            wrap("SUM(od.fg_balance * od.price_unit)") + ' AS "Total_Value"']
    return out


def _filter_sql(company: int | None, user: int | None = None, team: int | None = None) -> str:
    w = _BASE_WHERE
    if company is not None:
        w += f" AND od.company_id = {company}"
    if user:
        w += f" AND so.user_id = {user}"
    if team:
        w += f" AND so.team_id = {team}"
    return w


def _report_body(dim: str, where: str, rounded: bool = True, label_alias: str | None = None) -> str:
    label, joins = _DIM_SQL[dim]
    alias = label_alias or DIMENSIONS[dim].label
    cols = ",\n  ".join(_metric_sql(rounded))
    return (f'SELECT {label} AS "{alias}",\n  {cols}\nFROM operation_details od {joins}\n'
            f"WHERE {where}\nGROUP BY {label}")


def _report_sql(dim: str, company: int | None = COMPANY, user=None, team=None, rounded=True) -> str:
    return _with(_report_body(dim, _filter_sql(company, user, team), rounded) + "\nORDER BY 1 NULLS LAST")


_BUCKET_CASE = "CASE " + " ".join(f"WHEN {_cond(lo, hi)} THEN '{n}'" for n, lo, hi in BUCKETS) + " END"


def _long_cube_sql() -> str:
    parts = []
    for dim in DIMENSIONS:
        label, joins = _DIM_SQL[dim]
        parts.append(f"SELECT '{dim}' AS dimension, CAST({label} AS VARCHAR) AS label, {_BUCKET_CASE} AS bucket, "
                     f"CAST(SUM(od.fg_balance) AS DOUBLE) AS balance, "
                     f"CAST(SUM(od.fg_balance * od.price_unit) AS DOUBLE) AS value "
                     f"FROM operation_details od {joins} WHERE {_filter_sql(COMPANY)} "
                     f"GROUP BY {label}, {_BUCKET_CASE}")
    return _with("\nUNION ALL\n".join(parts))


def _bundle_body(user=None, team=None) -> str:
    parts = [f"SELECT '{dim}' AS dimension, * FROM ({_report_body(dim, _filter_sql(COMPANY, user, team), True, 'label')})"
             for dim in DIMENSIONS]
    return "\nUNION ALL\n".join(parts)


def _drill_body(group_type, group_value, bucket, company=COMPANY, user=None, team=None, null_group=False) -> str:
    where = _filter_sql(company, user, team)
    clean = (bucket or "").removeprefix("Balance_").removeprefix("Value_")
    for n, lo, hi in BUCKETS:
        if n == clean:
            where += f" AND {_cond(lo, hi)}"
    col = {"payment_terms": _PT_LABEL, "item_category": "od.fg_categ_type",
           "customer": "rp.name", "buyer": "od.buyer_name"}.get(group_type)
    if col is not None and null_group:
        where += f" AND {col} IS NULL"
    elif col is not None and group_value and group_value != TOTAL_WORD:
        lit = group_value.replace("'", "''")
        where += f" AND {col} = '{lit}'"
    return f"""SELECT so.name AS "OA", od.fg_categ_type AS "Category", {_PROD_LABEL} AS "Product",
  CAST(SUM(od.fg_balance) AS DOUBLE) AS "Qty",
  CAST(SUM(ROUND(od.fg_balance * od.price_unit, 0)) AS BIGINT) AS "Value"
FROM operation_details od
LEFT JOIN sale_order so ON od.oa_id = so.id
LEFT JOIN account_payment_term apt ON so.payment_term_id = apt.id
LEFT JOIN res_partner rp ON so.partner_id = rp.id
LEFT JOIN product_product pp ON od.product_id = pp.id
LEFT JOIN product_template pt ON pp.product_tmpl_id = pt.id
WHERE {where}
GROUP BY so.name, od.fg_categ_type, pt.name"""


def _drill_sql(*args, **kw) -> str:
    return _with(_drill_body(*args, **kw) + "\nORDER BY so.name NULLS LAST, pt.name NULLS LAST")


def _with_ctes(extra: str, body: str) -> str:
    """WITH the canonical CTEs plus more CTEs (``extra``), then ``body``."""
    return f"WITH {DUCKDB_CANONICAL_CTES.strip()},\n{extra}\n{body}"


def _with_totals_sql(dim: str, totals_first: bool = True, order: str = "query") -> str:
    label = DIMENSIONS[dim].label
    cols = {"query": METRIC_COLS, "export": EXPORT_METRIC_COLS,
            "screen": METRIC_COLS[-2:] + EXPORT_METRIC_COLS[:-2]}[order]
    q = ", ".join(f'"{c}"' for c in cols)
    sums = ", ".join(f'CAST(COALESCE(SUM(COALESCE("{c}", 0)), 0) AS BIGINT) AS "{c}"' for c in cols)
    pos_total = 0 if totals_first else 2
    rep = _report_body(dim, _filter_sql(COMPANY))
    return _with(f"""SELECT 'Total' AS "{label}", {sums}, 'total' AS row_type, {pos_total} AS row_order FROM ({rep}) r
UNION ALL
SELECT "{label}", {q}, 'row' AS row_type, 1 AS row_order FROM ({rep}) r""")


def _kpi_body() -> str:
    sums = ", ".join(f'CAST(COALESCE(SUM(COALESCE("{src}", 0)), 0) AS BIGINT) AS {name}' for name, (src, _) in KPI_SOURCES.items())
    return f"SELECT {sums} FROM ({_report_body('payment_terms', _filter_sql(COMPANY))}) r"


def _kpi_table_sql() -> str:
    rows = "\nUNION ALL\n".join(
        f"SELECT {pos} AS position, '{section}' AS section, '{metric}' AS metric, CAST({src} AS BIGINT) AS value FROM k"
        for pos, section, metric, src in KPI_ROWS)
    return _with_ctes(f"k AS ({_kpi_body()})", rows)


def _kpi_labels_sql() -> str:
    cols = ", ".join(
        f"CASE WHEN {name} IS NULL THEN '0 K' ELSE "
        f"format('{{:,.{digits}f}}', ROUND(CAST({name} AS DECIMAL(38,0)) * 0.001, {digits})) || ' K' END AS {name}"
        for name, (_, digits) in KPI_SOURCES.items())
    return _with(f"SELECT {cols} FROM ({_kpi_body()}) k")


def _lookup_sql() -> dict[str, str]:
    users = ("SELECT u.id, COALESCE(NULLIF(rp.name, ''), 'Unknown') AS name FROM res_users u "
             "LEFT JOIN res_partner rp ON u.partner_id = rp.id WHERE u.sale_team_id IS NOT NULL")
    teams = "SELECT id, name FROM crm_team WHERE is_sales AND (company_id IS NULL{extra}){term}"
    return {
        "lookup_companies": _with("SELECT id, name FROM res_company WHERE id IN (1, 3)"),
        "lookup_salespersons": _with(users),
        "lookup_salespersons_search": _with(users + f" AND rp.name ILIKE '%{SEARCH_USERS}%'"),
        "lookup_teams": _with(teams.format(extra=f" OR company_id = {COMPANY}", term="")),
        "lookup_teams_search": _with(teams.format(extra=f" OR company_id = {COMPANY}",
                                                  term=f" AND name ILIKE '%nation\\_2%' ESCAPE '\\'")),
        "lookup_teams_no_company": _with(teams.format(extra="", term="")),
    }


def oracle_sql() -> dict[str, str]:
    s: dict[str, str] = {
        "aging_plain_payment_terms": _report_sql("payment_terms", None, rounded=False),
        "aging_plain_item": _report_sql("item_category", None, rounded=False),
        "aging_plain_customer": _report_sql("customer", None, rounded=False),
        "aging_payment_terms": _report_sql("payment_terms"),
        "aging_item_category": _report_sql("item_category"),
        "aging_customer": _report_sql("customer"),
        "aging_buyer": _report_sql("buyer"),
        "aging_payment_terms_salesperson": _report_sql("payment_terms", user=SALESPERSON),
        "aging_item_team": _report_sql("item_category", team=TEAM),
        "aging_customer_salesperson_team": _report_sql("customer", user=SALESPERSON, team=TEAM),
        "aging_buyer_salesperson_team": _report_sql("buyer", user=SALESPERSON, team=TEAM),
        "aging_default_company": _report_sql("customer", 3),
        "aging_long_cube": _long_cube_sql(),
        "aging_bundle_one_pass": _with(_bundle_body()),
        "aging_bundle_salesperson_team": _with(_bundle_body(SALESPERSON, TEAM)),
        "drill_total": _drill_sql("payment_terms", "Total", "Total_Balance"),
    }
    for i, (name, _, _) in enumerate(BUCKETS):
        prefix = "Balance_" if i % 2 == 0 else "Value_"
        key = "drill_bucket_" + name.replace("-", "_").replace("+", "_plus")
        s[key] = _drill_sql("payment_terms", "Total", prefix + name)
    s.update({
        "drill_payment_term": _drill_sql("payment_terms", PT_VALUE, "Total_Value"),
        "drill_item": _drill_sql("item_category", ITEM_VALUE, "Total_Balance"),
        "drill_customer": _drill_sql("customer", CUSTOMER_VALUE, "Total_Balance"),
        "drill_buyer": _drill_sql("buyer", BUYER_VALUE, "Balance_30+"),
        "drill_salesperson_team": _drill_sql("customer", "Total", "Value_30+", user=SALESPERSON, team=TEAM),
        "drill_group_total_bypass": _drill_sql("customer", None, "Balance_6-10"),
        "drill_unknown_group_type": _drill_sql("warehouse", "X", "Value_11-15"),
        "drill_default_company": _drill_sql("item_category", ITEM_VALUE, "Balance_30+", company=3),
        "drill_null_group": _drill_sql("payment_terms", None, "Total_Balance", null_group=True),
        "drill_with_total": _drill_with_total_sql(),
        **{f"report_with_totals_{d}": _with_totals_sql(d) for d in DIMENSIONS},
        "export_layout_totals_first": _with_totals_sql("buyer", True, "screen"),
        "export_layout_totals_last": _with_totals_sql("buyer", False, "export"),
        "kpi_summary": _with(_kpi_body()),
        "kpi_table": _kpi_table_sql(),
        "kpi_labels": _kpi_labels_sql(),
        **_lookup_sql(),
        "export_roundtrip": _export_roundtrip_sql("customer"),
        **{f"export_roundtrip_{dim}": _export_roundtrip_sql(dim) for dim in DIMENSIONS},
        "export_summary": _kpi_table_sql(),
        "drill_export_roundtrip": _drill_export_sql(),
        "dashboard_default_company": _report_sql("buyer", 3),
        "edge_bundle": _edge(_bundle_body()),
        "edge_drill_json": _edge_drill_sql("Total_Balance"),
        "edge_drill_bucket": _edge_drill_sql("Balance_0-5"),
        "rollup_bundle": _with(_bundle_body()),
        "rollup_bundle_earlier": _with(_bundle_body()).replace(AS_OF.isoformat(), EARLIER.isoformat()),
        "rollup_bundle_salesperson_team": _with(_bundle_body(SALESPERSON, TEAM)),
        "rollup_bundle_edge": _edge(_bundle_body()),
        "rollup_refreshed": _with(_bundle_body()),
        "key_report": _key_report_sql(),
    })
    if training_data is not None:
        s.update(training_data.oracle_sql())
    if corpus_pipeline is not None and corpus_pipeline.ORACLE_SQL is not None:
        s["pipeline"] = corpus_pipeline.ORACLE_SQL
    return s


def _drill_with_total_sql() -> str:
    detail = _drill_body("buyer", BUYER_VALUE, "Value_30+")
    return _with_ctes(f"d AS ({detail})", """SELECT "OA", "Category", "Product", "Qty", "Value", 'detail' AS row_type, 0 AS row_order FROM d
UNION ALL
SELECT 'Total', NULL, NULL, CAST(COALESCE(SUM(COALESCE("Qty", 0)), 0) AS DOUBLE), CAST(COALESCE(SUM(COALESCE("Value", 0)), 0) AS BIGINT), 'total', 1 FROM d""")


def _export_roundtrip_sql(dim: str) -> str:
    label = DIMENSIONS[dim].label
    cols = ", ".join(f'"{c}"' for c in EXPORT_METRIC_COLS)
    sums = ", ".join(f'CAST(COALESCE(SUM(COALESCE("{c}", 0)), 0) AS BIGINT) AS "{c}"' for c in EXPORT_METRIC_COLS)
    rep = _report_body(dim, _filter_sql(COMPANY))
    return _with(f"""SELECT *, row_number() OVER (ORDER BY row_order, "{label}" NULLS LAST) AS position FROM (
SELECT 'Total' AS "{label}", {sums}, 'total' AS row_type, 0 AS row_order FROM ({rep}) r
UNION ALL
SELECT "{label}", {cols}, 'row' AS row_type, 1 AS row_order FROM ({rep}) r)""")


def _drill_export_sql() -> str:
    detail = _drill_body("payment_terms", PT_VALUE, "Value_30+")
    text = (f"""'Breakdown for Payment Terms: {PT_VALUE} (Value_30+)' AS title, '{PT_VALUE.replace(" ", "_")}_Value_30+' AS export_name""")
    return _with_ctes(f"d AS ({detail})", f"""SELECT *, row_number() OVER (ORDER BY row_order, "OA" NULLS LAST, "Product" NULLS LAST, "Category" NULLS LAST) AS position FROM (
SELECT "OA", "Category", "Product", "Qty", "Value", 'detail' AS row_type, 0 AS row_order, {text} FROM d
UNION ALL
SELECT 'Total', NULL, NULL, CAST(COALESCE(SUM(COALESCE("Qty", 0)), 0) AS DOUBLE), CAST(COALESCE(SUM(COALESCE("Value", 0)), 0) AS BIGINT), 'total', 1, {text} FROM d)""")


def _edge(body: str) -> str:
    return f"WITH {DUCKDB_EDGE_CTES.strip()}\n{body}"


def _edge_drill_sql(bucket: str) -> str:
    """The drill-down grouped by the parsed JSON: its keys and values, whatever their order in the text."""
    body = _drill_body("payment_terms", "Total", bucket)
    assert body.endswith(", pt.name")
    body = body.removesuffix(", pt.name") + ", pt.name ->> 'en_US', pt.name ->> 'fr_FR'"
    return _edge(body.replace(_PROD_LABEL, "COALESCE(pt.name ->> 'en_US', min(CAST(pt.name AS VARCHAR)))"))


def _key_report_sql() -> str:
    parts = []
    for t in ("sale_order", "account_payment_term", "res_partner", "product_product", "product_template", "res_company", "res_users", "crm_team"):
        parts.append(f"SELECT '{t}' AS table_name, 'set' AS check_name, 'id' AS column_name, count(*) AS checked, count(*) - count(id) AS violations FROM {t}")
        parts.append(f"SELECT '{t}', 'unique', 'id', count(id), count(id) - count(DISTINCT id) FROM {t}")
    for t, column, target in (("operation_details", "oa_id", "sale_order"), ("operation_details", "product_id", "product_product"),
                              ("operation_details", "company_id", "res_company"), ("sale_order", "partner_id", "res_partner"),
                              ("sale_order", "payment_term_id", "account_payment_term"), ("sale_order", "team_id", "crm_team"),
                              ("product_product", "product_tmpl_id", "product_template"), ("res_users", "partner_id", "res_partner"),
                              ("res_users", "sale_team_id", "crm_team")):
        parts.append(f"SELECT '{t}', 'exists', '{column}', count({column}), count(*) FILTER (WHERE {column} IS NOT NULL AND {column} NOT IN "
                     f"(SELECT id FROM {target} WHERE id IS NOT NULL)) FROM {t}")
    return _with("\nUNION ALL\n".join(parts))
