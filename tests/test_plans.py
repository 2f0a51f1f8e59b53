"""Plan shape: what reaches the scan, which joins exist, how often the fact is read."""

from __future__ import annotations

import datetime as dt
import re

import pytest
from conftest import SF0001

from shelfage.operators import aging, drilldown as dd
from shelfage.operators.filters import Filters
from shelfage.session import scratch_path
from shelfage.sinks import write_canonical
from shelfage.sources import DriverCatalog, ParquetCatalog

AS_OF = dt.date(2001, 7, 15)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def scans(df, table: str) -> int:
    return len(re.findall(rf"FileScan parquet [^\n]*{table}", plan(df)))


@pytest.fixture(scope="module", autouse=True)
def full_plan_strings(spark):
    old = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    yield
    spark.conf.set("spark.sql.maxMetadataStringLength", old)


@pytest.fixture(scope="module")
def canonical(spark):
    root = scratch_path(spark, "canonical")
    write_canonical(DriverCatalog(spark, SF0001), root)
    return ParquetCatalog(spark, root)


def test_canonical_layout_gives_same_reports(spark, canonical):
    drv = DriverCatalog(spark, SF0001)
    for dim in ("payment_terms", "customer", "buyer"):
        a = aging.aging_report(drv, dim, Filters(1), AS_OF).collect()
        b = aging.aging_report(canonical, dim, Filters(1), AS_OF).collect()
        assert a == b


def test_stock_filters_and_company_partition_reach_the_scan(canonical):
    df = aging.aging_report(canonical, "payment_terms", Filters(1), AS_OF)
    p = plan(df)
    fact = [line for line in p.splitlines() if "operation_details" in line and "FileScan" in line][0]
    assert "PartitionFilters: [isnotnull(company_id" in fact and "(company_id" in fact and "= 1)" in fact
    assert "EqualTo(next_operation,FG Packing)" in fact
    assert "Not(In(state, [closed,done]))" in fact
    assert "GreaterThan(fg_balance,0.00)" in fact


def test_drilldown_age_range_is_pushed(canonical):
    df = dd.drilldown(canonical, Filters(1), "payment_terms", "Total", "Balance_6-10", AS_OF)
    fact = [line for line in plan(df).splitlines() if "operation_details" in line and "FileScan" in line][0]
    assert "GreaterThanOrEqual(action_date,2001-07-05T00:00)" in fact
    assert "LessThan(action_date,2001-07-10T00:00)" in fact


def test_open_bucket_range_is_pushed(canonical):
    df = dd.drilldown(canonical, Filters(1), "buyer", "Brand#1", "Value_30+", AS_OF)
    fact = [line for line in plan(df).splitlines() if "operation_details" in line and "FileScan" in line][0]
    assert "LessThan(action_date,2001-06-15T00:00)" in fact
    assert "EqualTo(buyer_name,Brand#1)" in fact


def test_bundle_reads_fact_once(spark):
    cat = DriverCatalog(spark, SF0001)
    df = aging.bundle(cat, Filters(1), AS_OF)
    assert scans(df, "lineitem.parquet") == 1
    assert "Expand" in plan(df)  # grouping sets, not four aggregates


def test_item_report_needs_no_order_join(spark):
    cat = DriverCatalog(spark, SF0001)
    df = aging.aging_report(cat, "item_category", Filters(1), AS_OF)
    assert scans(df, "orders.parquet") == 0
    # S15: a filter on orders rejects order-less lines: one join with the orders, after the fold
    with_team = aging.aging_report(cat, "item_category", Filters(1, team_id=7), AS_OF)
    assert scans(with_team, "orders.parquet") == 1
    opt = with_team._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [oa_id" in opt[opt.index("Join Inner"):]


def test_payment_term_report_does_not_read_part(spark):
    cat = DriverCatalog(spark, SF0001)
    df = aging.aging_report(cat, "payment_terms", Filters(1), AS_OF)
    assert scans(df, "part.parquet") == 0


def test_order_side_dims_aggregate_before_join(spark):
    """Lines are folded per (order, bucket) before meeting sale_order."""
    cat = DriverCatalog(spark, SF0001)
    df = aging.aging_report(cat, "customer", Filters(1), AS_OF)
    p = df._jdf.queryExecution().optimizedPlan().toString()
    first_join = p.index("Join LeftOuter")
    assert "Aggregate [oa_id" in p[first_join:]


def test_order_restrictions_run_no_job_and_fold_before_the_join(spark):
    """Salesperson filter or a selected customer: building the plan runs nothing, and the lines are folded before they
    meet the orders, whatever the orders' size."""
    cat = DriverCatalog(spark, SF0001)
    for name in ("lineitem", "orders", "customer", "part"):
        cat.raw(name)  # schemas
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plan-only", "plan-only")
    try:
        dfs = [dd.drilldown(cat, Filters(1, salesperson_id=3), "customer", "Total", "Total_Balance", AS_OF),
               dd.drilldown(cat, Filters(1), "customer", "Customer#000000370", "Total_Balance", AS_OF),
               aging.aging_report(cat, "buyer", Filters(1, salesperson_id=3), AS_OF)]
        assert list(tracker.getJobIdsForGroup("plan-only")) == []
    finally:
        spark.sparkContext.setJobGroup("", "")
    for df in dfs:
        opt = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate [oa_id" in opt[opt.index("Join Inner"):]


def test_repeated_order_ids_count_alike_at_any_threshold(spark, fixture_cat):
    """An order stored twice counts twice everywhere, as in a plain SQL join; the broadcast threshold changes nothing."""
    from shelfage.sources import DataFrameCatalog
    tables = {n: fixture_cat.table(n) for n in ("operation_details", "sale_order", "account_payment_term", "res_partner",
                                                "product_product", "product_template", "res_company", "res_users", "crm_team")}
    so = tables["sale_order"]
    cat = DataFrameCatalog({**tables, "sale_order": so.union(so.where("id = 100"))})
    day = dt.date(2024, 3, 31)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    seen = []
    for threshold in ("10485760", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        try:
            f = Filters(1, salesperson_id=7)
            seen.append([sorted(map(tuple, df.collect()), key=str) for df in (
                aging.aging_report(cat, "buyer", f, day), aging.aging_report(cat, "customer", f, day), aging.bundle(cat, f, day),
                dd.drilldown(cat, f, "customer", "Total", "Total_Balance", day),
                dd.drilldown(cat, Filters(1), "customer", "Acme", "Total_Balance", day))])
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert seen[0] == seen[1]
    buyer, customer, _, cell, acme = seen[0]
    # order 100: lines of 10.5 + 5.5 + 4, twice; order 101 (2 lines, 3 + 2) once
    assert sum(r[15] for r in buyer) == sum(r[15] for r in customer) == 45
    assert sum(r[3] for r in cell) == 45
    # customer Acme is two partners: also order 104 (9 + 1)
    assert sum(r[3] for r in acme) == 55


def test_totals_have_no_sort_below_and_one_task_per_seed(spark):
    from shelfage.operators.totals import bundle_with_totals, report_with_totals
    cat = DriverCatalog(spark, SF0001)
    rep = aging.aging_report(cat, "customer", Filters(1), AS_OF, ordered=False)
    text = report_with_totals(rep, "customer")._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in text and "splits=1)" in text
    text = bundle_with_totals(aging.bundle(cat, Filters(1), AS_OF))._jdf.queryExecution().executedPlan().toString()
    assert text.count("splits=1)") == 4


def test_lines_without_an_order_are_spread(spark, fixture_cat):
    """Bundle of 3,000 buyers: no partition of the order join holds more than a few times the mean (AQE off)."""
    from shelfage.sources import DataFrameCatalog
    od = spark.range(30000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN NULL ELSE id % 4000 END AS oa_id", "CASE WHEN id % 3 = 1 THEN NULL ELSE id % 500 END AS product_id",
        "'FG Packing' AS next_operation", "'open' AS state", "CAST(1 AS DECIMAL(14,2)) AS fg_balance", "CAST(2 AS DECIMAL(14,2)) AS price_unit",
        "TIMESTAMP_NTZ'2024-03-30 00:00:00' AS action_date", "1 AS company_id", "CAST(id % 50 AS STRING) AS fg_categ_type", "CAST(id % 3000 AS STRING) AS buyer_name")
    tables = {n: fixture_cat.table(n) for n in ("sale_order", "account_payment_term", "res_partner", "product_product",
                                                "product_template", "res_company", "res_users", "crm_team")}
    cat = DataFrameCatalog({**tables, "operation_details": od})
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        lines = aging.stock_lines(cat, Filters(1), dt.date(2024, 3, 31), ["buyer_name"])
        g, _ = aging._grouped(lines, [["oa_id", "bucket"], ["buyer_name", "bucket"]])
        from pyspark.sql import functions as F
        g = g.withColumn("_spread", F.expr(aging.order_spread("oa_id", ["bucket", "buyer_name"])))
        sizes = [r["count"] for r in g.repartition(16, "oa_id", "_spread").groupBy(F.spark_partition_id()).count().collect()]
        assert max(sizes) <= 3 * sum(sizes) / 16
        text = aging.bundle(cat, Filters(1), dt.date(2024, 3, 31), ("customer", "buyer"))._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(oa_id" in text and "_spread" in text
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_totals_do_not_rescan(spark):
    from shelfage.operators.totals import report_with_totals
    cat = DriverCatalog(spark, SF0001)
    rep = aging.aging_report(cat, "customer", Filters(1), AS_OF)
    assert scans(report_with_totals(rep, "customer"), "lineitem.parquet") == 1
    d = dd.drilldown(cat, Filters(1), "buyer", "Brand#1", "Total_Value", AS_OF, with_total=True)
    # the count of heavy products reads the folded lines' exchange, not the lines
    d.collect()
    final = plan(d).split("== Initial Plan ==")[0]
    assert len(re.findall(r"FileScan parquet [^\n]*lineitem.parquet", final)) == 1


@pytest.fixture(scope="module")
def bucketed(spark):
    from shelfage.sources import TableCatalog
    root = scratch_path(spark, "bucketed")
    write_canonical(DriverCatalog(spark, SF0001), root, buckets=4, table_prefix="bk_")
    return TableCatalog(spark, "bk_")


def _exchanges_below_first_join(df) -> list[str]:
    """Exchange nodes feeding the order join (broadcasts turned off)."""
    p = df._jdf.queryExecution().executedPlan().toString()
    lines = p.splitlines()
    j = next(i for i, line in enumerate(lines) if "SortMergeJoin" in line and "_so_id" in line)
    depth = len(lines[j]) - len(lines[j].lstrip(" :+-"))
    below = []
    for line in lines[j + 1:]:
        d = len(line) - len(line.lstrip(" :+-"))
        if d <= depth:
            break
        if "Exchange" in line:
            below.append(line.strip())
    return below


def test_bucketed_layout_order_join_without_shuffle(spark, bucketed):
    drv = DriverCatalog(spark, SF0001)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rep = aging.aging_report(bucketed, "customer", Filters(1), AS_OF)
        assert _exchanges_below_first_join(rep) == []
        det = dd.drilldown(bucketed, Filters(1), "customer", "Total", "Total_Balance", AS_OF)
        assert _exchanges_below_first_join(det) == []
        assert rep.collect() == aging.aging_report(drv, "customer", Filters(1), AS_OF).collect()
        assert sorted(map(tuple, det.collect()), key=str) == sorted(
            map(tuple, dd.drilldown(drv, Filters(1), "customer", "Total", "Total_Balance", AS_OF).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_hot_order_join_is_split(spark):
    """One order holds a third of all lines, over many products: after the
    per-(order, category, product) fold it still has thousands of rows, and
    AQE's skew join must split its partition of the order join."""
    from shelfage.sources import DataFrameCatalog
    n = 30000
    od = spark.range(n).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 1 ELSE id END AS oa_id", "id % 5000 AS product_id",
        "'FG Packing' AS next_operation", "'open' AS state", "CAST(1.5 AS DECIMAL(14,2)) AS fg_balance",
        "CAST(2 AS DECIMAL(14,2)) AS price_unit", "TIMESTAMP_NTZ'2024-01-01 00:00:00' AS action_date",
        "1 AS company_id", "'Zip' AS fg_categ_type", "'B' AS buyer_name")
    so = spark.range(n).selectExpr("id", "concat('OA-', id) AS name", "CAST(1 AS INT) AS payment_term_id",
                                   "id % 100 AS partner_id", "id % 7 AS user_id", "CAST(1 AS INT) AS team_id")
    pp = spark.range(5000).selectExpr("id", "id AS product_tmpl_id")
    pt = spark.range(5000).selectExpr("id", "concat('{\"en_US\": \"P', id, '\"}') AS name")
    cat = DataFrameCatalog({"operation_details": od, "sale_order": so, "product_product": pp,
                            "product_template": pt})
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
            "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        df = dd.drilldown(cat, Filters(1), "payment_terms", "Total", "Total_Balance", dt.date(2024, 3, 1))
        rows = df.collect()
        final = df._jdf.queryExecution().executedPlan().toString()
        assert any("SortMergeJoin(skew=true)" in line and "_so_id" in line for line in final.splitlines())
        hot = [r for r in rows if r.OA == "OA-1"]
        # order 1 = the multiples of 3 plus id 1 itself; they hit every product residue mod 5000
        assert len(hot) == 5000 and sum(float(r.Qty) for r in hot) == 1.5 * (n // 3 + 1)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_line_level_aggregate_is_two_sums(spark):
    """The aggregate reading fact lines keeps two sums per line (see README, "Cheap per line")."""
    cat = DriverCatalog(spark, SF0001)
    for dim, key in (("customer", "oa_id"), ("payment_terms", "oa_id"), ("item_category", "product_id"),
                     ("buyer", "product_id")):
        df = aging.aging_report(cat, dim, Filters(1), AS_OF)
        lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
        partials = [line for line in lines if f"HashAggregate(keys=[{key}" in line and "partial_sum" in line]
        assert partials and all(line.count("partial_sum(") == 2 for line in partials)
