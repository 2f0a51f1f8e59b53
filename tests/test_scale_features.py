"""JSON equality, linguistic order, committed exports, day-grain rollup, key checks, heavy keys, pruning and intermediates."""

from __future__ import annotations

import datetime as dt
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from shelfage.functions.expressions import json_order_sql, json_value_sql
from shelfage.operators import aging, rollup
from shelfage.operators.drilldown import drilldown
from shelfage.operators.filters import Filters
from shelfage.operators.keyed import join_dimension
from shelfage.schema import DIMENSION_ORDER
from shelfage.session import children, intermediates, scratch_path
from shelfage.sinks import numbered, read_report, read_summary, write_reports
from shelfage.sources import DataFrameCatalog
from shelfage.sources.checks import key_report
from shelfage.sources.driver_tables import PRIORITIES, DriverCatalog
from conftest import FIX_AS_OF, OD_SCHEMA, SF0001

AS_OF = dt.date(2001, 7, 15)


def with_table(cat, **frames):
    return DataFrameCatalog({**cat.frames, **frames})


class confs:
    def __init__(self, spark, **values):
        self.spark, self.values = spark, {k.replace("__", "."): v for k, v in values.items()}

    def __enter__(self):
        self.old = {k: self.spark.conf.get(k) for k in self.values}
        for k, v in self.values.items():
            self.spark.conf.set(k, v)

    def __exit__(self, *_):
        for k, v in self.old.items():
            self.spark.conf.set(k, v)


def rows_of(df):
    return sorted(map(str, df.collect()))


# ---------------------------------------------------------------- JSON (AGG-9, ORD-2)
def test_equal_json_has_one_form(spark):
    same = [('{"a":1,"b":2}', '{"b": 2, "a": 1}'), ('{"en_US": "x", "fr_FR": "y"}', ' {"fr_FR":"y","en_US":"x"}'),
            ('{"a": 1.0}', '{"a": 1}'), ("[1, 2]", "[1,2]"), ('{"k": {"z": 1, "y": 2}}', '{"k":{"y":2,"z":1}}')]
    df = spark.createDataFrame(same, "a string, b string")
    assert all(r.x == r.y for r in df.selectExpr(f"{json_value_sql('a')} AS x", f"{json_value_sql('b')} AS y").collect())
    kept = ['{"en_US": "Net 30"}', '{"en_US": null, "fr_FR": "X"}', "plain text", "{bad", "", None, "{}"]
    df = spark.createDataFrame([(i, k) for i, k in enumerate(kept)], "i int, c string")
    assert [r.v for r in df.selectExpr("i", f"{json_value_sql('c')} AS v").orderBy("i").collect()] == kept


def test_json_order(spark):
    """Objects after other values, fewer pairs first, then key length, key and value."""
    want = ["text", "{}", '{"b": "a"}', '{"b": "a b"}', '{"b": "ab"}', '{"aa": "a"}', '{"a": "x", "b": "x"}', None]
    df = spark.createDataFrame([(w,) for w in reversed(want)], "c string")
    assert [r.c for r in df.orderBy(F.expr(json_order_sql("c")).asc_nulls_last()).collect()] == want


def test_drilldown_groups_equal_json(spark, fixture_cat):
    names = spark.createDataFrame([(500, '{"en_US": "Zipper", "fr_FR": "Fermeture"}'), (501, '{"fr_FR":"Fermeture","en_US":"Zipper"}'),
                                   (502, '{"fr_FR": "Bouton"}'), (503, None)], "id bigint, name string")
    before = drilldown(fixture_cat, Filters(1), None, None, "Total_Balance", FIX_AS_OF)
    after = drilldown(with_table(fixture_cat, product_template=names), Filters(1), None, None, "Total_Balance", FIX_AS_OF)
    a = [(r.Product, r.Qty, r.Value) for r in after.where("OA = 'OA-100'").collect()]
    assert before.where("OA = 'OA-100'").count() == 2 and a == [("Zipper", Decimal("20.00"), 38)]


def test_order_of_labels_by_collation(spark, fixture_cat):
    od = spark.createDataFrame([(100, 1000, "FG Packing", "open", Decimal(1), Decimal(1), dt.datetime(2024, 3, 31), 1, "Zip", b)
                                for b in ("b", "A", "a", "é", "f", None)], OD_SCHEMA)
    cat = with_table(fixture_cat, operation_details=od)
    stacked = aging.bundle(cat, Filters(1), FIX_AS_OF, ("buyer",))
    for collation, want in ((None, ["Total", "A", "a", "b", "f", "é", None]), ("UNICODE", ["Total", "a", "A", "b", "é", "f", None])):
        out = write_reports(stacked, scratch_path(spark, "t-order"), FIX_AS_OF, dimensions=("buyer",), collation=collation)
        got = numbered(read_report(spark, out, "buyer")).orderBy("position").collect()
        assert [r.Buyer for r in got] == want and [r.position for r in got] == list(range(1, 8))
    assert [r.Buyer for r in aging.aging_report(cat, "buyer", Filters(1), FIX_AS_OF, collation="UNICODE").collect()] == ["a", "A", "b", "é", "f", None]


# ---------------------------------------------------------------- exports as one commit (SNK-2, SNK-3)
def test_a_failed_export_is_not_readable(spark, fixture_cat, monkeypatch):
    import shelfage.sinks as sinks

    stacked = aging.bundle(fixture_cat, Filters(1), FIX_AS_OF)
    path = scratch_path(spark, "t-commit")

    def broken(*_):
        raise RuntimeError("between the writes")

    with monkeypatch.context() as m:
        m.setattr(sinks, "kpi_table", broken)
        with pytest.raises(RuntimeError):
            write_reports(stacked, path, FIX_AS_OF, dimensions=DIMENSION_ORDER)
    out = f"{path}/{sinks.export_name(FIX_AS_OF)}"
    with pytest.raises(FileNotFoundError):
        read_report(spark, out, "buyer")
    assert [c for c in children(spark, out) if c.startswith("data-")] == []
    assert write_reports(stacked, path, FIX_AS_OF, dimensions=DIMENSION_ORDER) == out
    first = rows_of(read_report(spark, out, "buyer"))
    with pytest.raises(FileExistsError):
        write_reports(stacked, path, FIX_AS_OF, dimensions=DIMENSION_ORDER)
    # a failed overwrite leaves the earlier export; a good one replaces it
    less = aging.bundle(fixture_cat, Filters(3), FIX_AS_OF)
    with monkeypatch.context() as m:
        m.setattr(sinks, "kpi_table", broken)
        with pytest.raises(RuntimeError):
            write_reports(less, path, FIX_AS_OF, mode="overwrite", dimensions=DIMENSION_ORDER)
    assert rows_of(read_report(spark, out, "buyer")) == first
    write_reports(less, path, FIX_AS_OF, mode="ignore", dimensions=DIMENSION_ORDER)
    assert rows_of(read_report(spark, out, "buyer")) == first
    write_reports(less, path, FIX_AS_OF, mode="overwrite", dimensions=DIMENSION_ORDER)
    assert read_report(spark, out, "buyer").count() == 2 and read_summary(spark, out).count() == 6
    assert len([c for c in children(spark, out) if c.startswith("data-")]) == 1
    with pytest.raises(FileNotFoundError):
        read_report(spark, out, "buyer", fmt="csv")


# ---------------------------------------------------------------- intermediates
def test_intermediates_are_removed(spark):
    outer = scratch_path(spark, "t-stays")
    spark.range(3).write.parquet(outer)
    with intermediates(spark) as made:
        a = scratch_path(spark, "t-gone")
        spark.range(3).write.parquet(a)
        with pytest.raises(ValueError), intermediates(spark):
            b = scratch_path(spark, "t-inner")
            spark.range(3).write.parquet(b)
            raise ValueError
        assert children(spark, b) == [] and children(spark, a) != [] and made == [a]
    assert children(spark, a) == [] and children(spark, outer) != []


# ---------------------------------------------------------------- rollup (SNK-1, AGG-8)
@pytest.mark.parametrize("filters", [Filters(1), Filters(1, salesperson_id=7), Filters(1, team_id=70), Filters(3), Filters(2)])
def test_rollup_equals_bundle_for_any_day(spark, fixture_cat, filters):
    root = rollup.build_rollup(fixture_cat, spark, scratch_path(spark, "t-rollup"))
    for day in (FIX_AS_OF, dt.date(2024, 3, 20), dt.date(2024, 5, 5)):
        want = aging.bundle(fixture_cat, filters, day)
        assert rows_of(rollup.bundle_from_rollup(fixture_cat, spark, root, filters, day)) == rows_of(want)
    got = rollup.bundle_from_rollup(fixture_cat, spark, root, filters, FIX_AS_OF, ("buyer",))
    assert rows_of(got) == rows_of(aging.bundle(fixture_cat, filters, FIX_AS_OF, ("buyer",)))


def test_rollup_refresh(spark, fixture_cat, monkeypatch):
    root = rollup.build_rollup(fixture_cat, spark, scratch_path(spark, "t-rollup"))
    # March loses its lines, an undated line and one of May are new, February changes but is not refreshed
    old = fixture_cat.frames["operation_details"]
    new = spark.createDataFrame([(100, 1000, "FG Packing", "open", Decimal(7), Decimal(2), t, 1, "Zip", "BuyerA")
                                 for t in (None, dt.datetime(2024, 5, 31, 23, 59), dt.datetime(2024, 2, 1))], OD_SCHEMA)
    changed = with_table(fixture_cat, operation_details=old.where(
        "action_date IS NULL OR company_id <> 1 OR action_date < '2024-03-01' OR action_date >= '2024-04-01'").unionByName(new))
    parts = [(1, "2024-03"), (1, "2024-05"), (1, rollup.UNDATED)]
    before = rows_of(rollup.bundle_from_rollup(fixture_cat, spark, root, Filters(1), FIX_AS_OF))
    with monkeypatch.context() as m:
        m.setattr(rollup, "_commit", lambda *_: (_ for _ in ()).throw(RuntimeError()))
        with pytest.raises(RuntimeError):
            rollup.refresh(changed, spark, root, parts)
    assert rows_of(rollup.bundle_from_rollup(fixture_cat, spark, root, Filters(1), FIX_AS_OF)) == before
    rollup.refresh(changed, spark, root, parts)
    expected = with_table(changed, operation_details=changed.frames["operation_details"].where("action_date IS NULL OR action_date <> '2024-02-01'"))
    got = rows_of(rollup.bundle_from_rollup(changed, spark, root, Filters(1), dt.date(2024, 6, 1)))
    assert got == rows_of(aging.bundle(expected, Filters(1), dt.date(2024, 6, 1)))
    assert (1, "2024-03") not in {(r.company_id, r.month) for r in rollup.manifest(spark, root).collect()}
    assert rollup.vacuum(spark, root) == 1       # the version of the failed refresh
    assert rows_of(rollup.bundle_from_rollup(changed, spark, root, Filters(1), dt.date(2024, 6, 1))) == got
    with pytest.raises(FileNotFoundError):
        rollup.read_rollup(spark, scratch_path(spark, "t-none"))


def test_rollup_answers_without_the_fact(spark):
    cat = DriverCatalog(spark, SF0001)
    root = rollup.build_rollup(cat, spark, scratch_path(spark, "t-rollup"))
    plan = rollup.bundle_from_rollup(cat, spark, root, Filters(1), AS_OF)._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan and "orders.parquet" not in plan
    assert re.search(r"PartitionFilters: \[[^\]]*company_id#\d+ = 1", plan)


# ---------------------------------------------------------------- key checks (SRC-1..9)
def test_key_report_counts_violations(spark, fixture_cat):
    so = fixture_cat.frames["sale_order"]
    bad = with_table(fixture_cat, sale_order=so.unionByName(so.where("id = 100")).unionByName(so.where("id = 101").withColumn("id", F.lit(None).cast("bigint"))))
    got = {(r.table_name, r.check_name, r.column_name): (r.checked, r.violations) for r in key_report(bad).collect()}
    assert got[("sale_order", "set", "id")] == (7, 1) and got[("sale_order", "unique", "id")] == (6, 1)
    assert got[("operation_details", "exists", "oa_id")] == (20, 1)          # order 999
    assert got[("operation_details", "exists", "product_id")] == (20, 1)     # product 1004
    assert got[("res_users", "exists", "partner_id")] == (4, 1) and got[("crm_team", "unique", "id")] == (5, 0)
    empty = with_table(fixture_cat, crm_team=fixture_cat.frames["crm_team"].limit(0))
    got = {(r.table_name, r.check_name): (r.checked, r.violations) for r in key_report(empty).where("table_name = 'crm_team'").collect()}
    assert got == {("crm_team", "set"): (0, 0), ("crm_team", "unique"): (0, 0)}


def test_fixed_priorities_are_those_of_the_orders(spark):
    have = {r.o_orderpriority for r in spark.read.parquet(f"{SF0001}/orders.parquet").select("o_orderpriority").distinct().collect()}
    assert have <= set(PRIORITIES)


# ---------------------------------------------------------------- heavy keys (JN-4, REP-8)
def test_a_popular_product_is_spread(spark):
    """A third of all rows on one product, AQE off: no partition of the join gets more than 3 times the mean."""
    rows = spark.range(60_000).selectExpr("id AS oa_id", "CASE WHEN id % 3 = 0 THEN 7 WHEN id % 30 = 1 THEN NULL ELSE id % 5000 END AS product_id")
    dim = spark.range(5000).selectExpr("id AS _product", "concat('p', id) AS name")
    with confs(spark, spark__sql__adaptive__enabled="false", spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__shuffle__partitions="16"):
        for heavy, most in ((1000, 3.0), (1_000_000, 100.0)):
            out = join_dimension(rows, "product_id", dim, "_product", ["oa_id"], heavy_rows=heavy)
            sizes = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect()]
            assert sum(sizes) == 60_000 and max(sizes) <= most * 60_000 / 16
            if heavy > 60_000:
                assert max(sizes) > 5 * 60_000 / 16      # what happens without pieces
            assert out.where("product_id IS NOT NULL AND name <> concat('p', product_id) OR (product_id IS NULL) <> (name IS NULL)").count() == 0


def test_drilldown_with_heavy_products_has_the_same_rows(spark):
    cat = DriverCatalog(spark, SF0001)
    for args in (("payment_terms", "Total", "Total_Balance"), ("buyer", "Brand#1", "Total_Value"), ("item_category", "PROMO", "Value_30+")):
        assert rows_of(drilldown(cat, Filters(1), *args, AS_OF, heavy_rows=1)) == rows_of(drilldown(cat, Filters(1), *args, AS_OF))


# ---------------------------------------------------------------- pruning and folding (FLT-5, FLT-6, SRC-1)
def above_lines(df) -> list[str]:
    """The operators from the fact scan up to the first exchange, of an initial plan (subqueries are no ancestors)."""
    text = df._jdf.queryExecution().executedPlan().toString().splitlines()
    at = next(i for i, line in enumerate(text) if "FileScan parquet" in line and "l_linestatus" in line)
    depth = lambda line: len(re.match(r"[ :+-]*", line)[0])
    out, last = [], depth(text[at])
    for line in reversed(text[:at]):
        if depth(line) < last:
            out.append(line)
            last = depth(line)
            if "Exchange hashpartitioning" in line:
                return out
    raise AssertionError("no exchange")


@pytest.mark.parametrize("dim", ["payment_terms", "item_category"])
def test_a_selection_of_orders_reaches_the_fact_scan(spark, dim):
    cat = DriverCatalog(spark, SF0001)
    prune = {"spark__sql__optimizer__runtime__bloomFilter__applicationSideScanSizeThreshold": "0", "spark__sql__autoBroadcastJoinThreshold": "-1"}
    with confs(spark, **prune):
        df = aging.aging_report(cat, dim, Filters(1, salesperson_id=3), AS_OF)
        lines = above_lines(df)
        assert any("might_contain" in x for x in lines), "the filter is applied before the first exchange"
        fold = next(i for i, x in enumerate(lines) if "HashAggregate" in x)
        assert any("might_contain" in x for x in lines[:fold]), "and before the fold"
        got = rows_of(df)
    with confs(spark, **prune, spark__sql__optimizer__runtime__bloomFilter__enabled="false"):
        df = aging.aging_report(cat, dim, Filters(1, salesperson_id=3), AS_OF)
        assert "might_contain" not in df._jdf.queryExecution().executedPlan().toString() and rows_of(df) == got


def test_lines_are_folded_before_they_meet_the_products(spark):
    cat = DriverCatalog(spark, SF0001)
    with confs(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        plans = [aging.aging_report(cat, d, Filters(1), AS_OF) for d in ("item_category", "buyer")]
        plans += [aging.bundle(cat, Filters(1), AS_OF), drilldown(cat, Filters(1), "buyer", "Brand#1", "Total_Value", AS_OF)]
        for df in plans:
            lines = above_lines(df)
            assert any("HashAggregate" in x and "partial_sum" in x for x in lines) and not any("Join" in x for x in lines)
