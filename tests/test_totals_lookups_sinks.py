"""Totals rows, KPIs, layouts, lookups and sinks on the edge fixture."""

from __future__ import annotations

import datetime as dt

from conftest import FIX_AS_OF

import pytest

from shelfage.operators import aging, lookups, totals
from shelfage.operators.filters import Filters
from shelfage.plans.dashboard import dashboard_summary, download_drilldown, download_excel, get_dashboard_data
from shelfage.schema import EXPORT_METRIC_COLS, METRIC_COLS, SCREEN_METRIC_COLS
from shelfage.session import scratch_path
from shelfage.sinks import committed, drilldown_export_name, export_name, read_detail, read_report, read_rows, read_summary, write_reports


def test_report_with_totals_sums_rounded_rows(fixture_cat):
    rep = aging.aging_report(fixture_cat, "buyer", Filters(1), FIX_AS_OF)
    out = totals.report_with_totals(rep, "buyer").collect()
    tot = [r for r in out if r.row_type == "total"]
    assert len(tot) == 1 and tot[0].Buyer == "Total" and tot[0].row_order == 0
    rows = [r for r in out if r.row_type == "row"]
    assert len(rows) == 4
    # S8/S20: sums of rounded rows, NULL as 0 (BuyerN has NULL Total_Value)
    assert tot[0].Total_Value == 58 + 31 + 0 + 10
    assert tot[0].Total_Balance == 30 + 23 + 7 + 5
    # the NULL label row keeps its NULL label and is not mistaken for the total
    assert any(r.Buyer is None for r in rows)
    # a NULL metric of a detail row stays NULL (only the totals treat it as 0)
    assert [r for r in rows if r.Buyer == "BuyerN"][0].Total_Value is None


def test_totals_last_and_layouts(fixture_cat):
    rep = aging.aging_report(fixture_cat, "item_category", Filters(1), FIX_AS_OF)
    last = totals.report_with_totals(rep, "item_category", totals_first=False)
    assert {r.row_order for r in last.collect() if r.row_type == "total"} == {2}
    assert totals.layout(last, "item_category", "export").columns == ["Item", *EXPORT_METRIC_COLS, "row_type",
                                                                      "row_order"]
    assert totals.layout(rep, "item_category", "screen").columns == ["Item", *SCREEN_METRIC_COLS]
    assert totals.layout(rep, "item_category", "query").columns == ["Item", *METRIC_COLS]


def test_kpis_from_payment_terms_only(fixture_cat):
    reports = get_dashboard_data(fixture_cat, {"company_id": 1}, FIX_AS_OF)
    summary = dashboard_summary(reports)
    k = summary["kpis"].collect()[0]
    assert (k.total_balance, k.total_value) == (30 + 8 + 5 + 22, 48 + 10 + 9 + 32)
    assert (k.balance_0_5, k.value_0_5, k.balance_30_plus, k.value_30_plus) == (21, 38, 3, 10)
    table = summary["kpi_table"].orderBy("position").collect()
    assert [(r.section, r.metric) for r in table] == [
        ("", "Total FG Balance"), ("", "Total FG Value"), ("0-5 Days Summary", "Balance"),
        ("0-5 Days Summary", "Value"), ("30+ Days Summary", "Balance"), ("30+ Days Summary", "Value")]
    labels = summary["kpi_labels"].collect()[0]
    assert labels.total_balance == "0.1 K" and labels.total_value == "0.10 K"
    assert set(summary) >= {f"{d}_with_totals" for d in reports}


def test_thousands_label_rounds_half_up(spark):
    from pyspark.sql import functions as F

    from shelfage.functions.expressions import thousands_label
    df = spark.createDataFrame([(1250,), (1234567,), (None,), (-1250,)], "v bigint")
    got = [r[0] for r in df.select(thousands_label(F.col("v"), 1)).collect()]
    assert got == ["1.3 K", "1,234.6 K", "0 K", "-1.3 K"]


def test_lookups(fixture_cat):
    comp = {r.id for r in lookups.companies(fixture_cat).collect()}
    assert comp == {1, 3}
    users = {r.id: r.name for r in lookups.salespersons(fixture_cat).collect()}
    assert users == {7: "Acme", 8: "Zeta", 9: "Unknown"}  # user 10 has no team; 9 has no partner
    assert {r.id for r in lookups.salespersons(fixture_cat, "zet").collect()} == {8}
    t1 = {r.name for r in lookups.teams(fixture_cat, 1).collect()}
    assert t1 == {"North Sales", "Global", "north export"}
    assert {r.name for r in lookups.teams(fixture_cat, None).collect()} == {"Global", "north export"}
    assert {r.name for r in lookups.teams(fixture_cat, 1, "NORTH").collect()} == {"North Sales", "north export"}
    # wildcards in the search term are literal
    assert lookups.teams(fixture_cat, 1, "%").count() == 0


def test_export_names():
    assert export_name(dt.date(2024, 3, 31)) == "FG_Stock_Aging_20240331"
    assert drilldown_export_name("Net 30", "Balance_0-5") == "Net_30_Balance_0-5"


def test_export_roundtrip(spark, fixture_cat):
    out = download_excel(fixture_cat, {"company_id": 1}, FIX_AS_OF, scratch_path(spark, "t-export"))
    assert out.endswith("FG_Stock_Aging_20240331")
    buyer = read_report(spark, out, "buyer").collect()
    assert len(buyer) == 5 and sum(r.row_type == "total" for r in buyer) == 1
    assert buyer[0].__fields__[1:] == [*EXPORT_METRIC_COLS, "row_type", "row_order", "position"]
    summary = read_summary(spark, out).orderBy("position").collect()
    assert [r.value for r in summary] == [65, 99, 21, 38, 3, 10]


def test_export_csv(spark, fixture_cat):
    out = download_excel(fixture_cat, {"company_id": 1}, FIX_AS_OF, scratch_path(spark, "t-csv"), fmt="csv")
    other = download_excel(fixture_cat, {"company_id": 1}, FIX_AS_OF, scratch_path(spark, "t-csv"))
    for d in ("payment_terms", "item_category", "customer", "buyer"):
        a, b = read_report(spark, out, d, fmt="csv").drop("position"), read_report(spark, other, d).drop("position")
        assert a.dtypes == b.dtypes
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert read_summary(spark, out, "csv").orderBy("position").collect() == read_summary(spark, other).orderBy("position").collect()


def test_export_of_some_reports_writes_only_them(spark, fixture_cat):
    stacked = aging.bundle(fixture_cat, Filters(1), FIX_AS_OF, ("buyer",))
    out = write_reports(stacked, scratch_path(spark, "t-part"), FIX_AS_OF, dimensions=("buyer",))
    assert {r.dimension for r in read_rows(spark, committed(spark, out, "reports", "parquet")).select("dimension").distinct().collect()} == {"buyer"}
    with pytest.raises(FileNotFoundError):
        read_summary(spark, out)
    rows = read_report(spark, out, "buyer").orderBy("position").collect()
    assert rows[0].row_type == "total" and [r.Buyer for r in rows[1:]] == sorted((r.Buyer for r in rows[1:]), key=lambda x: (x is None, x))


@pytest.mark.parametrize("label", ['{"fr_FR": "5-LOW"}', "A/B", "../../esc", "a:b", None, "..", "", "x" * 400, "é %=#?*"])
def test_drilldown_export_of_any_label(spark, fixture_cat, tmp_path, label):
    out = download_drilldown(fixture_cat, {"company_id": 1}, "customer", label, "Value_30+", FIX_AS_OF, str(tmp_path))
    assert [p.name for p in tmp_path.iterdir()] == [out.rsplit("/", 1)[1]] and (tmp_path / out.rsplit("/", 1)[1]).is_dir()
    rows = read_detail(spark, out).orderBy("position").collect()
    assert rows[-1].row_type == "total" and rows[0].export_name == drilldown_export_name(label, "Value_30+")
    assert rows[0].title.startswith("Breakdown for Customer: ")


def test_a_company_is_required(fixture_cat):
    with pytest.raises(ValueError):
        get_dashboard_data(fixture_cat, {}, FIX_AS_OF)
    with pytest.raises(ValueError):
        download_drilldown(fixture_cat, None, "customer", "Acme", "Total_Value", FIX_AS_OF)


def test_drilldown_export(spark, fixture_cat):
    out = download_drilldown(fixture_cat, {"company_id": 1}, "payment_terms", "Net 30", "Balance_0-5", FIX_AS_OF,
                             scratch_path(spark, "t-drill"))
    assert out.endswith("Net_30_Balance_0-5")
    rows = read_detail(spark, out).collect()
    total = [r for r in rows if r.row_type == "total"][0]
    assert (float(total.Qty), total.Value) == (16.0, 28)


def test_empty_selection_still_has_zero_totals(spark, fixture_cat):
    """An empty report keeps its Total row (zeros) and the KPIs are 0, not NULL, as on the screen."""
    from shelfage.operators import drilldown as dd
    rep = aging.aging_report(fixture_cat, "customer", Filters(1, salesperson_id=12345), FIX_AS_OF)
    assert rep.count() == 0
    out = totals.report_with_totals(rep, "customer").collect()
    assert len(out) == 1 and out[0].row_type == "total" and out[0].Customer == "Total"
    assert all(out[0][c] == 0 for c in METRIC_COLS)
    k = totals.kpi_summary(rep).collect()[0]
    assert k.total_value == 0 and totals.kpi_labels(totals.kpi_summary(rep)).collect()[0].total_value == "0.00 K"
    det = dd.drilldown(fixture_cat, Filters(1), "customer", "Nobody", "Total_Balance", FIX_AS_OF, with_total=True)
    rows = det.collect()
    assert len(rows) == 1 and rows[0].OA == "Total" and rows[0].Qty == 0 and rows[0].Value == 0
    stacked = aging.bundle(fixture_cat, Filters(1, salesperson_id=12345), FIX_AS_OF)
    tot = totals.bundle_with_totals(stacked).collect()
    assert sorted(r.dimension for r in tot) == sorted(["payment_terms", "item_category", "customer", "buyer"])
    assert all(r.row_type == "total" and r.Total_Balance == 0 for r in tot)
