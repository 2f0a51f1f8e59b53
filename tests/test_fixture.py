"""Edge-case fixture: expected values of FIXTURES.md section 2 (rules S1-S18)."""

from __future__ import annotations

from decimal import Decimal

import pytest
from conftest import FIX_AS_OF

from shelfage.operators import aging, drilldown as dd
from shelfage.operators.filters import Filters
from shelfage.plans.dashboard import get_dashboard_data
from shelfage.schema import DIMENSIONS, METRIC_COLS

N = None
# label -> Balance x7, Value x7, Total_Balance, Total_Value (section 2.1, company 1, rounded)
EXPECTED = {
    "payment_terms": {
        "Net 30": [16, 4, 0, 0, 0, 0, 0, 28, 10, 0, 0, 0, 0, 0, 30, 48],
        '{"en_US": null, "fr_FR": "X"}': [0, 0, 7, 1, 0, 0, 0, 0, 0, 0, 10, 0, 0, 0, 8, 10],
        '{"fr_FR": "Comptant"}': [0, 3, 2, 0, 0, 0, 0, 0, 3, 6, 0, 0, 0, 0, 5, 9],
        None: [5, 0, 0, 0, 8, 6, 3, 10, 0, 0, 0, 4, 8, 10, 22, 32],
    },
    "item_category": {
        "Button": [0, 0, 9, 1, 8, 0, 0, 0, 0, 6, 10, 4, 0, 0, 18, 20],
        "Zip": [16, 7, 0, 0, 0, 6, 3, 28, 13, 0, 0, 0, 8, 10, 42, 69],
        None: [5, 0, 0, 0, 0, 0, 0, 10, 0, 0, 0, 0, 0, 0, 5, 10],
    },
    "customer": {
        "Acme": [16, 7, 2, 0, 0, 0, 0, 28, 13, 6, 0, 0, 0, 0, 35, 57],
        "Zeta": [0, 0, 7, 1, 0, 0, 0, 0, 0, 0, 10, 0, 0, 0, 8, 10],
        None: [5, 0, 0, 0, 8, 6, 3, 10, 0, 0, 0, 4, 8, 10, 22, 32],
    },
    "buyer": {
        "BuyerA": [16, 0, 0, 1, 0, 0, 3, 28, 0, 0, 10, 0, 0, 10, 30, 58],
        "BuyerB": [0, 7, 2, 0, 8, 6, 0, 0, 13, 6, 0, 4, 8, 0, 23, 31],
        "BuyerN": [0, 0, 7, 0, 0, 0, 0, 0, 0, N, 0, 0, 0, 0, 7, N],
        None: [5, 0, 0, 0, 0, 0, 0, 10, 0, 0, 0, 0, 0, 0, 5, 10],
    },
}


def _as_dict(df, label):
    rows = df.collect()
    return {r[label]: [r[c] for c in METRIC_COLS] for r in rows}, [r[label] for r in rows]


@pytest.mark.parametrize("dim", list(DIMENSIONS))
def test_dashboard_report(fixture_cat, dim):
    df = aging.aging_report(fixture_cat, dim, Filters(1), FIX_AS_OF)
    got, order = _as_dict(df, DIMENSIONS[dim].label)
    assert got == EXPECTED[dim]
    assert order[-1] is None  # S13: NULL group last
    assert order[:-1] == sorted(order[:-1])


def test_bundle_equals_single_reports(fixture_cat):
    """I8: the one-pass bundle gives exactly the four single reports."""
    reports = get_dashboard_data(fixture_cat, {"company_id": 1}, FIX_AS_OF)
    for dim, df in reports.items():
        got, _ = _as_dict(df, DIMENSIONS[dim].label)
        assert got == EXPECTED[dim], dim


def test_salesperson_filter_drops_orderless_rows(fixture_cat):
    """S15: a salesperson filter turns the order join into an inner one (row 13 disappears)."""
    df = aging.aging_report(fixture_cat, "payment_terms", Filters(1, salesperson_id=8), FIX_AS_OF)
    got, _ = _as_dict(df, "Payment Terms")
    assert got == {
        '{"en_US": null, "fr_FR": "X"}': EXPECTED["payment_terms"]['{"en_US": null, "fr_FR": "X"}'],
        None: [0, 0, 0, 0, 8, 6, 3, 0, 0, 0, 0, 4, 8, 10, 17, 22],
    }


def test_falsy_company_is_default_company(fixture_cat):
    """S14: company 0 / None means the default company, never all companies."""
    a = aging.aging_report(fixture_cat, "item_category", Filters.from_mapping({"company_id": 0}, default_company=1), FIX_AS_OF)
    got, _ = _as_dict(a, "Item")
    assert got == EXPECTED["item_category"]


def test_plain_item_report_unrounded_all_companies(fixture_cat):
    """Section 2.2: no company filter, exact decimals."""
    df = aging.plain_report(fixture_cat, "item_category", FIX_AS_OF)
    got, _ = _as_dict(df, "Item")
    D = Decimal
    exp = {
        "Button": ["0", "0", "9", "1", "8", "0", "0", "0", "0", "6", "9.99", "4", "0", "0", "18", "19.99"],
        "Zip": ["96", "7", "0", "0", "0", "6", "2.5", "108.315", "13", "0", "0", "0", "7.5", "10", "121.5", "148.815"],
        None: ["5", "0", "0", "0", "0", "0", "0", "10", "0", "0", "0", "0", "0", "0", "5", "10"],
    }
    assert {k: [D(x) for x in v] for k, v in exp.items()} == got


def _detail(df):
    return sorted(((r.OA, r.Category, r.Product, float(r.Qty), r.Value) for r in df.collect()),
                  key=lambda t: tuple("" if x is None else str(x) for x in t))


ALL = [("OA-100", "Zip", "Zipper", 16.0, 28), ("OA-100", "Zip", "Zipper", 4.0, 10),
       ("OA-101", "Button", '{"fr_FR": "Bouton"}', 2.0, 6), ("OA-101", "Zip", "Zipper", 3.0, 3),
       ("OA-102", "Button", '{"fr_FR": "Bouton"}', 7.0, None), ("OA-102", "Button", None, 1.0, 10),
       ("OA-103", "Button", None, 8.0, 4), ("OA-103", "Zip", "Zipper", 2.5, 10), ("OA-103", "Zip", None, 6.0, 8),
       ("OA-104", "Zip", "Zipper", 10.0, 10), (None, None, "Zipper", 5.0, 10)]


@pytest.mark.parametrize("group_type,group_value,bucket,expected", [
    ("payment_terms", "Total", "Total_Balance", ALL),
    ("customer", None, "Value", ALL),                        # falsy value, unknown bucket name
    ("warehouse", "Anything", "Total_Value", ALL),           # unknown group type
    ("payment_terms", "Total", "Balance_0-5", [ALL[0], ALL[-1]]),
    ("payment_terms", "Total", "Value_0-5", [ALL[0], ALL[-1]]),  # S16: same rows
    ("payment_terms", "Net 30", "Total_Balance", [ALL[0], ALL[1], ALL[9]]),
    ("customer", "Acme", "Total_Balance", [ALL[0], ALL[1], ALL[2], ALL[3], ALL[9]]),
])
def test_drilldown(fixture_cat, group_type, group_value, bucket, expected):
    df = dd.drilldown(fixture_cat, Filters(1), group_type, group_value, bucket, FIX_AS_OF)
    assert df.columns == ["OA", "Category", "Product", "Qty", "Value"]
    assert _detail(df) == sorted(expected, key=lambda t: tuple("" if x is None else str(x) for x in t))


def test_drilldown_order_null_last(fixture_cat):
    rows = dd.drilldown(fixture_cat, Filters(1), "payment_terms", "Total", "Total_Balance", FIX_AS_OF).collect()
    oas = [r.OA for r in rows]
    assert oas[-1] is None and oas[:-1] == sorted(oas[:-1])


def test_drilldown_null_group_option(fixture_cat):
    """S18 option: select the NULL group instead of every group."""
    df = dd.drilldown(fixture_cat, Filters(1), "payment_terms", None, "Total_Balance", FIX_AS_OF, null_group=True)
    got = _detail(df)
    # payment term NULL: order 103 (no term) and the missing order 999
    assert {r[0] for r in got} == {"OA-103", None}
    assert sum(r[3] for r in got) == 21.5  # report cell shows it rounded: 22


def test_drilldown_with_total(fixture_cat):
    df = dd.drilldown(fixture_cat, Filters(1), "buyer", "BuyerN", "Total_Value", FIX_AS_OF, with_total=True)
    rows = {r.row_type: r for r in df.collect()}
    assert rows["detail"].Value is None and float(rows["detail"].Qty) == 7.0
    assert rows["total"].OA == "Total" and rows["total"].Value == 0  # S20: NULL counts as 0
    generic = dd.drilldown_with_total(dd.drilldown(fixture_cat, Filters(1), "buyer", "BuyerN", "Total_Value",
                                                   FIX_AS_OF))
    assert sorted(map(tuple, generic.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("filters,group_type,group_value,null_group,expected", [
    (Filters(1, salesperson_id=7), "customer", "Acme", False, [ALL[0], ALL[1], ALL[2], ALL[3]]),
    (Filters(1, team_id=70), "payment_terms", "Net 30", False, [ALL[0], ALL[1], ALL[9]]),
    (Filters(1, salesperson_id=8), "customer", None, True, [ALL[6], ALL[7], ALL[8]]),
    (Filters(1), "customer", "Nobody", False, []),
])
def test_drilldown_order_restrictions_both_plans(spark, fixture_cat, filters, group_type, group_value,
                                                 null_group, expected):
    """Order-side restrictions give the same rows whether their ids are broadcast
    (pruning the raw lines) or joined after the fold (threshold disabled)."""
    key = lambda t: tuple("" if x is None else str(x) for x in t)
    small = dd.drilldown(fixture_cat, filters, group_type, group_value, "Total_Balance", FIX_AS_OF, null_group)
    assert _detail(small) == sorted(expected, key=key)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        big = dd.drilldown(fixture_cat, filters, group_type, group_value, "Total_Balance", FIX_AS_OF, null_group)
        assert _detail(big) == sorted(expected, key=key)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_null_group_option_takes_precedence(fixture_cat):
    """null_group=True selects the NULL group even when a group value is passed too."""
    for gt in ("customer", "buyer"):
        a = dd.drilldown(fixture_cat, Filters(1), gt, None, "Total_Balance", FIX_AS_OF, null_group=True)
        b = dd.drilldown(fixture_cat, Filters(1), gt, "Acme", "Total_Balance", FIX_AS_OF, null_group=True)
        assert _detail(a) == _detail(b) and len(_detail(a)) > 0
