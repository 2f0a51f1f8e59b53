"""Property tests: random fact rows against a brute-force evaluation in plain Python.

The brute force follows the SQL semantics row by row (three-valued logic
for NULL states, CASE ... ELSE 0 sums, NULL-skipping SUM, HALF_UP rounding
after the sum, LEFT JOIN misses giving NULL labels); the Spark plans must
agree on every report and on drill-down totals.
"""

from __future__ import annotations

import datetime as dt
import json
from collections import defaultdict
from decimal import ROUND_HALF_UP, Decimal

import pytest
from conftest import OD_SCHEMA
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from shelfage.operators import aging, drilldown as dd
from shelfage.operators.filters import Filters
from shelfage.schema import BUCKETS, DIMENSIONS, METRIC_COLS
from shelfage.sources import DataFrameCatalog

AS_OF = dt.date(2024, 6, 30)
ORDERS = {  # id -> (name, partner_id, payment_term_id, user_id, team_id)
    1: ("OA-1", 10, 1, 5, 50), 2: ("OA-2", 11, 2, 5, 51), 3: ("OA-3", 12, None, 6, 50),
    4: ("OA-4", None, 3, None, None), 5: ("OA-5", 10, 1, 6, 51),
}
TERMS = {1: '{"en_US": "Net 30"}', 2: '{"fr_FR": "Comptant"}', 3: '{"en_US": null}'}
PARTNERS = {10: "Acme", 11: "Acme", 12: "Zeta"}
PRODUCTS = {100: 500, 101: 501, 102: 502}
TEMPLATES = {500: '{"en_US": "Zipper"}', 501: '{"en_US": "Zipper", "fr_FR": "F"}', 502: None}

money = st.one_of(st.none(), st.decimals(min_value=-5, max_value=500, places=2, allow_nan=False,
                                         allow_infinity=False))
row = st.tuples(
    st.sampled_from([1, 2, 3, 4, 5, 99, None]),                    # oa_id (99: no such order)
    st.sampled_from([100, 101, 102, 103, None]),                    # product_id (103: missing)
    st.sampled_from(["FG Packing", "FG Packing", "FG Packing", "Dyeing", None]),
    st.sampled_from(["open", "open", "draft", "done", "closed", None]),
    money, money,
    st.one_of(st.none(), st.integers(min_value=-5, max_value=60)),  # days before AS_OF
    st.integers(min_value=0, max_value=23),                         # hour
    st.sampled_from([1, 1, 2]),
    st.sampled_from(["Zip", "Button", None]),
    st.sampled_from(["BuyerA", "BuyerB", None]),
)


def _label(js):
    if js is None:
        return None
    v = json.loads(js).get("en_US")
    return v if v is not None else js


def _bucket(age):
    if age is None:
        return None
    for name, lo, hi in BUCKETS:
        if age >= lo and (hi is None or age <= hi):
            return name
    return None


def _r0(x):
    return None if x is None else int(x.quantize(Decimal(1), rounding=ROUND_HALF_UP))


def _lines(rows, company=1):
    out = []
    for (oa, prod, stage, state, bal, price, days, hour, comp, cat, buyer) in rows:
        if stage != "FG Packing" or state is None or state in ("done", "closed"):
            continue
        if bal is None or bal <= 0 or comp != company:
            continue
        age = days  # whole days: the hour is dropped before subtracting
        order = ORDERS.get(oa)
        labels = {
            "payment_terms": _label(TERMS.get(order[2])) if order else None,
            "item_category": cat,
            "customer": PARTNERS.get(order[1]) if order else None,
            "buyer": buyer,
        }
        tmpl = PRODUCTS.get(prod)
        out.append(dict(bal=bal, value=None if price is None else bal * price, bucket=_bucket(age), labels=labels,
                        oa=order[0] if order else None, cat=cat, pt=TEMPLATES.get(tmpl) if tmpl else None))
    return out


def brute_report(rows, dim):
    groups = defaultdict(list)
    for ln in _lines(rows):
        groups[ln["labels"][dim]].append(ln)
    res = {}
    for label, lns in groups.items():
        vals = []
        for key in ("bal", "value"):
            for name, _, _ in BUCKETS:
                terms = [ln[key] if ln["bucket"] == name else Decimal(0) for ln in lns]
                nn = [t for t in terms if t is not None]
                vals.append(_r0(sum(nn, Decimal(0))) if nn else None)
        for key in ("bal", "value"):
            nn = [ln[key] for ln in lns if ln[key] is not None]
            vals.append(_r0(sum(nn, Decimal(0))) if nn else None)
        # reorder: balances, values, totals
        res[label] = vals[0:7] + vals[7:14] + vals[14:16]
    return res


def _catalog(spark, rows):
    od = spark.createDataFrame(
        [(oa, prod, stage, state, bal, price,
          None if days is None else dt.datetime.combine(AS_OF - dt.timedelta(days=days), dt.time(hour)),
          comp, cat, buyer)
         for (oa, prod, stage, state, bal, price, days, hour, comp, cat, buyer) in rows], OD_SCHEMA)
    return DataFrameCatalog({
        "operation_details": od,
        "sale_order": spark.createDataFrame([(k, *v) for k, v in ORDERS.items()],
                                            "id bigint, name string, partner_id bigint, payment_term_id int, "
                                            "user_id bigint, team_id int"),
        "account_payment_term": spark.createDataFrame(list(TERMS.items()), "id int, name string"),
        "res_partner": spark.createDataFrame(list(PARTNERS.items()), "id bigint, name string"),
        "product_product": spark.createDataFrame(list(PRODUCTS.items()), "id bigint, product_tmpl_id bigint"),
        "product_template": spark.createDataFrame(list(TEMPLATES.items()), "id bigint, name string"),
    })


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(row, min_size=0, max_size=40))
def test_reports_and_drilldown_match_brute_force(spark, rows):
    cat = _catalog(spark, rows)
    stacked = aging.bundle(cat, Filters(1), AS_OF).collect()
    for dim in DIMENSIONS:
        want = brute_report(rows, dim)
        got = {r.label: [r[c] for c in METRIC_COLS] for r in stacked if r.dimension == dim}
        assert got == want, dim
    lines = _lines(rows)
    for name, _, _ in BUCKETS:
        det = dd.drilldown(cat, Filters(1), "payment_terms", "Total", f"Balance_{name}", AS_OF).collect()
        want_qty = sum((ln["bal"] for ln in lines if ln["bucket"] == name), Decimal(0))
        assert sum((r.Qty for r in det), Decimal(0)) == want_qty
        # groups: (order name, category, raw product JSON)
        keys = {(ln["oa"], ln["cat"], ln["pt"]) for ln in lines if ln["bucket"] == name}
        assert len(det) == len(keys)
        want_val = sum((_r0(ln["value"]) for ln in lines if ln["bucket"] == name and ln["value"] is not None), 0)
        assert sum((r.Value or 0) for r in det) == want_val


@pytest.mark.parametrize("days,hour,expected", [(0, 23, "0-5"), (5, 0, "0-5"), (6, 12, "6-10"), (30, 1, "26-30"),
                                                (31, 0, "30+"), (-1, 0, None)])
def test_bucket_edges(spark, days, hour, expected):
    rows = [(1, 100, "FG Packing", "open", Decimal("1.00"), Decimal("1.00"), days, hour, 1, "Zip", "BuyerA")]
    got = aging.long_cube(_catalog(spark, rows), Filters(1), AS_OF, ["buyer"]).collect()
    assert [r.bucket for r in got] == [expected]
