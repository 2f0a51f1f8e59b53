"""Driver-side helpers: bucket selector parsing, titles, LIKE escaping, filter parsing."""

from __future__ import annotations

from shelfage.functions.expressions import bucket_bounds, clean_bucket_name, escape_like
from shelfage.operators.drilldown import drilldown_title, group_selected
from shelfage.operators.filters import Filters


def test_bucket_selector():
    assert clean_bucket_name("Balance_0-5") == clean_bucket_name("Value_0-5") == "0-5"
    assert clean_bucket_name("Total_Balance") == "Balance"
    assert bucket_bounds("Value_30+") == (31, None)
    assert bucket_bounds("Balance_26-30") == (26, 30)
    assert bucket_bounds("Total_Value") is None and bucket_bounds(None) is None and bucket_bounds("x") is None


def test_group_selection():
    assert group_selected("customer", "Acme")
    assert not group_selected("customer", "Total")
    assert not group_selected("customer", "")
    assert not group_selected("customer", None)
    assert not group_selected("warehouse", "Acme")


def test_title():
    assert drilldown_title("payment_terms", "Net 30", "0-5 Days") == "Breakdown for Payment Terms: Net 30 (0-5 Days)"
    assert drilldown_title("item_category", None, "Total") == "Breakdown for Item: Total (Total)"
    assert drilldown_title("other", "x", "y") == "Breakdown for Buyer: x (y)"


def test_escape_like():
    assert escape_like("50%_a\\b") == "50\\%\\_a\\\\b"


def test_filters_from_mapping():
    f = Filters.from_mapping({"company_id": 0, "salesperson_id": 0, "team_id": None}, default_company=3)
    assert f.company == 3 and not f.needs_orders and f.order_predicate() is None
    g = Filters.from_mapping({"company_id": 2, "salesperson_id": 4, "team_id": 9})
    assert g.company == 2 and g.needs_orders and g.order_columns() == ["user_id", "team_id"]


def test_shared_dir_refuses_local_guess_on_a_cluster():
    import pytest

    from shelfage.session import shared_dir

    class _SC:
        master = "spark://cluster:7077"

        def getCheckpointDir(self):
            return None

    class _Conf:
        def get(self, key, default=None):
            return default

    class _Spark:
        sparkContext = _SC()
        conf = _Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(_Spark())
