"""Canonical tables from the driver's data: key uniqueness and types (FIXTURES.md section 1)."""

from __future__ import annotations

import pytest
from conftest import SF001

from shelfage.schema import TABLE_COLUMNS
from shelfage.sources import DriverCatalog

DIMENSIONS = ["sale_order", "account_payment_term", "res_partner", "product_product", "product_template",
              "res_company", "res_users", "crm_team"]


@pytest.mark.parametrize("table", DIMENSIONS)
def test_dimension_ids_unique_and_present(spark, table):
    """A duplicate id would multiply fact rows in the left joins; the reports rely on unique keys."""
    df = DriverCatalog(spark, SF001).table(table, ["id"])
    bad = df.groupBy("id").count().where("count > 1 OR id IS NULL")
    assert bad.count() == 0


def test_canonical_types(spark):
    cat = DriverCatalog(spark, SF001)
    od = {f.name: f.dataType.simpleString() for f in cat.table("operation_details").schema.fields}
    assert od == {
        "oa_id": "bigint", "product_id": "bigint", "next_operation": "string", "state": "string",
        "fg_balance": "decimal(14,2)", "price_unit": "decimal(14,2)", "action_date": "timestamp_ntz",
        "company_id": "int", "fg_categ_type": "string", "buyer_name": "string",
    }
    for name, cols in TABLE_COLUMNS.items():
        assert cat.table(name).columns == list(cols)
    crm = {f.name: f.dataType.simpleString() for f in cat.table("crm_team").schema.fields}
    assert crm["is_sales"] == "boolean"


def test_column_subset_leaves_out_unneeded_joins(spark):
    cat = DriverCatalog(spark, SF001)
    plan = cat.table("operation_details", ["oa_id", "fg_balance"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan  # the part join feeds only category / buyer
    plan = cat.table("sale_order", ["id", "user_id"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan  # the customer join feeds only team_id
