"""Drill-down: the order / category / product rows behind one report cell.

Plan shape:

1. Fact scan with the stock and company predicates, and the cell's age
   range rewritten onto the raw ``action_date`` column so that it reaches
   the parquet reader as a pushed range filter (row groups outside it are
   skipped).
2. Partial aggregate by ``(oa_id, fg_categ_type, product_id)``. Qty is a
   plain sum and Value is a sum of per-line rounded values, so both are
   additive and can be folded before any join; a hot order or the NULL
   order becomes a few partial rows per task instead of millions of lines.
3. One join of the folded rows with the orders: a left join for the order
   name, an inner join with the restricted orders when a salesperson, a
   team, a payment term or a customer is selected. Rows without an order
   carry a second join key that spreads them.
   Then one join with everything known by product (template name, and the
   category where the catalog keeps it by product): the dimension tables are
   joined with each other first, so the large side is joined once, and a
   popular product is cut into pieces (``keyed.join_dimension``).
4. Final aggregate by ``(order name, category, product JSON)``. The JSON is
   compared by value: its keys are put in one order first, on the
   dimension's rows.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import (action_date_range, as_date, bucket_bounds, json_order_sql, json_value_sql, label_order, round0_sql,
                                     translated_label_sql)
from ..schema import DIMENSIONS, TOTAL_WORD
from ..sources.catalog import Catalog
from .aging import FACT_COLUMN, order_spread
from .filters import Filters, fact_predicate
from .keyed import HEAVY_ROWS, join_dimension
from .totals import seeded

DETAIL_COLUMNS = ("OA", "Category", "Product", "Qty", "Value")


def group_selected(group_type: str | None, group_value: str | None) -> bool:
    """True when the cell selects one group (S17: 'Total', falsy or unknown type select all)."""
    return bool(group_value) and group_value != TOTAL_WORD and group_type in DIMENSIONS


def _products(cat: Catalog, keyed: list[str]) -> DataFrame:
    """_product, _pt_name and the fact attributes kept by product; dimension tables only."""
    pp = cat.table("product_product", ["id", "product_tmpl_id"]).selectExpr("id AS _pp_id", "product_tmpl_id")
    pt = cat.table("product_template", ["id", "name"]).selectExpr("id AS _pt_id", f"{json_value_sql('name')} AS _pt_name")
    product = pp.join(pt, F.expr("product_tmpl_id = _pt_id"), "left").select("_pp_id", "_pt_name")
    if not keyed:
        return product.withColumnRenamed("_pp_id", "_product")
    attributes = cat.attributes(keyed).withColumnRenamed(cat.fact_key, "_key")
    return product.join(attributes, F.expr("_pp_id = _key"), "full").select(F.coalesce("_pp_id", "_key").alias("_product"), "_pt_name", *keyed)


def drilldown(cat: Catalog, filters: Filters | dict | None = None, group_type: str | None = None,
              group_value: str | None = None, bucket: str | None = None,
              as_of: dt.date | str | None = None, null_group: bool = False,
              with_total: bool = False, default_company: int | None = None,
              collation: str | None = None, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """Detail rows ``OA, Category, Product, Qty, Value`` of one report cell (REP-8).

    ``bucket`` is the clicked metric column (``Balance_6-10``, ``Value_30+``,
    ``Total_Balance`` ...); a name that is not a bucket means every age,
    including future and undated lines. ``null_group=True`` selects the
    NULL group of ``group_type`` instead of the reference's "all groups".
    ``with_total=True`` adds the ``Total`` row (REP-11) from the same
    aggregate, with ``row_type`` / ``row_order`` columns. ``collation``
    orders the order names linguistically (``UNICODE``) instead of by bytes.
    """
    if not isinstance(filters, Filters):
        filters = Filters.from_mapping(filters, default_company)
    as_of = as_date(as_of)

    select_group = group_selected(group_type, group_value)
    by_null = null_group and group_type in DIMENSIONS
    fact_side = group_type in FACT_COLUMN and (select_group or by_null)
    group_column = FACT_COLUMN[group_type] if fact_side else None
    wanted = list(dict.fromkeys(["fg_categ_type", *([group_column] if fact_side else [])]))
    keyed = [c for c in wanted if c in cat.keyed_columns]
    stored = [c for c in wanted if c not in keyed]
    od = cat.table("operation_details", ["oa_id", "product_id", "next_operation", "state", "fg_balance", "price_unit", "action_date",
                                         "company_id", *stored])

    def selected() -> Column:
        col = F.col(group_column)
        return col.isNull() if by_null else col == F.lit(group_value)

    pred = fact_predicate(filters.company)
    bounds = bucket_bounds(bucket)
    if bounds is not None:
        pred = pred & action_date_range(as_of, bounds, od.schema["action_date"].dataType)
    if group_column in stored:
        pred = pred & selected()
    lines = od.where(pred)

    # Map-side-combinable partial sums per (order, category, product); a category kept by product follows from it.
    categ = [c for c in ("fg_categ_type",) if c in stored]
    part = lines.groupBy("oa_id", *categ, "product_id").agg(
        F.expr("sum(fg_balance) AS _qty"),
        F.expr("sum(round(fg_balance * price_unit, 0)) AS _value"),
    )
    spread = ["oa_id", "product_id", *categ]
    products = _products(cat, keyed)

    def with_product(rows: DataFrame) -> DataFrame:
        # a selected category or buyer restricts the products; lines without a product have neither
        if group_column in keyed and not by_null:
            return join_dimension(rows, "product_id", products.where(selected()), "_product", spread, "inner", part, heavy_rows)
        out = join_dimension(rows, "product_id", products, "_product", spread, "left", part, heavy_rows)
        return out.where(selected()) if group_column in keyed else out

    # Orders the cell is restricted to: salesperson / team (S15) and, for a selected (or the
    # NULL) payment term or customer, the orders carrying that label. One join with the orders
    # brings the name and applies the restriction.
    order_group = group_type in ("payment_terms", "customer") and (select_group or by_null)
    so_cols = ["id", "name", *filters.order_columns()]
    if order_group:
        so_cols.append("payment_term_id" if group_type == "payment_terms" else "partner_id")
    so = cat.table("sale_order", list(dict.fromkeys(so_cols)))
    if filters.needs_orders:
        so = so.where(filters.order_predicate())
    inner = filters.needs_orders
    if order_group:
        if group_type == "payment_terms":
            names = cat.table("account_payment_term", ["id", "name"]) \
                .selectExpr("id AS _grp_id", f"{json_value_sql('name')} AS _term").selectExpr("_grp_id", f"{translated_label_sql('_term')} AS _grp")
            key = "payment_term_id = _grp_id"
        else:
            names = cat.table("res_partner", ["id", "name"]).selectExpr("id AS _grp_id", "name AS _grp")
            key = "partner_id = _grp_id"
        if by_null:
            so = so.join(names, F.expr(key), "left")
        else:
            so = so.join(names.where(F.col("_grp") == F.lit(group_value)), F.expr(key), "inner")
            inner = True
    so = so.withColumnsRenamed({"id": "_so_id", "name": "_oa"})
    on = "oa_id = _so_id"
    # products first where they are restricted, the orders first otherwise
    j = with_product(part) if group_column in keyed else part
    if not cat.co_located:
        # lines without an order match nothing: a second key deals them over all partitions
        so = so.withColumn("_zero", F.expr("CAST(pmod(_so_id, 1) AS BIGINT)"))
        j = j.withColumn("_spread", F.expr(order_spread("oa_id", ["product_id", *(c for c in j.columns if c == "fg_categ_type")])))
        on += " AND _spread = _zero"
    j = j.join(so, F.expr(on), "inner" if inner else "left").drop("_spread", "_zero")
    if order_group and by_null:
        j = j.where(F.col("_grp").isNull())
    if group_column not in keyed:
        j = with_product(j)

    keys = ["_oa", "fg_categ_type", "_pt_name"]
    order = [*label_order(F.col("_oa"), collation), F.expr(json_order_sql("_pt_name")).asc_nulls_last(), F.col("fg_categ_type").asc_nulls_last()]
    if not with_total:
        out = j.groupBy(*keys).agg(F.expr("sum(_qty) AS Qty"), F.expr("sum(_value) AS Value"))
        return (out.orderBy(*order)
                .selectExpr("_oa AS OA", "fg_categ_type AS Category",
                            f"{translated_label_sql('_pt_name')} AS Product", "Qty",
                            f"{round0_sql('Value')} AS Value"))
    # Detail groups and the grand total from one aggregate (GROUPING SETS
    # (keys, ())); told apart by grouping id, as NULL keys are real groups.
    # A seed row makes the total exist (as zeros) for an empty selection.
    base = seeded(j.select(*keys, "_qty", "_value"), [], [()])
    out = base.groupingSets([[F.col(k) for k in [*keys, "_seed"]], []], *keys, "_seed").agg(
        F.expr("sum(_qty) AS Qty"), F.expr("sum(_value) AS Value"),
        F.expr("grouping_id(_oa, fg_categ_type, _pt_name, _seed) AS _gid"))
    out = out.where(F.expr("NOT (_gid = 0 AND _seed = 1)"))
    out = out.orderBy(F.expr("CASE WHEN _gid = 0 THEN 0 ELSE 1 END"), *order)
    return out.selectExpr(
        f"CASE WHEN _gid = 0 THEN _oa ELSE '{TOTAL_WORD}' END AS OA",
        "CASE WHEN _gid = 0 THEN fg_categ_type END AS Category",
        f"CASE WHEN _gid = 0 THEN {translated_label_sql('_pt_name')} END AS Product",
        "CASE WHEN _gid = 0 THEN Qty ELSE coalesce(Qty, 0) END AS Qty",
        f"CASE WHEN _gid = 0 THEN {round0_sql('Value')} ELSE coalesce({round0_sql('Value')}, 0) END AS Value",
        "CASE WHEN _gid = 0 THEN 'detail' ELSE 'total' END AS row_type",
        "CASE WHEN _gid = 0 THEN 0 ELSE 1 END AS row_order")


def drilldown_with_total(detail: DataFrame) -> DataFrame:
    """Detail rows followed by one ``Total`` row (REP-11, SET-2), for any detail frame.

    This evaluates ``detail`` twice (rows and total); for a drill-down
    built here, ``drilldown(..., with_total=True)`` gives the same rows
    from one aggregate.

    ``row_type`` (``detail`` / ``total``) and ``row_order`` carry the
    position, so the result can be written and re-read without losing it.
    NULL Qty / Value count as 0 in the total (S20).
    """
    total = detail.agg(
        F.sum(F.coalesce(F.col("Qty"), F.lit(0))).alias("Qty"),
        F.sum(F.coalesce(F.col("Value"), F.lit(0))).alias("Value"),
    ).select(F.lit(TOTAL_WORD).alias("OA"), F.lit(None).cast("string").alias("Category"),
             F.lit(None).cast("string").alias("Product"), "Qty", "Value",
             F.lit("total").alias("row_type"), F.lit(1).alias("row_order"))
    rows = detail.select(*DETAIL_COLUMNS, F.lit("detail").alias("row_type"), F.lit(0).alias("row_order"))
    return rows.unionByName(total)


def drilldown_title(group_type: str | None, group_value: str | None, bucket_label: str) -> str:
    """``Breakdown for <field>: <value> (<bucket label>)`` as the screen titles the detail (EXP-15)."""
    dim = DIMENSIONS.get(group_type or "", DIMENSIONS["buyer"])
    return f"Breakdown for {dim.label}: {group_value or TOTAL_WORD} ({bucket_label})"
