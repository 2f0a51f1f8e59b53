"""Ageing reports: the long cube, its wide form, single reports and the bundle.

Plan shape (all declarative; Catalyst/AQE choose the physical operators):

1. One scan of the fact with the stock and company predicates pushed to
   the reader, producing ``(bucket, balance, value)`` per line.
2. Order-side dimensions (payment term, customer): one map-side-combined
   aggregate folds the lines per ``(order, bucket)`` -- in the bundle the
   same aggregate also folds per ``(category, bucket)`` and ``(buyer,
   bucket)`` through grouping sets -- so the join to ``sale_order`` sees
   at most eight rows per order, and a hot order or the NULL order is a
   handful of partial sums before any shuffle. After that join the rows
   are folded again per ``(payment term, partner, bucket)`` so that the
   partner join cannot be skewed by a hot customer.
   Fact-side dimensions (item category, buyer) are folded per (key,
   bucket) in the same aggregate and need no join.
3. The widening aggregate by ``(dimension, label)`` pivots the (at most
   eight) bucket rows per label into fixed columns.

Sums stay exact decimals until the very end; rounding happens after the
sum (and only in the dashboard variants).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import age_sql, as_date, bucket_sql, ident, json_value_sql, label_order, round0_sql, translated_label_sql
from ..schema import BUCKET_NAMES, DIMENSION_ORDER, DIMENSIONS, METRIC_COLS
from ..sources.catalog import Catalog
from .filters import Filters, fact_predicate

# fact column behind each fact-side dimension
FACT_COLUMN = {"item_category": "fg_categ_type", "buyer": "buyer_name"}
# order column behind each order-side dimension
ORDER_KEY = {"payment_terms": "payment_term_id", "customer": "partner_id"}


def _check_dims(dims: Sequence[str]) -> list[str]:
    dims = list(dict.fromkeys(dims))
    for d in dims:
        if d not in DIMENSIONS:
            raise KeyError(f"unknown dimension {d!r}; expected one of {list(DIMENSIONS)}")
    return dims


def order_spread(null_keys: str, spread_by: Sequence[str]) -> str:
    """SQL of a second join key: 0 where the order key is set, else a hash of ``spread_by``.

    Rows without a key match nothing; the second key only deals them over all partitions. The
    other side's second key is ``pmod(key, 1)``: always 0, and no literal, which the optimizer would
    take out of the join keys.
    """
    cols = ", ".join(ident(c) for c in spread_by)
    return f"CASE WHEN {null_keys} IS NULL THEN CAST(pmod(xxhash64({cols}), 4096) + 1 AS BIGINT) ELSE CAST(0 AS BIGINT) END"


def stock_lines(cat: Catalog, filters: Filters, as_of: dt.date, extra: Sequence[str] = (),
                company_scope: bool = True, order_keys: Sequence[str] = ()) -> DataFrame:
    """Filtered fact lines: ``oa_id``, extra fact columns, ``bucket``, ``balance``, ``value``.

    With a salesperson / team filter (S15: lines without a matching order
    drop out) the lines are folded per ``(oa_id, extra columns, bucket)`` and
    the folded rows are inner-joined with the orders that pass, which also
    bring ``order_keys``; so there is one join with ``sale_order`` whatever its
    size, and an order id stored twice counts twice everywhere, as in a
    plain SQL join. Map-side combine turns an order holding a third of all lines into a few
    rows per task before the join. Nothing runs while the plan is built.
    """
    extra = list(dict.fromkeys(extra))
    cols = ["oa_id", "next_operation", "state", "fg_balance", "price_unit", "action_date", "company_id", *extra]
    od = cat.table("operation_details", list(dict.fromkeys(cols)))
    od = od.where(fact_predicate(filters.company if company_scope else None))
    lines = od.selectExpr(
        "oa_id", *[ident(c) for c in extra if c != "oa_id"],
        f"{bucket_sql(age_sql(as_of))} AS bucket",
        "fg_balance AS balance",
        "fg_balance * price_unit AS value",
    )
    if filters.needs_orders:
        keys = ["oa_id", *[c for c in extra if c != "oa_id"], "bucket"]
        so = cat.table("sale_order", list(dict.fromkeys(["id", *filters.order_columns(), *order_keys])))
        so = so.where(filters.order_predicate()).select(F.col("id").alias("_so_id"), *order_keys)
        lines = lines.groupBy(*keys).agg(*_sums()).join(so, F.expr("oa_id = _so_id"), "inner").drop("_so_id")
    return lines


def _sums() -> list:
    return [F.expr("sum(balance) AS balance"), F.expr("sum(value) AS value")]


def _grouping_id_of(keys: list[str], group: list[str]) -> int:
    n = len(keys)
    return sum(1 << (n - 1 - i) for i, k in enumerate(keys) if k not in group)


def _grouped(df: DataFrame, sets: list[list[str]]) -> tuple[DataFrame, dict[int, int]]:
    """Aggregate ``balance``/``value`` over several grouping sets in one pass.

    Returns the aggregate and, per set index, the ``_gid`` value that tags
    its rows (sets are told apart by grouping id, never by NULL keys,
    because NULL is a real group).
    """
    keys = list(dict.fromkeys(k for s in sets for k in s))
    if len(sets) == 1:
        return df.groupBy(*sets[0]).agg(*_sums(), F.expr("0 AS _gid")), {0: 0}
    g = df.groupingSets([[F.col(k) for k in s] for s in sets], *keys) \
        .agg(*_sums(), F.expr(f"grouping_id({', '.join(ident(k) for k in keys)}) AS _gid"))
    return g, {i: _grouping_id_of(keys, s) for i, s in enumerate(sets)}


def labelled_partials(cat: Catalog, filters: Filters | None = None, as_of: dt.date | str | None = None,
                      dimensions: Sequence[str] = DIMENSION_ORDER, company_scope: bool = True) -> DataFrame:
    """Partial sums tagged with ``(dimension, label, bucket)``; not yet unique per key.

    One scan, one grouping-sets aggregate. Its per-order rows and its
    per-category / per-buyer rows travel through the order joins together
    (the latter have no order key and are spread by a second one), then each row
    is expanded into the (dimension, label) pairs it contributes to. Keeping
    the pipeline linear matters: splitting the aggregate by grouping id
    would let Catalyst push each split below the aggregate and rescan the
    fact once per split.
    """
    filters = filters or Filters()
    as_of = as_date(as_of)
    dims = _check_dims(dimensions)
    fact_dims = [d for d in dims if DIMENSIONS[d].side == "fact"]
    order_dims = [d for d in dims if DIMENSIONS[d].side == "order"]

    label_keys = [ORDER_KEY[d] for d in order_dims]
    joined = filters.needs_orders
    # categories and buyers kept by product are attached after the fold: lines are folded once per product for both
    keyed = [d for d in fact_dims if FACT_COLUMN[d] in cat.keyed_columns]
    groups = [[d] for d in fact_dims if d not in keyed] + ([keyed] if keyed else [])
    columns = [cat.fact_key if ds == keyed and keyed else FACT_COLUMN[ds[0]] for ds in groups]
    lines = stock_lines(cat, filters, as_of, columns, company_scope, label_keys)
    # Two sums per line, folded per (key, bucket); the sixteen bucket columns
    # are formed later on the folded rows (see README, "Cheap per line").
    sets: list[list[str]] = ([[*(label_keys if joined else ["oa_id"]), "bucket"]] if order_dims else []) + \
        [[c, "bucket"] for c in columns]
    g, gids = _grouped(lines, sets)

    tagged: list[tuple[int, list[tuple[str, str]]]] = []
    if order_dims:
        g, label_cols = _attach_order_labels(cat, g, order_dims, joined, columns)
        tagged.append((gids[0], [(d, label_cols[d]) for d in order_dims]))
    offset = 1 if order_dims else 0
    for i, ds in enumerate(groups):
        tagged.append((gids[i + offset], [(d, FACT_COLUMN[d]) for d in ds]))
    if keyed:
        # rows without a product (those of the orders, too) are spread by a second key
        attributes = cat.attributes([FACT_COLUMN[d] for d in keyed]).withColumnRenamed(cat.fact_key, "_key") \
            .withColumn("_none", F.expr("CAST(pmod(_key, 1) AS BIGINT)"))
        others = [c for c in g.columns if c not in (cat.fact_key, "balance", "value")]
        g = g.withColumn("_spread", F.expr(order_spread(cat.fact_key, others))) \
            .join(attributes, F.expr(f"{ident(cat.fact_key)} = _key AND _spread = _none"), "left")

    whens = []
    for gid, pairs in tagged:
        arr = ", ".join(f"named_struct('dimension', '{d}', 'label', CAST({ident(c)} AS STRING))" for d, c in pairs)
        whens.append(f"WHEN _gid = {gid} THEN array({arr})")
    return g.selectExpr(f"inline(CASE {' '.join(whens)} END)", "bucket", "balance", "value")


def _attach_order_labels(cat: Catalog, g: DataFrame, order_dims: list[str], joined: bool,
                         fact_columns: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """Left-join order-side labels to the per-order partial sums (``joined``: they have the label keys already).

    The join to ``sale_order`` is on its unique id, so it cannot skew. Its
    result is folded again by ``(payment term id, partner id, bucket)``
    before the partner join: a customer holding a third of all orders
    becomes a few partial rows per task (map-side combine) instead of a
    third of the join input landing in one partition, and the partner join
    reads one row per partner, term and bucket instead of one per order.
    """
    label_keys = (["payment_term_id"] if "payment_terms" in order_dims else []) + \
        (["partner_id"] if "customer" in order_dims else [])
    if joined:
        j = g
    else:
        so = cat.table("sale_order", ["id", *label_keys]).withColumnRenamed("id", "_so_id")
        keep = [c for c in g.columns if c not in ("oa_id", "balance", "value")]  # _gid, bucket, fact keys
        on = "oa_id = _so_id"
        if fact_columns:
            # the per-category and per-buyer rows have no order id: spread them
            g = g.withColumn("_spread", F.expr(order_spread("oa_id", ["bucket", *fact_columns])))
            so = so.withColumn("_zero", F.expr("CAST(pmod(_so_id, 1) AS BIGINT)"))
            on += " AND _spread = _zero"
        j = g.join(so, F.expr(on), "left").groupBy(*keep, *label_keys).agg(*_sums())
    label_cols = {}
    if "payment_terms" in order_dims:
        apt = cat.table("account_payment_term", ["id", "name"]).selectExpr("id AS _apt_id", f"{json_value_sql('name')} AS _term") \
            .selectExpr("_apt_id", f"{translated_label_sql('_term')} AS _pt_label")
        j = j.join(apt, F.expr("payment_term_id = _apt_id"), "left")
        label_cols["payment_terms"] = "_pt_label"
    if "customer" in order_dims:
        rp = cat.table("res_partner", ["id", "name"]).selectExpr("id AS _rp_id", "name AS _cust_label")
        j = j.join(rp, F.expr("partner_id = _rp_id"), "left")
        label_cols["customer"] = "_cust_label"
    return j, label_cols


def long_cube(cat: Catalog, filters: Filters | None = None, as_of: dt.date | str | None = None,
              dimensions: Sequence[str] = DIMENSION_ORDER, company_scope: bool = True) -> DataFrame:
    """Exact sums per ``(dimension, label, bucket)``; bucket NULL holds unbucketed lines.

    Columns: dimension, label, bucket, balance, value. Additive: summing any
    rows of one dimension gives the sums of the union of their lines, so a
    saved cube can be rolled up later without touching the fact again.
    """
    parts = labelled_partials(cat, filters, as_of, dimensions, company_scope)
    return parts.groupBy("dimension", "label", "bucket").agg(*_sums())


def widen(long: DataFrame) -> DataFrame:
    """Labelled partial sums (or the long cube) -> one row per (dimension, label) with 7+7 bucket sums and 2 totals (exact).

    A bucket with no line gives 0; a bucket whose only lines have no price,
    in a group that has no other line, gives NULL (the SQL CASE ... ELSE 0
    semantics), and so does Total_Value when every price is missing.
    """
    aggs = [F.expr(f"sum(CASE WHEN bucket = '{b}' THEN balance ELSE 0 END) AS {ident('Balance_' + b)}")
            for b in BUCKET_NAMES]
    aggs += [F.expr(f"sum(CASE WHEN bucket = '{b}' THEN value ELSE 0 END) AS {ident('Value_' + b)}")
             for b in BUCKET_NAMES]
    aggs += [F.expr("sum(balance) AS Total_Balance"), F.expr("sum(value) AS Total_Value")]
    return long.groupBy("dimension", "label").agg(*aggs)


def finish(wide: DataFrame, dimension: str, rounded: bool = True, ordered: bool = True, collation: str | None = None) -> DataFrame:
    """Select one dimension's rows with the report's column names and (unless ``ordered=False``) order."""
    label = DIMENSIONS[dimension].label
    metrics = [f"{round0_sql(c)} AS {ident(c)}" if rounded else ident(c) for c in METRIC_COLS]
    out = wide.where(F.expr(f"dimension = '{dimension}'")).selectExpr(f"label AS {ident(label)}", *metrics)
    return out.orderBy(*label_order(F.col(label), collation)) if ordered else out


def aging_report(cat: Catalog, dimension: str, filters: Filters | None = None,
                 as_of: dt.date | str | None = None, rounded: bool = True,
                 company_scope: bool = True, ordered: bool = True, collation: str | None = None) -> DataFrame:
    """One ageing report (REP-4..7; with ``company_scope=False, rounded=False`` REP-1..3).

    ``ordered=False`` leaves out the sort, for reports that are aggregated further (totals, KPIs);
    ``collation`` (``UNICODE``) orders the labels linguistically instead of by bytes."""
    parts = labelled_partials(cat, filters, as_of, [dimension], company_scope)
    return finish(widen(parts), dimension, rounded, ordered, collation)


def plain_report(cat: Catalog, dimension: str, as_of: dt.date | str | None = None) -> DataFrame:
    """Stand-alone report: no company filter, no rounding."""
    return aging_report(cat, dimension, Filters(), as_of, rounded=False, company_scope=False)


def bundle(cat: Catalog, filters: Filters | None = None, as_of: dt.date | str | None = None,
           dimensions: Sequence[str] = DIMENSION_ORDER) -> DataFrame:
    """All requested reports from one scan, stacked: dimension, label, 16 rounded metrics.

    Consume it once (write it, or ``checkpoint()`` it) and split with
    :func:`split_bundle`; each split is then a cheap filter.
    """
    wide = widen(labelled_partials(cat, filters, as_of, dimensions))
    return wide.selectExpr("dimension", "label", *[f"{round0_sql(c)} AS {ident(c)}" for c in METRIC_COLS])


def split_bundle(stacked: DataFrame, dimensions: Sequence[str] = DIMENSION_ORDER, ordered: bool = True,
                 collation: str | None = None) -> dict[str, DataFrame]:
    """The four report DataFrames of a stacked bundle, with their own label names and order."""
    out = {}
    for d in dimensions:
        label = DIMENSIONS[d].label
        rows = stacked.where(F.expr(f"dimension = '{d}'")).selectExpr(f"label AS {ident(label)}", *[ident(c) for c in METRIC_COLS])
        out[d] = rows.orderBy(*label_order(F.col(label), collation)) if ordered else rows
    return out
