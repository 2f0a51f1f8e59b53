"""Key checks of a catalog: unique ids, ids that are set, references that exist.

The reports rely on them (an order id stored twice counts its lines twice, a line without its order has no
payment term), and a stored catalog has no constraints of its own. Each check folds its rows by the key first, with map-side
combination, so a key that a third of all rows share is one row a task when keys meet.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import Catalog

#: tables with an ``id``
IDENTIFIED = ("sale_order", "account_payment_term", "res_partner", "product_product", "product_template", "res_company", "res_users", "crm_team")
#: (table, column, referenced table)
REFERENCES = (
    ("operation_details", "oa_id", "sale_order"),
    ("operation_details", "product_id", "product_product"),
    ("operation_details", "company_id", "res_company"),
    ("sale_order", "partner_id", "res_partner"),
    ("sale_order", "payment_term_id", "account_payment_term"),
    ("sale_order", "team_id", "crm_team"),
    ("product_product", "product_tmpl_id", "product_template"),
    ("res_users", "partner_id", "res_partner"),
    ("res_users", "sale_team_id", "crm_team"),
)


def _row(df: DataFrame, table: str, check: str, column: str, checked: str, wrong: str) -> DataFrame:
    """One row: how many rows were checked and how many of them fail (0 and 0 for an empty table)."""
    return df.selectExpr(f"'{table}' AS table_name", f"'{check}' AS check_name", f"'{column}' AS column_name",
                         f"CAST(coalesce({checked}, 0) AS BIGINT) AS checked", f"CAST(coalesce({wrong}, 0) AS BIGINT) AS violations")


def key_report(cat: Catalog) -> DataFrame:
    """table_name, check_name (``set``, ``unique``, ``exists``), column_name, checked, violations.

    ``set`` counts rows whose id is NULL; ``unique`` the rows beyond the first of each id; ``exists`` the rows whose
    reference is set and not found. Rows without a reference are not checked by ``exists``.
    """
    out = []
    for table in IDENTIFIED:
        ids = cat.table(table, ["id"]).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
        total = ids.agg(F.sum("n").alias("n"), F.sum(F.expr("CASE WHEN id IS NULL THEN n END")).alias("unset"),
                        F.sum(F.expr("CASE WHEN id IS NOT NULL THEN n END")).alias("have"),
                        F.sum(F.expr("CASE WHEN id IS NOT NULL THEN n - 1 END")).alias("again"))
        out += [_row(total, table, "set", "id", "n", "unset"), _row(total, table, "unique", "id", "have", "again")]
    for table, column, target in REFERENCES:
        refs = cat.table(table, [column]).where(F.col(column).isNotNull()).groupBy(F.col(column).alias("ref")).agg(F.count(F.lit(1)).alias("n"))
        found = cat.table(target, ["id"]).where("id IS NOT NULL").distinct()
        total = refs.join(found, F.col("ref") == F.col("id"), "left") \
            .agg(F.sum("n").alias("n"), F.sum(F.expr("CASE WHEN id IS NULL THEN n END")).alias("lost"))
        out.append(_row(total, table, "exists", column, "n", "lost"))
    return reduce(DataFrame.unionByName, out)
