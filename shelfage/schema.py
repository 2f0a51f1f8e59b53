"""Fixed vocabulary of the ageing reports.

FIXED VALUES: the strings and numbers below must equal the ones the
dashboard uses, because report columns, filters and drill-down selectors
are matched on them literally.
"""

from __future__ import annotations

from dataclasses import dataclass

# --- fixed values (bucket names and closed day ranges; None = open end) ---
BUCKETS: tuple[tuple[str, int, int | None], ...] = (
    ("0-5", 0, 5),
    ("6-10", 6, 10),
    ("11-15", 11, 15),
    ("16-20", 16, 20),
    ("21-25", 21, 25),
    ("26-30", 26, 30),
    ("30+", 31, None),
)
# --- fixed values (fact predicates) ---
FG_STAGE = "FG Packing"
CLOSED_STATES = ("done", "closed")
# --- fixed values (selector words, fallbacks) ---
TOTAL_WORD = "Total"
UNKNOWN_NAME = "Unknown"
BUCKET_NAME_PREFIXES = ("Balance_", "Value_", "Total_")
LOOKUP_COMPANY_IDS = (1, 3)
EXPORT_FILE_PREFIX = "FG_Stock_Aging_"

BUCKET_NAMES = tuple(b[0] for b in BUCKETS)
BALANCE_COLS = tuple(f"Balance_{b}" for b in BUCKET_NAMES)
VALUE_COLS = tuple(f"Value_{b}" for b in BUCKET_NAMES)
TOTAL_COLS = ("Total_Balance", "Total_Value")
# query order: balances, values, totals
METRIC_COLS = BALANCE_COLS + VALUE_COLS + TOTAL_COLS
# export order: interleaved per bucket, totals last
EXPORT_METRIC_COLS = tuple(c for b in BUCKET_NAMES for c in (f"Balance_{b}", f"Value_{b}")) + TOTAL_COLS
# screen order: totals first, then interleaved per bucket
SCREEN_METRIC_COLS = TOTAL_COLS + tuple(c for b in BUCKET_NAMES for c in (f"Balance_{b}", f"Value_{b}"))


@dataclass(frozen=True)
class Dimension:
    key: str        # group_type as the dashboard sends it
    label: str      # report label column
    sheet: str      # export sheet name
    title: str      # export table title
    side: str       # "fact": column of operation_details; "order": reached through sale_order


# --- fixed values (the four report dimensions) ---
DIMENSIONS: dict[str, Dimension] = {
    "payment_terms": Dimension("payment_terms", "Payment Terms", "Payment Terms", "Aging by Payment Terms", "order"),
    "item_category": Dimension("item_category", "Item", "Item Category", "Aging by Item Category", "fact"),
    "customer": Dimension("customer", "Customer", "Customer", "Aging by Customer", "order"),
    "buyer": Dimension("buyer", "Buyer", "Buyer", "Aging by Buyer", "fact"),
}
DIMENSION_ORDER = tuple(DIMENSIONS)

# --- fixed values (KPI summary rows: position, section, metric, source column) ---
KPI_ROWS = (
    (1, "", "Total FG Balance", "total_balance"),
    (2, "", "Total FG Value", "total_value"),
    (3, "0-5 Days Summary", "Balance", "balance_0_5"),
    (4, "0-5 Days Summary", "Value", "value_0_5"),
    (5, "30+ Days Summary", "Balance", "balance_30_plus"),
    (6, "30+ Days Summary", "Value", "value_30_plus"),
)
# KPI name -> (report column, digits in the thousands label)
KPI_SOURCES = {
    "total_balance": ("Total_Balance", 1),
    "total_value": ("Total_Value", 2),
    "balance_0_5": ("Balance_0-5", 1),
    "value_0_5": ("Value_0-5", 2),
    "balance_30_plus": ("Balance_30+", 1),
    "value_30_plus": ("Value_30+", 2),
}

# Columns each canonical table offers (see FIXTURES.md section 1).
TABLE_COLUMNS: dict[str, tuple[str, ...]] = {
    "operation_details": (
        "oa_id", "product_id", "next_operation", "state", "fg_balance", "price_unit",
        "action_date", "company_id", "fg_categ_type", "buyer_name",
    ),
    "sale_order": ("id", "name", "partner_id", "payment_term_id", "user_id", "team_id"),
    "account_payment_term": ("id", "name"),
    "res_partner": ("id", "name"),
    "product_product": ("id", "product_tmpl_id"),
    "product_template": ("id", "name"),
    "res_company": ("id", "name"),
    "res_users": ("id", "partner_id", "sale_team_id"),
    "crm_team": ("id", "name", "company_id", "is_sales"),
}
