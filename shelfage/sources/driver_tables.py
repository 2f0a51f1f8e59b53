"""Canonical tables derived from the driver's TPC-H-style parquet tables.

The mapping is the one of FIXTURES.md section 3. Joins that only feed
optional columns (part attributes of the fact, the customer's nation as
sales team) are added only when such a column is requested.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .catalog import Catalog

# --- fixed values of the mapping (FIXTURES.md section 3) ---
OPEN_LINE_STATUS = "O"
STAGE_OPEN, STAGE_OTHER = "FG Packing", "Dyeing"
RETURNFLAG_STATE = {"R": "done", "A": "closed"}
OTHER_STATE = "open"
NO_CATEGORY_TYPE = "ECONOMY"
UNSET_PRIORITY = "4-NOT SPECIFIED"
FALLBACK_PRIORITY = "5-LOW"
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", UNSET_PRIORITY, FALLBACK_PRIORITY)

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def _en_us_json(text: str) -> str:
    return f"""concat('{{"en_US": "', {text}, '"}}')"""


def _fr_fr_json(text: str) -> str:
    return f"""concat('{{"fr_FR": "', {text}, '"}}')"""


_STATE = (f"CASE WHEN l_returnflag = 'R' THEN '{RETURNFLAG_STATE['R']}' "
          f"WHEN l_returnflag = 'A' THEN '{RETURNFLAG_STATE['A']}' ELSE '{OTHER_STATE}' END")

# canonical column -> Spark SQL expression over the driver's columns
_EXPRS: dict[str, dict[str, str]] = {
    "operation_details": {
        "oa_id": "l_orderkey",
        "product_id": "l_partkey",
        "next_operation": f"CASE WHEN l_linestatus = '{OPEN_LINE_STATUS}' THEN '{STAGE_OPEN}' ELSE '{STAGE_OTHER}' END",
        "state": _STATE,
        "fg_balance": "CAST(l_quantity - 1 AS DECIMAL(14,2))",
        "price_unit": "CASE WHEN l_partkey % 41 = 0 THEN NULL ELSE CAST(l_extendedprice AS DECIMAL(14,2)) END",
        "action_date": "l_shipdate",
        "company_id": "CAST(l_suppkey % 3 + 1 AS INT)",
        "fg_categ_type": f"nullif(p_type, '{NO_CATEGORY_TYPE}')",
        "buyer_name": "p_brand",
    },
    "sale_order": {
        "id": "o_orderkey",
        "name": "concat('OA-', CAST(o_orderkey AS STRING))",
        "partner_id": "o_custkey",
        "payment_term_id": f"CASE WHEN o_orderpriority = '{UNSET_PRIORITY}' THEN CAST(NULL AS INT) "
                           "ELSE CAST(substring(o_orderpriority, 1, 1) AS INT) END",
        "user_id": "o_custkey % 10",
        "team_id": "c_nationkey",
    },
    "account_payment_term": {
        "id": "CAST(substring(p, 1, 1) AS INT)",
        "name": f"CASE WHEN p = '{FALLBACK_PRIORITY}' THEN {_fr_fr_json('p')} ELSE {_en_us_json('p')} END",
    },
    "res_partner": {"id": "c_custkey", "name": "CASE WHEN c_custkey % 47 = 0 THEN NULL ELSE c_name END"},
    "product_product": {"id": "p_partkey", "product_tmpl_id": "p_partkey"},
    "product_template": {"id": "p_partkey", "name": _en_us_json("p_name")},
    "res_company": {"id": "CAST(r_regionkey + 1 AS INT)", "name": "r_name"},
    "res_users": {
        "id": "s_suppkey",
        "partner_id": "s_suppkey * 20",
        "sale_team_id": "CASE WHEN s_nationkey % 4 = 0 THEN CAST(NULL AS INT) ELSE s_nationkey END",
    },
    "crm_team": {
        "id": "n_nationkey",
        "name": "n_name",
        "company_id": "CASE WHEN n_regionkey = 0 THEN CAST(NULL AS INT) ELSE n_regionkey END",
        "is_sales": "n_nationkey % 2 = 0",
    },
}

# The same tables with undated lines, times of day and product names whose JSON keys come in two orders.
_EDGE_EXPRS = {
    "operation_details": {
        "action_date": "CASE WHEN l_orderkey % 97 <> 0 THEN l_shipdate + make_dt_interval(0, 0, 0, CAST(l_partkey % 86400 AS DECIMAL(18,6))) END"},
    "product_template": {
        "name": """CASE p_partkey % 3 WHEN 0 THEN concat('{"en_US": "', p_name, '", "fr_FR": "', p_name, '"}') """
                """WHEN 1 THEN concat('{"fr_FR":"', p_name, '","en_US":"', p_name, '"}') ELSE concat('{"en_US": "', p_name, '"}') END"""},
}

# schemas by path: a file's footer is read once a process, each action still lists and reads the files
_SCHEMAS: dict[str, StructType] = {}


class DriverCatalog(Catalog):
    """The driver's tables under canonical names; ``edge=True`` maps some columns to harder values (``_EDGE_EXPRS``).

    Category and buyer are columns of ``part``, so they are kept by product: lines are folded before they meet ``part``.
    """

    keyed_columns = frozenset({"fg_categ_type", "buyer_name"})

    def __init__(self, spark: SparkSession, sf_dir: str, edge: bool = False):
        self.spark, self.sf_dir, self.edge = spark, sf_dir.rstrip("/"), edge
        self._raw: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        path = f"{self.sf_dir}/{name}.parquet"
        if path not in self._raw:
            reader = self.spark.read
            self._raw[path] = (reader.schema(_SCHEMAS[path]) if path in _SCHEMAS else reader).parquet(path)
            _SCHEMAS[path] = self._raw[path].schema
        return self._raw[path]

    def _project(self, name: str, src: DataFrame, cols: list[str]) -> DataFrame:
        exprs = {**_EXPRS[name], **(_EDGE_EXPRS.get(name, {}) if self.edge else {})}
        return src.selectExpr(*[f"{exprs[c]} AS {c}" for c in cols])

    def attributes(self, columns: Sequence[str]) -> DataFrame:
        exprs = _EXPRS["operation_details"]
        return self.raw("part").selectExpr(f"p_partkey AS {self.fact_key}", *[f"{exprs[c]} AS {c}" for c in columns])

    def table(self, name: str, columns: Sequence[str] | None = None) -> DataFrame:
        cols = self._columns(name, columns)
        if name == "operation_details":
            src = self.raw("lineitem")
            if {"fg_categ_type", "buyer_name"} & set(cols):
                # part attributes are needed only for these two columns
                part = self.raw("part").select("p_partkey", "p_type", "p_brand")
                src = src.join(part, F.expr("l_partkey = p_partkey"), "left")
        elif name == "sale_order":
            src = self.raw("orders").where("o_orderkey % 59 <> 0")  # some lines have no order
            if "team_id" in cols:
                cust = self.raw("customer").select("c_custkey", "c_nationkey")
                src = src.join(cust, F.expr("o_custkey = c_custkey"), "left")
        elif name == "account_payment_term":
            # the set priorities are fixed: no second scan of the orders for them
            src = self.spark.createDataFrame([(p,) for p in PRIORITIES if p != UNSET_PRIORITY], "p string")
        else:
            src = self.raw({"res_partner": "customer", "product_product": "part", "product_template": "part",
                            "res_company": "region", "res_users": "supplier", "crm_team": "nation"}[name])
        return self._project(name, src, cols)


# DuckDB text of the same mapping, as CTEs over the driver's views. Used by
# the oracle SQL so both engines read identical canonical tables.
DUCKDB_CANONICAL_CTES = """
operation_details AS (
  SELECT l.l_orderkey AS oa_id, l.l_partkey AS product_id,
         CASE WHEN l.l_linestatus = 'O' THEN 'FG Packing' ELSE 'Dyeing' END AS next_operation,
         CASE WHEN l.l_returnflag = 'R' THEN 'done' WHEN l.l_returnflag = 'A' THEN 'closed' ELSE 'open' END AS state,
         CAST(l.l_quantity - 1 AS DECIMAL(14,2)) AS fg_balance,
         CASE WHEN l.l_partkey % 41 = 0 THEN NULL ELSE CAST(l.l_extendedprice AS DECIMAL(14,2)) END AS price_unit,
         l.l_shipdate AS action_date,
         CAST(l.l_suppkey % 3 + 1 AS INTEGER) AS company_id,
         NULLIF(p.p_type, 'ECONOMY') AS fg_categ_type,
         p.p_brand AS buyer_name
  FROM lineitem l LEFT JOIN part p ON l.l_partkey = p.p_partkey),
sale_order AS (
  SELECT o.o_orderkey AS id, 'OA-' || CAST(o.o_orderkey AS VARCHAR) AS name, o.o_custkey AS partner_id,
         CASE WHEN o.o_orderpriority = '4-NOT SPECIFIED' THEN NULL
              ELSE CAST(substr(o.o_orderpriority, 1, 1) AS INTEGER) END AS payment_term_id,
         o.o_custkey % 10 AS user_id, c.c_nationkey AS team_id
  FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_orderkey % 59 <> 0),
account_payment_term AS (
  SELECT CAST(substr(p, 1, 1) AS INTEGER) AS id,
         CASE WHEN p = '5-LOW' THEN '{"fr_FR": "' || p || '"}' ELSE '{"en_US": "' || p || '"}' END AS name
  FROM (SELECT DISTINCT o_orderpriority AS p FROM orders WHERE o_orderpriority <> '4-NOT SPECIFIED') t),
res_partner AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 47 = 0 THEN NULL ELSE c_name END AS name FROM customer),
product_product AS (SELECT p_partkey AS id, p_partkey AS product_tmpl_id FROM part),
product_template AS (SELECT p_partkey AS id, '{"en_US": "' || p_name || '"}' AS name FROM part),
res_company AS (SELECT CAST(r_regionkey + 1 AS INTEGER) AS id, r_name AS name FROM region),
res_users AS (
  SELECT s_suppkey AS id, s_suppkey * 20 AS partner_id,
         CASE WHEN s_nationkey % 4 = 0 THEN NULL ELSE s_nationkey END AS sale_team_id
  FROM supplier),
crm_team AS (
  SELECT n_nationkey AS id, n_name AS name,
         CASE WHEN n_regionkey = 0 THEN NULL ELSE n_regionkey END AS company_id,
         n_nationkey % 2 = 0 AS is_sales
  FROM nation)
"""

# the same with the values of ``_EDGE_EXPRS``
DUCKDB_EDGE_CTES = DUCKDB_CANONICAL_CTES \
    .replace("l.l_shipdate AS action_date", "CASE WHEN l.l_orderkey % 97 <> 0 THEN l.l_shipdate + to_seconds(l.l_partkey % 86400) END AS action_date") \
    .replace("""SELECT p_partkey AS id, '{"en_US": "' || p_name || '"}' AS name FROM part""",
             """SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN '{"en_US": "' || p_name || '", "fr_FR": "' || p_name || '"}'
    WHEN 1 THEN '{"fr_FR":"' || p_name || '","en_US":"' || p_name || '"}' ELSE '{"en_US": "' || p_name || '"}' END AS name FROM part""")
