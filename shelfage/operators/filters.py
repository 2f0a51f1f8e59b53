"""Dashboard filters turned into Column predicates."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import CLOSED_STATES, FG_STAGE


@dataclass(frozen=True)
class Filters:
    """``company_id``, ``salesperson_id``, ``team_id`` as the dashboard sends them.

    Falsy values mean "no filter", except the company: a falsy company is
    the caller's default company, never "all companies".
    """

    company_id: int | None = None
    salesperson_id: int | None = None
    team_id: int | None = None
    default_company: int | None = None

    @classmethod
    def from_mapping(cls, filters: Mapping | None, default_company: int | None = None) -> "Filters":
        f = dict(filters or {})
        return cls(f.get("company_id") or None, f.get("salesperson_id") or None,
                   f.get("team_id") or None, default_company)

    @property
    def company(self) -> int:
        company = self.company_id or self.default_company
        if not company:
            raise ValueError("no company selected: give company_id or the caller's default_company")
        return company

    @property
    def needs_orders(self) -> bool:
        return bool(self.salesperson_id or self.team_id)

    def order_columns(self) -> list[str]:
        cols = []
        if self.salesperson_id:
            cols.append("user_id")
        if self.team_id:
            cols.append("team_id")
        return cols

    def order_predicate(self) -> Column | None:
        """Predicate on ``sale_order``; rows without an order can never pass it."""
        parts = []
        if self.salesperson_id:
            parts.append(f"user_id = {int(self.salesperson_id)}")
        if self.team_id:
            parts.append(f"team_id = {int(self.team_id)}")
        return F.expr(" AND ".join(parts)) if parts else None


def open_stock_sql(alias: str = "") -> str:
    """Lines waiting for FG packing, not done/closed (NULL state excluded), positive balance.

    ``alias`` qualifies the columns (``"od."``) for use in a SQL statement.
    """
    states = ", ".join(f"'{x}'" for x in CLOSED_STATES)
    a = alias
    return f"{a}next_operation = '{FG_STAGE}' AND {a}state NOT IN ({states}) AND {a}fg_balance > 0"


def fact_predicate(company: int | None) -> Column:
    sql = open_stock_sql()
    if company is not None:
        sql += f" AND company_id = {int(company)}"
    return F.expr(sql)
