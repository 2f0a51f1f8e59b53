"""Filter-option lookups: companies, salespersons, sales teams (REP-12..14)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import contains_ci, name_or_unknown
from ..schema import LOOKUP_COMPANY_IDS
from ..sources.catalog import Catalog


def companies(cat: Catalog) -> DataFrame:
    """``id, name`` of the companies offered in the selector."""
    return cat.table("res_company", ["id", "name"]).where(F.col("id").isin(*LOOKUP_COMPANY_IDS))


def salespersons(cat: Catalog, term: str | None = None) -> DataFrame:
    """Users with a sales team, named by their partner (``Unknown`` when missing or empty).

    With a search term, users whose (partner) name contains it, ignoring case.
    Users are few per company; the partner table may be large, so the
    join is a plain equi-join that AQE broadcasts on the user side when
    it is small, instead of a client-side id list.
    """
    users = cat.table("res_users", ["id", "partner_id", "sale_team_id"]).where(F.col("sale_team_id").isNotNull())
    rp = cat.table("res_partner", ["id", "name"]).select(F.col("id").alias("_rp_id"), F.col("name").alias("_rp_name"))
    j = users.join(rp, users["partner_id"] == rp["_rp_id"], "left")
    if term:
        j = j.where(contains_ci("_rp_name", term))
    return j.select("id", name_or_unknown(F.col("_rp_name")).alias("name"))


def teams(cat: Catalog, company_id: int | None = None, term: str | None = None) -> DataFrame:
    """Sales teams of the selected company or of no company (S22); optional name search."""
    t = cat.table("crm_team", ["id", "name", "company_id", "is_sales"])
    scope = F.col("company_id").isNull()
    if company_id:
        scope = scope | (F.col("company_id") == F.lit(company_id))
    pred = F.col("is_sales") & scope
    if term:
        pred = contains_ci("name", term) & pred
    return t.where(pred).select("id", "name")
