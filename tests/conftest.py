from __future__ import annotations

import datetime as dt
import sys
from decimal import Decimal
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from shelfage.session import build_session  # noqa: E402
from shelfage.sources import DataFrameCatalog  # noqa: E402

SF0001 = "/root/testdata/sf0.001"
SF001 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[*]", shuffle_partitions=8, app="shelfage-tests")
    yield s
    s.stop()


# ---------------------------------------------------------------- edge fixture (FIXTURES.md section 2)
FIX_AS_OF = dt.date(2024, 3, 31)

OD_SCHEMA = ("oa_id bigint, product_id bigint, next_operation string, state string, fg_balance decimal(14,2), "
             "price_unit decimal(14,2), action_date timestamp_ntz, company_id int, fg_categ_type string, "
             "buyer_name string")


def _d(x):
    return None if x is None else Decimal(x)


def _t(x):
    return None if x is None else dt.datetime.fromisoformat(x)


FG, DY = "FG Packing", "Dyeing"
# (#, oa_id, product_id, stage, state, fg_balance, price_unit, action_date, company, category, buyer)
OD_ROWS = [
    (1, 100, 1000, FG, "open", "10.50", "2.00", "2024-03-31 00:00", 1, "Zip", "BuyerA"),
    (2, 100, 1000, FG, "open", "5.50", "1.33", "2024-03-26 18:30", 1, "Zip", "BuyerA"),
    (3, 100, 1001, FG, "open", "4.00", "2.50", "2024-03-25 00:00", 1, "Zip", "BuyerB"),
    (4, 101, 1001, FG, "open", "3.00", "1.00", "2024-03-21 00:00", 1, "Zip", "BuyerB"),
    (5, 101, 1002, FG, "open", "2.00", "3.00", "2024-03-20 00:00", 1, "Button", "BuyerB"),
    (6, 102, 1002, FG, "open", "7.00", None, "2024-03-16 00:00", 1, "Button", "BuyerN"),
    (7, 102, 1003, FG, "open", "1.00", "9.99", "2024-03-15 00:00", 1, "Button", "BuyerA"),
    (8, 103, 1003, FG, "open", "8.00", "0.50", "2024-03-10 00:00", 1, "Button", "BuyerB"),
    (9, 103, 1004, FG, "open", "6.00", "1.25", "2024-03-01 00:00", 1, "Zip", "BuyerB"),
    (10, 103, 1000, FG, "open", "2.50", "4.00", "2024-02-29 00:00", 1, "Zip", "BuyerA"),
    (11, 104, 1000, FG, "open", "9.00", "1.00", "2024-04-02 00:00", 1, "Zip", "BuyerA"),
    (12, 104, 1000, FG, "open", "1.00", "1.00", None, 1, "Zip", "BuyerA"),
    (13, 999, 1000, FG, "open", "5.00", "2.00", "2024-03-31 00:00", 1, None, None),
    (14, 100, 1000, FG, "done", "50.00", "1.00", "2024-03-31 00:00", 1, "Zip", "BuyerA"),
    (15, 100, 1000, FG, None, "60.00", "1.00", "2024-03-31 00:00", 1, "Zip", "BuyerA"),
    (16, 100, 1000, FG, "open", "0.00", "1.00", "2024-03-31 00:00", 1, "Zip", "BuyerA"),
    (17, 100, 1000, FG, "open", None, "1.00", "2024-03-31 00:00", 1, "Zip", "BuyerA"),
    (18, 100, 1000, DY, "open", "70.00", "1.00", "2024-03-31 00:00", 1, "Zip", "BuyerA"),
    (19, 100, 1000, FG, "open", "80.00", "1.00", "2024-03-31 00:00", 3, "Zip", "BuyerA"),
    (20, 100, 1000, FG, "closed", "90.00", "1.00", "2024-03-31 00:00", 1, "Zip", "BuyerA"),
]


@pytest.fixture(scope="session")
def fixture_cat(spark):
    od = spark.createDataFrame(
        [(r[1], r[2], r[3], r[4], _d(r[5]), _d(r[6]), _t(r[7]), r[8], r[9], r[10]) for r in OD_ROWS], OD_SCHEMA)
    so = spark.createDataFrame(
        [(100, "OA-100", 1, 1, 7, 70), (101, "OA-101", 2, 2, 7, 71), (102, "OA-102", 3, 3, 8, 70),
         (103, "OA-103", None, None, 8, None), (104, "OA-104", 1, 1, None, 70)],
        "id bigint, name string, partner_id bigint, payment_term_id int, user_id bigint, team_id int")
    apt = spark.createDataFrame(
        [(1, '{"en_US": "Net 30"}'), (2, '{"fr_FR": "Comptant"}'), (3, '{"en_US": null, "fr_FR": "X"}')],
        "id int, name string")
    rp = spark.createDataFrame([(1, "Acme"), (2, "Acme"), (3, "Zeta")], "id bigint, name string")
    pp = spark.createDataFrame([(1000, 500), (1001, 501), (1002, 502), (1003, 503)],
                               "id bigint, product_tmpl_id bigint")
    pt = spark.createDataFrame(
        [(500, '{"en_US": "Zipper"}'), (501, '{"en_US": "Zipper", "fr_FR": "Fermeture"}'),
         (502, '{"fr_FR": "Bouton"}'), (503, None)], "id bigint, name string")
    company = spark.createDataFrame([(1, "Main"), (2, "Other"), (3, "Third")], "id int, name string")
    users = spark.createDataFrame([(7, 1, 70), (8, 3, 71), (9, 44, 70), (10, 2, None)],
                                  "id bigint, partner_id bigint, sale_team_id int")
    teams = spark.createDataFrame(
        [(70, "North Sales", 1, True), (71, "South Sales", 3, True), (72, "Global", None, True),
         (73, "Support", 1, False), (74, "north export", None, True)],
        "id int, name string, company_id int, is_sales boolean")
    return DataFrameCatalog({
        "operation_details": od, "sale_order": so, "account_payment_term": apt, "res_partner": rp,
        "product_product": pp, "product_template": pt, "res_company": company, "res_users": users,
        "crm_team": teams,
    })
