"""Day-grain rollup: a stored, mergeable aggregate that answers the dashboard for any ``as_of`` without a fact scan.

Open stock is summed per (company, action day, dimensions). Ages are differences of days, so the buckets of any date
follow from the stored days; sums are exact decimals, so partial sums merge without loss. Three kinds of rows keep the
reports' join rules: ``order`` (payment term, partner, salesperson and team of the line's order, after a left
join), ``fact`` (category and buyer of every line) and ``fact_order`` (category and buyer of the lines that have
an order, with its salesperson and team, for the filtered reports).

Layout: ``<root>/data/version=<v>/company_id=<c>/month=<m>/`` and ``<root>/manifest/<n>``: one row per live partition and the
version that holds it. A build or refresh writes a new version first and its manifest last; readers
take the highest complete manifest, so a failed refresh changes nothing. ``refresh`` recomputes only the
(company, month) partitions it is given: their predicates reach the fact scan, a partition that has no stock any more leaves the
manifest, the others are not touched. ``vacuum`` removes versions that no manifest names.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import age_sql, as_date, bucket_sql, ident, round0_sql
from ..schema import DIMENSION_ORDER, DIMENSIONS, METRIC_COLS
from ..session import children, remove
from ..sources.catalog import Catalog
from .aging import FACT_COLUMN, ORDER_KEY, _attach_order_labels, _check_dims, _sums, order_spread, widen
from .filters import Filters, fact_predicate
from .keyed import join_dimension

UNDATED = "undated"
PARTITION = ["company_id", "month"]
KEYS = {
    "order": ["payment_term_id", "partner_id", "user_id", "team_id"],
    "fact": ["fg_categ_type", "buyer_name"],
    "fact_order": ["fg_categ_type", "buyer_name", "user_id", "team_id"],
}
ROWS = ("kind string, day date, payment_term_id int, partner_id bigint, user_id bigint, team_id bigint, fg_categ_type string, "
        "buyer_name string, balance decimal(38,2), value decimal(38,4)")
STORED = f"{ROWS}, version string, company_id int, month string"
MANIFEST = "company_id int, month string, version string"


def month_sql(day: str = "day") -> str:
    return f"coalesce(date_format({day}, 'yyyy-MM'), '{UNDATED}')"


def _partition_predicate(partitions: Iterable[tuple[int, str]]) -> F.Column:
    """Raw-column conditions of (company, month) pairs, so that they prune and reach the reader."""
    out = F.lit(False)
    for company, month in partitions:
        if month == UNDATED:
            dates = F.col("action_date").isNull()
        else:
            first = dt.date.fromisoformat(f"{month}-01")
            after = (first + dt.timedelta(days=31)).replace(day=1)
            dates = (F.col("action_date") >= F.lit(first)) & (F.col("action_date") < F.lit(after))
        out = out | ((F.col("company_id") == F.lit(int(company))) & dates)
    return out


def day_rows(cat: Catalog, partitions: Sequence[tuple[int, str]] | None = None) -> DataFrame:
    """The rollup's rows (with company_id and month) of the whole fact, or of some (company, month) partitions."""
    keyed = [c for c in KEYS["fact"] if c in cat.keyed_columns]
    stored = [c for c in KEYS["fact"] if c not in keyed]
    extra = stored + ([cat.fact_key] if keyed else [])
    od = cat.table("operation_details", ["company_id", "oa_id", "next_operation", "state", "fg_balance", "price_unit", "action_date", *extra])
    od = od.where(fact_predicate(None))
    if partitions is not None:
        od = od.where(_partition_predicate(partitions))
    lines = od.selectExpr("company_id", "to_date(action_date) AS day", "oa_id", *[ident(c) for c in extra],
                          "fg_balance AS balance", "fg_balance * price_unit AS value")
    base = ["company_id", "day"]
    fold = lines.groupBy(*base, "oa_id", *extra).agg(*_sums())
    if keyed:
        attributes = cat.attributes(keyed).withColumnRenamed(cat.fact_key, "_key")
        fold = join_dimension(fold, cat.fact_key, attributes, "_key", ["oa_id", "day"]) \
            .groupBy(*base, "oa_id", *KEYS["fact"]).agg(*_sums())
    so = cat.table("sale_order", ["id", *KEYS["order"]]).withColumnRenamed("id", "_so_id") \
        .withColumn("_zero", F.expr("CAST(pmod(_so_id, 1) AS BIGINT)"))
    spread = fold.withColumn("_spread", F.expr(order_spread("oa_id", ["day", *KEYS["fact"]])))
    joined = spread.join(so, F.expr("oa_id = _so_id AND _spread = _zero"), "left")
    parts = {"order": joined, "fact": fold, "fact_order": joined.where("_so_id IS NOT NULL")}
    names = [c.split()[0] for c in ROWS.split(", ")][2:8]
    types = dict(c.split() for c in ROWS.split(", "))
    out = None
    for kind, rows in parts.items():
        part = rows.groupBy(*base, *KEYS[kind]).agg(*_sums()).selectExpr(
            f"'{kind}' AS kind", "day", *[f"CAST({c if c in KEYS[kind] else 'NULL'} AS {types[c]}) AS {c}" for c in names],
            "CAST(balance AS DECIMAL(38,2)) AS balance", "CAST(value AS DECIMAL(38,4)) AS value", "CAST(company_id AS INT) AS company_id",
            f"{month_sql()} AS month")
        out = part if out is None else out.unionByName(part)
    return out


# ---------------------------------------------------------------- store
def _latest(spark: SparkSession, root: str) -> int:
    done = [int(n) for n in children(spark, f"{root}/manifest") if n.isdigit() and "_SUCCESS" in children(spark, f"{root}/manifest/{n}")]
    return max(done, default=-1)


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """The live partitions and their versions; a rollup without a complete manifest is refused."""
    n = _latest(spark, root.rstrip("/"))
    if n < 0:
        raise FileNotFoundError(f"{root} holds no complete rollup")
    return spark.read.schema(MANIFEST).parquet(f"{root.rstrip('/')}/manifest/{n}")


def _write(spark: SparkSession, rows: DataFrame, root: str) -> DataFrame:
    version = uuid.uuid4().hex[:12]
    path = f"{root}/data/version={version}"
    rows.repartition(*PARTITION, F.pmod(F.xxhash64("kind", "day"), F.lit(8))).write.partitionBy(*PARTITION).parquet(path)
    return spark.read.schema(f"{ROWS}, company_id int, month string").parquet(path).select(*PARTITION).distinct() \
        .withColumn("version", F.lit(version))


def _commit(spark: SparkSession, live: DataFrame, root: str) -> None:
    # a number an unfinished commit left behind is skipped
    taken = [int(n) for n in children(spark, f"{root}/manifest") if n.isdigit()]
    live.select("company_id", "month", "version").coalesce(1).write.parquet(f"{root}/manifest/{max(taken, default=-1) + 1}")


def build_rollup(cat: Catalog, spark: SparkSession, root: str) -> str:
    """Computes the rollup of the whole fact below ``root``; an earlier one stays readable until the end."""
    root = root.rstrip("/")
    _commit(spark, _write(spark, day_rows(cat), root), root)
    return root


def refresh(cat: Catalog, spark: SparkSession, root: str, partitions: Sequence[tuple[int, str]]) -> None:
    """Recomputes the given (company, month) partitions (month as ``yyyy-MM``, or ``undated``) and leaves the others as they are."""
    root = root.rstrip("/")
    changed = spark.createDataFrame([(int(c), m) for c, m in partitions], "company_id int, month string")
    kept = manifest(spark, root).join(changed, PARTITION, "left_anti")
    _commit(spark, kept.unionByName(_write(spark, day_rows(cat, list(partitions)), root)), root)


def vacuum(spark: SparkSession, root: str) -> int:
    """Removes the versions and manifests that the latest manifest does not need; how many versions went."""
    root = root.rstrip("/")
    n = _latest(spark, root)
    live = {r.version for r in manifest(spark, root).select("version").distinct().collect()}   # one row per build or refresh
    stale = [v for v in children(spark, f"{root}/data") if v.removeprefix("version=") not in live]
    remove(spark, [f"{root}/data/{v}" for v in stale])
    remove(spark, [f"{root}/manifest/{m}" for m in children(spark, f"{root}/manifest") if m.isdigit() and int(m) < n])
    return len(stale)


def read_rollup(spark: SparkSession, root: str, company: int | None = None) -> DataFrame:
    """The live rows; the company and the live versions prune partition folders."""
    root = root.rstrip("/")
    live, rows = manifest(spark, root), spark.read.schema(STORED).parquet(f"{root}/data")
    if company is not None:
        live, rows = (x.where(F.col("company_id") == F.lit(int(company))) for x in (live, rows))
    return rows.join(live, [*PARTITION, "version"], "left_semi")


# ---------------------------------------------------------------- reports
def bundle_from_rollup(cat: Catalog, spark: SparkSession, root: str, filters: Filters | None = None, as_of: dt.date | str | None = None,
                       dimensions: Sequence[str] = DIMENSION_ORDER) -> DataFrame:
    """``aging.bundle`` from a stored rollup: dimension, label, 16 rounded metrics. ``cat`` gives the labels only."""
    filters = filters or Filters()
    as_of = as_date(as_of)
    dims = _check_dims(dimensions)
    order_dims = [d for d in dims if DIMENSIONS[d].side == "order"]
    fact_dims = [d for d in dims if DIMENSIONS[d].side == "fact"]
    fact_kind = "fact_order" if filters.needs_orders else "fact"
    kinds = (["order"] if order_dims else []) + ([fact_kind] if fact_dims else [])
    rows = read_rollup(spark, root, filters.company).where(F.col("kind").isin(kinds))
    if filters.needs_orders:
        rows = rows.where(filters.order_predicate())
    keys = [ORDER_KEY[d] for d in order_dims] + [FACT_COLUMN[d] for d in fact_dims]
    g = rows.withColumn("bucket", F.expr(bucket_sql(age_sql(as_of, "day")))).groupBy("kind", "bucket", *keys).agg(*_sums())
    g, labels = _attach_order_labels(cat, g, order_dims, True, [])
    pairs = {"order": [(d, labels[d]) for d in order_dims], fact_kind: [(d, FACT_COLUMN[d]) for d in fact_dims]}
    whens = " ".join(
        f"WHEN kind = '{kind}' THEN array(" + ", ".join(f"named_struct('dimension', '{d}', 'label', CAST({ident(c)} AS STRING))" for d, c in p) + ")"
        for kind, p in pairs.items() if p)
    wide = widen(g.selectExpr(f"inline(CASE {whens} END)", "bucket", "balance", "value"))
    return wide.selectExpr("dimension", "label", *[f"{round0_sql(c)} AS {ident(c)}" for c in METRIC_COLS])
