"""Sinks: canonical table layout, report exports and their names (SNK-1..4).

Exports are directories of parquet (or CSV) written by the executors; the
driver only plans them. A report bundle and its totals rows are written by
one job (one fact scan), partitioned by dimension; the KPI table is then
derived from that written table, never from the fact again.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from .functions.expressions import as_date, label_order
from .operators.drilldown import drilldown_title, drilldown_with_total
from .operators.totals import bundle_with_totals, kpi_summary, kpi_table
from .schema import DIMENSIONS, EXPORT_FILE_PREFIX, EXPORT_METRIC_COLS, TABLE_COLUMNS
from .session import children, remove
from .sources.catalog import Catalog


def export_name(as_of: dt.date | str | None = None) -> str:
    """``FG_Stock_Aging_<yyyymmdd>`` for the export's as-of date."""
    return f"{EXPORT_FILE_PREFIX}{as_date(as_of).strftime('%Y%m%d')}"


def drilldown_export_name(group_value: str | None, bucket: str | None) -> str:
    """``<group_value>_<bucket>`` with spaces replaced by ``_``."""
    return f"{group_value}_{bucket}".replace(" ", "_")


def path_name(name: str) -> str:
    """A file name for any text: ASCII letters, digits, ``-``, ``+`` and ``_`` as they are, ``.`` after the first character,
    every other byte of its UTF-8 form as ``=XX``. No separator, no relative step, nothing a file system reads as a URI or glob."""
    safe = set(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-+")
    out = "".join(chr(b) if b in safe or (b == 46 and i) or (b == 95 and i) else f"={b:02X}" for i, b in enumerate(name.encode()))
    return out if len(out) <= 200 else f"{out[:150]}={hashlib.sha256(name.encode()).hexdigest()[:32]}"


def write_canonical(cat: Catalog, root: str, mode: str = "errorifexists", buckets: int | None = None,
                    table_prefix: str = "") -> None:
    """Store the canonical tables as parquet below ``root``.

    The fact is partitioned by ``company_id`` so the dashboard's company
    filter prunes whole directories.

    Without ``buckets`` (read back with ``ParquetCatalog``) the fact is
    range-partitioned on ``(company_id, action_date, oa_id)`` before the write:
    a company (or a date of it) holding most rows is split into many ranges (many
    writer tasks, never one per company), and each file covers a narrow,
    sorted date range, so age-range filters skip whole files and row
    groups.

    With ``buckets`` the tables are also registered in the session catalog
    as ``<table_prefix><name>`` (read back with ``TableCatalog``): the fact
    is bucketed and sorted by ``oa_id`` and ``sale_order`` by ``id`` with
    the same bucket count, so the per-order aggregate and the order join of
    the order-side reports and drill-downs run without any shuffle of the
    two largest tables. Each writer task holds exactly one bucket
    (``repartition`` on the bucket key), so every company directory gets
    ``buckets`` files. Bucketing puts all lines of one order in one bucket
    (one writer and one scan task); with an order key dominated by a single
    order, use the default layout, where AQE can split hot partitions.
    """
    root = root.rstrip("/")
    keys = {"operation_details": "oa_id", "sale_order": "id"}
    for name in TABLE_COLUMNS:
        df = cat.table(name)
        path = f"{root}/{name}"
        if buckets:
            w = (df.repartition(buckets, keys[name]) if name in keys else df).write.mode(mode)
            if name == "operation_details":
                w = w.partitionBy("company_id")
            if name in keys:
                w = w.bucketBy(buckets, keys[name]).sortBy(keys[name])
            w.option("path", path).saveAsTable(f"{table_prefix}{name}")
        elif name == "operation_details":
            (df.repartitionByRange("company_id", "action_date", "oa_id").sortWithinPartitions("company_id", "action_date", "oa_id")
             .write.mode(mode).partitionBy("company_id").parquet(path))
        else:
            df.write.mode(mode).parquet(path)


REPORT_SCHEMA = ", ".join(["label string", *[f"`{c}` bigint" for c in EXPORT_METRIC_COLS], "row_type string", "row_order int",
                           "position bigint", "dimension string"])
MANIFEST_SCHEMA = "folder string, format string, parts string"
SUMMARY_SCHEMA = "position int, section string, metric string, value bigint"
DETAIL_SCHEMA = ("OA string, Category string, Product string, Qty decimal(38,2), Value bigint, row_type string, row_order int, "
                 "position bigint, title string, export_name string")
# CSV keeps NULL, empty texts and line breaks apart and whole
_CSV = {"header": "true", "nullValue": "\\N", "emptyValue": "", "quoteAll": "true", "escape": '"', "multiLine": "true"}


def _placed(df: DataFrame) -> DataFrame:
    """Adds ``position``, increasing in the frame's order (the rows must be sorted)."""
    return df.withColumn("position", F.monotonically_increasing_id())


@contextmanager
def _export(spark: SparkSession, out: str, fmt: str, mode: str, parts: Sequence[str]) -> Iterator[str | None]:
    """One export as one commit: the block writes below the folder it gets, the manifest that names the folder is written last.

    Until then readers see the earlier export, or none. ``None`` is given when there is nothing to write (``ignore``).
    A folder whose block failed is removed.
    """
    if mode not in ("errorifexists", "error", "overwrite", "ignore"):
        raise ValueError(f"an export cannot be written with mode {mode!r}")
    before = _manifest(spark, out)
    if before is not None and mode in ("errorifexists", "error"):
        raise FileExistsError(f"{out} holds a complete export")
    if before is not None and mode == "ignore":
        yield None
        return
    folder = f"data-{uuid.uuid4().hex[:12]}"
    try:
        yield f"{out}/{folder}"
    except BaseException:
        remove(spark, [f"{out}/{folder}"])
        raise
    spark.createDataFrame([(folder, fmt, ",".join(parts))], MANIFEST_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{out}/manifest")
    if before is not None:
        remove(spark, [f"{out}/{before.folder}"])


def _manifest(spark: SparkSession, out: str) -> Row | None:
    done = "_SUCCESS" in children(spark, f"{out}/manifest")
    return spark.read.schema(MANIFEST_SCHEMA).parquet(f"{out}/manifest").first() if done else None


def committed(spark: SparkSession, out: str, part: str, fmt: str) -> str:
    """The folder of one part of a complete export; an incomplete one, or a part it does not have, is refused."""
    out = out.rstrip("/")
    found = _manifest(spark, out)
    if found is None:
        raise FileNotFoundError(f"{out} holds no complete export")
    if part not in found.parts.split(",") or fmt != found.format:
        raise FileNotFoundError(f"the export {out} has {found.parts} as {found.format}, not {part} as {fmt}")
    return f"{out}/{found.folder}/{part}"


def write_reports(stacked: DataFrame, path: str, as_of: dt.date | str | None = None,
                  fmt: str = "parquet", mode: str = "errorifexists", *,
                  dimensions: Sequence[str], collation: str | None = None) -> str:
    """Write a stacked, rounded bundle as the dashboard export (SNK-2).

    Layout below ``<path>/FG_Stock_Aging_<yyyymmdd>``: ``manifest/``, written last, names the folder that holds
    ``reports/dimension=<d>/`` -- each report of ``dimensions`` (those the bundle was made for) with its
    ``Total`` row, export column order (interleaved, totals last), ``row_type`` / ``row_order`` and ``position``
    (label order, the total first; ``collation`` orders the labels linguistically) -- and
    ``summary/`` -- the KPI table (read back from the written payment-terms
    rows), only when the payment terms are among the reports. Returns the export directory.
    """
    out = f"{path.rstrip('/')}/{export_name(as_of)}"
    spark = stacked.sparkSession
    opts = _fmt_opts(fmt)
    stacked = stacked.where(F.col("dimension").isin(list(dimensions)))
    parts = ["reports", *(["summary"] if "payment_terms" in dimensions else [])]
    with _export(spark, out, fmt, mode, parts) as folder:
        if folder is None:
            return out
        # 1) reports with their totals rows: one job, one fact scan
        reports = bundle_with_totals(stacked, dimensions=dimensions) \
            .orderBy("dimension", "row_order", *label_order(F.col("label"), collation))
        _placed(reports).select("dimension", "label", *EXPORT_METRIC_COLS, "row_type", "row_order", "position") \
            .write.format(fmt).options(**opts).partitionBy("dimension").save(f"{folder}/reports")
        # 2) KPI summary from the written payment-terms rows (small), not from the fact
        if "summary" in parts:
            pt = (read_rows(spark, f"{folder}/reports", fmt, REPORT_SCHEMA)
                  .where((F.col("dimension") == "payment_terms") & (F.col("row_type") == "row")))
            kpi_table(kpi_summary(pt)).coalesce(1).write.format(fmt).options(**opts).save(f"{folder}/summary")
    return out


def _fmt_opts(fmt: str) -> dict:
    return dict(_CSV) if fmt == "csv" else {}


def read_rows(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None) -> DataFrame:
    """The rows of an export; text formats are read with a fixed schema, never an inferred one."""
    if fmt == "csv" and schema is None:
        raise ValueError("a CSV export is read with its schema")
    reader = spark.read.format(fmt).options(**_fmt_opts(fmt))
    return (reader.schema(schema) if fmt == "csv" else reader).load(path)


def read_report(spark: SparkSession, export_dir: str, dimension: str, fmt: str = "parquet") -> DataFrame:
    """One report of a complete export, with its own label column name (partition pruned)."""
    df = read_rows(spark, committed(spark, export_dir, "reports", fmt), fmt, REPORT_SCHEMA)
    return (df.where(F.col("dimension") == dimension)
            .select(F.col("label").alias(DIMENSIONS[dimension].label), *EXPORT_METRIC_COLS, "row_type", "row_order", "position"))


def read_summary(spark: SparkSession, export_dir: str, fmt: str = "parquet") -> DataFrame:
    return read_rows(spark, committed(spark, export_dir, "summary", fmt), fmt, SUMMARY_SCHEMA)


def read_detail(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read_rows(spark, committed(spark, path, "detail", fmt), fmt, DETAIL_SCHEMA)


def numbered(rows: DataFrame) -> DataFrame:
    """``position`` as 1, 2, ... in its order, for the rows of one report or detail.

    A position holds the writing task's number and the row's place in it, so only counts per writing task are added up.
    """
    rows = rows.withColumn("_part", F.shiftright("position", 33))
    tasks = rows.groupBy("_part").agg(F.min("position").alias("_first"), F.count(F.lit(1)).alias("_n"))
    tasks = tasks.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).drop("_n")
    return rows.join(tasks, "_part").withColumn("position", F.col("position") - F.col("_first") + F.col("_before") + 1) \
        .drop("_part", "_first", "_before")


def write_drilldown(detail: DataFrame, path: str, group_value: str | None, bucket: str | None,
                    fmt: str = "parquet", mode: str = "errorifexists", group_type: str | None = None) -> str:
    """Detail rows plus their total row below ``<path>/<group_value>_<bucket>`` (SNK-3, SNK-4).

    ``detail`` may already carry its total (``drilldown(..., with_total=True)``). The folder is the path-safe form
    (``path_name``) of the export name; the rows carry the exact name, the screen's title (EXP-15) and their position.
    """
    name = drilldown_export_name(group_value, bucket)
    out = f"{path.rstrip('/')}/{path_name(name)}"
    if "row_type" not in detail.columns:
        detail = drilldown_with_total(detail).orderBy("row_order", F.col("OA").asc_nulls_last(), F.col("Product").asc_nulls_last())
    rows = _placed(detail).withColumn("title", F.lit(drilldown_title(group_type, group_value, str(bucket)))).withColumn("export_name", F.lit(name))
    with _export(detail.sparkSession, out, fmt, mode, ["detail"]) as folder:
        if folder is not None:
            rows.write.format(fmt).options(**_fmt_opts(fmt)).save(f"{folder}/detail")
    return out
