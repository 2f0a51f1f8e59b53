"""Canonical table access.

Every report asks a catalog for a canonical table *and the columns it
needs*. A stored catalog just prunes columns (Catalyst would do that too);
the driver-table adapter uses the column list to leave out joins that
only feed columns nobody asked for, something Catalyst cannot do for an
outer join because it knows nothing about key uniqueness.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from ..schema import TABLE_COLUMNS


class Catalog:
    """Base: ``table(name, columns)`` returns a DataFrame with exactly those columns."""

    #: fact and orders are stored in buckets of the order id: their join needs no shuffle and keeps its one key
    co_located = False
    #: fact columns that follow from ``fact_key`` and are stored by it, apart from the lines
    keyed_columns: frozenset[str] = frozenset()
    fact_key = "product_id"

    def table(self, name: str, columns: Sequence[str] | None = None) -> DataFrame:
        raise NotImplementedError

    def attributes(self, columns: Sequence[str]) -> DataFrame:
        """``fact_key`` (unique) and some of the ``keyed_columns``: operators fold the lines by the key and attach these afterwards."""
        raise NotImplementedError

    @staticmethod
    def _columns(name: str, columns: Sequence[str] | None) -> list[str]:
        if name not in TABLE_COLUMNS:
            raise KeyError(f"unknown canonical table {name!r}")
        cols = list(columns) if columns is not None else list(TABLE_COLUMNS[name])
        bad = [c for c in cols if c not in TABLE_COLUMNS[name]]
        if bad:
            raise KeyError(f"{name} has no column(s) {bad}")
        return list(dict.fromkeys(cols))


class DataFrameCatalog(Catalog):
    """Canonical tables given as DataFrames (tests, or tables already loaded)."""

    def __init__(self, frames: Mapping[str, DataFrame]):
        self.frames = dict(frames)

    def table(self, name, columns=None):
        return self.frames[name].select(*self._columns(name, columns))


class ParquetCatalog(Catalog):
    """Canonical tables stored as ``<root>/<table>`` parquet directories.

    The fact table is expected partitioned by ``company_id`` (see
    ``sinks.write_canonical``), so the company filter prunes whole
    directories before any file is opened.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def table(self, name, columns=None):
        df = self.spark.read.parquet(f"{self.root}/{name}")
        return df.select(*self._columns(name, columns))


class TableCatalog(Catalog):
    """Canonical tables registered in the session catalog as ``<prefix><table>``.

    Used for the bucketed layout of ``sinks.write_canonical(..., buckets=n)``:
    bucket specs live in the catalog, so only tables (not bare paths) let
    Spark plan bucketed, shuffle-free aggregates and joins on the order key.
    """

    co_located = True

    def __init__(self, spark: SparkSession, prefix: str = ""):
        self.spark, self.prefix = spark, prefix

    def table(self, name, columns=None):
        return self.spark.table(f"{self.prefix}{name}").select(*self._columns(name, columns))
