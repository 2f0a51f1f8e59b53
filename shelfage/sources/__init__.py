"""Sources: canonical table catalogs (stored parquet, in-memory frames, driver-table adapter)."""

from .catalog import Catalog, DataFrameCatalog, ParquetCatalog, TableCatalog
from .driver_tables import DUCKDB_CANONICAL_CTES, DriverCatalog

__all__ = ["Catalog", "DataFrameCatalog", "ParquetCatalog", "TableCatalog", "DriverCatalog", "DUCKDB_CANONICAL_CTES"]
