"""Joins of folded fact rows with a dimension, with no key in one task.

Rows without a key match nothing and are dealt over all partitions by a hash. A key that more than ``HEAVY_ROWS`` folded rows
share is cut into pieces of about that many rows; its dimension row is replicated once per piece. Keys below that
travel as they are. The heavy keys come from a map-side combined count of the folded rows, whose exchange the join
reuses. They are at most one per ``HEAVY_ROWS`` rows (16 bytes each), which bounds what is broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import ident

#: Folded rows of one key that one task joins at most (about).
HEAVY_ROWS = 1_000_000


def heavy_keys(rows: DataFrame, key: str, heavy_rows: int) -> DataFrame:
    """(_heavy, _pieces): keys with more than ``heavy_rows`` rows, and in how many pieces they are cut."""
    return rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_heavy")).agg(F.count(F.lit(1)).alias("_rows")) \
        .where(F.col("_rows") > heavy_rows).select("_heavy", F.ceil(F.col("_rows") / heavy_rows).cast("int").alias("_pieces"))


def join_dimension(rows: DataFrame, key: str, dim: DataFrame, dim_key: str, spread_by: Sequence[str], how: str = "left",
                   counted: DataFrame | None = None, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """``rows`` joined with ``dim`` on a unique dimension key; ``dim_key`` is dropped.

    ``counted`` are the rows the heavy keys are counted in (``rows`` themselves if not given): any frame with ``key`` that has
    at least as many rows of each key, so that a cheaper ancestor can be counted.
    """
    heavy = F.broadcast(heavy_keys(rows if counted is None else counted, key, heavy_rows))
    spread = f"xxhash64({', '.join(ident(c) for c in spread_by)})"
    left = rows.join(heavy, F.col(key) == F.col("_heavy"), "left").withColumn("_piece", F.expr(
        f"CAST(CASE WHEN {ident(key)} IS NULL THEN pmod({spread}, 4096) WHEN _pieces IS NULL THEN 0 ELSE pmod({spread}, _pieces) END AS INT)"))
    right = dim.join(heavy.select(F.col("_heavy").alias("_dim_heavy"), F.col("_pieces").alias("_dim_pieces")),
                     F.col(dim_key) == F.col("_dim_heavy"), "left") \
        .select(*dim.columns, F.explode(F.sequence(F.lit(0), F.coalesce("_dim_pieces", F.lit(1)) - 1)).alias("_copy"))
    return left.join(right, (F.col(key) == F.col(dim_key)) & (F.col("_piece") == F.col("_copy")), how) \
        .drop("_heavy", "_pieces", "_piece", "_copy", dim_key)
