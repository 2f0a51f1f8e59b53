"""Column expressions shared by the reports (all built-in, JVM-side).

The larger fixed expressions are written as Spark SQL expression text
(``*_sql`` helpers) and turned into Columns with ``F.expr``: one parse on
the JVM instead of dozens of Python-to-JVM calls per builder chain, which
keeps plan construction cheap. User-supplied values never go into SQL
text; they are bound with ``F.lit``.
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from ..schema import BUCKET_NAME_PREFIXES, BUCKETS, UNKNOWN_NAME


def ident(name: str) -> str:
    """Quoted identifier for SQL expression text."""
    return "`" + name.replace("`", "``") + "`"


def as_date(as_of: dt.date | str | None) -> dt.date:
    """Resolve the clock once; ``None`` means the current date in the session's time zone."""
    if as_of is None:
        session = SparkSession.getActiveSession()
        return session.sql("SELECT current_date()").first()[0] if session else dt.date.today()
    if isinstance(as_of, dt.datetime):
        return as_of.date()
    if isinstance(as_of, dt.date):
        return as_of
    return dt.date.fromisoformat(str(as_of))


def age_sql(as_of: dt.date, action_date: str = "action_date") -> str:
    """Whole days from the action date (time of day dropped) to ``as_of``."""
    return f"datediff(DATE'{as_of.isoformat()}', to_date({ident(action_date)}))"


def age_days(as_of: dt.date, action_date: str | Column = "action_date") -> Column:
    if isinstance(action_date, str):
        return F.expr(age_sql(as_of, action_date))
    return F.datediff(F.lit(as_of), F.to_date(action_date))


def bucket_sql(age: str) -> str:
    """CASE text giving the bucket name of an age; NULL for negative or unknown ages."""
    whens = []
    for name, lo, hi in BUCKETS:
        cond = f"{age} BETWEEN {lo} AND {hi}" if hi is not None else f"{age} >= {lo}"
        whens.append(f"WHEN {cond} THEN '{name}'")
    return "CASE " + " ".join(whens) + " END"


def bucket_of(age: str | Column) -> Column:
    """Bucket name of an age (SQL text or Column), NULL for negative or unknown ages."""
    if isinstance(age, str):
        return F.expr(bucket_sql(age))
    expr = None
    for name, lo, hi in BUCKETS:
        cond = age.between(lo, hi) if hi is not None else age >= lo
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr


def line_value(balance: str = "fg_balance", price: str = "price_unit") -> Column:
    """Exact decimal product; NULL price gives NULL."""
    return F.expr(f"{ident(balance)} * {ident(price)}")


def json_value_sql(json_col: str) -> str:
    """A JSON text in one form for equal values: keys in order (shorter first, then by bytes), numbers and spaces normalized.

    Objects are printed as ``{"k": v, ...}``, so names stored in that form stay as they are. Other values get the compact
    form; text that is no JSON stays as it is. A repeated key is kept with all its values.
    """
    c = ident(json_col)
    quoted = "substring(to_json(array(e.k)), 2, length(to_json(array(e.k))) - 2)"
    entries = f"transform(map_entries(from_json({c}, 'map<string,variant>')), " \
              "e -> struct(octet_length(e.key) AS n, e.key AS k, coalesce(to_json(e.value), 'null') AS v))"
    return f"coalesce(concat('{{', array_join(transform(array_sort({entries}), e -> concat({quoted}, ': ', e.v)), ', '), '}}'), " \
           f"to_json(try_parse_json({c})), {c})"


def json_order_sql(json_col: str) -> str:
    """Sort key of a JSON text: objects after other values, by their number of pairs, then pair by pair (key length, key, value)."""
    c = ident(json_col)
    entries = f"array_sort(transform(map_entries(from_json({c}, 'map<string,string>')), " \
              "e -> struct(octet_length(e.key) AS n, e.key AS k, e.value AS v)))"
    return f"CASE WHEN {c} IS NOT NULL THEN struct(coalesce(size({entries}), -1) AS pairs, {entries} AS entries, {c} AS text) END"


def label_order(label: Column, collation: str | None = None) -> list[Column]:
    """Sort columns of a label, NULL last: by bytes, or by a collation (``UNICODE``: a, A, b) and then by bytes."""
    by_bytes = label.asc_nulls_last()
    return [F.collate(label, collation).asc_nulls_last(), by_bytes] if collation else [by_bytes]


def translated_label_sql(json_col: str) -> str:
    c = ident(json_col)
    return f"coalesce(get_json_object({c}, '$.en_US'), {c})"


def translated_label(json_text: str | Column) -> Column:
    """``name.en_US`` of a translated JSON name, else the whole stored text."""
    if isinstance(json_text, str):
        return F.expr(translated_label_sql(json_text))
    return F.coalesce(F.get_json_object(json_text, "$.en_US"), json_text)


def round0_sql(col: str) -> str:
    return f"CAST(round({ident(col)}, 0) AS BIGINT)"


def round0(col: str | Column) -> Column:
    """Decimal round to an integer, half away from zero, as bigint."""
    if isinstance(col, str):
        return F.expr(round0_sql(col))
    return F.round(col, 0).cast("bigint")


def thousands_label(col: Column, digits: int) -> Column:
    """``value / 1000`` with ``digits`` decimals, grouped, plus ``' K'``; NULL gives ``'0 K'``.

    The division is decimal and the rounding HALF_UP before formatting, so no
    double rounding step can differ between engines.
    """
    k = F.round(col.cast("decimal(38,0)") * F.lit(Decimal("0.001")), digits)
    return F.when(col.isNull(), F.lit("0 K")).otherwise(F.concat(F.format_number(k, digits), F.lit(" K")))


def name_or_unknown(col: Column) -> Column:
    return F.coalesce(F.nullif(col, F.lit("")), F.lit(UNKNOWN_NAME))


def clean_bucket_name(metric: str | None) -> str:
    """``Balance_0-5`` / ``Value_0-5`` -> ``0-5``; ``Total_Balance`` -> ``Balance`` (no bucket)."""
    name = metric or ""
    for prefix in BUCKET_NAME_PREFIXES:
        name = name.replace(prefix, "")
    return name


def bucket_bounds(metric: str | None) -> tuple[int, int | None] | None:
    """Closed day range of a metric column name, or None when it selects no bucket."""
    clean = clean_bucket_name(metric)
    for name, lo, hi in BUCKETS:
        if name == clean:
            return lo, hi
    return None


def action_date_range(as_of: dt.date, bounds: tuple[int, int | None], dtype: DataType,
                      action_date: str = "action_date") -> Column:
    """Age range rewritten as a range on the raw column, so parquet can skip row groups.

    ``lo <= as_of - date(t) <= hi``  <=>  ``as_of - hi <= t < as_of - lo + 1 day``.
    Literals take the column's own type, which keeps the comparison pushable.
    """
    lo, hi = bounds
    c, t = ident(action_date), dtype.simpleString()
    upper = as_of - dt.timedelta(days=lo - 1)
    cond = f"{c} < CAST('{upper.isoformat()}' AS {t})"
    if hi is not None:
        lower = as_of - dt.timedelta(days=hi)
        cond = f"{c} >= CAST('{lower.isoformat()}' AS {t}) AND {cond}"
    return F.expr(cond)


def escape_like(term: str) -> str:
    return term.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def contains_ci(col: str | Column, term: str) -> Column:
    """Case-insensitive substring test (``ilike '%term%'`` with wildcards escaped)."""
    c = F.col(col) if isinstance(col, str) else col
    return c.ilike(f"%{escape_like(term)}%")
