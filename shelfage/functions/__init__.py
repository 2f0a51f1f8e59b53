"""Functions: column expressions of the ageing reports."""

from .expressions import (
    action_date_range, age_days, as_date, bucket_bounds, bucket_of, clean_bucket_name,
    contains_ci, escape_like, line_value, name_or_unknown, round0, thousands_label,
    translated_label,
)

__all__ = [
    "action_date_range", "age_days", "as_date", "bucket_bounds", "bucket_of", "clean_bucket_name",
    "contains_ci", "escape_like", "line_value", "name_or_unknown", "round0", "thousands_label",
    "translated_label",
]
