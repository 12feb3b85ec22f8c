"""Column-expression helpers (all built-in Spark SQL expressions)."""

from kindling.functions.columns import (  # noqa: F401
    band_color,
    band_label,
    date_from_year_day,
    hash_uniform,
    nan_to_null,
    num,
    radius,
    safe_div,
    sample_std,
    split_hash,
)
