"""Feature operators.

Whole-table statistics for normalisation are one aggregate, read through merged
scalar subqueries (one job, one row).  Divisions are ANSI-safe: a zero divisor
gives NULL.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindling.functions.columns import nan_to_null, num, safe_div, sample_std
from kindling.schema import FEATURES, TARGET


def select_base_features(df: DataFrame, target: str = TARGET, features: Sequence[str] = FEATURES,
                         keep: Sequence[str] = ()) -> DataFrame:
    """Project the base features plus the target (and ``keep``, e.g. a row key)."""
    missing = [c for c in [*keep, *features, target] if c not in df.columns]
    if missing:
        raise KeyError(f"missing columns: {missing}")
    return df.select(*dict.fromkeys([*keep, *features, target]))


def add_ratio(df: DataFrame, out: str, num: str, *den: str) -> DataFrame:
    """num / (den1 * den2 * ...), NULL when the product is 0."""
    prod = F.col(den[0])
    for d in den[1:]:
        prod = prod * F.col(d)
    return df.withColumn(out, nan_to_null(safe_div(F.col(num), prod).cast("double")))


def frp_per_area(df: DataFrame, frp: str = "frp", scan: str = "scan", track: str = "track",
                 out: str = "frp_per_area") -> DataFrame:
    """P10: frp / (scan * track)."""
    return add_ratio(df, out, frp, scan, track)


def temperature_diff(df: DataFrame, a: str = "brightness", b: str = "bright_t31",
                     out: str = "temperature_diff") -> DataFrame:
    """A - b.  With the default columns this contains the target (leakage)."""
    return df.withColumn(out, num(a) - num(b))


def log_transform(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """{new: source} -> log1p(source); sources that are absent are skipped; x <= -1 -> NULL."""
    new = {n: F.log1p(num(s)) for n, s in mapping.items() if s in df.columns}
    return df.withColumns(new) if new else df


def normalize(df: DataFrame, cols: Sequence[str], method: str = "min_max", suffix: str = "_norm") -> DataFrame:
    """Whole-table min-max or z-score (sample std) into ``<col>_norm``.

    Absent columns are skipped; a constant column gives NULL; an unknown method
    raises.
    """
    if method not in ("min_max", "standard"):
        raise ValueError(f"unknown normalisation method: {method}")
    cols = [c for c in cols if c in df.columns]
    if not cols:
        return df
    if method == "min_max":
        aggs = [e for i, c in enumerate(cols) for e in (F.min(num(c)).alias(f"a{i}"), F.max(num(c)).alias(f"b{i}"))]
    else:
        aggs = [e for i, c in enumerate(cols)
                for e in (F.avg(num(c)).alias(f"a{i}"), sample_std(num(c)).alias(f"b{i}"))]
    stats = df.agg(*aggs)
    new = {}
    for i, c in enumerate(cols):
        a, b = stats.select(f"a{i}").scalar(), stats.select(f"b{i}").scalar()
        if method == "min_max":
            new[c + suffix] = safe_div(num(c) - a, b - a)
        else:
            new[c + suffix] = safe_div(num(c) - a, b)
    return df.withColumns(new)


def generate_features(df: DataFrame, base_only: bool = False, target: str = TARGET,
                      features: Sequence[str] = FEATURES, derived: Sequence[str] = (),
                      log: Mapping[str, str] | None = None, normalize_cols: Sequence[str] = (),
                      normalize_method: str = "min_max", keep: Sequence[str] = ()) -> DataFrame:
    """P9 alone (``base_only``), or P10 -> P11 -> P12 -> P13/P14 in that order."""
    if base_only:
        return select_base_features(df, target, features, keep)
    out = df
    if "frp_per_area" in derived:
        out = frp_per_area(out)
    if "temperature_diff" in derived:
        out = temperature_diff(out)
    if log:
        out = log_transform(out, log)
    if normalize_cols:
        out = normalize(out, normalize_cols, normalize_method)
    return out


def numeric_columns(df: DataFrame, limit: int | None = None) -> list[str]:
    """Numeric column names in schema order (optionally the first ``limit``)."""
    cols = [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and not isinstance(f.dataType, T.BooleanType)]
    return cols[:limit] if limit is not None else cols


def select_numeric(df: DataFrame, limit: int | None = None) -> DataFrame:
    return df.select(*numeric_columns(df, limit))
