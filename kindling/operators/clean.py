"""Cleaning and validation operators.

Statistics that a filter needs (mean/std for the outlier rule) are scalar
subqueries over a one-row aggregate: Spark merges them into one job, the row
count is fixed at one, and no join is planned.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindling.functions.columns import date_from_year_day, hash_uniform, nan_to_null, num, parse_date, sample_std
from kindling.schema import (
    AUSTRALIA,
    CRITICAL_COLUMNS,
    OUTLIER_SIGMA,
    SYNTHETIC_END,
    SYNTHETIC_SEED,
    SYNTHETIC_START,
    TARGET,
    require_columns,
)

_FLOATS = (T.DoubleType, T.FloatType)


def float_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, _FLOATS)]


def nullify_nan(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """NaN -> NULL in float columns (pandas has one missing value)."""
    cols = float_columns(df) if cols is None else [c for c in cols if c in float_columns(df)]
    if not cols:
        return df
    return df.withColumns({c: nan_to_null(c) for c in cols})


def drop_missing(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop rows with NULL or NaN in any of ``cols``; absent column -> KeyError.

    Written as plain predicates on the raw columns, so ``IS NOT NULL`` reaches
    the Parquet scan.
    """
    require_columns(df, cols)
    floats = set(float_columns(df))
    cond = None
    for c in cols:
        e = F.col(c).isNotNull() & (~F.isnan(F.col(c)) if c in floats else F.lit(True))
        cond = e if cond is None else cond & e
    return df.where(cond) if cond is not None else df


def coerce_date(df: DataFrame, col: str = "acq_date") -> DataFrame:
    """Text -> DATE, unparseable -> NULL; only if the column exists."""
    if col not in df.columns:
        return df
    dt = df.schema[col].dataType
    if isinstance(dt, T.DateType):
        return df
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return df.withColumn(col, F.to_date(F.col(col)))
    return df.withColumn(col, parse_date(col))


def filter_region(df: DataFrame, min_lat: float = AUSTRALIA[0], max_lat: float = AUSTRALIA[1],
                  min_lon: float = AUSTRALIA[2], max_lon: float = AUSTRALIA[3],
                  lat_col: str = "latitude", lon_col: str = "longitude") -> DataFrame:
    """Inclusive bounding box (literal bounds: pushed down to the scan).

    NaN fails the upper bound (Spark orders NaN above every number), so the
    raw columns can be filtered directly.
    """
    require_columns(df, [lat_col, lon_col])
    return df.where(F.col(lat_col).between(min_lat, max_lat) & F.col(lon_col).between(min_lon, max_lon))


def filter_outliers(df: DataFrame, col: str, k: float = OUTLIER_SIGMA) -> DataFrame:
    """P5: keep rows strictly inside mean +- k * sample std of ``col``.

    Statistics are taken over ``df`` as given (so after earlier filters) with
    NaN read as missing.  A NULL or NaN value, or a NULL std (one row), drops
    the row, as in pandas.  Skipped when the column is absent.
    """
    if col not in df.columns:
        return df
    stats = df.agg(F.avg(num(col)).alias("mu"), sample_std(num(col)).alias("sd"))
    mu, sd = stats.select("mu").scalar(), stats.select("sd").scalar()
    c = F.col(col)
    return df.where((c > mu - F.lit(k) * sd) & (c < mu + F.lit(k) * sd))


def require_target(df: DataFrame, target: str) -> DataFrame:
    """ValueError when the target column is absent."""
    if target not in df.columns:
        raise ValueError(f"Target column '{target}' not found in data")
    return df


def clean_detections(df: DataFrame) -> DataFrame:
    """The fixed preset: drop missing critical columns, coerce the date, keep the
    Australian box (if lat/lon exist), drop brightness outliers (3 sigma), NaN->NULL.

    Filters run on the raw columns (NaN-safe) so they reach the scan; the
    NaN->NULL projection comes last.
    """
    out = drop_missing(df, [c for c in CRITICAL_COLUMNS])
    out = coerce_date(out, "acq_date")
    if "latitude" in out.columns and "longitude" in out.columns:
        out = filter_region(out)
    return nullify_nan(filter_outliers(out, TARGET, OUTLIER_SIGMA))


def create_dataset(df: DataFrame, critical_columns: Sequence[str] = (), date_col: str = "acq_date",
                   region: Mapping | None = None, outliers: Mapping | None = None,
                   target: str | None = None) -> DataFrame:
    """Configurable P1 -> P3 -> P4 -> P5 -> P6, in that order.

    ``region``: {"enabled": bool, "min_latitude", "max_latitude", "min_longitude",
    "max_longitude", "lat_col", "lon_col"}; ``outliers``: {"enabled", "column",
    "std_threshold"} (the reference's configuration keys).
    """
    out = df
    if critical_columns:
        out = drop_missing(out, critical_columns)
    out = coerce_date(out, date_col)
    region = region or {}
    if region.get("enabled", False):
        out = filter_region(out, region.get("min_latitude", AUSTRALIA[0]), region.get("max_latitude", AUSTRALIA[1]),
                            region.get("min_longitude", AUSTRALIA[2]), region.get("max_longitude", AUSTRALIA[3]),
                            region.get("lat_col", "latitude"), region.get("lon_col", "longitude"))
    outliers = outliers or {}
    if outliers.get("enabled", False):
        out = filter_outliers(out, outliers.get("column"), outliers.get("std_threshold", OUTLIER_SIGMA))
    if target:
        require_target(out, target)
    # NaN -> NULL last: a projection after the filters keeps them pushed down
    return nullify_nan(out)


def ensure_acq_date(df: DataFrame, out_col: str = "acq_date", fill: str | None = None,
                    seed: int = SYNTHETIC_SEED, row_id: str | None = None) -> DataFrame:
    """Derive ``acq_date`` (DATE) when absent.

    From ``acquisition_date`` (text or timestamp); else from ``acq_year`` +
    ``acq_day`` (day of year, out-of-range -> NULL); else NULL, unless
    ``fill="synthetic"``: then a hash-derived date in the synthetic window, with
    ``is_synthetic_date`` = true so that it is never mistaken for data.
    """
    if out_col in df.columns:
        return df
    if "acquisition_date" in df.columns:
        dt = df.schema["acquisition_date"].dataType
        src = F.col("acquisition_date")
        val = F.to_date(src) if isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)) \
            else parse_date(src)
        return df.withColumn(out_col, val)
    if "acq_year" in df.columns and "acq_day" in df.columns:
        return df.withColumn(out_col, date_from_year_day("acq_year", "acq_day"))
    if fill != "synthetic":
        return df.withColumn(out_col, F.lit(None).cast("date"))
    if row_id is None:
        raise ValueError("fill='synthetic' needs a row_id column for repeatable dates")
    start = F.to_date(F.lit(SYNTHETIC_START))
    span = F.datediff(F.to_date(F.lit(SYNTHETIC_END)), start) + 1
    offset = F.floor(hash_uniform(seed, out_col, F.col(row_id)) * span).cast("int")
    return df.withColumns({out_col: F.date_add(start, offset), "is_synthetic_date": F.lit(True)})


def require_features(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """P20: raise listing every missing feature; then project them in the given order."""
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise ValueError(f"Missing features: {missing}")
    return df.select(*names)


def range_check(df: DataFrame, bounds: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Add ``violations`` (names of the rules broken, NULL counts as broken) and ``valid``."""
    require_columns(df, list(bounds))
    flags = [F.when(~F.coalesce(F.col(c).between(lo, hi), F.lit(False)), F.lit(c)) for c, (lo, hi) in bounds.items()]
    out = df.withColumn("violations", F.filter(F.array(*flags), lambda x: x.isNotNull()))
    return out.withColumn("valid", F.size("violations") == 0)


def range_violation_counts(df: DataFrame, bounds: Mapping[str, tuple[float, float]]) -> DataFrame:
    """P21 summary: rows and per-rule violation counts in one aggregate."""
    require_columns(df, list(bounds))
    aggs = [F.count(F.lit(1)).alias("n")]
    for c, (lo, hi) in bounds.items():
        aggs.append(F.sum(F.when(F.coalesce(F.col(c).between(lo, hi), F.lit(False)), 0).otherwise(1))
                    .cast("long").alias(f"bad_{c}"))
    return df.agg(*aggs)


def filter_dates(df: DataFrame, col: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Inclusive date range on the DATE of ``col``."""
    d = F.col(col).cast("date")
    cond = F.lit(True)
    if start is not None:
        cond = cond & (d >= F.to_date(F.lit(start)))
    if end is not None:
        cond = cond & (d <= F.to_date(F.lit(end)))
    return df.where(cond)


def null_audit(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Missing cells per column (NULL, or NaN in float columns), one aggregate, long output."""
    cols = list(cols or df.columns)
    floats = set(float_columns(df))
    aggs = []
    for c in cols:
        miss = F.col(c).isNull() | F.isnan(F.col(c)) if c in floats else F.col(c).isNull()
        aggs.append(F.count_if(miss).alias(c))
    wide = df.agg(*aggs)
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("long").alias("nulls")) for c in cols])
    return wide.select(F.inline(pairs))
