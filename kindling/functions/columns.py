"""Reusable column expressions.  Nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kindling.schema import BAND_HIGH, BAND_MODERATE, BANDS, RADIUS_SCALE


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c) -> Column:
    """NaN -> NULL so that pandas' single notion of "missing" holds."""
    return F.nanvl(_c(c), F.lit(None).cast("double"))


def num(c) -> Column:
    """Column as double with NaN read as NULL: the input form for aggregates, so
    that filters can still run on the raw column (and reach the scan)."""
    return nan_to_null(_c(c).cast("double"))


def safe_div(a, b) -> Column:
    """a / b, NULL when b is 0 or NULL (ANSI-safe)."""
    return F.try_divide(_c(a), _c(b))


def sample_std(c) -> Column:
    """Aggregate: sample std (ddof 1) that is exactly 0 for a constant column and
    NULL below two values.  Spark's merged moment sums leave ~1e-16 for a
    constant, which would otherwise turn "divide by zero" into huge numbers."""
    x = _c(c)
    return (F.when(F.count(x) < 2, F.lit(None).cast("double"))
            .when(F.min(x) == F.max(x), F.lit(0.0))
            .otherwise(F.stddev_samp(x)))


def band_label(pred, high: float = BAND_HIGH, moderate: float = BAND_MODERATE) -> Column:
    """Intensity band; boundaries go to the lower band, NULL (and NaN) gives NULL."""
    p = num(pred)
    return (F.when(p > high, F.lit(BANDS[0][0]))
            .when(p > moderate, F.lit(BANDS[1][0]))
            .when(p.isNotNull(), F.lit(BANDS[2][0])))


def band_color(pred, high: float = BAND_HIGH, moderate: float = BAND_MODERATE) -> Column:
    p = num(pred)
    return (F.when(p > high, F.lit(BANDS[0][1]))
            .when(p > moderate, F.lit(BANDS[1][1]))
            .when(p.isNotNull(), F.lit(BANDS[2][1])))


def radius(pred, scale: float = RADIUS_SCALE) -> Column:
    return num(pred) * F.lit(scale)


def split_hash(seed, *keys) -> Column:
    """md5 hex of ``'<seed>:<key>[:<key>...]'``: a partition-independent shuffle order.
    A NULL key hashes as the text ``\\N`` (never a NULL hash, so no row is lost)."""
    parts = [F.lit(f"{seed}:")]
    for i, k in enumerate(keys):
        if i:
            parts.append(F.lit(":"))
        parts.append(F.coalesce(_c(k).cast("string"), F.lit("\\N")))
    return F.md5(F.concat(*parts))


def hash_uniform(seed, name: str, row_id) -> Column:
    """Uniform double in [0, 1) from md5(seed:name:id); same value on any partitioning."""
    h = F.md5(F.concat(F.lit(f"{seed}:{name}:"), _c(row_id).cast("string")))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / F.lit(float(2 ** 52))


# Text date layouts tried in order (ISO first, month before day
# for slash dates, as pandas does for ambiguous input).
DATE_FORMATS = ["yyyy/MM/dd", "MM/dd/yyyy", "yyyyMMdd"]


def parse_date(c) -> Column:
    """Text -> DATE: ISO (with or without a time part), then the layouts above; else NULL."""
    s = _c(c).cast("string")
    return F.coalesce(F.try_to_date(s), *[F.try_to_date(s, f) for f in DATE_FORMATS])


def date_from_year_day(year, day) -> Column:
    """Date from year + day-of-year (1-based); NULL when the day is out of range."""
    y, d = _c(year).cast("int"), _c(day).cast("int")
    start = F.make_date(y, F.lit(1), F.lit(1))
    days_in_year = F.datediff(F.add_months(start, 12), start)
    return F.when((d >= 1) & (d <= days_in_year), F.date_add(start, d - 1))
