"""Summaries for exploration.

Everything is an aggregate whose output size is bounded by the number of
columns, bins or groups; the data itself is never collected.  Per-column
statistics that a later expression needs are merged scalar subqueries.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindling.functions.columns import num, safe_div, sample_std, split_hash
from kindling.operators.gram import correlations
from kindling.operators.selection import exact_quantiles, exact_quantiles_of
from kindling.plans.materialize import materialize
from kindling.schema import HIST_BINS, TOP_CORRELATES


def _long(pairs: list[Column]) -> Column:
    return F.inline(F.array(*pairs))


def column_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A1: (column, count, mean, std, min, max) per column, one pass (partial + final hash agg)."""
    aggs = []
    for i, c in enumerate(cols):
        x = num(c)
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), sample_std(x).alias(f"s{i}"),
                 F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
    wide = df.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("count"), F.col(f"m{i}").alias("mean"),
                     F.col(f"s{i}").alias("std"), F.col(f"lo{i}").alias("min"), F.col(f"hi{i}").alias("max"))
            for i, c in enumerate(cols)]
    return wide.select(_long(rows))


def melt(df: DataFrame, cols: Sequence[str], name: str = "column", value: str = "value") -> DataFrame:
    """Wide -> long (name, value) for numeric columns, NULLs dropped."""
    pairs = [F.struct(F.lit(c).alias(name), num(c).alias(value)) for c in cols]
    return df.select(_long(pairs)).where(F.col(value).isNotNull())


def describe(df: DataFrame, cols: Sequence[str], exact: bool = True, accuracy: int = 100_000) -> DataFrame:
    """A2: count, mean, std, min, 25/50/75 %, max per column (long output).

    ``exact=True`` gives pandas' interpolated quantiles through histogram
    refinement (several passes, no group held in one task); ``exact=False`` uses
    one pass of ``percentile_approx`` (values are data points, rank error
    about 1/accuracy).
    """
    stats = column_stats(df, cols)
    if exact:
        # all columns share the selection's passes; the numbers are attached by a literal lookup (no join)
        vals = dict(zip(cols, exact_quantiles_of(df, [num(c) for c in cols], [0.25, 0.5, 0.75]), strict=True)) if cols else {}
        pick = [F.create_map(*[e for c in cols for e in (F.lit(c), F.lit(vals[c][i]).cast("double"))])[F.col("column")]
                .alias(name) for i, name in enumerate(("p25", "p50", "p75"))]
        return stats.select("column", "count", "mean", "std", "min", *pick, "max")
    long_ = melt(df, cols)
    pq = F.percentile_approx("value", [0.25, 0.5, 0.75], accuracy)
    q = long_.groupBy("column").agg(pq.alias("p")).select(
        "column", F.col("p")[0].alias("p25"), F.col("p")[1].alias("p50"), F.col("p")[2].alias("p75"))
    # both sides hold one row per column: the join is over tiny inputs
    return stats.join(F.broadcast(q), on="column", how="left").select(
        "column", "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def correlation_matrix(df: DataFrame, cols: Sequence[str], group_cols: Sequence[str] = ()) -> DataFrame:
    """A3: full Pearson matrix in long form (a, b, i, j, corr), pairwise-complete, per group.

    One pass of mergeable pair sums (``kindling.operators.gram``): the plan doesn't grow with the
    columns.  The diagonal is 1; a constant column's cells are NULL.
    """
    return correlations(df, cols, group_cols)


def lower_triangle(corr: DataFrame) -> DataFrame:
    """A4: the cells a heatmap shows when the upper triangle and diagonal are masked."""
    return corr.where(F.col("i") > F.col("j"))


def top_correlates(df: DataFrame, target: str, cols: Sequence[str], k: int = TOP_CORRELATES) -> DataFrame:
    """A5: features by signed correlation with the target, descending (NULL last, name breaks ties), top k."""
    feats = [c for c in cols if c != target]
    cells = correlations(df, [*feats, target]).where((F.col("b") == target) & (F.col("a") != target))
    return cells.select(F.col("a").alias("feature"), "corr").orderBy(F.col("corr").desc_nulls_last(), F.col("feature")).limit(k)


def _bin(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Equal-width bin over [lo, hi], last bin closed; a constant column falls in
    the middle bin; a NULL value has no bin (``least`` alone would skip the NULL
    and return the last bin)."""
    raw = F.floor(safe_div((x - lo) * F.lit(float(bins)), hi - lo))
    b = F.when(hi == lo, F.lit(bins // 2)).otherwise(F.least(raw, F.lit(bins - 1)))
    return F.when(x.isNotNull(), b).cast("int")


def histogram(df: DataFrame, cols: Sequence[str], bins: int = HIST_BINS) -> DataFrame:
    """(column, bin, lo, hi, count) for every non-empty bin of every column.

    min/max are merged scalar subqueries; each row is binned per column, then
    (column, bin) pairs are counted by one grouped aggregate (map-side combine).
    """
    cols = list(cols)
    stats = df.agg(*[e for i, c in enumerate(cols)
                     for e in (F.min(num(c)).alias(f"lo{i}"), F.max(num(c)).alias(f"hi{i}"))])
    los = [stats.select(f"lo{i}").scalar() for i in range(len(cols))]
    his = [stats.select(f"hi{i}").scalar() for i in range(len(cols))]
    pairs = [F.struct(F.lit(c).alias("column"), F.lit(i).alias("ci"),
                      _bin(num(c), los[i], his[i], bins).alias("bin"))
             for i, c in enumerate(cols)]
    counted = (df.select(_long(pairs)).where(F.col("bin").isNotNull())
               .groupBy("column", "ci", "bin").agg(F.count(F.lit(1)).alias("count")))
    lo_arr, hi_arr = F.array(*los), F.array(*his)
    lo = F.get(lo_arr, F.col("ci"))
    hi = F.get(hi_arr, F.col("ci"))
    width = (hi - lo) / F.lit(float(bins))
    edge_lo = F.when(hi == lo, lo - 0.5 + F.col("bin") / F.lit(float(bins))).otherwise(lo + F.col("bin") * width)
    edge_hi = F.when(hi == lo, lo - 0.5 + (F.col("bin") + 1) / F.lit(float(bins))).otherwise(
        F.when(F.col("bin") == bins - 1, hi).otherwise(lo + (F.col("bin") + 1) * width))
    return counted.select("column", "bin", edge_lo.alias("lo"), edge_hi.alias("hi"), "count")


def density_curve(df: DataFrame, col: str, grid: int = 200, fine_bins: int = 1024) -> DataFrame:
    """Gaussian KDE (Scott bandwidth sd * n^-1/5) on ``grid`` points over [min, max].

    The data is first reduced to a ``fine_bins`` histogram (one grouped
    aggregate); the kernel sum runs over bin centres, so the work after the
    aggregate is grid x fine_bins regardless of the row count.  The error is
    bounded by the bin width.
    """
    x = num(col)
    stats = df.agg(F.count(x).alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi"), sample_std(x).alias("sd"))
    n, lo, hi, sd = (stats.select(c).scalar() for c in ("n", "lo", "hi", "sd"))
    h = sd * F.pow(n.cast("double"), F.lit(-0.2))
    width = (hi - lo) / F.lit(float(fine_bins))
    b = F.least(F.floor(safe_div(x - lo, width)), F.lit(fine_bins - 1)).cast("int")
    fine = (df.select(F.coalesce(b, F.lit(0)).alias("b")).where(x.isNotNull())
            .groupBy("b").agg(F.count(F.lit(1)).alias("w")))
    centre = F.when(hi == lo, lo).otherwise(lo + (F.col("b") + 0.5) * width)
    step = F.when(hi == lo, F.lit(0.0)).otherwise((hi - lo) / F.lit(float(max(grid - 1, 1))))
    pts = fine.select(centre.alias("c"), "w", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("i"))
    gx = lo + F.col("i") * step
    z = safe_div(gx - F.col("c"), h)
    kern = F.col("w") * F.exp(-0.5 * z * z) / (h * F.lit(math.sqrt(2 * math.pi)))
    return (pts.groupBy("i").agg(F.sum(kern).alias("s"))
            .select("i", gx.alias("x"), (F.col("s") / n).alias("density")))


def scatter_density_many(df: DataFrame, xs: Sequence[str], y: str, bins: int = 10) -> DataFrame:
    """A8 for several x columns against one y in a single pass: (feature, xb, yb, n).

    All bounds come from one merged stats aggregate; each row is binned once
    per feature, then (feature, xb, yb) is counted with map-side combine.
    """
    xs = list(xs)
    yc = num(y)
    stats = df.agg(F.min(yc).alias("yl"), F.max(yc).alias("yh"),
                   *[e for i, x in enumerate(xs) for e in (F.min(num(x)).alias(f"xl{i}"), F.max(num(x)).alias(f"xh{i}"))])
    yl, yh = stats.select("yl").scalar(), stats.select("yh").scalar()
    yb = _bin(yc, yl, yh, bins)
    pairs = [F.struct(F.lit(x).alias("feature"),
                      _bin(num(x), stats.select(f"xl{i}").scalar(), stats.select(f"xh{i}").scalar(), bins).alias("xb"),
                      yb.alias("yb"))
             for i, x in enumerate(xs)]
    return (df.select(_long(pairs)).where(F.col("xb").isNotNull() & F.col("yb").isNotNull())
            .groupBy("feature", "xb", "yb").agg(F.count(F.lit(1)).alias("n")))


def scatter_density(df: DataFrame, x: str, y: str, bins: int = 10) -> DataFrame:
    """2-D binned counts (xb, yb, n) instead of a point cloud."""
    return scatter_density_many(df, [x], y, bins).drop("feature")


#: Parts of a bin that are ranked apart before the bin's first points are taken from all of them.
SAMPLE_PARTS = 4096


def scatter_sample(df: DataFrame, xs: Sequence[str], y: str, key_cols: Sequence[str], k: int = 50, bins: int = 10, seed: int = 1) -> DataFrame:
    """A8 as points: of every (feature, x bin) the ``k`` rows (all, if fewer) of the smallest
    hash of ``seed`` and the key, so the points follow the rows and not their partitions.

    Bins are those of ``scatter_density``.  A first pass counts the bins; by the count a bin's
    rows are thinned to a little over ``k`` by their hash before any shuffle, so no task gets a
    whole bin.  Bins that came out short (keys that repeat, for the hashes of distinct keys are
    even) are thinned less until none is.  Rows without x or y give no point; repeated keys are
    ordered by x and y.  Returns (feature, bin, x, y, key columns).
    """
    xs, keys = list(xs), list(key_cols)
    stats = df.agg(*[e for i, x in enumerate(xs) for e in (F.min(num(x)).alias(f"lo{i}"), F.max(num(x)).alias(f"hi{i}"))])
    pairs = [F.struct(F.lit(x).alias("feature"), _bin(num(x), stats.select(f"lo{i}").scalar(), stats.select(f"hi{i}").scalar(), bins).alias("bin"),
                      num(x).alias("x")) for i, x in enumerate(xs)]
    # names of its own for the keys: a key may be called x, y, bin or feature
    named = {c: f"__key{i}" for i, c in enumerate(keys)}
    points = df.select(*[F.col(c).alias(n) for c, n in named.items()], num(y).alias("y"), split_hash(seed, *keys).alias("__h"), _long(pairs))
    points = points.where(F.col("bin").isNotNull() & F.col("y").isNotNull())
    sizes = {(r["feature"], r["bin"]): r["n"] for r in points.groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("n")).collect()}  # features x bins
    share = {b: (k + 8 * math.sqrt(k) + 32) / n for b, n in sizes.items()}
    spark = df.sparkSession

    def thinned() -> DataFrame:
        rows = [(f, b, f"{min(int(s * 2 ** 48), 2 ** 48 - 1):012x}" if s < 1 else "g") for (f, b), s in share.items()]  # "g" is above every digit
        cuts = spark.createDataFrame(rows, "feature string, bin int, __cut string")
        return points.join(F.broadcast(cuts), ["feature", "bin"]).where(F.col("__h") < F.col("__cut"))

    while True:
        kept = materialize(thinned(), "scatter-sample")  # a little over k rows a bin
        got = {(r["feature"], r["bin"]): r["n"] for r in kept.groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("n")).collect()}
        short = [b for b, n in sizes.items() if got.get(b, 0) < min(k, n)]
        if not short:
            break
        share |= {b: share[b] * 16 for b in short}
    # Rows of a repeated key share a hash and can't be thinned by it: equal points are counted on the
    # map side, and the rest ranked in salted parts first, so no task holds more than k a part of a bin.
    order, point = ["__h", *named.values(), "x", "y"], ["feature", "bin", "__h", *named.values(), "x", "y"]
    counted = kept.groupBy(*point).agg(F.count(F.lit(1)).alias("__n")).withColumn("__salt", F.pmod(F.xxhash64(*order), F.lit(SAMPLE_PARTS)))
    salted = Window.partitionBy("feature", "bin", "__salt").orderBy(*order)
    counted = counted.withColumn("__rank", F.row_number().over(salted)).where(F.col("__rank") <= k)
    earlier = Window.partitionBy("feature", "bin").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0))).where(F.col("__before") < k)
    kept = counted.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), F.least(F.col("__n"), k - F.col("__before")).cast("int"))))
    return kept.select("feature", "bin", "x", "y", *[F.col(n).alias(c) for c, n in named.items()])


def daily_summary(df: DataFrame, date_col: str, value_col: str) -> DataFrame:
    """Per DATE of ``date_col``: rows, mean, exact median and max of ``value_col``."""
    d = df.select(F.col(date_col).cast("date").alias("d"), num(value_col).alias("v"))
    # count/mean/max ride along in the selection's own per-day stats pass
    out = exact_quantiles(d, "v", [0.5], group_cols=["d"], names=["m"],
                          extra={"rows": lambda v: F.count(F.lit(1)), "a": F.avg, "mx": F.max})
    return out.select("d", F.col("rows").alias("n"), "a", "m", "mx")
