"""Stored quantile state (A2, A17): mergeable sketches per group and column.

A pass over the rows leaves one small state per (group, column): count, mean, sum of
squared deviations, least and greatest value, and a KLL sketch of the values.  States
are stored once; summaries of any set of groups, such as a range of dates (P22), come
from merging them, without the rows.  The exact way is ``describe`` and ``daily_summary``.

NULL and NaN count as missing.  A group whose values are all missing has a state with
count 0, which merges as nothing; a column without any value has NULL statistics.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from kindling.functions.columns import num, safe_div
from kindling.operators.explore import _long

#: Size parameter of a sketch: about 3 k values at most are kept per state.
SKETCH_K = 1000


def rank_error(k: int = SKETCH_K) -> float:
    """Share of the rows by which a quantile's rank may be off, at 99 % confidence, merged or not."""
    return 2.296 / k ** 0.9723


def quantile_states(df: DataFrame, cols: Sequence[str], group_cols: Sequence[str] = (), k: int = SKETCH_K) -> DataFrame:
    """One row per (group, column): n, mean, m2, lo, hi, sketch.

    One aggregate whose map side already sends states, so a group that holds a third of
    all rows costs a state per map task.
    """
    aggs = []
    for i, c in enumerate(cols):
        x = num(c)
        aggs += [F.count(x).alias(f"__n{i}"), F.avg(x).alias(f"__a{i}"), F.var_pop(x).alias(f"__v{i}"), F.min(x).alias(f"__lo{i}"),
                 F.max(x).alias(f"__hi{i}"), F.kll_sketch_agg_double(x, k).alias(f"__q{i}")]
    wide = df.groupBy(*group_cols).agg(*aggs)
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"__n{i}").alias("n"), F.col(f"__a{i}").alias("mean"),
                     (F.col(f"__v{i}") * F.col(f"__n{i}")).alias("m2"), F.col(f"__lo{i}").alias("lo"), F.col(f"__hi{i}").alias("hi"),
                     F.col(f"__q{i}").alias("sketch")) for i, c in enumerate(cols)]
    return wide.select(*group_cols, _long(rows))


def merge_states(states: DataFrame, by: Sequence[str] = (), k: int = SKETCH_K) -> DataFrame:
    """States merged per (``by``, column); the result is of the same form.

    Squared deviations are moved to the common mean before they are added, so values far
    from zero lose no digits.
    """
    w = Window.partitionBy(*by, "column")
    common = safe_div(F.sum(F.col("mean") * F.col("n")).over(w), F.sum("n").over(w))
    shifted = states.withColumn("__common", common)
    moved = F.col("m2") + F.col("n") * F.pow(F.col("mean") - F.col("__common"), F.lit(2.0))
    return shifted.groupBy(*by, "column").agg(
        F.sum("n").alias("n"), F.max("__common").alias("mean"), F.sum(moved).alias("m2"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        F.kll_merge_agg_double("sketch", k).alias("sketch"))


def quantile(sketch: str | Column, n: str | Column, level: float) -> Column:
    """The value at ``level`` (0 to 1) of a sketch; NULL for a state without values."""
    sketch, n = (F.col(c) if isinstance(c, str) else c for c in (sketch, n))
    return F.when(n > 0, F.kll_sketch_get_quantile_double(sketch, F.lit(float(level))))


def describe_states(states: DataFrame, by: Sequence[str] = (), levels: Sequence[float] = (0.25, 0.5, 0.75), k: int = SKETCH_K) -> DataFrame:
    """A2 (A17 with ``by`` a date) from stored states alone: count, mean, std, min, quantiles ``p<level in %>``, max."""
    m = merge_states(states, by, k)
    std = F.when(F.col("n") < 2, F.lit(None).cast("double")).when(F.col("lo") == F.col("hi"), F.lit(0.0)).otherwise(
        F.sqrt(safe_div("m2", F.col("n") - 1)))
    return m.select(*by, "column", F.col("n").alias("count"), "mean", std.alias("std"), F.col("lo").alias("min"),
                    *[quantile("sketch", "n", q).alias(f"p{100 * q:g}") for q in levels], F.col("hi").alias("max"))
