"""Stage 4 of the workflow: the tables behind the exploration charts.

Histograms of the first ten numeric columns, the full correlation matrix and
its lower triangle (the masked heatmap), the top correlates of the target with
a binned scatter of each against the target, and the target's density curve.
Every table is an aggregate whose size is bounded by columns x bins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindling.operators import explore
from kindling.operators.features import numeric_columns
from kindling.plans.materialize import materialize
from kindling.schema import HIST_BINS, TOP_CORRELATES


def eda_tables(df: DataFrame, target: str | None, bins: int = HIST_BINS, max_hist_columns: int | None = None,
               top_k: int = TOP_CORRELATES, scatter_bins: int = 20) -> dict[str, DataFrame]:
    """Passes over ``df``: histograms 2, correlations 2, scatter 2, density 2.

    The correlation matrix (k^2 rows) is computed once and written to the
    checkpoint folder; the heatmap cells and the top correlates are read from
    it rather than recomputed.
    """
    nums = numeric_columns(df)
    corr = materialize(explore.correlation_matrix(df, nums), "eda-corr")
    out = {
        "histograms": explore.histogram(df, nums[:max_hist_columns], bins),
        "correlations": corr,
        "heatmap_cells": explore.lower_triangle(corr),
    }
    if target and target in nums:
        top = (corr.where((F.col("b") == target) & (F.col("a") != target))
               .select(F.col("a").alias("feature"), "corr")
               .orderBy(F.col("corr").desc_nulls_last(), F.col("feature")).limit(top_k))
        out["top_correlates"] = top
        feats = [r.feature for r in top.collect()]  # at most top_k names
        if feats:
            out["scatter"] = explore.scatter_density_many(df, feats, target, scatter_bins)
        out["target_density"] = explore.density_curve(df, target)
    return out
