"""Regression metrics and model/run comparison.

A9 is one grouped aggregate over (label, prediction) rows: MAE, RMSE, R2 and
explained variance with the degenerate cases of the usual definitions
(constant label, fewer than two rows) written out with ``when``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindling.functions.columns import num, safe_div
from kindling.plans.materialize import broadcast_if_small, materialize

METRICS = ("mae", "rmse", "r2", "explained_variance")


def regression_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction",
                       group_cols: Sequence[str] = ("model",), metrics: Sequence[str] = METRICS) -> DataFrame:
    """One row per group with n and the requested metrics, over the rows
    where both label and prediction are present.

    r2 = 1 - SSE / (n * var_pop(y)); explained_variance = 1 - var_pop(y - yhat) / var_pop(y).
    With a constant label each is 1 when its numerator is 0, else 0.  r2 is
    NULL below two rows.
    """
    y0, yh = num(label), num(prediction)    # NaN is missing
    y = F.when(yh.isNotNull(), y0)          # complete (label, prediction) pairs only
    e = y - yh
    group_cols = [g for g in group_cols]
    agg = pred.groupBy(*group_cols).agg(
        F.count(e).alias("n"),
        F.avg(F.abs(e)).alias("mae"),
        F.avg(e * e).alias("_mse"),
        F.sum(e * e).alias("_sse"),
        F.var_pop(y).alias("_vy"),
        F.var_pop(e).alias("_ve"),
    )
    n, vy, sse, ve = F.col("n"), F.col("_vy"), F.col("_sse"), F.col("_ve")
    r2 = (F.when(n < 2, F.lit(None).cast("double"))
          .when(vy == 0, F.when(sse == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
          .otherwise(1 - safe_div(sse, vy * n)))
    ev = (F.when(n < 1, F.lit(None).cast("double"))
          .when(vy == 0, F.when(ve == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
          .otherwise(1 - safe_div(ve, vy)))
    cols = {"mae": F.col("mae"), "rmse": F.sqrt("_mse"), "r2": r2, "explained_variance": ev}
    unknown = [m for m in metrics if m not in cols]
    if unknown:
        raise ValueError(f"unknown metrics: {unknown}")
    return agg.select(*group_cols, "n", *[cols[m].alias(m) for m in metrics])


def best_model(scores: DataFrame, metric: str = "mae", group_cols: Sequence[str] = ()) -> DataFrame:
    """A10: argmin of the metric per group; a missing value counts as +inf; earlier position wins ties."""
    order = F.struct(F.coalesce(F.col(metric), F.lit(float("inf"))).alias("m"), F.col("position").alias("p"))
    return scores.groupBy(*group_cols).agg(F.min_by("model", order).alias("best"),
                                           F.min(metric).alias(metric))


def default_model(specs: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """The last spec flagged default; if none is flagged, the first spec."""
    flagged = F.max_by("model", F.when(F.col("is_default"), F.col("position")))
    first = F.min_by("model", F.col("position"))
    return specs.groupBy(*group_cols).agg(F.coalesce(flagged, first).alias("default_model"))


def flag_default(scores: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """scores with ``is_default`` replaced by the single resolved default per group
    (a window over the already-aggregated score rows)."""
    w = Window.partitionBy(*group_cols) if group_cols else Window.partitionBy(F.lit(0))
    flagged = F.max_by("model", F.when(F.col("is_default"), F.col("position"))).over(w)
    first = F.min_by("model", F.col("position")).over(w)
    return scores.withColumn("is_default", F.col("model") == F.coalesce(flagged, first))


def improvement_pct(scores: DataFrame, base: str, other: str, metric: str = "mae",
                    group_cols: Sequence[str] = ()) -> DataFrame:
    """(metric[base] - metric[other]) / metric[base] * 100 per group (conditional aggregate, no self join)."""
    b = F.max(F.when(F.col("model") == base, F.col(metric)))
    o = F.max(F.when(F.col("model") == other, F.col(metric)))
    return scores.groupBy(*group_cols).agg((safe_div(b - o, b) * 100).alias("pct"))


def residuals(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """residual = y - yhat next to the prediction; NULL where either is missing (NaN too)."""
    return pred.withColumn("residual", num(label) - num(prediction))


def prediction_bounds(pred: DataFrame, label: str = "label", prediction: str = "prediction",
                      group_cols: Sequence[str] = ("model",)) -> DataFrame:
    """The diagonal of a predicted-vs-actual chart: [min, max] over both columns."""
    return pred.groupBy(*group_cols).agg(
        F.least(F.min(num(label)), F.min(num(prediction))).alias("lo"),
        F.greatest(F.max(num(label)), F.max(num(prediction))).alias("hi"))


def predictions_vs_actual(pred: DataFrame, label: str = "label", prediction: str = "prediction",
                          group_cols: Sequence[str] = ("model",), bins: int = 20) -> DataFrame:
    """Binned (actual, predicted) pairs per group on a square grid over the
    group's [min, max] of both columns, plus that diagonal.  Actuals are always
    the real labels (never a stand-in)."""
    g = list(group_cols)
    bounds = prediction_bounds(pred, label, prediction, g)   # one row per group
    y, yh = num(label), num(prediction)
    span = F.col("hi") - F.col("lo")

    def b(c):
        raw = F.floor(safe_div((c - F.col("lo")) * F.lit(float(bins)), span))
        return F.when(span == 0, F.lit(0)).otherwise(F.least(raw, F.lit(bins - 1))).cast("int")

    if g:
        # One bounds row per group: written and measured, broadcast when small, else
        # joined by shuffle; a NULL group matches itself either way.
        bounds = materialize(bounds, "pva-bounds")
        other = bounds.withColumnsRenamed({c: f"__{c}" for c in g})
        on = F.lit(True)
        for c in g:
            on = on & F.col(c).eqNullSafe(F.col(f"__{c}"))
        joined = pred.join(broadcast_if_small(other), on).drop(*other.columns[:len(g)])
    else:
        lo, hi = (bounds.select(c).scalar() for c in ("lo", "hi"))
        joined = pred.withColumns({"lo": lo, "hi": hi})
    return (joined.where(y.isNotNull() & yh.isNotNull())
            .groupBy(*g, b(y).alias("actual_bin"), b(yh).alias("predicted_bin"), "lo", "hi")
            .agg(F.count(F.lit(1)).alias("n")))


def model_comparison(scores: DataFrame) -> DataFrame:
    """(model, mae, r2) for models that have both; no rows where a metric wasn't asked for."""
    absent = [m for m in ("mae", "r2") if m not in scores.columns]
    scores = scores.withColumns({m: F.lit(None).cast("double") for m in absent}) if absent else scores
    return scores.where(F.col("mae").isNotNull() & F.col("r2").isNotNull()).select("model", "mae", "r2")


def compare_runs(scores: DataFrame, metric: str = "mae") -> DataFrame:
    """Rank of each model within its run, and change against the model's previous run."""
    by_run = Window.partitionBy("run_id").orderBy(F.col(metric).asc_nulls_last(), F.col("model"))
    by_model = Window.partitionBy("model").orderBy("run_id")
    return scores.select("run_id", "model", metric,
                         F.rank().over(by_run).alias("rk"),
                         (F.col(metric) - F.lag(metric).over(by_model)).alias("d"))


def best_run_per_model(scores: DataFrame, metric: str = "mae") -> DataFrame:
    """The run with the lowest metric for each model (latest run wins ties)."""
    order = F.struct(F.coalesce(F.col(metric), F.lit(float("inf"))).alias("m"), (-F.col("run_id")).alias("r"))
    return scores.groupBy("model").agg(F.min_by("run_id", order).alias("best_run"), F.min(metric).alias(metric))
