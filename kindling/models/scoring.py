"""Scoring (M9-M11, P18/P19 applied to predictions)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindling.functions.columns import band_color, band_label, radius
from kindling.models.specs import FEATURES_COL, ModelSpec
from kindling.operators.clean import require_features
from kindling.operators.metrics import METRICS, regression_metrics


def score_batch(model: PipelineModel, df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """M9: predictions, features bound by name; a missing feature raises before any work."""
    require_features(df, features)
    out = model.transform(df.select(*dict.fromkeys([*keep, *features])))
    return out.drop(FEATURES_COL)


def with_intensity(pred: DataFrame, prediction: str = "prediction") -> DataFrame:
    """P18 + P19: band, colour and map radius of each prediction."""
    return pred.withColumns({"intensity": band_label(prediction), "color": band_color(prediction),
                             "radius": radius(prediction)})


def stacked_predictions(test: DataFrame, fitted: Sequence[tuple[ModelSpec, PipelineModel]],
                        features: Sequence[str], label: str, extra: Sequence[str] = ()) -> DataFrame:
    """One long table (model, position, is_default, *extra, label, prediction) over all models.

    The models are applied one after another to the same rows (each output
    column renamed before the next model runs), so the input is scanned once
    whatever the number of models; ``inline`` then turns the prediction
    columns into rows.
    """
    require_features(test, features)
    wide = test.select(*dict.fromkeys([*extra, label, *features]))
    for pos, (_, model) in enumerate(fitted):
        wide = model.transform(wide).drop(FEATURES_COL).withColumnRenamed("prediction", f"__pred{pos}")
    rows = F.array(*[F.struct(F.lit(spec.name).alias("model"), F.lit(pos).alias("position"),
                              F.lit(bool(spec.is_default)).alias("is_default"),
                              F.col(f"__pred{pos}").cast("double").alias("prediction"))
                     for pos, (spec, _) in enumerate(fitted)])
    return wide.select(*extra, F.col(label).cast("double").alias("label"), F.inline(rows)).select(
        "model", "position", "is_default", *extra, "label", "prediction")


def score_models(test: DataFrame, fitted: Sequence[tuple[ModelSpec, PipelineModel]], features: Sequence[str],
                 label: str, metrics: Sequence[str] = METRICS) -> DataFrame:
    """Metrics of every model in one grouped aggregate, plus position and resolved default flag.

    The default is the last spec flagged default, else the first model (A11).
    """
    long_ = stacked_predictions(test, fitted, features, label)
    scores = regression_metrics(long_, "label", "prediction", ["model", "position"], metrics)
    flagged = [i for i, (s, _) in enumerate(fitted) if s.is_default]
    default_pos = flagged[-1] if flagged else 0
    return scores.withColumn("is_default", F.col("position") == default_pos)


def train_and_test_r2(train: DataFrame, test: DataFrame, fitted: Sequence[tuple[ModelSpec, PipelineModel]],
                      features: Sequence[str], label: str) -> DataFrame:
    """r2 on both splits, grouped by (model, split), one aggregate."""
    both = (stacked_predictions(train, fitted, features, label).withColumn("split", F.lit("train"))
            .unionByName(stacked_predictions(test, fitted, features, label).withColumn("split", F.lit("test"))))
    return regression_metrics(both, "label", "prediction", ["model", "split"], ["r2"])
