"""Model specifications and fitting (M2-M8).

A linear spec becomes a ``PipelineModel`` of ``VectorAssembler`` (features bound by name) and
``LinearRegression``; trees and forests are grown best-first by ``kindling.models.leafwise``
(``max_leaf_nodes``, ``max_depth``, ``min_samples_split`` and ``min_samples_leaf`` as given).
Both kinds have ``transform``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, SparkSession

from kindling.models.leafwise import MAX_BINS, TreeModel, cv_leaf_limits, fit_hashed_forest, fit_leafwise
from kindling.plans.materialize import run_concurrently
from kindling.schema import CV_FOLDS, LEAF_GRID, TREE_SEED

MODEL_TYPES = ("LinearRegression", "DecisionTreeRegressor", "RandomForestRegressor")
FEATURES_COL = "features"


@dataclass
class ModelSpec:
    name: str
    type: str
    hyperparameters: dict = field(default_factory=dict)
    is_default: bool = False

    def __post_init__(self):
        if self.type not in MODEL_TYPES:
            raise ValueError(f"unsupported model type: {self.type}")


_TREE = {"max_leaf_nodes", "max_depth", "min_samples_split", "min_samples_leaf", "max_bins", "random_state"}
_KNOWN = {"LinearRegression": {"fit_intercept"}, "DecisionTreeRegressor": _TREE, "RandomForestRegressor": _TREE | {"n_estimators", "bootstrap"}}


def _hyperparameters(spec: ModelSpec) -> dict:
    """The spec's parameters; an unknown name raises instead of being ignored."""
    unknown = sorted(set(spec.hyperparameters) - _KNOWN[spec.type])
    if unknown:
        raise ValueError(f"{spec.name}: unsupported hyperparameters {unknown}")
    return dict(spec.hyperparameters)


def assembler(features: Sequence[str]) -> VectorAssembler:
    # NULL/NaN features raise (handleInvalid="error"): clean before fitting.
    return VectorAssembler(inputCols=list(features), outputCol=FEATURES_COL, handleInvalid="error")


def fit_model(train: DataFrame, spec: ModelSpec, features: Sequence[str], label: str, key_cols: Sequence[str] = ()) -> PipelineModel | TreeModel:
    """M2 / M4 / M5: one spec -> a fitted model.  ``key_cols`` name a row for a forest's resampling."""
    hp = _hyperparameters(spec)
    if spec.type == "LinearRegression":
        reg = LinearRegression(featuresCol=FEATURES_COL, labelCol=label, predictionCol="prediction", solver="normal", regParam=0.0, elasticNetParam=0.0,
                               fitIntercept=hp.get("fit_intercept", True), standardization=False)
        return Pipeline(stages=[assembler(features), reg]).fit(train)
    if spec.type == "DecisionTreeRegressor":
        hp.pop("random_state", None)  # nothing in a tree of all features is drawn; ties have a fixed order
        return fit_leafwise(train, features, label, **hp)
    return fit_hashed_forest(train, features, label, key_cols, **{"random_state": TREE_SEED, **hp})


def fit_linear(train: DataFrame, features: Sequence[str], label: str) -> PipelineModel:
    """M2: ordinary least squares with intercept."""
    return fit_model(train, ModelSpec("linear_regression", "LinearRegression"), features, label)


def fit_tree(train: DataFrame, features: Sequence[str], label: str, **hp) -> PipelineModel:
    """M4: regression tree (max_leaf_nodes / max_depth / random_state)."""
    return fit_model(train, ModelSpec("decision_tree", "DecisionTreeRegressor", hp), features, label)


def fit_forest(train: DataFrame, features: Sequence[str], label: str, **hp) -> PipelineModel:
    """M5: random forest (n_estimators / max_depth / random_state), all features per split."""
    return fit_model(train, ModelSpec("random_forest", "RandomForestRegressor", hp), features, label)


def fit_models(train: DataFrame, specs: Sequence[ModelSpec], features: Sequence[str], label: str, parallelism: int = 3,
               key_cols: Sequence[str] = ()) -> list[tuple[ModelSpec, PipelineModel | TreeModel]]:
    """M6: every spec on the same training rows, up to ``parallelism`` at a time.

    A fit keeps nothing cached: trees work on binned copies written to the checkpoint folder.
    """
    data = train.select(*dict.fromkeys([*key_cols, *features, label]))
    fits = run_concurrently({i: (lambda s=s: fit_model(data, s, features, label, key_cols)) for i, s in enumerate(specs)}, max_workers=parallelism)
    return [(s, fits[i]) for i, s in enumerate(specs)]


def tune_tree(train: DataFrame, features: Sequence[str], label: str, fold_col: str, folds: int = CV_FOLDS,
              leaf_grid: Sequence[int] = LEAF_GRID, max_bins: int = MAX_BINS) -> DataFrame:
    """M7: k-fold CV (folds 0..folds-1 in ``fold_col``) of leaf limits, mean MAE; first minimum wins.

    One tree per fold, all grown in the same passes, answers every limit: its first ``L - 1``
    splits are the tree of ``L`` leaves.  Returns (max_leaf_nodes, cv_mae, is_best).
    """
    maes = cv_leaf_limits(train, features, label, fold_col, folds, leaf_grid, max_bins)
    best = min(range(len(maes)), key=lambda i: maes[i])
    rows = [(int(limit), mae, i == best) for i, (limit, mae) in enumerate(zip(leaf_grid, maes, strict=True))]
    return train.sparkSession.createDataFrame(rows, "max_leaf_nodes int, cv_mae double, is_best boolean")


def feature_importance(model: PipelineModel | TreeModel, features: Sequence[str]) -> DataFrame | None:
    """M8: (feature, importance) descending; None for a model without importances."""
    if not isinstance(model, TreeModel):
        return None
    imp = dict(zip(model.features, model.importances(), strict=True))
    spark = SparkSession.getActiveSession()
    rows = sorted(((f, imp[f]) for f in features), key=lambda r: (-r[1], r[0]))
    return spark.createDataFrame(rows, "feature string, importance double")


def coefficients(model: PipelineModel | TreeModel, features: Sequence[str]) -> DataFrame:
    """M3: (feature, coefficient) sorted descending, intercept last."""
    reg = None if isinstance(model, TreeModel) else model.stages[-1]
    if not hasattr(reg, "coefficients"):
        raise ValueError("model has no coefficients")
    spark = SparkSession.getActiveSession()
    rows = sorted(zip(features, reg.coefficients.toArray().tolist()), key=lambda r: (-r[1], r[0]))
    rows.append(("intercept", float(reg.intercept)))
    return spark.createDataFrame(rows, "feature string, coefficient double")


def save_model(model: PipelineModel | TreeModel, path: str) -> str:
    """Saved through Spark, on any Hadoop filesystem."""
    if isinstance(model, TreeModel):
        model.save(SparkSession.builder.getOrCreate(), path)  # also from a thread of its own
    else:
        model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel | TreeModel:
    spark = SparkSession.builder.getOrCreate()
    head = spark.read.text(f"{path}/metadata").first()
    return TreeModel.load(spark, path) if head and "leafwise trees" in head[0] else PipelineModel.load(path)
