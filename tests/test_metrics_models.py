import numpy as np
import pytest
from pyspark.sql import functions as F

from kindling.models.scoring import score_batch, score_models, train_and_test_r2, with_intensity
from kindling.models.specs import (
    ModelSpec,
    coefficients,
    feature_importance,
    fit_linear,
    fit_models,
    load_model,
    save_model,
    tune_tree,
)
from kindling.operators import metrics
from kindling.operators.split import contiguous_fold_column, train_test_split
from kindling.plans.workflow import evaluate_performance
from kindling.sources.readers import synthetic_detections


def _metrics(spark, y, yh, group="m"):
    df = spark.createDataFrame([(group, float(a), float(b)) for a, b in zip(y, yh)], "model string, y double, p double")
    return metrics.regression_metrics(df, "y", "p").first()


def test_metrics_match_definitions(spark):
    rng = np.random.default_rng(1)
    y = rng.normal(10, 3, 200)
    yh = y + rng.normal(0.5, 1, 200)
    r = _metrics(spark, y, yh)
    e = y - yh
    assert abs(r.mae - np.abs(e).mean()) < 1e-9
    assert abs(r.rmse - np.sqrt((e ** 2).mean())) < 1e-9
    assert abs(r.r2 - (1 - (e ** 2).sum() / ((y - y.mean()) ** 2).sum())) < 1e-9
    assert abs(r.explained_variance - (1 - e.var() / y.var())) < 1e-9


def test_metrics_degenerate_cases(spark):
    perfect = _metrics(spark, [1, 2, 3], [1, 2, 3])
    assert (perfect.mae, perfect.rmse, perfect.r2, perfect.explained_variance) == (0.0, 0.0, 1.0, 1.0)
    const_ok = _metrics(spark, [5, 5, 5], [5, 5, 5])
    assert (const_ok.r2, const_ok.explained_variance) == (1.0, 1.0)
    const_bad = _metrics(spark, [5, 5, 5], [4, 5, 6])
    assert (const_bad.r2, const_bad.explained_variance) == (0.0, 0.0)
    one = _metrics(spark, [5], [4])
    assert one.r2 is None and one.mae == 1.0
    empty = spark.createDataFrame([], "model string, y double, p double")
    assert metrics.regression_metrics(empty, "y", "p").count() == 0
    with pytest.raises(ValueError):
        metrics.regression_metrics(empty, "y", "p", metrics=["mape"])


def test_best_default_ties(spark):
    s = spark.createDataFrame([("a", 0, False, 2.0), ("b", 1, True, 1.0), ("c", 2, True, 1.0), ("d", 3, False, None)],
                              "model string, position int, is_default boolean, mae double")
    assert metrics.best_model(s).first().best == "b"          # first in order among equal MAE
    assert metrics.default_model(s).first().default_model == "c"  # last flagged default wins
    none = s.withColumn("is_default", F.lit(False))
    assert metrics.default_model(none).first().default_model == "a"
    missing = spark.createDataFrame([("a", 0, None), ("b", 1, 3.0)], "model string, position int, mae double")
    assert metrics.best_model(missing).first().best == "b"    # missing MAE counts as +inf
    pct = metrics.improvement_pct(s, "a", "b").first().pct
    assert pct == 50.0
    assert metrics.model_comparison(s.withColumn("r2", F.lit(0.5))).count() == 3


def test_compare_runs(spark):
    s = spark.createDataFrame([(1, "lin", 3.0), (1, "tree", 2.0), (2, "lin", 2.5), (2, "tree", 2.5)],
                              "run_id long, model string, mae double")
    got = {(r.run_id, r.model): (r.rk, r.d) for r in metrics.compare_runs(s).collect()}
    assert got == {(1, "lin"): (2, None), (1, "tree"): (1, None), (2, "lin"): (1, -0.5), (2, "tree"): (2, 0.5)}
    best = {r.model: r.best_run for r in metrics.best_run_per_model(s).collect()}
    assert best == {"lin": 2, "tree": 1}


@pytest.fixture(scope="module")
def planted(spark):
    """Synthetic detections with a planted signal: brightness = linear + step in frp."""
    df = synthetic_detections(spark, 4000, seed=11).withColumn(
        "brightness", 300 + 0.8 * F.col("bright_t31") + F.when(F.col("frp") > 50, 60.0).otherwise(0.0)
        + 2 * F.col("scan"))
    return df


FEATS = ["latitude", "longitude", "scan", "track", "bright_t31", "frp", "confidence"]


def test_linear_matches_numpy(spark, planted):
    pdf = planted.select(*FEATS, "brightness").toPandas()
    X = np.column_stack([pdf[FEATS].to_numpy(dtype=float), np.ones(len(pdf))])
    beta, *_ = np.linalg.lstsq(X, pdf["brightness"].to_numpy(), rcond=None)
    m = fit_linear(planted, FEATS, "brightness")
    coef = {r.feature: r.coefficient for r in coefficients(m, FEATS).collect()}
    assert np.allclose([coef[f] for f in FEATS], beta[:-1], atol=1e-6)
    assert abs(coef["intercept"] - beta[-1]) < 1e-5


def test_models_learn_signal_and_roundtrip(spark, planted, tmp_path):
    train, test = train_test_split(planted, "id", 0.25, 1)
    specs = [ModelSpec("linear_regression", "LinearRegression"),
             ModelSpec("decision_tree", "DecisionTreeRegressor", {"max_leaf_nodes": 200}),
             ModelSpec("random_forest", "RandomForestRegressor", {"n_estimators": 5, "max_depth": 6}, is_default=True)]
    fitted = fit_models(train, specs, FEATS, "brightness")
    scores = evaluate_performance(score_models(test, fitted, FEATS, "brightness"))
    got = {r.model: r for r in scores.collect()}
    assert got["random_forest"].is_default and not got["linear_regression"].is_default
    assert got["decision_tree"].r2 > 0.9 and got["random_forest"].r2 > 0.9
    assert sum(r.is_best for r in got.values()) == 1
    r2 = {(r.model, r.split): r.r2 for r in train_and_test_r2(train, test, fitted, FEATS, "brightness").collect()}
    assert r2[("linear_regression", "train")] >= 0
    imp = feature_importance(fitted[1][1], FEATS).collect()
    assert abs(sum(r.importance for r in imp) - 1) < 1e-9 and imp[0].feature in ("frp", "bright_t31")
    assert feature_importance(fitted[0][1], FEATS) is None
    path = save_model(fitted[2][1], str(tmp_path / "rf"))
    again = load_model(path)
    a = score_batch(fitted[2][1], test, FEATS, keep=["id"]).orderBy("id").collect()
    b = score_batch(again, test, FEATS, keep=["id"]).orderBy("id").collect()
    assert [r.prediction for r in a] == [r.prediction for r in b]
    with pytest.raises(ValueError):
        score_batch(again, test.drop("latitude"), FEATS)
    banded = with_intensity(score_batch(again, test, FEATS)).select("prediction", "intensity", "color", "radius")
    for r in banded.collect():
        assert r.intensity == ("High" if r.prediction > 400 else "Moderate" if r.prediction > 350 else "Low")
        assert r.radius == r.prediction * 50


def test_unknown_models_and_parameters_raise(planted):
    with pytest.raises(ValueError):
        ModelSpec("x", "SVR")
    for hp in ({"max_leaf_nodes": 8, "criterion": "absolute_error"}, {"cache_node_ids": True}):
        with pytest.raises(ValueError):
            fit_models(planted, [ModelSpec("t", "DecisionTreeRegressor", hp)], FEATS, "brightness")


def test_tune_tree_picks_one(spark, planted):
    train = contiguous_fold_column(planted, "id", 5, 1)
    res = tune_tree(train, FEATS, "brightness", "fold", folds=5, leaf_grid=[4, 8, 64, 128]).collect()
    assert [r.max_leaf_nodes for r in res] == [4, 8, 64, 128] and sum(r.is_best for r in res) == 1
    assert len({r.cv_mae for r in res}) == 4
    best = min(res, key=lambda r: (r.cv_mae, res.index(r)))
    assert best.is_best


def test_flag_default_window(spark):
    s = spark.createDataFrame([(1, "a", 0, False), (1, "b", 1, True), (1, "c", 2, True), (2, "a", 0, False)],
                              "run_id long, model string, position int, is_default boolean")
    got = {(r.run_id, r.model): r.is_default for r in metrics.flag_default(s, ["run_id"]).collect()}
    assert got == {(1, "a"): False, (1, "b"): False, (1, "c"): True, (2, "a"): True}
    one = metrics.flag_default(s.where("run_id = 1"))
    assert [r.model for r in one.where("is_default").collect()] == ["c"]


def test_metrics_use_complete_pairs(spark):
    df = spark.createDataFrame([("m", 1.0, 1.5), ("m", 2.0, None), ("m", None, 3.0), ("m", 3.0, 2.5)],
                               "model string, y double, p double")
    r = metrics.regression_metrics(df, "y", "p").first()
    assert r.n == 2 and r.mae == 0.5 and r.r2 == 1 - 0.5 / (1.0 * 2)
