"""Golden scores from the reference's three stored runs (FIXTURES F5), the
reference's own small fixtures (F1, F4), and writer round trips."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindling.operators import clean, features, metrics
from kindling.plans.workflow import evaluate_performance
from kindling.sources import sinks
from kindling.sources.readers import read_detections

# Stored scores of three runs (run_id, model, position, is_default, mae, rmse, r2), fixed values.
RUNS = [
    (1748729493, "linear_regression", 0, False, 7.998593293669099, 11.481063594919803, 0.7488801757234207),
    (1748729493, "decision_tree", 1, False, 1.8276581387645165, 3.2535432560734465, 0.9798335281799166),
    (1748729493, "random_forest", 2, True, 1.4895225968599701, 2.5400292135560996, 0.9877088030746194),
    (1748729677, "linear_regression", 0, False, 7.998593293669099, 11.481063594919803, 0.7488801757234207),
    (1748729677, "decision_tree", 1, False, 3.8651326814708433, 5.40910906951733, 0.9442598374332961),
    (1748729677, "random_forest", 2, True, 5.519946542017589, 7.447494981430275, 0.8943335317144534),
    (1748729735, "linear_regression", 0, False, 7.998593293669099, 11.481063594919803, 0.7488801757234207),
    (1748729735, "decision_tree", 1, False, 3.2400843266958534, 4.55393430831048, 0.9604915240752061),
    (1748729735, "random_forest", 2, True, 2.103760024553364, 3.243847827434303, 0.9799535396556073),
]
SCHEMA = "run_id long, model string, position int, is_default boolean, mae double, rmse double, r2 double"


def test_golden_best_and_default_per_run(spark):
    s = spark.createDataFrame(RUNS, SCHEMA)
    best = {r.run_id: r.best for r in metrics.best_model(s, "mae", ["run_id"]).collect()}
    assert best == {1748729493: "random_forest", 1748729677: "decision_tree", 1748729735: "random_forest"}
    default = {r.run_id: r.default_model for r in metrics.default_model(s, ["run_id"]).collect()}
    assert set(default.values()) == {"random_forest"}
    ev = evaluate_performance(s, "mae", ["run_id"])
    assert ev.where("is_best").count() == 3
    cmp = {(r.run_id, r.model): (r.rk, r.d) for r in metrics.compare_runs(s).collect()}
    assert cmp[(1748729677, "random_forest")][0] == 2 and cmp[(1748729493, "random_forest")][0] == 1
    assert abs(cmp[(1748729677, "random_forest")][1] - (5.519946542017589 - 1.4895225968599701)) < 1e-12
    assert cmp[(1748729735, "linear_regression")][1] == 0.0
    best_run = {r.model: r.best_run for r in metrics.best_run_per_model(s).collect()}
    assert best_run["random_forest"] == 1748729493 and best_run["linear_regression"] == 1748729735
    imp = {r.run_id: r.pct for r in metrics.improvement_pct(s, "linear_regression", "random_forest",
                                                            group_cols=["run_id"]).collect()}
    assert abs(imp[1748729493] - (7.998593293669099 - 1.4895225968599701) / 7.998593293669099 * 100) < 1e-9
    table = sinks.scores_table(s).where("run_id = 1748729735").collect()
    assert [r.model for r in table] == ["linear_regression", "decision_tree", "random_forest"]


def _sample_df(spark):
    """The reference's 10-row fixture (linspace columns; fixed stand-ins for its unseeded draws)."""
    n = 10
    lat, lon = np.linspace(-20, -30, n), np.linspace(130, 150, n)
    bright, t31, frp = np.linspace(320, 340, n), np.linspace(300, 310, n), np.linspace(10, 30, n)
    scan, track = np.linspace(1.5, 1.7, n), np.linspace(1.1, 1.3, n)
    rows = [(float(lat[i]), float(lon[i]), float(bright[i]), float(scan[i]), float(track[i]), float(t31[i]),
             float(frp[i]), 80 + 2 * i, f"2019-10-{i + 1:02d}") for i in range(n)]
    return spark.createDataFrame(rows, "latitude double, longitude double, brightness double, scan double, "
                                       "track double, bright_t31 double, frp double, confidence int, acq_date string")


def test_reference_fixture_clean_and_features(spark):
    df = _sample_df(spark)
    cleaned = clean.clean_detections(df)
    assert cleaned.count() == 10
    audit = {r.column: r.nulls for r in clean.null_audit(cleaned).collect()}
    assert set(audit.values()) == {0}
    assert cleaned.agg(F.min("latitude"), F.max("latitude")).first() == (-30.0, -20.0)
    ds = clean.create_dataset(df, ["latitude", "longitude", "brightness"],
                              region={"enabled": True, "min_latitude": -44, "max_latitude": -10,
                                      "min_longitude": 112, "max_longitude": 154},
                              outliers={"enabled": True, "column": "brightness", "std_threshold": 3},
                              target="brightness")
    assert "brightness" in ds.columns and ds.count() == 10
    fe = features.generate_features(ds, derived=["frp_per_area", "temperature_diff"], log={"log_frp": "frp"},
                                    normalize_cols=["frp", "scan"], normalize_method="min_max")
    assert {"frp_per_area", "temperature_diff", "log_frp", "frp_norm", "scan_norm"} <= set(fe.columns)
    r = fe.orderBy("acq_date").first()
    assert r.temperature_diff == 20.0 and abs(r.frp_per_area - 10 / (1.5 * 1.1)) < 1e-12 and r.frp_norm == 0.0
    base = features.generate_features(ds, base_only=True)
    assert base.columns == ["latitude", "longitude", "scan", "track", "bright_t31", "frp", "confidence", "brightness"]


def test_write_table_csv_round_trip_and_report(spark, tmp_path):
    df = _sample_df(spark)
    path = sinks.write_table(df, str(tmp_path / "csv"), fmt="csv")
    back = read_detections(spark, path, schema=None)
    assert back.count() == 10
    typed = spark.read.csv(path, header=True, schema=df.schema)
    assert sorted(tuple(r) for r in typed.collect()) == sorted(tuple(r) for r in df.collect())
    sinks.write_table(df, str(tmp_path / "pq"))
    assert spark.read.parquet(str(tmp_path / "pq")).count() == 10
    s = spark.createDataFrame(RUNS, SCHEMA).where("run_id = 1748729735")
    out = sinks.write_metrics_report(evaluate_performance(s), str(tmp_path / "report"))
    lines = [json.loads(x) for p in sorted((tmp_path / "report").glob("part-*")) for x in p.read_text().splitlines()]
    assert out and sum(x["is_best"] for x in lines) == 1 and len(lines) == 3


def test_residuals_and_bounds(spark):
    p = spark.createDataFrame([("m", 10.0, 12.0), ("m", 20.0, 15.0), ("n", 1.0, 1.0)],
                              "model string, label double, prediction double")
    assert sorted(r.residual for r in metrics.residuals(p).collect()) == [-2.0, 0.0, 5.0]
    b = {r.model: (r.lo, r.hi) for r in metrics.prediction_bounds(p).collect()}
    assert b == {"m": (10.0, 20.0), "n": (1.0, 1.0)}


def test_predictions_vs_actual_and_summaries(spark):
    from kindling.plans.workflow import performance_summaries
    p = spark.createDataFrame([("m", float(i), float(i) + (1 if i % 2 else -1)) for i in range(100)] +
                              [("k", 5.0, 5.0)], "model string, label double, prediction double")
    pva = metrics.predictions_vs_actual(p, bins=10)
    assert pva.agg(F.sum("n")).first()[0] == 101
    m = pva.where("model = 'm'").collect()
    assert all(0 <= r.actual_bin <= 9 and 0 <= r.predicted_bin <= 9 for r in m) and m[0].lo == -1.0
    assert pva.where("model = 'k'").first().actual_bin == 0
    scores = spark.createDataFrame(RUNS, SCHEMA).where("run_id = 1748729735")
    out = performance_summaries(scores, p.withColumn("is_default", F.col("model") == "m"),
                                ["model_comparison", "residuals", "no_such_chart"])
    assert set(out) == {"model_comparison", "residuals"}
    assert out["residuals"].agg(F.sum("n")).first()[0] == 100     # binned, not one row per test row


def test_predictions_vs_actual_null_group(spark):
    """A NULL group is counted like any other, however many groups there are."""
    import kindling.operators.metrics as M
    rows = [("a", 1.0, 2.0), ("a", 3.0, 2.5), ("b", 5.0, 5.0), (None, 1.0, 2.0), (None, 2.0, 2.0), ("b", float("nan"), 1.0)]
    for extra in (0, 1001):
        p = spark.createDataFrame(rows + [(f"g{i}", 0.0, 1.0) for i in range(extra)], "model string, label double, prediction double")
        got = {(r.model, r.actual_bin, r.predicted_bin): r.n for r in M.predictions_vs_actual(p, bins=2).collect()}
        assert len(got) == 5 + extra and got[(None, 0, 1)] == 1 and got[(None, 1, 1)] == 1
        assert got[("a", 0, 1)] == 1 and got[("a", 1, 1)] == 1 and sum(got.values()) == 5 + extra


def test_float_written_integers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("latitude,confidence\n-20.5,85.0\n-21.0,\n-22.0,90\n-23.0,7.5\n")
    from kindling.sources.readers import read_detections
    assert sorted((r.latitude, r.confidence) for r in read_detections(spark, str(tmp_path)).collect()) == [
        (-23.0, None), (-22.0, 90), (-21.0, None), (-20.5, 85)]


def test_missing_values_and_repeated_keys(spark):
    from kindling.functions.columns import band_label
    from kindling.operators.metrics import regression_metrics
    from kindling.operators.split import train_test_split
    p = spark.createDataFrame([("m", 1.0, 2.0), ("m", float("nan"), 2.0), ("m", 3.0, float("nan"))], "model string, label double, prediction double")
    assert [r.b for r in p.select(band_label("prediction").alias("b")).collect()][2] is None
    r = regression_metrics(p).first()
    assert (r.n, r.mae) == (1, 1.0)
    with pytest.raises(ValueError, match="identify rows"):
        train_test_split(spark.range(1000).selectExpr("id % 10 as k"), "k", 0.25)
