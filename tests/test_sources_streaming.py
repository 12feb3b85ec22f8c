import os

import pytest
from pyspark.sql import functions as F

from kindling.models.specs import ModelSpec, fit_linear
from kindling.plans.workflow import WorkflowOptions, run_workflow
from kindling.schema import DETECTION_SCHEMA, FORM_RANGES, SYNTHETIC_RANGES
from kindling.sources import registry, sinks
from kindling.sources.readers import read_detections, read_first_available, synthetic_detections
from kindling.streaming.scoring import read_stream, score_frame, start_scoring

CSV = """latitude,longitude,brightness,scan,track,acq_date,acq_time,satellite,instrument,confidence,version,bright_t31,frp,daynight
-20.5,130.1,330.2,1.1,1.0,2019-10-01,130,Terra,MODIS,80,6.0NRT,300.1,12.5,D
NaN,131.0,331.0,1.2,1.1,2019-10-02,140,Aqua,MODIS,81,6.0NRT,301.0,13.0,N
-21.0,abc,332.0,1.3,1.2,2019-13-40,150,Terra,MODIS,82,6.0NRT,302.0,14.0,D
-22.0,132.0,,1.4,1.3,,160,Terra,MODIS,83,6.0NRT,303.0,15.0,D
"""


def test_read_detections_csv(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "fire_nrt_M6.csv").write_text(CSV)
    (d / "other.csv").write_text(CSV)
    df = read_detections(spark, str(d), pattern="fire_nrt*.csv")
    rows = df.orderBy("acq_time").collect()
    assert len(rows) == 4
    assert rows[1].latitude is None            # NaN text -> NULL
    assert rows[2].longitude is None           # bad numeric -> NULL (PERMISSIVE)
    assert rows[3].brightness is None          # empty -> NULL
    assert df.schema == DETECTION_SCHEMA
    assert read_detections(spark, str(d)).count() == 8


def test_read_first_available_and_synthetic(spark, tmp_path):
    good = tmp_path / "good.csv"
    good.write_text(CSV)
    df, used = read_first_available(spark, [str(tmp_path / "missing.csv"), str(good)])
    assert used == str(good) and df.count() == 4
    with pytest.raises(FileNotFoundError):
        read_first_available(spark, [str(tmp_path / "missing.csv")])
    syn, used = read_first_available(spark, [str(tmp_path / "missing.csv")], synthetic_rows=100)
    assert used == "synthetic" and syn.count() == 100 and syn.where("not is_synthetic").count() == 0


def test_synthetic_ranges_and_partition_independence(spark):
    a = synthetic_detections(spark, 3000, seed=42)
    b = synthetic_detections(spark, 3000, seed=42, num_partitions=7)
    ra = [tuple(r) for r in a.orderBy("id").collect()]
    assert ra == [tuple(r) for r in b.orderBy("id").collect()]
    st = a.agg(*[F.min(c).alias(f"{c}_lo") for c in SYNTHETIC_RANGES],
               *[F.max(c).alias(f"{c}_hi") for c in SYNTHETIC_RANGES],
               F.min("confidence").alias("clo"), F.max("confidence").alias("chi"),
               F.min("acq_date").alias("dlo"), F.max("acq_date").alias("dhi")).first()
    for c, (lo, hi) in SYNTHETIC_RANGES.items():
        assert lo <= st[f"{c}_lo"] and st[f"{c}_hi"] < hi
    assert 0 <= st.clo and st.chi <= 99 and str(st.dlo) >= "2019-10-01" and str(st.dhi) <= "2020-01-11"


def test_write_run_and_registry(spark, tmp_path):
    root = str(tmp_path / "scores")
    s = spark.createDataFrame([("lin", 0, True, 1.0)], "model string, position int, is_default boolean, mae double")
    sinks.write_run(s, root, 100)
    sinks.write_run(s.withColumn("mae", F.lit(2.0)), root, 200)
    sinks.write_run(s.withColumn("mae", F.lit(3.0)), root, 100)   # replaces only run 100
    got = {r.run_id: r.mae for r in spark.read.parquet(root).collect()}
    assert got == {100: 3.0, 200: 2.0}
    runs = spark.createDataFrame([("1748729493",), ("latest",), ("1748729735",), ("1748729677",), ("1748729735",)],
                                 "run_id string")
    assert [r.run_id for r in registry.list_runs(runs).collect()] == ["1748729735", "1748729677", "1748729493"]
    reg = spark.createDataFrame([("1", "tree", "/m/1/tree", 10), ("2", "tree", "/m/2/tree", 30),
                                 ("3", "forest", "/m/3/forest", 50), ("3", "tree_v2", "/m/3/tree_v2", 40)],
                                "run_id string, model string, path string, modified_at long")
    assert registry.resolve_model(reg, "tree", "9", ["2", "1"]).first().path == "/m/2/tree"
    assert registry.resolve_model(reg, "tree", "1", ["2"]).first().path == "/m/1/tree"
    last = registry.resolve_model(reg, "tree", "9", ["8"]).first()
    assert last.path == "/m/3/tree_v2" and last.rule == "most_recent"
    assert registry.resolve_model(reg, "svr", None).count() == 0


def test_preview_and_shape(spark):
    df = spark.range(0, 100).withColumn("x", F.col("id") % 7)
    assert [r.id for r in sinks.preview(df, ["x", "id"], 3).collect()] == [0, 7, 14]
    assert sinks.shape(df) == (100, 2)


def test_stream_equals_batch(spark, tmp_path):
    src = tmp_path / "src"
    df = synthetic_detections(spark, 500, seed=5)
    feats = ["scan", "track", "bright_t31", "frp"]
    df.select("id", "latitude", "longitude", *feats, "brightness").write.parquet(str(src / "a"))
    bad = spark.createDataFrame([(9999, -20.0, 130.0, 9.0, 1.0, 300.0, 10.0, 320.0)],
                                "id long, latitude double, longitude double, scan double, track double, "
                                "bright_t31 double, frp double, brightness double")
    bad.write.parquet(str(src / "b"))
    model = fit_linear(df, feats, "brightness")
    schema = spark.read.parquet(str(src / "a")).schema
    stream = read_stream(spark, str(src), schema, recursive=True)
    scored = score_frame(stream, model, feats, FORM_RANGES)
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    start_scoring(scored, out, ck, available_now=True).awaitTermination()
    got = {r.id: r for r in spark.read.parquet(out).collect()}
    batch = {r.id: r for r in score_frame(spark.read.parquet(str(src / "a")), model, feats, FORM_RANGES).collect()}
    assert len(got) == 501 and all(got[k].prediction == batch[k].prediction for k in batch)
    assert got[9999].prediction is None and list(got[9999].violations) == ["scan"] and got[9999].intensity is None


def test_workflow_end_to_end_and_leakage(spark, tmp_path):
    df = synthetic_detections(spark, 2000, seed=9).withColumn(
        "brightness", 250 + F.col("bright_t31") * 0.5 + F.col("frp")).withColumn(
        "frp", F.when(F.col("id") % 100 == 7, F.lit(None)).otherwise(F.col("frp")))
    specs = [ModelSpec("linear_regression", "LinearRegression"),
             ModelSpec("decision_tree", "DecisionTreeRegressor", {"max_leaf_nodes": 100}, is_default=True),
             ModelSpec("random_forest", "RandomForestRegressor", {"n_estimators": 3, "max_depth": 5})]
    opts = WorkflowOptions(key_cols=["id"], specs=specs, region={"enabled": True}, count_dropped=True,
                           outliers={"enabled": True, "column": "brightness", "std_threshold": 3})
    res = run_workflow(spark, df, opts, str(tmp_path / "run"), run_id=42)
    scores = res["scores"].collect()
    assert res["dropped_missing_features"] == 20
    assert [r.model for r in scores] == ["linear_regression", "decision_tree", "random_forest"]
    assert [r.is_default for r in scores] == [False, True, False]
    assert scores[0].r2 > 0.99
    assert os.path.isdir(tmp_path / "run" / "models" / "run_id=42" / "random_forest")
    assert set(res["summaries"]) == {"feature_importance", "predictions_vs_actual", "residuals", "model_comparison"}
    imp = spark.read.parquet(str(tmp_path / "run" / "summaries" / "feature_importance"))
    assert {r.model for r in imp.collect()} == {"decision_tree", "random_forest"}
    test_rows = spark.read.parquet(str(tmp_path / "run" / "test")).count()
    train_rows = spark.read.parquet(str(tmp_path / "run" / "train")).count()
    assert test_rows + train_rows == spark.read.parquet(str(tmp_path / "run" / "features")).count()
    listing = registry.model_listing(spark, str(tmp_path / "run" / "models"))
    assert {r.model for r in listing.collect()} == {"linear_regression", "decision_tree", "random_forest"}
    leaky = WorkflowOptions(key_cols=["id"], specs=specs, base_only=False, derived=["temperature_diff"],
                            features=["scan", "temperature_diff"])
    with pytest.raises(ValueError, match="target"):
        run_workflow(spark, df, leaky, str(tmp_path / "run2"), run_id=1)


def test_score_points(spark):
    from kindling.streaming.scoring import score_points
    feats = ["scan", "track", "bright_t31", "frp"]
    df = synthetic_detections(spark, 300, seed=2)
    model = fit_linear(df, feats, "brightness")
    pts = [{"scan": 1.0, "track": 1.2, "bright_t31": 300.0, "frp": 20.0},
           {"scan": 9.0, "track": 1.2, "bright_t31": 300.0, "frp": 20.0}]
    out = score_points(spark, model, pts, feats, FORM_RANGES).collect()
    assert out[0].prediction is not None and out[0].intensity in ("High", "Moderate", "Low")
    assert out[1].prediction is None and list(out[1].violations) == ["scan"]
    with pytest.raises(ValueError, match="frp"):
        score_points(spark, model, [{"scan": 1.0, "track": 1.0, "bright_t31": 300.0}], feats, FORM_RANGES)


def test_workflow_tunes_tree_without_leaf_limit(spark, tmp_path, monkeypatch):
    import kindling.plans.workflow as W
    monkeypatch.setattr(W, "LEAF_GRID", [4, 64])   # keep the CV small in a unit test
    df = synthetic_detections(spark, 1200, seed=4).withColumn(
        "brightness", 250 + F.when(F.col("frp") > 50, 80.0).otherwise(0.0) + F.col("scan") * 20)
    opts = WorkflowOptions(key_cols=["id"], eda=False, summaries=(),
                           specs=[ModelSpec("tree", "DecisionTreeRegressor", {}, is_default=True)])
    res = run_workflow(spark, df, opts, str(tmp_path / "run"), run_id=3, resume=True)
    tuning = spark.read.parquet(str(tmp_path / "run" / "tuning")).collect()
    assert sorted(r.max_leaf_nodes for r in tuning) == [4, 64] and sum(r.is_best for r in tuning) == 1
    chosen = [r.max_leaf_nodes for r in tuning if r.is_best][0]
    assert res["specs"][0].hyperparameters["max_leaf_nodes"] == chosen and "tuning" not in res["reused"]

    def again(*a, **k):
        raise AssertionError("tuned again")

    monkeypatch.setattr(W, "tune_tree", again)
    opts.metrics = ("mae",)   # scores anew, from the tuned and fitted tree on record
    second = run_workflow(spark, df, opts, str(tmp_path / "run"), run_id=3, resume=True)
    assert {"tuning", "models/tree"} <= set(second["reused"]) and "scores" not in second["reused"]
    assert second["specs"][0].hyperparameters["max_leaf_nodes"] == chosen and second["scores"].columns == ["model", "is_default", "mae"]


def test_csv_stream_binds_by_header_and_rejects_mismatch(spark, tmp_path):
    from pyspark.errors import StreamingQueryException

    from kindling.sources.readers import header_schema
    good = tmp_path / "good"
    good.mkdir()
    (good / "a.csv").write_text("frp,latitude\n12.5,-20.0\n")
    schema = header_schema(spark, str(good))
    assert [(f.name, f.dataType.simpleString()) for f in schema.fields] == [("frp", "double"), ("latitude", "double")]
    (good / "b.csv").write_text("latitude,frp\n-21.0,13.5\n")   # same columns, other order
    q = start_scoring(read_stream(spark, str(good), schema, fmt="csv"), str(tmp_path / "o"), str(tmp_path / "ck"),
                      available_now=True)
    with pytest.raises(StreamingQueryException):
        q.awaitTermination()


def test_workflow_rerun_same_run_id(spark, tmp_path):
    df = synthetic_detections(spark, 600, seed=12).withColumn("brightness", 300 + F.col("frp"))
    opts = WorkflowOptions(key_cols=["id"], eda=False, summaries=(),
                           specs=[ModelSpec("linear_regression", "LinearRegression")])
    first = run_workflow(spark, df, opts, str(tmp_path / "run"), run_id=5)["scores"].collect()
    again = run_workflow(spark, df, opts, str(tmp_path / "run"), run_id=5)["scores"].collect()
    assert first == again
    assert spark.read.parquet(str(tmp_path / "run" / "scores")).count() == 1   # replaced, not appended
