import json

from pyspark.sql import functions as F

from kindling.__main__ import main
from kindling.sources.readers import synthetic_detections


def test_cli_workflow_runs_and_score(spark, tmp_path, capsys):
    csv = str(tmp_path / "in")
    det = synthetic_detections(spark, 1500, seed=3).withColumn(
        "brightness", 200 + F.col("bright_t31") * 0.6 + F.col("frp") * 0.8)
    (det.drop("id", "is_synthetic").withColumn("acq_date", F.date_format("acq_date", "yyyy-MM-dd"))
     .write.option("header", True).csv(csv))
    out = str(tmp_path / "run")
    assert main(["workflow", "--input", csv, "--out", out, "--run-id", "7", "--no-eda"]) == 0
    rows = [json.loads(x) for x in capsys.readouterr().out.strip().splitlines()]
    assert [r["model"] for r in rows] == ["linear_regression", "decision_tree", "random_forest"]
    assert [r["is_default"] for r in rows] == [False, False, True] and rows[0]["r2"] > 0.99
    assert set(rows[0]) == {"run_id", "model", "is_default", "mae", "rmse", "r2"}

    assert main(["runs", "--models", f"{out}/models"]) == 0
    listed = json.loads(capsys.readouterr().out.strip())
    assert listed == {"run_id": "7", "models": ["decision_tree", "linear_regression", "random_forest"]}

    model = f"{out}/models/run_id=7/random_forest"
    assert main(["score", "--model", model, "--input", csv, "--out", str(tmp_path / "scored")]) == 0
    counts = json.loads(capsys.readouterr().out.strip())
    assert sum(counts.values()) == 1500
    assert main(["score", "--model", model, "--input", csv, "--out", str(tmp_path / "streamed"), "--stream",
                 "--checkpoint", str(tmp_path / "ck"), "--once"]) == 0
    streamed = spark.read.parquet(str(tmp_path / "streamed"))
    batch = spark.read.parquet(str(tmp_path / "scored"))
    key = ["latitude", "longitude", "scan", "track", "bright_t31", "frp", "confidence"]
    s_rows = sorted((tuple(r[k] for k in key), r.prediction) for r in streamed.collect())
    b_rows = sorted((tuple(r[k] for k in key), r.prediction) for r in batch.collect())
    assert len(s_rows) == 1500 and s_rows == b_rows      # stream binds columns by name, like batch
