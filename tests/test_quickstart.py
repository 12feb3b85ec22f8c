"""The README quickstart, on local paths."""

from pyspark.sql import functions as F

import kindling as k


def test_readme_quickstart(spark, tmp_path):
    det = k.synthetic_detections(spark, 1200, seed=1).withColumn(
        "brightness", 250 + F.col("bright_t31") * 0.4 + F.col("frp"))
    (det.drop("id", "is_synthetic").withColumn("acq_date", F.date_format("acq_date", "yyyy-MM-dd"))
     .write.option("header", True).csv(str(tmp_path / "fires")))
    raw = k.read_detections(spark, str(tmp_path / "fires"), pattern="part-*.csv")
    clean = k.clean_detections(raw)
    assert k.describe(clean, ["brightness", "frp"]).count() == 2
    key = ["latitude", "longitude", "acq_date", "acq_time"]
    train, test = k.train_test_split(clean, key, 0.25, seed=1)
    assert train.count() + test.count() == clean.count() and test.count() == 300
    res = k.run_workflow(spark, raw, k.shipped_options(eda=False), str(tmp_path / "runs"))
    assert [r.model for r in res["scores"].collect()] == ["linear_regression", "decision_tree", "random_forest"]
    model = k.load_model(res["models"]["random_forest"])
    scored = k.score_frame(raw, model, k.schema.FEATURES, k.schema.FORM_RANGES)
    assert scored.where("prediction is null").count() == 0 and scored.count() == 1200
