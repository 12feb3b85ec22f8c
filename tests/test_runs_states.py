"""Run publication, resumed workflows, stored quantile states, hashed scatter samples and the two-way stream sink."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

import kindling.plans.workflow as W
from kindling.models.specs import ModelSpec, fit_linear, save_model
from kindling.operators.explore import scatter_sample
from kindling.operators.quantiles import describe_states, merge_states, quantile_states, rank_error
from kindling.plans.workflow import WorkflowOptions, run_workflow
from kindling.schema import FORM_RANGES
from kindling.sources.readers import synthetic_detections
from kindling.sources.registry import list_runs, resolve_model
from kindling.sources.runlog import RunLog, content_fingerprint, published_models, published_runs
from kindling.streaming import scoring as S


def _visible(spark, out):
    return [r.run_id for r in list_runs(published_runs(spark, out)).collect()]


def test_runs_show_only_while_published(spark, tmp_path):
    out = str(tmp_path)
    assert _visible(spark, out) == []
    run = RunLog(spark, out, 7)
    run.start()
    run.stage("models/a", None, lambda: {"models/a": "/m/a"})
    assert _visible(spark, out) == [] and published_models(spark, out).count() == 0
    run.publish()
    assert _visible(spark, out) == ["7"] and resolve_model(published_models(spark, out), "a", "7").first().path == "/m/a"
    RunLog(spark, out, 7).start()  # written anew: hidden until it is published again
    assert _visible(spark, out) == []
    RunLog(spark, out, 7).publish()
    assert _visible(spark, out) == ["7"]


def test_two_writers_of_one_run_collide(spark, tmp_path):
    a, b = RunLog(spark, str(tmp_path), 1), RunLog(spark, str(tmp_path), 1)
    a.start()
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        b.start()


def test_stages_are_reused_by_fingerprint_and_reopened(spark, tmp_path):
    out, built = str(tmp_path), []

    def build():
        built.append(1)
        return {"t": "/t"}

    assert RunLog(spark, out, 1).stage("t", "x", build) == {"t": "/t"}
    again = RunLog(spark, out, 1)
    assert again.stage("t", "x", build) == {"t": "/t"} and len(built) == 1 and again.reused == ["t"]
    RunLog(spark, out, 1).stage("t", None, build)
    assert len(built) == 2 and not RunLog(spark, out, 1).finished("t", "x")  # overwritten without a fingerprint: unknown

    def broken():
        raise RuntimeError("lost")

    RunLog(spark, out, 1).stage("t", "x", build)
    with pytest.raises(RuntimeError):
        RunLog(spark, out, 1).stage("t", "y", broken)
    assert not RunLog(spark, out, 1).finished("t", "x")  # halfway overwritten: the old table isn't taken for finished


def test_content_fingerprint(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "b", 1.0), (2, "b", 1.0)], "k int, s string, v double")
    same = content_fingerprint(df.repartition(3))
    assert content_fingerprint(df.orderBy(F.desc("k"))) == same
    assert content_fingerprint(df.distinct()) != same and content_fingerprint(df.withColumnRenamed("v", "w")) != same
    assert content_fingerprint(df.where("false")) == content_fingerprint(df.where("k > 9"))


def test_workflow_resumes_after_a_failed_fit(spark, tmp_path, monkeypatch):
    df = synthetic_detections(spark, 800, seed=6).withColumn("brightness", 250 + F.col("frp"))
    specs = [ModelSpec("linear_regression", "LinearRegression", {}, True), ModelSpec("tree", "DecisionTreeRegressor", {"max_leaf_nodes": 8})]
    opts = WorkflowOptions(key_cols=["id"], specs=specs)
    out, fit = str(tmp_path / "run"), W.fit_models
    with pytest.raises(ValueError, match="run_id"):
        run_workflow(spark, df, opts, out, resume=True)

    def lost(*a, **k):
        raise RuntimeError("executor lost")

    monkeypatch.setattr(W, "fit_models", lost)
    with pytest.raises(RuntimeError):
        run_workflow(spark, df, opts, out, run_id=3, resume=True)
    assert _visible(spark, out) == []
    monkeypatch.setattr(W, "fit_models", fit)
    for name in ("create_dataset", "generate_features", "train_test_split", "eda_tables"):  # none may run again
        monkeypatch.setattr(W, name, lost)
    res = run_workflow(spark, df, opts, out, run_id=3, resume=True)
    assert {"processed", "features", "split", "eda"} <= set(res["reused"]) and not any(n.startswith("models/") for n in res["reused"])
    assert _visible(spark, out) == ["3"] and {r.model for r in published_models(spark, out).collect()} == {"linear_regression", "tree"}
    assert set(published_runs(spark, out).first().paths) >= {"processed", "features", "train", "test", "scores", "metrics", "models/tree", "summaries/residuals"}
    before = res["scores"].collect()
    # other hyperparameters of one model: the other one and all before are taken over
    monkeypatch.setattr(W, "fit_models", lambda train, s, *a, **k: fit(train, s, *a, **k) if [x.name for x in s] == ["tree"] else lost())
    opts.specs = [specs[0], ModelSpec("tree", "DecisionTreeRegressor", {"max_leaf_nodes": 16})]
    second = run_workflow(spark, df, opts, out, run_id=3, resume=True)
    assert "models/linear_regression" in second["reused"] and "scores" not in second["reused"]
    assert second["scores"].collect()[0] == before[0] and second["scores"].count() == 2
    # changed rows: nothing is
    with pytest.raises(RuntimeError):
        run_workflow(spark, df.where("id <> 5"), opts, out, run_id=3, resume=True)


def test_workflow_without_keys_stores_row_ids_once(spark, tmp_path):
    df = synthetic_detections(spark, 400, seed=8).withColumn("brightness", 300 + F.col("frp")).repartition(7, "frp")
    specs = [ModelSpec("linear_regression", "LinearRegression")]
    run_workflow(spark, df, WorkflowOptions(specs=specs, eda=False, summaries=()), str(tmp_path), run_id=1)
    stored, feats = (spark.read.parquet(str(tmp_path / t)) for t in ("processed", "features"))
    both = stored.select("row_id", F.col("frp").alias("a")).join(feats.select("row_id", F.col("frp").alias("b")), "row_id")
    assert both.count() == feats.count() > 0 and both.where("a <> b").count() == 0


def test_states_merge_to_the_whole(spark):
    rng = random.Random(5)
    rows = [(g if g else None, 1e9 + rng.gauss(0, 1) if rng.random() > 0.1 else rng.choice([None, math.nan])) for g in [0] * 9000 + [1] * 500 + [2] * 40]
    rows += [(3, None), (4, 5.0)]
    df = spark.createDataFrame(rows, "g int, v double").repartition(5)
    states = quantile_states(df, ["v"], ["g"])
    got = describe_states(states, levels=(0.0, 0.1, 0.5, 0.9, 1.0)).first()
    vals = sorted(v for _, v in rows if v is not None and not math.isnan(v))
    mean = math.fsum(vals) / len(vals)
    assert got["count"] == len(vals) and abs(got["mean"] - mean) < 1e-3 and (got["min"], got["max"]) == (vals[0], vals[-1])
    std = math.sqrt(math.fsum((v - mean) ** 2 for v in vals) / (len(vals) - 1))
    assert abs(got["std"] / std - 1) < 1e-6
    for q in (0.1, 0.5, 0.9):
        rank = sum(v <= got[f"p{100 * q:g}"] for v in vals) / len(vals)
        assert abs(rank - q) <= 2 * rank_error()
    assert (got["p0"], got["p100"]) == (vals[0], vals[-1])
    per = {r.g: r for r in describe_states(states, ["g"]).collect()}
    assert per[3]["count"] == 0 and per[3]["p50"] is None and per[3]["mean"] is None and per[3]["std"] is None
    assert per[4]["p50"] == 5.0 and per[4]["std"] is None and set(per) == {None, 1, 2, 3, 4}
    twice = merge_states(merge_states(states, ["g"]))  # merged states merge again
    assert twice.first()["n"] == len(vals)
    empty = describe_states(quantile_states(df.where("false"), ["v"], ["g"]))
    assert empty.count() == 0


def test_scatter_sample_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, 5.0 if i % 3 else rng.uniform(0, 10), rng.random()) for i in range(6000)]
    rows += [(7000, None, 1.0), (7001, 1.0, None), (7002, math.nan, 1.0), (None, 2.0, 0.5)]
    df = spark.createDataFrame(rows, "k int, x double, y double")
    got = {(r.bin, r.k, r.x, r.y) for r in scatter_sample(df, ["x"], "y", ["k"], k=15).collect()}
    full = [(k, x, y) for k, x, y in rows if x is not None and not math.isnan(x) and y is not None]
    bounded = [x for _, x, _ in rows if x is not None and not math.isnan(x)]
    lo, hi = min(bounded), max(bounded)
    bins = {}
    for k, x, y in full:
        bins.setdefault(min(math.floor((x - lo) * 10 / (hi - lo)), 9), []).append((hashlib.md5(f"1:{'\\N' if k is None else k}".encode()).hexdigest(), k, x, y))
    want = {(b, k, x, y) for b, pts in bins.items() for _, k, x, y in sorted(pts, key=lambda p: (p[0], p[2], p[3]))[:15]}
    assert got == want
    other = {(r.bin, r.k, r.x, r.y) for r in scatter_sample(df.repartition(9), ["x"], "y", ["k"], k=15).collect()}
    assert other == want


def test_scatter_sample_with_one_key_for_all(spark):
    """Hashes that don't differ can't thin evenly: bins are widened until whole."""
    df = spark.range(0, 5000).select(F.lit(1).alias("k"), (F.col("id") % 7).cast("double").alias("x"), F.col("id").cast("double").alias("y"))
    got = scatter_sample(df, ["x"], "y", ["k"], k=5, bins=7).groupBy("bin").agg(F.count("*").alias("n"), F.max("y").alias("y")).collect()
    assert {(r.bin, r.n) for r in got} == {(b, 5) for b in range(7)} and all(r.y == r.bin + 28 for r in got)
    assert scatter_sample(df.where("false"), ["x"], "y", ["k"]).count() == 0
    same = spark.range(0, 3000).select((F.col("id") % 2).alias("k"), F.lit(2.0).alias("x"), F.lit(1.0).alias("y"))  # equal rows are points each
    assert [(r.bin, r.x, r.y) for r in scatter_sample(same, ["x"], "y", ["k"], k=7).collect()] == [(5, 2.0, 1.0)] * 7
    few = scatter_sample(same.where("k = 0").limit(3), ["x"], "y", ["k"], k=7)
    assert few.count() == 3


FEATS = ["scan", "track", "bright_t31", "frp"]


def _publish(spark, out, run_id, df):
    run = RunLog(spark, out, run_id)
    run.start()
    path = f"{out}/models/run_id={run_id}/lin"
    run.stage("models/lin", None, lambda: {"models/lin": save_model(fit_linear(df, FEATS, "brightness"), path)})
    run.publish()


def test_two_way_stream_killed_and_restarted_equals_batch(spark, tmp_path, monkeypatch):
    from pyspark.errors import StreamingQueryException

    src, runs, out, ck = (str(tmp_path / n) for n in ("src", "runs", "out", "ck"))
    df = synthetic_detections(spark, 400, seed=5)
    bad = spark.createDataFrame([(9001, 9.0, 1.0, 300.0, 10.0), (9002, 9.0, 1.0, None, 10.0), (9003, 1.0, 1.0, 300.0, math.nan)],
                                "id long, scan double, track double, bright_t31 double, frp double")
    rows = df.select("id", *FEATS).unionByName(bad)
    for i in range(3):
        rows.where(F.col("id") % 3 == i).coalesce(1).write.parquet(f"{src}/{i}")
    _publish(spark, runs, 1, df)
    RunLog(spark, runs, 2).start()  # never published: no batch may take it
    stream = S.read_stream(spark, src, rows.schema, recursive=True, max_files_per_trigger=1)

    def start():
        S.start_two_way(stream, S.published_model(runs, "lin"), FEATS, FORM_RANGES, out, ck, available_now=True).awaitTermination()

    writes = []
    from pyspark.sql.readwriter import DataFrameWriter
    plain = DataFrameWriter.parquet

    def dying(self, path, *a, **k):  # the second batch dies after its rows were written, before its counts
        if "/counts/batch_id=1" in path and not writes:
            writes.append(path)
            raise RuntimeError("killed")
        return plain(self, path, *a, **k)

    monkeypatch.setattr(DataFrameWriter, "parquet", dying)
    with pytest.raises(StreamingQueryException):
        start()
    assert writes and {r.batch_id for r in S.batch_counts(spark, out).collect()} == {0}  # the half-written batch doesn't show
    assert {r.batch_id for a in (True, False) for r in S.read_two_way(spark, out, a).collect()} == {0}
    monkeypatch.undo()
    start()
    model = fit_linear(df, FEATS, "brightness")
    batch = {r.id: r.prediction for r in S.score_frame(rows, model, FEATS, FORM_RANGES).collect()}
    good = S.read_two_way(spark, out, True).collect()
    lost = {r.id: sorted(r.violations) for r in S.read_two_way(spark, out, False).collect()}
    assert len(good) + len(lost) == 403 and {r.id: r.prediction for r in good} == {k: v for k, v in batch.items() if v is not None}
    assert {r.model_run for r in good} == {"1"} and {k: v for k, v in lost.items() if k > 9000} == {9001: ["scan"], 9002: ["bright_t31", "scan"], 9003: ["frp"]}
    counts = {(r.kind, r.name): r.n for r in S.batch_counts(spark, out).groupBy("kind", "name").agg(F.sum("n").alias("n")).collect()}
    assert counts[("accepted", "rows")] == len(good) and counts[("rejected", "rows")] == len(lost)
    assert counts[("violation", "scan")] == sum("scan" in v for v in lost.values())


def test_two_way_stream_takes_the_newest_published_model(spark, tmp_path):
    src, runs, out, ck = (str(tmp_path / n) for n in ("src", "runs", "out", "ck"))
    df = synthetic_detections(spark, 200, seed=5)
    rows = df.select("id", *FEATS)
    stream_of = lambda: S.read_stream(spark, src, rows.schema, recursive=True)

    def start():
        S.start_two_way(stream_of(), S.published_model(runs, "lin"), FEATS, {}, out, ck, available_now=True).awaitTermination()

    rows.where("id < 100").write.parquet(f"{src}/a")
    _publish(spark, runs, 1, df)
    start()
    rows.where("id >= 100").write.parquet(f"{src}/b")
    _publish(spark, runs, 2, df.withColumn("brightness", F.col("brightness") + 1000))
    start()
    by_run = {r.model_run: (r.lo, r.hi) for r in S.read_two_way(spark, out, True).groupBy("model_run").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).collect()}
    assert by_run == {"1": (0, 99), "2": (100, 199)}
    with pytest.raises(ValueError, match="accepted"):
        S.start_two_way(stream_of().withColumn("Accepted", F.lit(1)), S.published_model(runs, "lin"), FEATS, {}, out, ck)
    with pytest.raises(ValueError, match="no published model"):
        S.published_model(str(tmp_path / "none"), "lin")(spark)
