"""M12 evaluate_performance and M13 run_workflow: the batch workflow end to end.

Every stage writes its table (processed rows, features, train, test, scores,
metrics) under ``<out>/<stage>/run_id=<id>/``.  Later stages read the written
table back, so lineage is cut at each stage and a lost executor recomputes at
most one stage.  A run is published when all its stages are written; a second
start with ``resume`` reuses the stages that a first one finished.  ``out`` must
be a shared filesystem on a cluster.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kindling.models.scoring import score_models, stacked_predictions
from kindling.models.specs import ModelSpec, feature_importance, fit_models, load_model, save_model, tune_tree
from kindling.operators.explore import scatter_density
from kindling.operators.clean import create_dataset, drop_missing
from kindling.operators.features import generate_features
from kindling.operators.metrics import (
    METRICS,
    model_comparison,
    prediction_bounds,
    predictions_vs_actual,
    residuals,
)
from kindling.operators.split import contiguous_fold_column, train_test_split
from kindling.plans.eda import eda_tables
from kindling.plans.materialize import run_concurrently
from kindling.schema import (
    CRITICAL_COLUMNS,
    CV_FOLDS,
    LEAF_GRID,
    FEATURES,
    SHIPPED_METRICS,
    SHIPPED_MODELS,
    SPLIT_SEED,
    TARGET,
    TEST_SIZE,
    WORKFLOW_CRITICAL_COLUMNS,
)
from kindling.sources.runlog import RunLog, content_fingerprint, fingerprint
from kindling.sources.sinks import scores_table, write_metrics_report, write_run

log = logging.getLogger(__name__)

# Derived features that are computed from the default target.
_TARGET_DERIVED = {"temperature_diff": "brightness"}

#: Part of every stage's fingerprint: raise it when a stage gives other results from the same input and options.
STAGES_VERSION = 1


@dataclass
class WorkflowOptions:
    # Unique row key for the exact split.  Empty: a ``row_id`` is assigned when
    # the processed table is written, so it is fixed once stored (pass real key
    # columns for a split that is the same on any re-run).
    key_cols: Sequence[str] = ()
    target: str = TARGET
    features: Sequence[str] = tuple(FEATURES)
    critical_columns: Sequence[str] = tuple(CRITICAL_COLUMNS)
    date_col: str = "acq_date"
    region: Mapping | None = None
    outliers: Mapping | None = None
    base_only: bool = True
    derived: Sequence[str] = ()
    log: Mapping[str, str] | None = None
    normalize_cols: Sequence[str] = ()
    normalize_method: str = "min_max"
    test_size: float = TEST_SIZE
    seed: int = SPLIT_SEED
    specs: Sequence[ModelSpec] = field(default_factory=list)
    metrics: Sequence[str] = METRICS
    summaries: Sequence[str] = ("feature_importance", "predictions_vs_actual", "residuals", "model_comparison")
    allow_target_leakage: bool = False
    eda: bool = True
    count_dropped: bool = False  # one extra pass over the cleaned rows


def evaluate_performance(scores: DataFrame, metric: str = "mae", group_cols: Sequence[str] = ()) -> DataFrame:
    """Per-model metrics with default flag and ``is_best`` (argmin of ``metric``, A10).

    ``scores`` is already aggregated (one row per model and group), so the
    argmin is a window over those few rows: the scores are computed once, not
    re-evaluated by a second query.
    """
    value = F.col(metric) if metric in scores.columns else F.lit(None).cast("double")  # a metric not asked for is missing
    order = F.struct(F.coalesce(value, F.lit(float("inf"))).alias("m"), F.col("position").alias("p"))
    w = Window.partitionBy(*group_cols) if group_cols else Window.partitionBy(F.lit(0))
    return scores.withColumn("is_best", F.col("model") == F.min_by("model", order).over(w))


SUMMARIES = ("model_comparison", "predictions_vs_actual", "residuals", "prediction_bounds", "feature_importance")


def performance_summaries(scores: DataFrame, predictions: DataFrame | None = None,
                          names: Sequence[str] = ("model_comparison",), fitted=None,
                          features: Sequence[str] = (), bins: int = 20) -> dict[str, DataFrame]:
    """The requested summary tables (the data behind each evaluation chart).

    Summaries of predictions use the default model's (label, prediction) rows
    and are binned, so their size does not grow with the test set:
    ``predictions_vs_actual`` (A14) and ``residuals`` (A13: prediction x
    residual density).  ``feature_importance`` lists tree models' importances
    (M8).  Unknown names are logged and skipped.
    """
    out = {}
    default = None
    if predictions is not None and "is_default" in predictions.columns:
        default = predictions.where(F.col("is_default"))
    for name in names:
        if name == "model_comparison":
            out[name] = model_comparison(scores)
        elif name == "feature_importance":
            per_model = [(spec.name, feature_importance(m, features)) for spec, m in (fitted or [])]
            tables = [t.withColumn("model", F.lit(n)) for n, t in per_model if t is not None]
            if tables:
                t = tables[0]
                for x in tables[1:]:
                    t = t.unionByName(x)
                out[name] = t.select("model", "feature", "importance")
        elif name in ("predictions_vs_actual", "residuals", "prediction_bounds"):
            if default is None:
                log.warning("summary %s needs predictions; skipped", name)
                continue
            if name == "predictions_vs_actual":
                out[name] = predictions_vs_actual(default, bins=bins)
            elif name == "residuals":
                out[name] = scatter_density(residuals(default), "prediction", "residual", bins)
            else:
                out[name] = prediction_bounds(default)
        else:
            log.warning("unsupported summary: %s", name)
    return out


def shipped_options(**overrides) -> WorkflowOptions:
    """The reference's shipped configuration: 7 critical columns, no region
    filter, 3-sigma brightness outliers, the 7 base features, linear + tree +
    forest (forest default), test share 0.25 with seed 1, MAE/RMSE/R2."""
    base = dict(critical_columns=list(WORKFLOW_CRITICAL_COLUMNS), region={"enabled": False},
                outliers={"enabled": True, "column": TARGET, "std_threshold": 3}, base_only=True,
                specs=[ModelSpec(n, t, dict(hp), d) for n, t, hp, d in SHIPPED_MODELS],
                metrics=list(SHIPPED_METRICS))
    base.update(overrides)
    return WorkflowOptions(**base)


def _check_leakage(opts: WorkflowOptions) -> None:
    if opts.allow_target_leakage:
        return
    from_target = {opts.target, f"{opts.target}_norm"} | {d for d in opts.derived if _TARGET_DERIVED.get(d) == opts.target}
    from_target |= {new for new, source in (opts.log or {}).items() if source in from_target}
    from_target |= {f"{c}_norm" for c in opts.normalize_cols if c in from_target}
    leaks = [f for f in opts.features if f in from_target]
    if leaks:
        raise ValueError(f"features {leaks} are computed from the target '{opts.target}'; "
                         "pass allow_target_leakage=True to train on them anyway")


def _tune_unset_trees(train: DataFrame, key_cols: list[str], opts: WorkflowOptions, out: str,
                      run_id: int, runlog: RunLog, mark: str | None) -> tuple[list[ModelSpec], str | None]:
    """A tree spec with neither ``max_leaf_nodes`` nor ``max_depth`` gets its leaf
    limit from 5-fold CV over the candidate grid (M7) on the training rows; the
    CV table is written with the run.  Other specs pass through unchanged."""
    needs = [s for s in opts.specs if s.type == "DecisionTreeRegressor"
             and "max_leaf_nodes" not in s.hyperparameters and "max_depth" not in s.hyperparameters]
    if not needs:
        return list(opts.specs), None

    def _tuning() -> dict:
        folded = contiguous_fold_column(train, key_cols, CV_FOLDS, opts.seed)
        return {"tuning": write_run(tune_tree(folded, opts.features, opts.target, "fold", CV_FOLDS, LEAF_GRID), f"{out}/tuning", run_id)}

    path = runlog.stage("tuning", mark, _tuning)["tuning"]
    best = train.sparkSession.read.parquet(path).where("is_best").first()["max_leaf_nodes"]
    tuned = [ModelSpec(s.name, s.type, {**s.hyperparameters, "max_leaf_nodes": best}, s.is_default)
             if s in needs else s for s in opts.specs]
    return tuned, path


def run_workflow(spark: SparkSession, df: DataFrame, opts: WorkflowOptions, out: str,
                 run_id: int | None = None, resume: bool = False, input_version: str | None = None) -> dict:
    """Clean -> features -> EDA tables -> split -> fit -> score -> evaluate, written per run.

    The run is published last (``kindling.sources.runlog``): until then, and again from the
    start of a second writing, ``published_runs`` and ``published_models`` don't show it.

    ``resume=True`` records a fingerprint of each stage (input, options, stages before it,
    code version) and takes over the stages that an earlier start of the same run finished
    under the same one; ``run_id`` must be given.  The input is told by ``input_version`` (a
    snapshot's id, say), or else by its content, which costs one aggregate over all its columns.
    """
    if not opts.specs:
        raise ValueError("no model specs given")
    if resume and run_id is None:
        raise ValueError("resume needs the run_id to go on with")
    names = [s.name for s in opts.specs]
    if len(set(names)) < len(names):
        raise ValueError(f"model names must differ: {names}")
    _check_leakage(opts)
    run_id = int(time.time()) if run_id is None else int(run_id)
    out = out.rstrip("/")
    runlog = RunLog(spark, out, run_id)
    runlog.start()

    def mark(*parts) -> str | None:
        return fingerprint(STAGES_VERSION, *parts) if resume else None

    source = (input_version or content_fingerprint(df)) if resume else None
    key_cols = list(opts.key_cols)
    if not key_cols:
        df, key_cols = df.withColumn("row_id", F.monotonically_increasing_id()), ["row_id"]
    clean_mark = mark("processed", source, key_cols, opts.critical_columns, opts.date_col, opts.region, opts.outliers, opts.target)

    def _processed() -> dict:
        clean = create_dataset(df, opts.critical_columns, opts.date_col, opts.region, opts.outliers, opts.target)
        return {"processed": write_run(clean, f"{out}/processed", run_id)}

    keep = list(dict.fromkeys([*key_cols, *opts.features, opts.target]))
    # A row with a missing feature or target can be neither fitted nor scored
    # (VectorAssembler rejects it): drop such rows here, openly, and count them.
    fit_cols = list(dict.fromkeys([*opts.features, opts.target]))
    feats_mark = mark("features", clean_mark, opts.base_only, opts.features, opts.derived, opts.log, opts.normalize_cols, opts.normalize_method)

    try:
        # a run's own folder has its own columns, whatever other runs wrote
        clean = spark.read.parquet(runlog.stage("processed", clean_mark, _processed)["processed"])

        def _features() -> dict:
            feats = generate_features(clean, opts.base_only, opts.target, opts.features, opts.derived, opts.log,
                                      opts.normalize_cols, opts.normalize_method, keep=key_cols)
            return {"features": write_run(drop_missing(feats, fit_cols), f"{out}/features", run_id)}

        full = spark.read.parquet(runlog.stage("features", feats_mark, _features)["features"])
        feats = full.select(*keep)
    except AnalysisException as e:  # nothing was written: every row was dropped
        raise ValueError("no rows left after cleaning; check the input columns and filters") from e
    dropped_missing = clean.count() - feats.count() if opts.count_dropped else None

    # The EDA tables only read the written features: they run in the background
    # while the split, fits and scoring proceed (same work, better utilisation).
    pool = ThreadPoolExecutor(max_workers=1)

    def _eda() -> dict:
        tables = eda_tables(full.drop(*key_cols), opts.target)
        return run_concurrently({f"eda/{name}": (lambda n=name, t=table: write_run(t, f"{out}/eda/{n}", run_id))
                                 for name, table in tables.items()})

    eda_future = pool.submit(lambda: runlog.stage("eda", mark("eda", feats_mark, opts.target), _eda) if opts.eda else {})
    try:
        split_mark = mark("split", feats_mark, key_cols, opts.test_size, opts.seed)

        def _split() -> dict:
            train, test = train_test_split(feats, key_cols, opts.test_size, opts.seed)
            return run_concurrently({"train": lambda: write_run(train, f"{out}/train", run_id),
                                     "test": lambda: write_run(test, f"{out}/test", run_id)})

        parts = runlog.stage("split", split_mark, _split)
        train, test = (spark.read.parquet(parts[part]) for part in ("train", "test"))

        specs, tuning_path = _tune_unset_trees(train, key_cols, opts, out, run_id, runlog,
                                               mark("tuning", split_mark, key_cols, opts.features, opts.target, opts.seed, CV_FOLDS, LEAF_GRID))
        marks = {s.name: mark("model", split_mark, s.name, s.type, s.hyperparameters, opts.features, opts.target, key_cols) for s in specs}
        at = {s.name: f"{out}/models/run_id={run_id}/{s.name}" for s in specs}
        known = {n for n, m in marks.items() if runlog.finished(f"models/{n}", m)}
        fresh = dict(zip([s.name for s in specs if s.name not in known],
                         [m for _, m in fit_models(train, [s for s in specs if s.name not in known], opts.features, opts.target, key_cols=key_cols)],
                         strict=True))
        model_paths = run_concurrently({n: (lambda n=n: runlog.stage(f"models/{n}", marks[n], lambda: {f"models/{n}": save_model(fresh[n], at[n])}))
                                        for n in at})
        model_paths = {n: paths[f"models/{n}"] for n, paths in model_paths.items()}
        fitted = [(s, fresh[s.name] if s.name in fresh else load_model(model_paths[s.name])) for s in specs]

        scores_mark = mark("scores", [marks[s.name] for s in specs], [s.is_default for s in specs], opts.metrics)

        def _scores() -> dict:
            scores = score_models(test, fitted, opts.features, opts.target, opts.metrics)
            return {"scores": write_run(evaluate_performance(scores), f"{out}/scores", run_id)}

        # everything after this reads the written scores (a few rows), never re-scores
        scores_out = spark.read.parquet(runlog.stage("scores", scores_mark, _scores)["scores"]).withColumn("run_id", F.lit(run_id).cast("long"))

        def _summaries() -> dict:
            flagged = [i for i, (s, _) in enumerate(fitted) if s.is_default]
            default_pos = flagged[-1] if flagged else 0          # same rule as score_models (A11)
            preds = stacked_predictions(test, [fitted[default_pos]], opts.features, opts.target).withColumn(
                "is_default", F.lit(True))
            summaries = performance_summaries(scores_out.drop("run_id"), preds, opts.summaries, fitted, opts.features)
            paths = run_concurrently({f"summaries/{n}": (lambda n=n, t=t: write_run(t, f"{out}/summaries/{n}", run_id))
                                      for n, t in summaries.items()})
            return paths | {"metrics": write_metrics_report(scores_out, f"{out}/metrics/run_id={run_id}", mode="overwrite")}

        summary_paths = runlog.stage("summaries", mark("summaries", scores_mark, opts.summaries), _summaries)
    finally:
        pool.shutdown(wait=True)   # never leave EDA jobs running past a failure
    eda_paths = eda_future.result()
    runlog.publish()

    def under(paths: Mapping[str, str], kind: str) -> dict[str, str]:
        return {n.removeprefix(kind): p for n, p in paths.items() if n.startswith(kind)}

    return {"run_id": run_id, "scores": scores_table(scores_out.drop("run_id"), opts.metrics),
            "evaluated": scores_out, "models": model_paths, "fitted": fitted, "eda": under(eda_paths, "eda/"),
            "summaries": under(summary_paths, "summaries/"), "dropped_missing_features": dropped_missing, "tuning": tuning_path,
            "specs": specs, "reused": list(runlog.reused)}
