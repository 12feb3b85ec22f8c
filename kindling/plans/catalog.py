"""Registered queries over the supplied tables, each with its DuckDB oracle text.

Every query reads whole tables (no id subsets or caps) and exercises one
operator (or a short chain).  Values that depend on summation order are rounded
the same way on both sides: aggregates to 4 decimals, ratios to 6; row-wise
arithmetic is bit-equal and left unrounded.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindling.functions.columns import band_label, radius
from kindling.models.scoring import score_models, stacked_predictions, train_and_test_r2
from kindling.models.specs import (
    ModelSpec,
    coefficients,
    feature_importance,
    fit_linear,
    fit_model,
    fit_models,
    save_model,
    tune_tree,
)
from kindling.operators import clean, explore, features, metrics, quantiles
from kindling.operators.gram import linear_fits
from kindling.operators.selection import exact_quantiles_of
from kindling.operators.split import contiguous_fold_column, train_test_split
from kindling.plans.workflow import evaluate_performance, run_workflow, shipped_options
from kindling.session import ensure_checkpoint_dir
from kindling.sources.readers import read_detections, read_table
from kindling.sources.text import read_text, reject_counts, typed
from kindling.sources import sinks
from kindling.sources import registry
from kindling.sources.registry import list_runs
from kindling.sources.runlog import RunLog, published_models, published_runs
from kindling.streaming.scoring import batch_counts, published_model, read_stream, read_two_way, score_frame, start_scoring, start_two_way


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return read_table(spark, sf, name)


def _scratch(spark: SparkSession, label: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/kindling/{label}-{uuid.uuid4().hex}"


# --------------------------------------------------------------------- P ops
def q_drop_missing(spark, sf):
    li = _t(spark, sf, "lineitem").select(F.nullif("l_discount", F.lit(0.0)).alias("d"))
    kept = clean.drop_missing(li, ["d"])
    return kept.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("d"), 4).alias("s"))


def q_null_audit(spark, sf):
    li = _t(spark, sf, "lineitem").select(F.nullif("l_discount", F.lit(0.0)).alias("d"), "l_quantity")
    return clean.null_audit(li, ["d", "l_quantity"])


def q_filter_region(spark, sf):
    li = _t(spark, sf, "lineitem")
    box = clean.filter_region(li, 10, 20, 0.02, 0.05, lat_col="l_quantity", lon_col="l_discount")
    return box.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("s"))


def q_filter_outliers(spark, sf):
    ev = clean.filter_outliers(_t(spark, sf, "events"), "value", 3.0)
    return ev.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("v"))


def _lineitem_detections(spark, sf):
    """A detection-shaped view derived from lineitem (for the fixed cleaning preset)."""
    li = _t(spark, sf, "lineitem")
    return li.select(
        (F.lit(-8.0) - F.col("l_discount") * 400).alias("latitude"),      # -8 .. -48
        (F.lit(110.0) + F.col("l_quantity")).alias("longitude"),          # 111 .. 160
        (F.col("l_extendedprice") / 200).alias("brightness"),
        (F.lit(1.0) + F.col("l_tax") * 10).alias("scan"),
        (F.lit(1.0) + F.col("l_discount") * 10).alias("track"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("acq_date"))


def q_clean_detections(spark, sf):
    c = clean.clean_detections(_lineitem_detections(spark, sf))
    return c.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("brightness"), 4).alias("b"),
                  F.min("latitude").alias("lat_lo"), F.max("latitude").alias("lat_hi"),
                  F.min("longitude").alias("lon_lo"), F.max("longitude").alias("lon_hi"),
                  F.date_format(F.min("acq_date"), "yyyy-MM-dd").alias("first_day"))


def q_create_dataset(spark, sf):
    li = _t(spark, sf, "lineitem")
    ds = clean.create_dataset(
        li, critical_columns=["l_quantity", "l_discount"], date_col="l_shipdate",
        region={"enabled": True, "min_latitude": 5, "max_latitude": 45, "min_longitude": 0.01,
                "max_longitude": 0.09, "lat_col": "l_quantity", "lon_col": "l_discount"},
        outliers={"enabled": True, "column": "l_extendedprice", "std_threshold": 2},
        target="l_extendedprice")
    return ds.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"),
                                          F.round(F.sum("l_extendedprice"), 2).alias("s"),
                                          F.date_format(F.min("l_shipdate"), "yyyy-MM-dd").alias("first_day"))


def q_ratio_diff(spark, sf):
    li = _t(spark, sf, "lineitem").withColumn("_t1", 1 + F.col("l_tax"))
    out = features.frp_per_area(li, frp="l_extendedprice", scan="l_quantity", track="_t1", out="r")
    out = features.temperature_diff(out, a="l_extendedprice", b="l_quantity", out="d")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "r", "d")


def q_log_transform(spark, sf):
    out = features.log_transform(_t(spark, sf, "lineitem"), {"r": "l_extendedprice", "skipped": "no_such_column"})
    return out.select("l_orderkey", "l_partkey", F.round("r", 6).alias("r"))


def q_minmax(spark, sf):
    out = features.normalize(_t(spark, sf, "lineitem"), ["l_quantity"], "min_max")
    return out.select("l_orderkey", "l_partkey", F.col("l_quantity_norm").alias("r"))


def q_zscore(spark, sf):
    out = features.normalize(_t(spark, sf, "lineitem"), ["l_quantity"], "standard")
    return out.select("l_orderkey", "l_partkey", F.round("l_quantity_norm", 6).alias("r"))


def q_date_from_doy(spark, sf):
    o = _t(spark, sf, "orders").select("o_orderkey", F.year("o_orderdate").alias("acq_year"),
                                       F.dayofyear("o_orderdate").alias("acq_day"))
    return clean.ensure_acq_date(o).select("o_orderkey", F.date_format("acq_date", "yyyy-MM-dd").alias("acq_date"))


def q_date_from_text(spark, sf):
    o = _t(spark, sf, "orders").select("o_orderkey",
                                       F.date_format("o_orderdate", "yyyy/MM/dd").alias("acquisition_date"))
    return clean.ensure_acq_date(o).select("o_orderkey", F.date_format("acq_date", "yyyy-MM-dd").alias("acq_date"))


def q_intensity_band(spark, sf):
    o = _t(spark, sf, "orders")
    b = o.select(band_label("o_totalprice", 400000.0, 350000.0).alias("b"), radius("o_totalprice").alias("rad"))
    return b.groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("rad"), 2).alias("r"))


def q_range_check(spark, sf):
    li = _t(spark, sf, "lineitem")
    return clean.range_violation_counts(li, {"l_quantity": (5, 45), "l_discount": (0.01, 0.09)})


def q_range_flags(spark, sf):
    li = _t(spark, sf, "lineitem")
    chk = clean.range_check(li, {"l_quantity": (5, 45), "l_discount": (0.01, 0.09)})
    return chk.groupBy("valid", F.array_join("violations", ",").alias("rules")).agg(F.count(F.lit(1)).alias("n"))


def q_filter_dates(spark, sf):
    li = clean.filter_dates(_t(spark, sf, "lineitem"), "l_shipdate", "1997-01-01", "1998-12-31")
    return li.agg(F.count(F.lit(1)).alias("n"), F.min("l_shipdate").alias("lo"), F.max("l_shipdate").alias("hi"))


# --------------------------------------------------------------------- A ops
def q_column_stats(spark, sf):
    st = explore.column_stats(_t(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    return st.select("column", "count", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"),
                     "min", "max")


def q_describe(spark, sf):
    d = explore.describe(_t(spark, sf, "events"), ["value"])
    return d.select("column", "count", *[F.round(c, 6).alias(c) for c in ("mean", "std")], "min",
                    *[F.round(c, 6).alias(c) for c in ("p25", "p50", "p75")], "max")


def q_quantile_levels(spark, sf):
    """Exact quantiles of several columns in shared passes, refined down to ranges of 64 rows or one value."""
    cols, qs = ["l_quantity", "l_extendedprice", "l_discount"], [0.01, 0.5, 0.99]
    got = exact_quantiles_of(_t(spark, sf, "lineitem"), cols, qs, final_max=64)
    rows = [(c, q, round(v, 6)) for c, vs in zip(cols, got) for q, v in zip(qs, vs) if v is not None]
    return spark.createDataFrame(rows, "column string, q double, value double")


_CORR_COLS = ["l_quantity", "l_extendedprice", "l_discount"]


def q_correlations(spark, sf):
    cm = explore.correlation_matrix(_t(spark, sf, "lineitem"), _CORR_COLS)
    return cm.select("a", "b", "i", "j", F.round("corr", 6).alias("corr"))


def q_lower_triangle(spark, sf):
    cm = explore.lower_triangle(explore.correlation_matrix(_t(spark, sf, "lineitem"), _CORR_COLS))
    return cm.select("a", "b", F.round("corr", 6).alias("corr"))


def q_top_correlates(spark, sf):
    tc = explore.top_correlates(_t(spark, sf, "lineitem"), "l_extendedprice",
                                ["l_extendedprice", "l_quantity", "l_discount", "l_tax"], k=2)
    return tc.select("feature", F.round("corr", 6).alias("c"))


def q_histogram(spark, sf):
    h = explore.histogram(_t(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"], 30)
    return h.select("column", "bin", "count")


def q_histogram_events(spark, sf):
    h = explore.histogram(_t(spark, sf, "events"), ["value"], 30)
    return h.select("bin", F.col("count").alias("n"))


def q_numeric_histograms(spark, sf):
    li = _t(spark, sf, "lineitem")
    h = explore.histogram(li, features.numeric_columns(li, 10), 30)
    return h.select("column", "bin", "count")


def q_density_curve(spark, sf):
    d = explore.density_curve(_t(spark, sf, "events"), "value", grid=200)
    return d.select("i", F.round("x", 8).alias("x"), F.round("density", 10).alias("density"))


def q_scatter_density(spark, sf):
    return explore.scatter_density(_t(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", 10)


def q_scatter_sample(spark, sf):
    """Twenty points of each bin of two features, by hash of the line's key."""
    s = explore.scatter_sample(_t(spark, sf, "lineitem"), ["l_quantity", "l_discount"], "l_extendedprice", ["l_orderkey", "l_linenumber"], k=20)
    return s.select("feature", "bin", "x", F.round("y", 2).alias("y"), "l_orderkey", "l_linenumber")


_STORED = ["l_extendedprice", "l_quantity"]


def _daily_states(spark, sf):
    """Sketches per day and column of lineitem, stored."""
    li = _t(spark, sf, "lineitem").select(F.col("l_shipdate").cast("date").alias("day"), *_STORED)
    path = _scratch(spark, "daily-states")
    sinks.write_table(quantiles.quantile_states(li, _STORED, ["day"]), path)
    return spark.read.parquet(path)


def q_stored_quantiles(spark, sf):
    """Summaries of two years from the merged states of their days; each quantile's true rank must be within
    twice the stated error (far enough out for a sketch's own draws never to show)."""
    states = clean.filter_dates(_daily_states(spark, sf), "day", "1994-01-01", "1995-12-31")
    stored = quantiles.describe_states(states).collect()  # a row a column
    rows = clean.filter_dates(_t(spark, sf, "lineitem"), "l_shipdate", "1994-01-01", "1995-12-31")
    bound = 2 * quantiles.rank_error()
    ranks = [(r["column"], q, r[f"p{q}"]) for r in stored for q in (25, 50, 75)]
    checks = rows.agg(*[e for i, (c, _, v) in enumerate(ranks) for e in (F.count_if(F.col(c) < v).alias(f"below{i}"), F.count_if(F.col(c) <= v).alias(f"upto{i}"))])
    each = [F.struct(F.lit(c).alias("column"), F.lit(q).alias("level"),
                     ((F.col(f"below{i}") <= (q / 100 + bound) * r["count"]) & (F.col(f"upto{i}") >= (q / 100 - bound) * r["count"])).alias("within"),
                     F.lit(r["count"]).alias("n"), F.round(F.lit(r["mean"]), 4).alias("mean"), F.round(F.lit(r["std"]), 4).alias("std"),
                     F.lit(r["min"]).alias("lo"), F.lit(r["max"]).alias("hi"))
            for i, (c, q, _) in enumerate(ranks) for r in stored if r["column"] == c]
    return checks.select(F.inline(F.array(*each)))


def q_daily_from_states(spark, sf):
    """Rows, total, spread, least and greatest of every day out of the stored states (medians have their own check)."""
    d = quantiles.describe_states(_daily_states(spark, sf), ["day"], levels=())
    return d.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "column", F.col("count").alias("n"), F.round(F.col("mean") * F.col("count"), 2).alias("total"),
                    F.round("std", 4).alias("std"), F.col("min").alias("lo"), F.col("max").alias("hi"))


def q_daily_summary(spark, sf):
    d = explore.daily_summary(_t(spark, sf, "events"), "ts", "value")
    return d.select(F.date_format("d", "yyyy-MM-dd").alias("d"), "n", F.round("a", 4).alias("a"),
                    F.round("m", 4).alias("m"), "mx")


# --------------------------------------------------------------------- M ops
def q_exact_split(spark, sf):
    _, test = train_test_split(_t(spark, sf, "orders"), "o_orderkey", 0.25, 1)
    return test.agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("k"))


def q_linear_fit(spark, sf):
    o = _t(spark, sf, "orders")
    m = fit_linear(o, ["o_custkey"], "o_totalprice")
    c = coefficients(m, ["o_custkey"])
    return c.select("feature", F.when(F.col("feature") == "intercept", F.round("coefficient", 4))
                    .otherwise(F.round("coefficient", 6)).alias("coefficient"))


def _order_model_predictions(spark, sf):
    """Linear fit of o_totalprice on o_custkey plus a train-mean baseline, scored on the test split."""
    train, test = train_test_split(_t(spark, sf, "orders"), "o_orderkey", 0.25, 1)
    fitted = fit_models(train, [ModelSpec("linear", "LinearRegression")], ["o_custkey"], "o_totalprice")
    lin = stacked_predictions(test, fitted, ["o_custkey"], "o_totalprice", extra=["o_orderkey"])
    mu = train.agg(F.avg("o_totalprice").alias("mu")).select("mu").scalar()
    mean = test.select(F.lit("mean").alias("model"), F.lit(1).alias("position"), F.lit(False).alias("is_default"),
                       "o_orderkey", F.col("o_totalprice").alias("label"), mu.alias("prediction"))
    return lin.unionByName(mean)


def q_wide_correlations(spark, sf):
    """Forty columns, each with NULLs of its own, in one plan."""
    li = _t(spark, sf, "lineitem")
    cols = [F.when(F.col("l_linenumber") % 7 != i % 7, F.col(c) * F.lit(1.0 + i % 3) + F.col("l_quantity") * F.lit(float(i % 5))).alias(f"v{i}")
            for i, c in enumerate(["l_quantity", "l_extendedprice", "l_discount", "l_tax"] * 10)]
    m = explore.correlation_matrix(li.select(*cols), [f"v{i}" for i in range(40)])
    return explore.lower_triangle(m).select("a", "b", F.round("corr", 6).alias("corr"))


def q_group_correlations(spark, sf):
    m = explore.correlation_matrix(_t(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"], ["l_returnflag", "l_linestatus"])
    return explore.lower_triangle(m).select("l_returnflag", "l_linestatus", "a", "b", F.round("corr", 6).alias("corr"))


def q_linear_by_year(spark, sf):
    """One pass of normal equations, one fit per order year."""
    o = _order_features(spark, sf).withColumn("year", F.year(F.col("acq_date").cast("date")))
    return linear_fits(o, _CELL_FEATURES, "o_totalprice", ["year"]).select("year", "n", "term", F.round("coefficient", 4).alias("coefficient"), F.round("r2", 6).alias("r2"))


def q_linear_leave_fold_out(spark, sf):
    """The training fit of every fold, from the folds' states."""
    o = contiguous_fold_column(_order_features(spark, sf), "o_orderkey", 5, 1)
    return linear_fits(o, _CELL_FEATURES, "o_totalprice", ["fold"], leave_out=True).select("fold", "n", "term", F.round("coefficient", 4).alias("coefficient"), F.round("r2", 6).alias("r2"))


def q_train_test_r2(spark, sf):
    train, test = train_test_split(_t(spark, sf, "orders"), "o_orderkey", 0.25, 1)
    fitted = fit_models(train, [ModelSpec("linear", "LinearRegression")], ["o_custkey"], "o_totalprice")
    r = train_and_test_r2(train, test, fitted, ["o_custkey"], "o_totalprice")
    return r.select("model", "split", "n", F.round("r2", 6).alias("r2"))


def q_preview(spark, sf):
    return sinks.preview(_t(spark, sf, "orders"), ["o_orderkey"], 5)


def _order_scores(spark, sf):
    return metrics.regression_metrics(_order_model_predictions(spark, sf), "label", "prediction",
                                      ["model", "position"])


def q_model_metrics(spark, sf):
    s = _order_scores(spark, sf)
    return s.select("model", F.round("mae", 4).alias("mae"), F.round("rmse", 4).alias("rmse"),
                    F.round("r2", 6).alias("r2"), F.round("explained_variance", 6).alias("ev"))


def q_best_model(spark, sf):
    b = metrics.best_model(_order_scores(spark, sf), "mae")
    return b.select("best", F.round("mae", 4).alias("mae"))


def q_improvement_pct(spark, sf):
    p = metrics.improvement_pct(_order_scores(spark, sf), base="mean", other="linear")
    return p.select(F.round("pct", 4).alias("pct"))


def q_model_comparison(spark, sf):
    c = metrics.model_comparison(_order_scores(spark, sf))
    return c.select("model", F.round("mae", 4).alias("mae"), F.round("r2", 6).alias("r2"))


def q_prediction_bounds(spark, sf):
    b = metrics.prediction_bounds(_order_model_predictions(spark, sf), "label", "prediction", ["model"])
    return b.select("model", F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi"))


def q_predictions_vs_actual(spark, sf):
    p = metrics.predictions_vs_actual(_order_model_predictions(spark, sf), "label", "prediction", ["model"], bins=20)
    return p.select("model", "actual_bin", "predicted_bin", F.round("lo", 4).alias("lo"),
                    F.round("hi", 4).alias("hi"), "n")


def q_residuals(spark, sf):
    p = _order_model_predictions(spark, sf).where(F.col("model") == "mean")
    r = metrics.residuals(p, "label", "prediction")
    return r.select("o_orderkey", F.round("residual", 4).alias("residual"))


def _run_scores(spark, sf):
    """Per (year, priority) MAE of a constant prediction: a run x model score table from orders."""
    o = _t(spark, sf, "orders").select(F.year("o_orderdate").alias("run_id"),
                                       F.col("o_orderpriority").alias("model"),
                                       F.col("o_totalprice").alias("label"),
                                       F.lit(250000.0).alias("prediction"))
    s = metrics.regression_metrics(o, "label", "prediction", ["run_id", "model"], ["mae"])
    return s.select("run_id", "model", F.round("mae", 4).alias("mae"))


def q_default_model(spark, sf):
    """Per year: the default among priority 'models' (flagged when any order tops 499,000)."""
    specs = (_t(spark, sf, "orders")
             .groupBy(F.year("o_orderdate").alias("run_id"), F.col("o_orderpriority").alias("model"))
             .agg(F.max(F.col("o_totalprice") > 499000).alias("is_default"))
             .withColumn("position", F.substring("model", 1, 1).cast("int") - 1))
    return metrics.default_model(specs, ["run_id"])


def q_compare_runs(spark, sf):
    c = metrics.compare_runs(_run_scores(spark, sf), "mae")
    return c.select("run_id", "model", "mae", "rk", F.round("d", 4).alias("d"))


def q_best_run(spark, sf):
    return metrics.best_run_per_model(_run_scores(spark, sf), "mae")


def q_list_runs(spark, sf):
    return list_runs(_t(spark, sf, "orders").select(F.year("o_orderdate").alias("run_id")))


def _order_registry(spark, sf):
    """A registry table derived from orders: run = order year, model = priority,
    modified_at = the run's latest order date for that priority."""
    o = _t(spark, sf, "orders")
    return (o.groupBy(F.year("o_orderdate").cast("string").alias("run_id"), F.col("o_orderpriority").alias("model"))
            .agg(F.max("o_orderdate").alias("modified_at"))
            .withColumn("path", F.concat(F.lit("runs/"), F.col("run_id"), F.lit("/"), F.col("model"))))


def q_resolve_model(spark, sf):
    return registry.resolve_model(_order_registry(spark, sf), "1-URGENT", "1990", ["2003", "1998", "1997"])


def q_resolve_latest(spark, sf):
    return registry.resolve_model(_order_registry(spark, sf), "URGENT", "1990", ["1991"])


_TREE_FEATURES = ["o_custkey", "day", "month", "priority"]
_CELL_FEATURES = ["priority", "quarter"]  # twenty cells: trees that split all of them predict cell means


def _order_features(spark, sf):
    o = _t(spark, sf, "orders")
    date = F.col("o_orderdate").cast("date")
    return o.select("o_orderkey", F.col("o_orderdate").alias("acq_date"), "o_custkey", F.datediff(date, F.lit("1992-01-01").cast("date")).cast("double").alias("day"),
                    F.month(date).cast("double").alias("month"), F.quarter(date).cast("double").alias("quarter"),
                    F.substring("o_orderpriority", 1, 1).cast("double").alias("priority"), "o_totalprice")


def _order_train(spark, sf):
    return train_test_split(_order_features(spark, sf), "o_orderkey", 0.25, 1)[0]


def _rounded(scores, *more):
    cols = [F.round(c, d).alias(c) for c, d in (("mae", 4), ("rmse", 4), ("r2", 6)) if c in scores.columns]
    return scores.select("model", "is_default", *cols, *more)


def q_leafwise_tree(spark, sf):
    """Best-first tree of twenty leaves over twenty cells, as predictions per cell."""
    train = _order_train(spark, sf)
    m = fit_model(train, ModelSpec("tree", "DecisionTreeRegressor", {"max_leaf_nodes": 20}), _CELL_FEATURES, "o_totalprice")
    return m.transform(train).groupBy(*_CELL_FEATURES).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("prediction"), 4).alias("prediction"))


def q_tree_importance(spark, sf):
    m = fit_model(_order_train(spark, sf), ModelSpec("decision_tree", "DecisionTreeRegressor", {"max_leaf_nodes": 200}),
                  _TREE_FEATURES, "o_totalprice")
    return feature_importance(m, _TREE_FEATURES)


def _cell_specs():
    return [ModelSpec("linear_regression", "LinearRegression"),
            ModelSpec("decision_tree", "DecisionTreeRegressor", {"max_leaf_nodes": 200}, is_default=True),
            ModelSpec("random_forest", "RandomForestRegressor", {"n_estimators": 5, "max_depth": 10, "random_state": 42}, is_default=True)]


def q_model_scores(spark, sf):
    """Linear model, tree and hashed forest on one split, scored in one aggregate, with default and best flags."""
    train, test = train_test_split(_order_features(spark, sf), "o_orderkey", 0.25, 1)
    fitted = fit_models(train, _cell_specs(), _CELL_FEATURES, "o_totalprice", key_cols=["o_orderkey"])
    scores = evaluate_performance(score_models(test, fitted, _CELL_FEATURES, "o_totalprice"))
    return _rounded(scores, F.round("explained_variance", 6).alias("explained_variance"), "n", "is_best")


def q_forest_scores(spark, sf):
    train, test = train_test_split(_order_features(spark, sf), "o_orderkey", 0.25, 1)
    fitted = fit_models(train, _cell_specs(), _TREE_FEATURES, "o_totalprice", key_cols=["o_orderkey"])
    return evaluate_performance(score_models(test, fitted, _TREE_FEATURES, "o_totalprice"))


def q_contiguous_folds(spark, sf):
    folded = contiguous_fold_column(_t(spark, sf, "orders"), "o_orderkey", 5, 1)
    return folded.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


def q_tune_tree(spark, sf):
    train = contiguous_fold_column(_order_train(spark, sf), "o_orderkey", 5, 1)
    return tune_tree(train, _TREE_FEATURES, "o_totalprice", "fold", max_bins=255)


def q_tune_tree_folds(spark, sf):
    """The same search where every limit allows all cells: held-out errors of cell means, the first limit wins."""
    train = contiguous_fold_column(_order_train(spark, sf), "o_orderkey", 5, 1)
    t = tune_tree(train, _CELL_FEATURES, "o_totalprice", "fold")
    return t.select("max_leaf_nodes", F.round("cv_mae", 4).alias("cv_mae"), "is_best")


def q_workflow(spark, sf):
    """The shipped configuration's cleaning, models and metrics over orders."""
    opts = shipped_options(key_cols=["o_orderkey"], target="o_totalprice", features=_CELL_FEATURES, critical_columns=[*_CELL_FEATURES, "o_totalprice"],
                           outliers={"enabled": True, "column": "o_totalprice", "std_threshold": 3})
    res = run_workflow(spark, _order_features(spark, sf), opts, _scratch(spark, "workflow"), run_id=1)
    return _rounded(res["scores"])


def _order_csv(spark, sf):
    """Orders as CSV whose fields hold missing-value texts, whole numbers with a fraction, and fields that don't parse."""
    o = _t(spark, sf, "orders")
    k = F.col("o_orderkey")
    price = F.when(k % 5 == 0, "NA").when(k % 7 == 0, "oops").when(k % 11 == 0, "1d").otherwise(F.col("o_totalprice").cast("string"))
    cust = F.when(k % 3 == 0, F.concat(F.col("o_custkey").cast("string"), F.lit(".0"))).when(k % 13 == 0, "1.5").otherwise(F.col("o_custkey").cast("string"))
    late = F.when(k % 4 == 0, "n/a").otherwise(F.when(F.month(F.col("o_orderdate").cast("date")) > 6, "True").otherwise("False"))
    said = F.concat(F.col("o_orderpriority"), F.lit(', "'), F.col("o_orderstatus"), F.lit('"'))
    path = _scratch(spark, "orders-csv")
    o.select("o_orderkey", cust.alias("o_custkey"), price.alias("o_totalprice"), late.alias("late"), said.alias("said")).write.option("header", True).option("escape", '"').csv(path)
    return path


def q_csv_round_trip(spark, sf):
    """Orders through CSV and back with inferred types: per column its type, values present and a checksum."""
    o = _t(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 9 != 0, F.col("o_custkey")).alias("o_custkey"), "o_totalprice", "o_orderpriority",
                                       (F.col("o_orderkey") % 2 == 0).alias("even"))
    path = _scratch(spark, "csv-round-trip")
    sinks.write_table(o, path, "csv")
    back = read_detections(spark, path, schema=None)
    types = dict(back.dtypes)
    check = {"o_orderkey": F.sum("o_orderkey"), "o_custkey": F.sum("o_custkey"), "o_totalprice": F.sum("o_totalprice"), "o_orderpriority": F.sum(F.length("o_orderpriority")),
             "even": F.sum(F.col("even").cast("int"))}
    wide = back.agg(*[e for c, x in check.items() for e in (F.count(c).alias(f"n_{c}"), F.round(x.cast("double"), 2).alias(f"s_{c}"))])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(types[c]).alias("type"), F.col(f"n_{c}").alias("n"), F.col(f"s_{c}").alias("total")) for c in check])))


def q_csv_rejects(spark, sf):
    """Fields of a damaged CSV that don't parse as declared, counted by column and reason."""
    schema = "o_orderkey long, o_custkey int, o_totalprice double, late boolean, said string"
    return reject_counts(typed(read_text(spark, _order_csv(spark, sf)), T.StructType.fromDDL(schema)))


def q_csv_stream(spark, sf):
    """The same CSV as a file stream: values are those that batch reads."""
    schema = T.StructType.fromDDL("o_orderkey long, o_custkey int, o_totalprice double, late boolean, said string")
    out = _scratch(spark, "csv-stream")
    q = read_stream(spark, _order_csv(spark, sf), schema, "csv", pattern="*.csv").writeStream.format("parquet").option("checkpointLocation", _scratch(spark, "csv-ckpt"))
    q.trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(schema).parquet(out).select("o_orderkey", "o_custkey", F.round("o_totalprice", 2).alias("o_totalprice"), "late", "said")


def q_stream_score(spark, sf):
    """A linear model over a file stream of orders; rows out of range have no prediction."""
    model = fit_linear(_order_features(spark, sf), _CELL_FEATURES, "o_totalprice")
    stream = read_stream(spark, sf, _t(spark, sf, "orders").schema, pattern="orders.parquet")
    date = F.col("o_orderdate").cast("date")
    feats = stream.select("o_orderkey", F.quarter(date).cast("double").alias("quarter"),
                          F.substring("o_orderpriority", 1, 1).cast("double").alias("priority"))
    scored = score_frame(feats, model, _CELL_FEATURES, {"quarter": (1, 3), "priority": (1, 5)})
    out = _scratch(spark, "stream-out")
    q = start_scoring(scored, out, _scratch(spark, "stream-ckpt"), available_now=True)
    q.awaitTermination()
    return spark.read.parquet(out).select("o_orderkey", "valid", F.round("prediction", 2).alias("prediction"), "intensity", F.round("radius", 2).alias("radius"))


def _published_orders(spark, sf):
    """A folder of runs: 1 published with a model of all orders, 2 started and never published."""
    out = _scratch(spark, "published")
    done = RunLog(spark, out, 1)
    done.start()
    model = fit_linear(_order_features(spark, sf), _CELL_FEATURES, "o_totalprice")
    done.stage("models/linear", None, lambda: {"models/linear": save_model(model, f"{out}/models/run_id=1/linear")})
    done.publish()
    halfway = RunLog(spark, out, 2)
    halfway.start()
    halfway.stage("models/linear", None, lambda: {"models/linear": f"{out}/models/run_id=2/linear"})
    return out


def q_stream_two_way(spark, sf):
    """Orders streamed through the published model: rows accepted and rejected, counts by broken rule."""
    stream = read_stream(spark, sf, _t(spark, sf, "orders").schema, pattern="orders.parquet")
    date = F.col("o_orderdate").cast("date")
    feats = stream.select("o_orderkey", F.quarter(date).cast("double").alias("quarter"), F.substring("o_orderpriority", 1, 1).cast("double").alias("priority"))
    out = _scratch(spark, "two-way")
    start_two_way(feats, published_model(_published_orders(spark, sf), "linear"), _CELL_FEATURES, {"quarter": (1, 3), "priority": (2, 5)},
                  out, _scratch(spark, "two-way-ckpt"), available_now=True).awaitTermination()
    means = read_two_way(spark, out, True).groupBy(F.lit("accepted").alias("kind"), F.col("model_run")).agg(F.round(F.avg("prediction"), 4).alias("prediction"))
    return batch_counts(spark, out).groupBy("kind", "name").agg(F.sum("n").alias("n")).join(means, "kind", "left").select("kind", "name", "n", "model_run", "prediction")


def q_published_runs(spark, sf):
    """A run for each year of orders, published only where the year is even: runs and models that show."""
    years = [r["y"] for r in _t(spark, sf, "orders").select(F.year(F.col("o_orderdate").cast("date")).alias("y")).distinct().orderBy("y").collect()]  # one a year
    out = _scratch(spark, "yearly")
    for y in years:
        run = RunLog(spark, out, y)
        run.start()
        run.stage("models/mean", None, lambda y=y: {"models/mean": f"models/{y}"})
        if y % 2 == 0:
            run.publish()
    newest = F.col("run_id") == F.max("run_id").over(Window.partitionBy(F.lit(0)))  # one row a run
    return list_runs(published_runs(spark, out)).join(published_models(spark, out), "run_id").select("run_id", "model", "path", newest.alias("latest"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "drop_missing": q_drop_missing,
    "null_audit": q_null_audit,
    "filter_region": q_filter_region,
    "filter_outliers": q_filter_outliers,
    "clean_detections": q_clean_detections,
    "create_dataset": q_create_dataset,
    "ratio_diff": q_ratio_diff,
    "log_transform": q_log_transform,
    "minmax": q_minmax,
    "zscore": q_zscore,
    "date_from_doy": q_date_from_doy,
    "date_from_text": q_date_from_text,
    "intensity_band": q_intensity_band,
    "range_check": q_range_check,
    "range_flags": q_range_flags,
    "filter_dates": q_filter_dates,
    "column_stats": q_column_stats,
    "describe": q_describe,
    "quantile_levels": q_quantile_levels,
    "correlations": q_correlations,
    "lower_triangle": q_lower_triangle,
    "top_correlates": q_top_correlates,
    "wide_correlations": q_wide_correlations,
    "group_correlations": q_group_correlations,
    "linear_by_year": q_linear_by_year,
    "linear_leave_fold_out": q_linear_leave_fold_out,
    "histogram": q_histogram,
    "histogram_events": q_histogram_events,
    "numeric_histograms": q_numeric_histograms,
    "density_curve": q_density_curve,
    "scatter_density": q_scatter_density,
    "scatter_sample": q_scatter_sample,
    "stored_quantiles": q_stored_quantiles,
    "daily_from_states": q_daily_from_states,
    "daily_summary": q_daily_summary,
    "exact_split": q_exact_split,
    "linear_fit": q_linear_fit,
    "model_metrics": q_model_metrics,
    "train_test_r2": q_train_test_r2,
    "best_model": q_best_model,
    "improvement_pct": q_improvement_pct,
    "model_comparison": q_model_comparison,
    "prediction_bounds": q_prediction_bounds,
    "predictions_vs_actual": q_predictions_vs_actual,
    "residuals": q_residuals,
    "default_model": q_default_model,
    "compare_runs": q_compare_runs,
    "best_run": q_best_run,
    "list_runs": q_list_runs,
    "preview": q_preview,
    "resolve_model": q_resolve_model,
    "resolve_latest": q_resolve_latest,
    "leafwise_tree": q_leafwise_tree,
    "tree_importance": q_tree_importance,
    "model_scores": q_model_scores,
    "forest_scores": q_forest_scores,
    "contiguous_folds": q_contiguous_folds,
    "tune_tree": q_tune_tree,
    "tune_tree_folds": q_tune_tree_folds,
    "workflow": q_workflow,
    "csv_round_trip": q_csv_round_trip,
    "csv_rejects": q_csv_rejects,
    "csv_stream": q_csv_stream,
    "stream_score": q_stream_score,
    "stream_two_way": q_stream_two_way,
    "published_runs": q_published_runs,
}
