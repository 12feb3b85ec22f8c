"""Plan-shape guards: the scale properties the operators are built for."""

import pytest

from __spark_entry__ import queries

from .conftest import SF_SMALL

# queries whose plans are pure DataFrame work (no ML fit / stream / workflow side effects)
PLAN_QUERIES = ["drop_missing", "null_audit", "filter_region", "filter_outliers", "create_dataset", "ratio_diff",
                "log_transform", "minmax", "zscore", "date_from_doy", "intensity_band", "range_check", "range_flags",
                "filter_dates", "column_stats", "correlations", "lower_triangle", "top_correlates", "histogram",
                "histogram_events", "numeric_histograms", "density_curve", "scatter_density", "compare_runs",
                "best_run", "list_runs", "exact_split", "clean_detections", "date_from_text", "preview",
                "resolve_model", "resolve_latest", "default_model", "describe", "daily_summary"]


@pytest.fixture(autouse=True)
def _full_metadata(spark):
    old = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    yield
    spark.conf.set("spark.sql.maxMetadataStringLength", old)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", PLAN_QUERIES)
def test_no_cartesian_or_nested_loop_join(spark, name):
    plan = _plan(queries()[name](spark, SF_SMALL))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name,pushed", [
    ("filter_region", ["GreaterThanOrEqual(l_quantity,10.0)", "LessThanOrEqual(l_discount,0.05)"]),
    ("create_dataset", ["GreaterThanOrEqual(l_quantity,5.0)", "LessThanOrEqual(l_discount,0.09)",
                        "IsNotNull(l_quantity)"]),
    ("filter_dates", ["IsNotNull(l_shipdate)"]),
])
def test_filters_reach_the_scan(spark, name, pushed):
    plan = _plan(queries()[name](spark, SF_SMALL))
    for p in pushed:
        assert p in plan, (p, plan)


def test_drop_missing_pushes_is_not_null(spark):
    from kindling.operators.clean import drop_missing
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    plan = _plan(drop_missing(li, ["l_discount", "l_returnflag"]).select("l_orderkey"))
    assert "IsNotNull(l_discount)" in plan and "IsNotNull(l_returnflag)" in plan


@pytest.mark.parametrize("name,cols", [
    ("filter_region", {"l_quantity", "l_extendedprice", "l_discount"}),
    ("log_transform", {"l_orderkey", "l_partkey", "l_extendedprice"}),
    ("exact_split", {"o_orderkey"}),
])
def test_scans_read_only_needed_columns(spark, name, cols):
    import re
    plan = _plan(queries()[name](spark, SF_SMALL))
    for schema in re.findall(r"ReadSchema: struct<([^>]*)>", plan):
        read = {f.split(":")[0] for f in schema.split(",")}
        assert read <= cols, (read, cols)


def test_split_does_not_shuffle_the_data(spark):
    from kindling.operators.split import train_test_split
    o = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    train, test = train_test_split(o, "o_orderkey", 0.25, 1)
    for df in (train, test):
        plan = _plan(df)
        assert "Exchange" not in plan and "Sort" not in plan and "Window" not in plan


def test_scoring_scans_test_rows_once(spark):
    plan = _plan(queries()["forest_scores"](spark, SF_SMALL))
    assert plan.count("FileScan parquet") == 1


def test_few_group_bounds_are_not_shuffle_joined(spark):
    """Per-model bounds (a handful of groups) must not be joined by shuffle, which
    would send each model's rows to one task: they are attached by lookup."""
    plan = _plan(queries()["predictions_vs_actual"](spark, SF_SMALL))
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan and "NestedLoopJoin" not in plan


@pytest.mark.parametrize("name", PLAN_QUERIES)
def test_no_python_udfs(spark, name):
    plan = _plan(queries()[name](spark, SF_SMALL))
    assert "EvalPython" not in plan and "PythonUDF" not in plan


@pytest.mark.parametrize("name", ["filter_region", "ratio_diff", "histogram", "describe", "exact_split"])
def test_whole_stage_codegen_in_final_plan(spark, name):
    df = queries()[name](spark, SF_SMALL)
    df.collect()                                   # AQE's final plan exists after execution
    final = df._jdf.queryExecution().executedPlan().toString()
    assert "*(" in final or "WholeStageCodegen" in final, final
