"""kindling: Spark-native detection analytics.

DataFrame -> DataFrame operators for cleaning, exploring and modelling flat
numeric tables (satellite fire detections or any table of the same shape),
Spark ML regressors, one-pass regression metrics, a run registry and batch or
streaming scoring.  Every operator takes column names as arguments.

The names below are the public API; the submodules hold the details.
"""

__version__ = "0.1.0"

from kindling.models.scoring import score_batch, score_models, train_and_test_r2, with_intensity  # noqa: E402
from kindling.models.specs import (  # noqa: E402
    ModelSpec,
    coefficients,
    feature_importance,
    fit_forest,
    fit_linear,
    fit_model,
    fit_models,
    fit_tree,
    load_model,
    save_model,
    tune_tree,
)
from kindling.operators.clean import (  # noqa: E402
    clean_detections,
    coerce_date,
    create_dataset,
    drop_missing,
    ensure_acq_date,
    filter_dates,
    filter_outliers,
    filter_region,
    null_audit,
    nullify_nan,
    range_check,
    range_violation_counts,
    require_features,
    require_target,
)
from kindling.operators.explore import (  # noqa: E402
    column_stats,
    correlation_matrix,
    daily_summary,
    density_curve,
    describe,
    histogram,
    lower_triangle,
    scatter_density,
    scatter_density_many,
    scatter_sample,
    top_correlates,
)
from kindling.operators.features import (  # noqa: E402
    frp_per_area,
    generate_features,
    log_transform,
    normalize,
    numeric_columns,
    select_base_features,
    select_numeric,
    temperature_diff,
)
from kindling.operators.metrics import (  # noqa: E402
    best_model,
    best_run_per_model,
    compare_runs,
    default_model,
    improvement_pct,
    model_comparison,
    prediction_bounds,
    predictions_vs_actual,
    regression_metrics,
    residuals,
)
from kindling.operators.quantiles import describe_states, merge_states, quantile_states  # noqa: E402
from kindling.operators.selection import exact_quantiles  # noqa: E402
from kindling.operators.split import fold_column, split_column, train_test_split  # noqa: E402
from kindling.plans.eda import eda_tables  # noqa: E402
from kindling.plans.workflow import (  # noqa: E402
    WorkflowOptions,
    evaluate_performance,
    performance_summaries,
    run_workflow,
    shipped_options,
)
from kindling.sources.readers import read_detections, read_first_available, synthetic_detections  # noqa: E402
from kindling.sources.registry import list_runs, model_listing, resolve_model  # noqa: E402
from kindling.sources.runlog import RunLog, published_models, published_runs  # noqa: E402
from kindling.sources.sinks import preview, scores_table, shape, write_metrics_report, write_run, write_table  # noqa: E402
from kindling.streaming.scoring import (  # noqa: E402
    batch_counts,
    published_model,
    read_stream,
    read_two_way,
    score_frame,
    score_points,
    start_scoring,
    start_two_way,
)
