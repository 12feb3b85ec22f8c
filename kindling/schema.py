"""Detection schema, feature lists and the fixed values the results depend on."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's for equal results)
# ---------------------------------------------------------------------------
# Training features, in training order.
FEATURES = ["latitude", "longitude", "scan", "track", "bright_t31", "frp", "confidence"]
# Default regression target.
TARGET = "brightness"
# Critical columns of the fixed cleaning preset.
CRITICAL_COLUMNS = ["latitude", "longitude", "brightness", "scan", "track"]
# Critical columns of the shipped workflow configuration.
WORKFLOW_CRITICAL_COLUMNS = ["latitude", "longitude", "brightness", "scan", "track", "frp", "confidence"]
# Models of the shipped workflow configuration: (name, type, hyperparameters, is_default).
SHIPPED_MODELS = [
    ("linear_regression", "LinearRegression", {}, False),
    ("decision_tree", "DecisionTreeRegressor", {"max_leaf_nodes": 200, "random_state": 1}, True),
    ("random_forest", "RandomForestRegressor", {"n_estimators": 5, "max_depth": 10, "random_state": 42}, True),
]
# Metrics of the shipped configuration.
SHIPPED_METRICS = ["mae", "rmse", "r2"]
# Default bounding box (Australia), inclusive: min_lat, max_lat, min_lon, max_lon.
AUSTRALIA = (-44.0, -10.0, 112.0, 154.0)
# Outlier rule of the cleaning preset: strictly inside mean +- 3 sample std.
OUTLIER_SIGMA = 3.0
# Intensity bands of a predicted brightness: > 400 High/red, > 350 Moderate/orange, else Low/blue.
BAND_HIGH = 400.0
BAND_MODERATE = 350.0
BANDS = [("High", "red"), ("Moderate", "orange"), ("Low", "blue")]
# Texts that a CSV field may hold for a missing value (the empty field is one).
MISSING_TEXTS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A",
                 "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
# Texts of true and false.
TRUE_TEXTS, FALSE_TEXTS = ["True", "TRUE", "true"], ["False", "FALSE", "false"]
# Map circle radius = prediction * 50.
RADIUS_SCALE = 50.0
# Histogram bins of the EDA stage.
HIST_BINS = 30
# Top correlates with the target.
TOP_CORRELATES = 5
# Synthetic-data date window and seed.
SYNTHETIC_START = "2019-10-01"
SYNTHETIC_END = "2020-01-11"
SYNTHETIC_SEED = 42
# Tree tuning: candidate max_leaf_nodes, folds, seed.
LEAF_GRID = [5000, 10000, 15000, 20000, 25000, 30000, 50000]
CV_FOLDS = 5
TREE_SEED = 1
# Split defaults of the shipped configuration.
TEST_SIZE = 0.25
SPLIT_SEED = 1
# Input ranges of the scoring form (column: (low, high), inclusive).
FORM_RANGES = {
    "latitude": (-90.0, 90.0),
    "longitude": (-180.0, 180.0),
    "scan": (0.1, 5.0),
    "track": (0.1, 5.0),
    "bright_t31": (200.0, 400.0),
    "confidence": (0.0, 100.0),
    "frp": (0.0, 200.0),
}
# Ranges of the synthetic generator (column: (low, high), high exclusive).
SYNTHETIC_RANGES = {
    "latitude": (-44.0, -10.0),
    "longitude": (112.0, 154.0),
    "brightness": (300.0, 500.0),
    "scan": (0.5, 2.0),
    "track": (0.5, 2.0),
    "bright_t31": (250.0, 350.0),
    "frp": (5.0, 100.0),
}
SYNTHETIC_CONFIDENCE = (0, 100)  # integers, high exclusive
# ---------------------------------------------------------------------------

DETECTION_SCHEMA = T.StructType([
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
    T.StructField("brightness", T.DoubleType()),
    T.StructField("scan", T.DoubleType()),
    T.StructField("track", T.DoubleType()),
    T.StructField("acq_date", T.StringType()),
    T.StructField("acq_time", T.IntegerType()),
    T.StructField("satellite", T.StringType()),
    T.StructField("instrument", T.StringType()),
    T.StructField("confidence", T.IntegerType()),
    T.StructField("version", T.StringType()),
    T.StructField("bright_t31", T.DoubleType()),
    T.StructField("frp", T.DoubleType()),
    T.StructField("daynight", T.StringType()),
])


def require_columns(df, cols, exc=KeyError):
    """Raise ``exc`` naming every column of ``cols`` absent from ``df``."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise exc(f"missing columns: {missing}")
