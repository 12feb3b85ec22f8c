"""Writers and previews."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "error",
                partition_by: Sequence[str] = ()) -> str:
    """Parquet (default) or CSV with a header; never overwrites unless asked."""
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)
    return path


def scores_table(scores: DataFrame, metrics: Sequence[str] = ("mae", "rmse", "r2", "explained_variance")) -> DataFrame:
    """One row per model: model, is_default and the metrics present, in model order."""
    cols = [m for m in metrics if m in scores.columns]
    keep = [c for c in ("run_id",) if c in scores.columns]
    return scores.orderBy(*keep, "position").select(*keep, "model", "is_default", *cols)


def write_metrics_report(evaluated: DataFrame, path: str, mode: str = "error") -> str:
    """Per-model metrics with default and best flags as JSON lines."""
    evaluated.write.mode(mode).json(path)
    return path


def write_run(df: DataFrame, root: str, run_id: int, fmt: str = "parquet") -> str:
    """Append ``df`` under ``<root>/run_id=<run_id>/``, replacing only that run's partition."""
    # per-write option (not the session conf): safe when several runs write at once
    (df.withColumn("run_id", F.lit(int(run_id)).cast("bigint"))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .format(fmt).partitionBy("run_id").save(root))
    return f"{root.rstrip('/')}/run_id={int(run_id)}"


def preview(df: DataFrame, order_by: Sequence[str], n: int = 5) -> DataFrame:
    """First ``n`` rows under an explicit total order (Spark has no implicit row order)."""
    return df.orderBy(*order_by).limit(n)


def shape(df: DataFrame) -> tuple[int, int]:
    """(rows, columns)."""
    return df.count(), len(df.columns)
