"""Cut lineage by writing a (small) intermediate table to the shared checkpoint folder.

Read-back tables carry file statistics, so the planner sees their real size
(e.g. when deciding whether a side may be broadcast).  Nothing is kept on a
machine-local disk: the folder is the cluster's ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from kindling.session import ensure_checkpoint_dir


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    spark = df.sparkSession
    root = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{root}/kindling/{label}-{uuid.uuid4().hex}"
    df.write.mode("error").parquet(path)
    return spark.read.parquet(path)


#: A written side is broadcast up to this many bytes of values, which are measured.
BROADCAST_MAX_BYTES = 32 << 20


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Broadcast hint for a written table whose measured size is within ``limit``; above
    it the planner keeps a shuffle join."""
    from pyspark.sql import functions as F

    width = sum([F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c, t in df.dtypes if t in ("string", "binary")], F.lit(16 * len(df.columns)))
    size = df.agg(F.sum(width.cast("long")).alias("size")).first()["size"]
    return F.broadcast(df) if (size or 0) <= limit else df


def run_concurrently(tasks: dict, max_workers: int = 4) -> dict:
    """Submit independent Spark actions from driver threads (Spark schedules
    concurrent jobs); returns {name: result}; the first failure is raised."""
    from concurrent.futures import ThreadPoolExecutor

    if max_workers <= 1 or len(tasks) <= 1:
        return {k: fn() for k, fn in tasks.items()}
    with ThreadPoolExecutor(max_workers=max_workers) as pool:
        futures = {k: pool.submit(fn) for k, fn in tasks.items()}
        return {k: f.result() for k, f in futures.items()}
