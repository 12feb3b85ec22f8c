"""Run and model registry.

The registry is a table of (run_id, model, path, modified_at) rows, e.g. built
from a ``binaryFile`` listing or written by the workflow.  Lookups are
aggregates over it, not loops over listings.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindling.models.specs import load_model, save_model  # noqa: F401  (S10)

LATEST = "latest"


def list_runs(runs: DataFrame, col: str = "run_id") -> DataFrame:
    """Distinct run ids, without 'latest', newest first (compared as text)."""
    rid = F.col(col).cast("string")
    return runs.select(rid.alias("run_id")).where(rid != LATEST).distinct().orderBy(F.col("run_id").desc())


def model_listing(spark: SparkSession, root: str) -> DataFrame:
    """Registry rows from saved models laid out as ``<root>/run_id=<r>/<model>/metadata/part-*``."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
             .option("pathGlobFilter", "part-*").load(root).select("path", "modificationTime"))
    pat = r"^(.*/run_id=([^/]+)/([^/]+))/metadata/part-[^/]*$"
    return (files.where(F.col("path").rlike(pat))
            .select(F.regexp_extract("path", pat, 2).alias("run_id"),
                    F.regexp_extract("path", pat, 3).alias("model"),
                    F.regexp_extract("path", pat, 1).alias("path"),
                    F.col("modificationTime").alias("modified_at"))
            .groupBy("run_id", "model", "path").agg(F.max("modified_at").alias("modified_at")))


def resolve_model(registry: DataFrame, model: str, run_id: str | None, fallbacks: Sequence[str] = ()) -> DataFrame:
    """One row (run_id, model, path, rule) for ``model``.

    The selected run first, then the fallback runs in the given order; failing
    those, the most recently modified entry whose model name contains ``model``
    (the later run id wins a tie).
    """
    order = [r for r in [run_id, *fallbacks] if r is not None]
    prio = F.array_position(F.array(*[F.lit(str(r)) for r in order]), F.col("run_id").cast("string")) if order \
        else F.lit(0)
    exact = registry.where((F.col("model") == model) & (prio > 0))
    by_prio = exact.agg(F.min_by(F.struct("run_id", "model", "path"), prio).alias("hit"))
    latest = registry.where(F.col("model").contains(model)).agg(
        F.max_by(F.struct("run_id", "model", "path"), F.struct("modified_at", "run_id")).alias("hit"))
    picked = by_prio.select("hit", F.lit("priority").alias("rule"), F.lit(0).alias("o")).unionByName(
        latest.select("hit", F.lit("most_recent").alias("rule"), F.lit(1).alias("o")))
    return (picked.where(F.col("hit").isNotNull()).orderBy("o").limit(1)
            .select(F.col("hit.run_id").cast("string").alias("run_id"), "hit.model", "hit.path", "rule"))
