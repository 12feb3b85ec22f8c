"""Run publication (S9, S11, S12) and finished stages.

A run's history is a set of events, each a one-row JSON file in a folder of its own that
is never rewritten, so an event is there whole or not at all, on object stores too, and
writers of different runs never meet.  The last event decides:

* ``<out>/runs/run_id=<id>/<seq>``: ``started`` or ``published`` with the paths of the
  run's tables and models.  A run is visible only while its last event is ``published``,
  so one that was killed halfway, or is being written anew, isn't; the latest run is the
  newest visible one, and changes in the moment its event appears.
* ``<out>/log/run_id=<id>/<seq>``: ``finished`` or ``reopened`` stages, with the
  fingerprint of all they depend on.

Two writers of the same run collide on an event's folder, and the second fails.
"""

from __future__ import annotations

import datetime
import hashlib
import json
import threading
from collections.abc import Callable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT = (T.StructType().add("run_id", T.LongType()).add("seq", T.LongType()).add("stage", T.StringType()).add("state", T.StringType())
         .add("fingerprint", T.StringType()).add("paths", T.MapType(T.StringType(), T.StringType())).add("at", T.TimestampType()))
RUN = "run"


def fingerprint(*parts) -> str:
    """Digest of values that JSON can hold (others by their text)."""
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()


def content_fingerprint(df: DataFrame) -> str:
    """Digest of a table's columns and rows, whatever their order and partitioning: one aggregate, no shuffle of rows."""
    cells = [F.to_json(c) if "map<" in t else F.col(c) for c, t in df.dtypes]
    total = F.sum(F.xxhash64(*cells).cast("decimal(20,0)")) if cells else F.lit(None)
    row = df.agg(F.count(F.lit(1)).alias("n"), total.cast("string").alias("total")).first()
    return fingerprint(df.dtypes, row["n"], row["total"])


def _events(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(EVENT).option("recursiveFileLookup", True).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], EVENT)


def _last(events: DataFrame, *key: str) -> DataFrame:
    return events.groupBy(*key).agg(F.max_by(F.struct(*EVENT.names), "seq").alias("e")).select("e.*")


def published_runs(spark: SparkSession, out: str) -> DataFrame:
    """Visible runs: run_id, published_at, paths (name -> path of its tables and models)."""
    last = _last(_events(spark, f"{out.rstrip('/')}/runs"), "run_id")
    return last.where(F.col("state") == "published").select("run_id", F.col("at").alias("published_at"), "paths")


def published_models(spark: SparkSession, out: str) -> DataFrame:
    """The model registry of visible runs, in the form that ``resolve_model`` reads."""
    each = published_runs(spark, out).select("run_id", "published_at", F.explode("paths").alias("name", "path"))
    return each.where(F.col("name").startswith("models/")).select(
        F.col("run_id").cast("string").alias("run_id"), F.substring("name", len("models/") + 1, 1 << 20).alias("model"), "path",
        F.col("published_at").alias("modified_at"))


class RunLog:
    """The events of one run, written by one driver."""

    def __init__(self, spark: SparkSession, out: str, run_id: int):
        self.spark, self.out, self.run_id, self.lock = spark, out.rstrip("/"), int(run_id), threading.Lock()
        self.folder = {kind: f"{self.out}/{kind}/run_id={self.run_id}" for kind in ("runs", "log")}
        past = {kind: _last(_events(spark, path), "stage").collect() for kind, path in self.folder.items()}  # one row a stage
        self.seq = {kind: max((r["seq"] for r in rows), default=0) for kind, rows in past.items()}
        self.stages = {r["stage"]: r for r in past["log"] if r["state"] == "finished"}
        self.paths: dict[str, str] = {}
        self.reused: list[str] = []

    def _append(self, kind: str, stage: str, state: str, mark: str | None, paths: Mapping[str, str]) -> None:
        with self.lock:
            self.seq[kind] += 1
            seq = self.seq[kind]
        at = datetime.datetime.now(datetime.timezone.utc)
        row = self.spark.createDataFrame([(self.run_id, seq, stage, state, mark, dict(paths), at)], EVENT)
        row.coalesce(1).write.mode("error").json(f"{self.folder[kind]}/{seq:06d}")

    def start(self) -> None:
        """The run isn't visible from now on."""
        self._append("runs", RUN, "started", None, {})

    def finished(self, name: str, mark: str | None) -> bool:
        known = self.stages.get(name)
        return known is not None and mark is not None and known["fingerprint"] == mark

    def stage(self, name: str, mark: str | None, build: Callable[[], Mapping[str, str]]) -> dict[str, str]:
        """The paths of a stage: those on record if it finished under the same fingerprint, else what ``build`` writes.

        A stage that is built anew is taken off the record first, so tables halfway
        overwritten are never taken for finished.  ``mark=None`` always builds.
        """
        known = self.stages.get(name)
        if self.finished(name, mark):
            paths = dict(known["paths"])
            self.reused.append(name)
        else:
            if known:
                self._append("log", name, "reopened", None, {})
            paths = dict(build())
            if mark is not None:
                self._append("log", name, "finished", mark, paths)
        with self.lock:
            self.paths |= paths
        return paths

    def publish(self) -> None:
        """The run is visible, with all paths its stages gave."""
        self._append("runs", RUN, "published", None, self.paths)
