"""Stateless streaming scoring of arriving detections.

readStream (files or any streaming source) -> range check (P21) -> model
(M9) -> intensity band and radius (P18/P19) -> writeStream.  Rows that break a
range rule are kept with a NULL prediction and their ``violations``.  The
stream holds no state, so it scales with the input partitions; the sink is
exactly-once through the checkpoint location.  ``start_two_way`` keeps accepted
and rejected rows apart, counts what was broken, and takes the model of each
micro-batch from the published runs.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from kindling.models.scoring import with_intensity
from kindling.models.specs import load_model
from kindling.operators.clean import nullify_nan, range_check, require_features
from kindling.sources.registry import resolve_model
from kindling.sources.runlog import published_models
from kindling.sources.text import text_stream, typed


def score_frame(df: DataFrame, model: PipelineModel, features: Sequence[str],
                bounds: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Batch or streaming, one pass over the input (no self-union, so a stream's
    source is read once per micro-batch).

    Rows that break a range rule (or miss a feature) keep their values and get
    a NULL prediction: the model sees neutral zeros for them, and its output is
    masked afterwards.
    """
    require_features(df, features)
    checked = range_check(df, {c: b for c, b in bounds.items() if c in df.columns})
    ok = F.col("valid")
    for f in features:
        ok = ok & F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double"))
    checked = checked.withColumn("__ok", ok)
    hidden = {f: f"__orig_{f}" for f in features}
    staged = checked.withColumnsRenamed(hidden).withColumns(
        {f: F.when(F.col("__ok"), F.col(h).cast("double")).otherwise(F.lit(0.0)) for f, h in hidden.items()})
    scored = model.transform(staged).drop("features", *features).withColumnsRenamed(
        {h: f for f, h in hidden.items()})
    scored = scored.withColumn("prediction", F.when(F.col("__ok"), F.col("prediction"))).drop("__ok")
    return with_intensity(scored)


def score_points(spark: SparkSession, model: PipelineModel, points: Sequence[Mapping], features: Sequence[str],
                 bounds: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Score a few user-entered points (the form of the reference's app) through
    the same plan as batch and stream scoring.  Missing features raise."""
    missing = sorted({f for p in points for f in features if f not in p})
    if missing:
        raise ValueError(f"Missing features: {missing}")
    schema = T.StructType([T.StructField(f, T.DoubleType()) for f in features])
    rows = [tuple(None if p[f] is None else float(p[f]) for f in features) for p in points]
    return score_frame(spark.createDataFrame(rows, schema), model, features, bounds)


def read_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
                max_files_per_trigger: int | None = None, pattern: str | None = None,
                recursive: bool = False) -> DataFrame:
    """A file stream over the folder ``path`` (new files become micro-batches).

    A stream needs its schema up front.  CSV goes through the batch reader's rules
    (``kindling.sources.text``): the header of every file is checked against the
    schema's names, so a file with other or reordered columns fails loudly, and
    fields are typed as in batch, with what doesn't parse in ``_rejects``.
    """
    if fmt == "csv":
        return nullify_nan(typed(text_stream(spark, path, schema.names, pattern, recursive, max_files_per_trigger), schema))
    r = spark.readStream.format(fmt).schema(schema)
    if recursive:
        r = r.option("recursiveFileLookup", True)
    if pattern:
        r = r.option("pathGlobFilter", pattern)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


def start_scoring(scored: DataFrame, sink: str, checkpoint: str, fmt: str = "parquet",
                  available_now: bool = False, processing_time: str | None = None) -> StreamingQuery:
    w = scored.writeStream.format(fmt).option("checkpointLocation", checkpoint).outputMode("append")
    if available_now:
        w = w.trigger(availableNow=True)
    elif processing_time:
        w = w.trigger(processingTime=processing_time)
    return w.start(sink)


def published_model(out: str, model: str, run_id: str | None = None, fallbacks: Sequence[str] = ()) -> Callable[[SparkSession], tuple[str, str]]:
    """S12 for a stream: asked at each micro-batch, gives (run id, path) of ``model`` among the published runs of ``out``."""
    def ask(spark: SparkSession) -> tuple[str, str]:
        hit = resolve_model(published_models(spark, out), model, run_id, fallbacks).first()
        if hit is None:
            raise ValueError(f"no published model like {model!r} under {out}")
        return hit["run_id"], hit["path"]
    return ask


#: Columns that the two-way sink adds; a stream must not have them.
TWO_WAY = ("accepted", "batch_id", "model_run")


def start_two_way(stream: DataFrame, model_of: Callable[[SparkSession], tuple[str, str]], features: Sequence[str],
                  bounds: Mapping[str, tuple[float, float]], out: str, checkpoint: str,
                  available_now: bool = False, processing_time: str | None = None) -> StreamingQuery:
    """Score a stream into accepted rows (with a prediction) and rejected ones, with counts by broken rule.

    A micro-batch is written once, to ``<out>/rows/batch_id=<id>/accepted=<bool>/``, replacing
    what an earlier attempt at the batch left; its counts, from the written rows, come last and
    make it visible to ``read_two_way`` and ``batch_counts``.  So a killed and restarted stream
    leaves what one without a fault does, row by row.  All rows of a batch get the same model,
    the one published when the batch (or its last attempt) ran.  A feature that is missing counts
    under its name like a broken rule.  ``out`` belongs to one checkpoint.
    """
    clash = sorted({c.lower() for c in stream.columns} & {*TWO_WAY, "valid", "violations"})
    if clash:
        raise ValueError(f"the sink adds columns of these names: {clash}")
    loaded: dict[str, object] = {}

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        run, path = model_of(spark)
        if path not in loaded:
            loaded.clear()
            loaded[path] = load_model(path)
        scored = score_frame(batch, loaded[path], features, bounds)
        missing = [F.when(F.coalesce(F.isnan(F.col(f).cast("double")), F.lit(True)), F.lit(f)) for f in features]
        broken = F.array_union("violations", F.filter(F.array(*missing), lambda x: x.isNotNull()))
        marked = scored.withColumns({"violations": broken, "model_run": F.lit(run), "accepted": F.col("prediction").isNotNull()})
        rows_at = f"{out}/rows/batch_id={batch_id}"
        marked.write.mode("overwrite").partitionBy("accepted").parquet(rows_at)
        rows = spark.read.schema(marked.schema).parquet(rows_at)
        # (kind, name) of each row's counts: one aggregate over two columns
        marks = F.array_union(F.array(F.struct(F.when(F.col("accepted"), "accepted").otherwise("rejected").alias("kind"), F.lit("rows").alias("name"))),
                              F.transform("violations", lambda v: F.struct(F.lit("violation").alias("kind"), v.alias("name"))))
        counts = rows.select(F.inline(marks)).groupBy("kind", "name").agg(F.count(F.lit(1)).alias("n"))
        counts.coalesce(1).write.mode("overwrite").parquet(f"{out}/counts/batch_id={batch_id}")

    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if available_now:
        w = w.trigger(availableNow=True)
    elif processing_time:
        w = w.trigger(processingTime=processing_time)
    return w.start()


def batch_counts(spark: SparkSession, out: str) -> DataFrame:
    """Counts of all finished batches: batch_id, kind (accepted, rejected, violation), name, n."""
    return spark.read.schema("kind string, name string, n long, batch_id long").parquet(f"{out}/counts")


def read_two_way(spark: SparkSession, out: str, accepted: bool) -> DataFrame:
    """The accepted or the rejected rows of all finished batches."""
    done = batch_counts(spark, out).select("batch_id").distinct()
    rows = spark.read.parquet(f"{out}/rows").where(F.col("accepted") == accepted)
    return rows.withColumn("batch_id", F.col("batch_id").cast("long")).join(done, "batch_id", "left_semi")
