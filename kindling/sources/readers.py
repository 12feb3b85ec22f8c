"""Readers (S1-S5).

CSV is read as text and typed by ``kindling.sources.text``, whose rules batch and
stream share: declared types are bound by header name, missing-value texts are
NULL, and so is what can't be read as its type.  Object-store paths (``s3a://``, ``abfss://``, ``gs://``) go through the
same reader: there is no download step.
"""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindling.functions.columns import hash_uniform
from kindling.operators.clean import nullify_nan
from kindling.schema import (
    DETECTION_SCHEMA,
    SYNTHETIC_CONFIDENCE,
    SYNTHETIC_END,
    SYNTHETIC_RANGES,
    SYNTHETIC_SEED,
    SYNTHETIC_START,
)
from kindling.sources.text import REJECTS, header_of, infer_types, read_text, typed

log = logging.getLogger(__name__)


def read_detections(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | None = DETECTION_SCHEMA,
                    fmt: str = "csv", pattern: str | None = None, recursive: bool = False,
                    nan_to_null: bool | None = None) -> DataFrame:
    """Read detections from files or an object store.

    CSV: header names bind the declared types (unparseable values -> NULL, columns
    absent from the file stay absent, others stay text; ``schema=None`` infers
    types from the data in one pass); other formats use ``schema`` as given.
    ``kindling.sources.text.read_text`` keeps what was rejected.

    ``pattern`` (e.g. ``"fire_nrt*.csv"``) keeps matching file names;
    ``recursive`` descends into sub-folders.  All matches are read (not "the
    first one", whose choice would depend on listing order).  ``nan_to_null``
    (default: on for text formats) turns ``NaN`` text into NULL at the source;
    for columnar sources it stays off so filters reach the scan — every
    operator treats NaN as missing itself.
    """
    if fmt == "csv":
        raw = read_text(spark, path, pattern, recursive)
        df = typed(raw, schema if schema is not None else infer_types(raw)).drop(REJECTS)
    else:
        reader = spark.read.format(fmt)
        if schema is not None:
            reader = reader.schema(schema)
        if pattern:
            reader = reader.option("pathGlobFilter", pattern)
        if recursive:
            reader = reader.option("recursiveFileLookup", True)
        df = reader.load(path if isinstance(path, str) else list(path))
    if nan_to_null is None:
        nan_to_null = fmt in ("csv", "json", "text")
    return nullify_nan(df) if nan_to_null else df


def header_schema(spark: SparkSession, path: str, declared: T.StructType = DETECTION_SCHEMA) -> T.StructType:
    """Schema for CSV files under ``path`` in their header's column order, with
    the declared types bound by name (other columns as text).  Used to start a
    CSV stream, which needs its schema before any micro-batch is read."""
    types = {f.name: f.dataType for f in declared.fields}
    return T.StructType([T.StructField(c, types.get(c, T.StringType())) for c in header_of(spark, path)])


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A Parquet table ``<root>/<name>.parquet``."""
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")


def synthetic_detections(spark: SparkSession, n: int, seed: int = SYNTHETIC_SEED,
                         num_partitions: int | None = None) -> DataFrame:
    """``n`` uniform detections in the generator's ranges, flagged ``is_synthetic``.

    Values are md5-derived from (seed, column, row id), so they are the same on
    any partitioning and any cluster size.
    """
    ids = spark.range(0, n, numPartitions=num_partitions) if num_partitions else spark.range(0, n)
    cols = {}
    for c, (lo, hi) in SYNTHETIC_RANGES.items():
        cols[c] = F.lit(lo) + hash_uniform(seed, c, F.col("id")) * F.lit(hi - lo)
    clo, chi = SYNTHETIC_CONFIDENCE
    cols["confidence"] = (F.lit(clo) + F.floor(hash_uniform(seed, "confidence", F.col("id")) * (chi - clo))).cast("int")
    start = F.to_date(F.lit(SYNTHETIC_START))
    span = F.datediff(F.to_date(F.lit(SYNTHETIC_END)), start) + 1
    cols["acq_date"] = F.date_add(start, F.floor(hash_uniform(seed, "acq_date", F.col("id")) * span).cast("int"))
    cols["acq_time"] = F.floor(hash_uniform(seed, "acq_time", F.col("id")) * 2400).cast("int")
    cols["daynight"] = F.when(hash_uniform(seed, "daynight", F.col("id")) < 0.5, "D").otherwise("N")
    cols["is_synthetic"] = F.lit(True)
    return ids.withColumns(cols).select(
        "id", *SYNTHETIC_RANGES.keys(), "confidence", "acq_date", "acq_time", "daynight", "is_synthetic")


def read_first_available(spark: SparkSession, sources: Sequence[str], schema: T.StructType | None = DETECTION_SCHEMA,
                         fmt: str = "csv", synthetic_rows: int | None = None) -> tuple[DataFrame, str]:
    """S3: try the sources in order; return (data, source used).

    A missing path is skipped, anything else raises.
    Synthetic rows are returned only when ``synthetic_rows`` is given, and they
    carry ``is_synthetic = true``.
    """
    for src in sources:
        try:
            df = read_detections(spark, src, schema, fmt)
            log.info("reading detections from %s", src)
            return df, src
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            log.warning("source %s unavailable: %s", src, str(e).splitlines()[0])
    if synthetic_rows is not None:
        log.warning("no source available; generating %d synthetic rows", synthetic_rows)
        return synthetic_detections(spark, synthetic_rows), "synthetic"
    raise FileNotFoundError(f"none of the sources could be read: {list(sources)}")
