"""Typed reading of CSV text (S1): one set of rules for batch, stream and inference.

Fields are read as text.  A field that holds one of the missing-value texts is NULL.  Any other is
parsed as its column's type; what doesn't parse is NULL too and recorded in the row's ``_rejects``
(column, value, reason), so bad input is counted and can be sent elsewhere instead of
vanishing.  Types are declared by header name or inferred by one pass that counts, per column,
what each field could be: a column is the least type that holds all its fields, in the order
boolean, long, double, text (a mix of booleans and numbers is text; a column without values is
double).  Quotes inside quoted fields are doubled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindling.schema import FALSE_TEXTS, MISSING_TEXTS, TRUE_TEXTS

REJECTS, CORRUPT = "_rejects", "_corrupt"
_REJECT_TYPE = "array<struct<column:string,value:string,reason:string>>"
#: A decimal number as data files write it; Java's own parser would also take "1d" or "0x1p3".
_NUMBER = r"^\s*[+-]?(?:(?:[0-9]+(?:[.][0-9]*)?|[.][0-9]+)(?:[eE][+-]?[0-9]+)?|(?i:inf|infinity))\s*$"
_WHOLE = r"^\s*[+-]?[0-9]+\s*$"
_WHOLE_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _options(reader, pattern: str | None, recursive: bool, multi_line: bool):
    reader = reader.option("header", True).option("mode", "PERMISSIVE").option("escape", '"').option("multiLine", multi_line)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.option("recursiveFileLookup", True) if recursive else reader


def header_of(spark: SparkSession, path: str | Sequence[str], pattern: str | None = None, recursive: bool = False) -> list[str]:
    """Column names of the files' header (of one of them; ``read_text`` checks the others against it)."""
    reader = _options(spark.read.format("csv"), pattern, recursive, False)
    return reader.load(path if isinstance(path, str) else list(path)).columns


def text_schema(columns: Sequence[str]) -> T.StructType:
    return T.StructType([*[T.StructField(c, T.StringType()) for c in columns], T.StructField(CORRUPT, T.StringType())])


def read_text(spark: SparkSession, path: str | Sequence[str], pattern: str | None = None, recursive: bool = False, multi_line: bool = False) -> DataFrame:
    """Every field as text, with ``_corrupt`` (the line) where a line has too few or too many fields.

    All files must have the same header: one with other or reordered columns raises when it is read.
    """
    columns = header_of(spark, path, pattern, recursive)
    if {CORRUPT, REJECTS} & set(columns):
        raise ValueError(f"the names {CORRUPT} and {REJECTS} are taken")
    reader = _options(spark.read.format("csv"), pattern, recursive, multi_line).schema(text_schema(columns)).option("enforceSchema", False)
    return reader.option("columnNameOfCorruptRecord", CORRUPT).load(path if isinstance(path, str) else list(path))


def text_stream(spark: SparkSession, path: str, columns: Sequence[str], pattern: str | None = None, recursive: bool = False, max_files_per_trigger: int | None = None) -> DataFrame:
    """``read_text`` of the files that arrive under ``path``."""
    reader = _options(spark.readStream.format("csv"), pattern, recursive, False).schema(text_schema(columns)).option("enforceSchema", False)
    reader = reader.option("columnNameOfCorruptRecord", CORRUPT)
    return (reader.option("maxFilesPerTrigger", max_files_per_trigger) if max_files_per_trigger else reader).load(path)


def _present(c: str) -> Column:
    return F.when(~F.col(c).isin(MISSING_TEXTS), F.col(c))


def _parsed(text: Column, kind: T.DataType) -> Column:
    """The text as ``kind``, NULL where it isn't one.  Whole numbers may be written with a fraction of
    zero ("85.0"), as writers do for integer columns that have gaps."""
    if isinstance(kind, T.StringType):
        return text
    trimmed = F.trim(text)
    if isinstance(kind, T.BooleanType):
        return F.when(text.isin(TRUE_TEXTS), True).when(text.isin(FALSE_TEXTS), False)
    if not isinstance(kind, T.NumericType):
        return trimmed.try_cast(kind)
    number = F.when(text.rlike(_NUMBER), trimmed)
    if not isinstance(kind, _WHOLE_TYPES):
        return number.try_cast(kind)
    value = number.try_cast("double")
    return F.coalesce(F.when(text.rlike(_WHOLE), trimmed).try_cast(kind), F.when(~text.rlike(_WHOLE) & (value == F.floor(value)), value.try_cast(kind)))


def typed(raw: DataFrame, schema: T.StructType) -> DataFrame:
    """``read_text``'s rows with the declared types bound by name (other columns stay text) and ``_rejects``."""
    types = {f.name: f.dataType for f in schema.fields}
    columns = [c for c in raw.columns if c != CORRUPT]
    values = {c: _parsed(_present(c), types.get(c, T.StringType())) for c in columns}
    bad = [F.when(_present(c).isNotNull() & values[c].isNull(), F.struct(F.lit(c).alias("column"), F.col(c).alias("value"), F.lit(f"not a {types[c].simpleString()}").alias("reason")))
           for c in columns if not isinstance(types.get(c, T.StringType()), T.StringType)]
    if CORRUPT in raw.columns:
        bad.append(F.when(F.col(CORRUPT).isNotNull(), F.struct(F.lit(None).cast("string").alias("column"), F.col(CORRUPT).alias("value"), F.lit("wrong number of fields").alias("reason"))))
    rejects = F.filter(F.array(*bad), lambda x: x.isNotNull()) if bad else F.array()
    return raw.select(*[values[c].alias(c) for c in columns], rejects.cast(_REJECT_TYPE).alias(REJECTS))


def infer_types(raw: DataFrame) -> T.StructType:
    """The least type of each column, from one aggregate over its fields (kinds are counted map-side and merge freely)."""
    columns = [c for c in raw.columns if c != CORRUPT]
    aggs = []
    for i, c in enumerate(columns):
        x = _present(c)
        whole = x.rlike(_WHOLE) & F.trim(x).try_cast("long").isNotNull()
        aggs += [F.count(x).alias(f"n{i}"), F.count_if(x.isin([*TRUE_TEXTS, *FALSE_TEXTS])).alias(f"b{i}"), F.count_if(whole).alias(f"w{i}"), F.count_if(x.rlike(_NUMBER)).alias(f"d{i}")]
    got = raw.agg(*aggs).first()

    def least(n: int, booleans: int, whole: int, numbers: int) -> T.DataType:
        if n == 0:
            return T.DoubleType()
        return T.BooleanType() if booleans == n else T.LongType() if whole == n else T.DoubleType() if numbers == n else T.StringType()

    return T.StructType([T.StructField(c, least(*[got[f"{k}{i}"] for k in "nbwd"])) for i, c in enumerate(columns)])


def rejected(df: DataFrame) -> DataFrame:
    """(row's other columns' JSON, column, value, reason): one row per rejected field or line of a ``typed`` table."""
    others = [c for c in df.columns if c != REJECTS]
    return df.where(F.size(REJECTS) > 0).select(F.to_json(F.struct(*others)).alias("row"), F.explode(REJECTS).alias("r")).select("row", "r.column", "r.value", "r.reason")


def reject_counts(df: DataFrame) -> DataFrame:
    """(column, reason, n) of a ``typed`` table."""
    return df.select(F.explode(REJECTS).alias("r")).groupBy("r.column", "r.reason").agg(F.count(F.lit(1)).alias("n"))
