"""Helpers shared by the operators of this package: intermediate tables in the shared
checkpoint folder, checked broadcasts, ranks without one-task windows, and word hashes."""

from __future__ import annotations

import ctypes
import functools
import gc
import os
import sys
import uuid
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from kindling.session import ensure_checkpoint_dir
from kindling.sources.readers import read_table

#: A table is broadcast only when its rows, counted first, take no more than this.
BROADCAST_MAX_BYTES = 32 << 20
#: Partitions of a shuffle beyond so many for each core are worked on one after another.
TASKS_A_CORE = 8
#: Text that a Python task works on at once.
CHUNK_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A supplied table.  Texts go to Python in batches of 4 MB, whatever their lengths; the executor and its worker hold several at once.  Also lets Python workers that see the driver's folders find this library
    (elsewhere it is installed or sent with ``--py-files``)."""
    root, known = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in known.get("PYTHONPATH", "").split(os.pathsep):
        known["PYTHONPATH"] = os.pathsep.join(filter(None, [known.get("PYTHONPATH"), root]))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
    return read_table(spark, sf_dir, name)


class Scratch:
    """Tables of one run below ``spark.checkpoint.dir``: written once, read back (which cuts the
    lineage), and dropped as soon as a later table no longer needs them."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/kindling/{label}-{uuid.uuid4().hex}"
        self._n = 0

    def write(self, df: DataFrame, name: str, keep_shuffles: bool = True, by: str | None = None) -> DataFrame:
        """``keep_shuffles``: until the driver happens to collect its garbage; else only while the table is written.
        ``by``: a column, each value's rows being in files of their own, which can go alone."""
        self._n += 1
        path = f"{self.root}/{self._n}-{name}"
        conf, key = self.spark.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = conf.get(key, "false")
        try:
            if not keep_shuffles:
                conf.set(key, "true")
            (df.write.partitionBy(by) if by else df.write).parquet(path)
        finally:
            conf.set(key, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._kindling_path = path
        return out

    def drop(self, *tables: DataFrame, only: str = "") -> None:
        """``only``: the rows of one value (column=value) of the column a table was written by."""
        for t in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{t._kindling_path}/{only}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def drop_all(self) -> None:
        """All tables of the run; for a run whose results no longer read them."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def checked_broadcast(df: DataFrame, rows: int, row_bytes: int, limit: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Broadcast hint where ``rows`` counted rows of ``row_bytes`` fit the limit; else a shuffle join."""
    return F.broadcast(df) if rows * row_bytes <= limit else df


def most_tasks(spark: SparkSession) -> int:
    """TASKS_A_CORE for each core: a task that calls Python or writes takes longer to start than small partitions to work on."""
    return TASKS_A_CORE * max(1, spark.sparkContext.defaultParallelism)


def mix(*cols: Column | str) -> Column:
    """A well mixed long of the columns, the same on every run and cluster."""
    return F.xxhash64(*cols)


def ranked(df: DataFrame, part: list[str], order: list[str], rank: str, rows: int, per_bucket: int = 1024) -> DataFrame:
    """Rank from 0 within ``part`` with no task holding a whole part.

    Rows go to ``rows / per_bucket`` buckets by a hash of the first order column, so rows that
    share it stay adjacent; the buckets' counts give each bucket's first rank, and a window over
    (part, bucket) ranks its rows.  Where one value of the first order column is frequent, pass a
    second: it splits that value's rows over buckets of their own.
    """
    buckets = max(1, rows // per_bucket)
    b = F.pmod(mix(*order), F.lit(buckets)).cast("long")
    d = df.withColumn("_bucket", b)
    sizes = d.groupBy(*part, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*part).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*part, "_bucket").orderBy(*order)
    d = d.withColumn("_in", F.row_number().over(inside) - 1)
    return d.join(sizes, [*part, "_bucket"]).withColumn(rank, (F.col("_first") + F.col("_in")).cast("long")).drop(
        "_bucket", "_first", "_in")


def documents_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, under fixed names; whatever else the table has stays behind."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


#: Modules whose tables a worker keeps between tasks.
_KEEPING = ("bpe", "token_counts")


def give_back() -> None:
    """Return freed memory to the system; else this worker, idle while the executor goes on without Python, keeps its pages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


@functools.cache
def set_modules_aside() -> None:
    """What this worker has imported is left out of its later collections; to walk it took longer than a small task."""
    gc.collect()
    gc.freeze()


def tidied(task: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the task yields; what it used is given back when it ends."""
    set_modules_aside()  # before the task has any rows
    yield from task
    del task  # and with it the task's caches and texts
    give_back()


def release(keep: str = "") -> None:
    """Drop what earlier tasks of other operators have left in this Python worker, which Spark uses again."""
    dropped = False
    for name in _KEEPING:
        held = getattr(sys.modules.get(f"kindling.llm.{name}"), "_loaded", None)
        if held and name != keep:
            held.clear()
            dropped = True
    if dropped:
        give_back()


def text_chunks(batches: Iterable[pa.RecordBatch], limit: int = CHUNK_BYTES, keep: str = "") -> Iterator[tuple[pa.Array, list[bytes]]]:
    """(ids, texts as UTF-8; null is empty) of at most ``limit`` bytes, or of one longer text.
    ``keep``: the module whose tables this task uses."""
    release(keep)
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).cast(pa.binary())
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        start = size = 0
        for i, n in enumerate(sizes.tolist()):
            if size + n > limit and i > start:
                yield ids.slice(start, i - start), [t or b"" for t in texts.slice(start, i - start).to_pylist()]
                start, size = i, 0
            size += n
        if start < len(sizes):
            yield ids.slice(start), [t or b"" for t in texts.slice(start).to_pylist()]


class HashTable:
    """Hash table from non-negative longs to ints, looked up for whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.shift = np.uint64(64 - max(4, int(2 * len(keys)).bit_length() + 1))
        self.mask = (1 << (64 - int(self.shift))) - 1
        self.keys = np.full(self.mask + 1, -1, np.int64)
        self.values = np.full(self.mask + 1, -1, np.int32)
        slot, todo = self._slots(keys), np.arange(len(keys))
        while len(todo):
            free = todo[self.keys[slot[todo]] < 0]
            self.keys[slot[free]] = keys[free]  # of several that want a slot the last gets it
            self.values[slot[free]] = values[free]
            todo = todo[self.keys[slot[todo]] != keys[todo]]
            slot[todo] = (slot[todo] + 1) & self.mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values, -1 where there is none."""
        slot = self._slots(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], -1)
        todo = np.flatnonzero((found != keys) & (found >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.mask
            found = self.keys[slot[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (found >= 0)]
        return out


class WordHashes(dict):
    """64-bit hash of a word, remembered for as many words as a task can hold."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h
