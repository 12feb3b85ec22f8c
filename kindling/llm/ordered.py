"""Running values in true order within groups, with no group held by one task."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindling.llm.common import Scratch


def running(df: DataFrame, part: str, order: Sequence[str], scratch: Scratch, name: str,
            xors: Sequence[str] = (), previous: str | None = None) -> DataFrame:
    """``df`` with, per ``part`` (a long, not null) in the order of ``order``: ``rank`` from 1, the running
    xor of each column of ``xors`` as ``x_<column>`` (this row's included), and ``previous``'s value
    on the row before as ``before`` (null on a group's first row).

    Rows are range-partitioned on (part, order) and sorted, so a hot group spans several tasks.
    Each task streams its rows once; only a partition's first group can have begun in an earlier
    one, so one row per partition, folded on the driver, completes that group's values.  Rows equal
    in (part, order) get any order among themselves.
    """
    kept = [f.name for f in df.schema.fields]
    done = df.select(*kept)
    done = done.repartitionByRange(part, *order).sortWithinPartitions(part, *order)
    new = [("rank", "long"), *[(f"x_{x}", "long") for x in xors], ("before", "long"), ("_pid", "int")]
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, T.LongType() if t == "long" else T.IntegerType()) for n, t in new]])

    def stream(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        group, seen, acc, last = None, 0, [0] * len(xors), None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            key = batch.column(kept.index(part)).to_numpy(zero_copy_only=False)
            first = np.empty(n, bool)
            first[0] = group is None or key[0] != group
            first[1:] = key[1:] != key[:-1]
            start = np.maximum.accumulate(np.where(first, np.arange(n), -1))  # -1: the group of the batch before goes on
            rank = np.where(start < 0, np.arange(n) + 1 + seen, np.arange(n) - start + 1)
            cols = [pa.array(rank, pa.int64())]
            for k, x in enumerate(xors):
                v = batch.column(kept.index(x)).to_numpy(zero_copy_only=False)
                total = np.bitwise_xor.accumulate(v)
                base = np.where(start < 0, acc[k], total[start - 1])
                base = np.where(start == 0, 0, base)
                run = total ^ base
                acc[k] = int(run[-1])
                cols.append(pa.array(run, pa.int64()))
            before = pa.nulls(n, pa.int64())
            if previous:
                v = batch.column(kept.index(previous)).to_numpy(zero_copy_only=False).astype(np.int64)
                shifted = np.concatenate(([last if last is not None else 0], v[:-1]))
                before, last = pa.array(shifted, pa.int64(), mask=first), int(v[-1])
            group, seen = key[-1], int(rank[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols, before, pa.array(np.full(n, pid, np.int32))], [f.name for f in schema])

    done = scratch.write(done.mapInArrow(stream, schema), name)
    values = ["rank", *[f"x_{x}" for x in xors]]
    end = F.max(F.struct(part, *values, F.col(previous or part)))
    ends = {r["_pid"]: r for r in done.groupBy("_pid").agg(F.min(part).alias("a"), end.alias("z")).collect()}  # a row per partition
    carry, open_group, held, prev = [], None, None, None
    for pid in sorted(ends):
        a, z = ends[pid]["a"], tuple(ends[pid]["z"])
        going_on = open_group is not None and a == open_group
        if going_on:
            carry.append((pid, a, *held, prev))
        open_group, prev = z[0], z[-1]
        mine = z[1:-1]
        held = tuple(m + h if i == 0 else m ^ h for i, (m, h) in enumerate(zip(mine, held, strict=True))) if going_on and z[0] == a else mine
    if carry:
        fields = "_pid int, _group long, " + ", ".join(f"c_{v} long" for v in values) + ", c_before long"
        extra = df.sparkSession.createDataFrame(carry, fields)  # at most one row per partition
        done = done.join(F.broadcast(extra), (done["_pid"] == extra["_pid"]) & (done[part] == extra["_group"]), "left")
        done = done.select(*kept, *[
            (F.col(v) + F.coalesce(f"c_{v}", F.lit(0)) if v == "rank" else F.col(v).bitwiseXOR(F.coalesce(f"c_{v}", F.lit(0)))).alias(v) for v in values],
            F.when((F.col("rank") == 1) & F.col("_group").isNotNull(), F.col("c_before")).otherwise(F.col("before")).alias("before"))
    else:
        done = done.drop("_pid")
    return done if previous else done.drop("before")
