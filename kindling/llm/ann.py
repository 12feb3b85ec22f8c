"""Approximate nearest neighbours by collision counting (6).

In the manner of C2LSH and QALSH (Gan et al., 2012; Huang et al., 2015): every block of vectors
keeps one sorted array of values for each of M single projections.  A query's windows on these
arrays are centred on the query's own projections and widen step by step (virtual rehashing); a
vector within so many windows that its count passes a threshold is a candidate, and windows widen
until a block has enough of them.  Candidates are verified by their cosine in double precision.
Blocks of queries meet blocks of vectors; no task holds more than one of each.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from kindling.llm.common import Scratch, mix, table

#: Projections, share of them that a candidate must collide in, first half width and its factor.
PROJECTIONS, THRESHOLD, WIDTH, WIDEN = 128, 0.75, 0.7, 1.1
#: A block yields this many candidates at least, and this share of its vectors.
CANDIDATES, CANDIDATE_SHARE = 40, 0.08
VECTORS_PER_BLOCK, QUERIES_PER_BLOCK, NEAREST, QUERY_EVERY = 4096, 2048, 5, 50


def usable(vector: Column) -> Column:
    """Neither null nor zero, and all components finite numbers."""
    real = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(vector, real) & F.exists(vector, lambda x: x != 0), F.lit(False))


class CollisionIndex:
    """Sorted projections of a block of unit vectors."""

    def __init__(self, vectors: np.ndarray, seed: int = 6):
        self.lines = np.random.default_rng(seed).standard_normal((vectors.shape[1], PROJECTIONS))
        values = vectors @ self.lines
        self.order = np.argsort(values, axis=0, kind="stable").T.ravel().astype(np.int32)
        # one rising array of all lines: each line's values lie in a stretch of their own
        self.apart = 4 * np.arange(PROJECTIONS) * np.sqrt((self.lines ** 2).sum(axis=0).max())
        self.sorted = (np.sort(values, axis=0) + self.apart).T.ravel()
        self.first = (np.arange(PROJECTIONS) * len(vectors)).astype(np.int32)
        self.size, self.count = len(vectors), np.arange(len(self.order), dtype=np.int32)

    def candidates(self, query: np.ndarray) -> np.ndarray:
        """Vectors that collide with the query often enough, for windows just wide enough."""
        need = min(self.size, CANDIDATES + int(CANDIDATE_SHARE * self.size))
        centre, often = query @ self.lines + self.apart, int(np.ceil(THRESHOLD * PROJECTIONS))
        counts, last = np.zeros(self.size, np.int64), self.first + self.size
        low = high = np.clip(np.searchsorted(self.sorted, centre).astype(np.int32), self.first, last)
        width = WIDTH
        while True:
            a = np.clip(np.searchsorted(self.sorted, centre - width).astype(np.int32), self.first, low)
            b = np.clip(np.searchsorted(self.sorted, centre + width).astype(np.int32), high, last)
            starts, lengths = np.concatenate([a, high]), np.concatenate([low - a, b - high])
            places = np.repeat(starts - np.cumsum(lengths, dtype=np.int32) + lengths, lengths)
            places += self.count[:len(places)]
            counts += np.bincount(self.order[places], minlength=self.size)  # only what the windows have gained
            low, high = a, b
            found = np.flatnonzero(counts >= often)
            if len(found) >= need:
                return found
            width *= WIDEN


def _search_block(queries: pd.DataFrame, vectors: pd.DataFrame, nearest: int) -> pd.DataFrame:
    out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
    if len(queries) and len(vectors):
        q, v = (np.stack(d["vector"].to_numpy()).astype(np.float64) for d in (queries, vectors))
        # scaled by the largest component first, or squares of very small or large ones are lost
        q, v = (x / np.abs(x).max(axis=1, keepdims=True) for x in (q, v))
        q, v = (x / np.sqrt((x * x).sum(axis=1, keepdims=True)) for x in (q, v))
        index, ids = CollisionIndex(v), vectors["vec_id"].to_numpy()
        for query_id, x in zip(queries["vec_id"].to_numpy(), q, strict=True):
            found = index.candidates(x)
            found = found[ids[found] != query_id]
            score = v[found] @ x
            best = np.lexsort((ids[found], -score))[:nearest]
            out["query_id"] += [query_id] * len(best)
            out["vec_id"] += ids[found][best].tolist()
            out["score"] += score[best].tolist()
    return pd.DataFrame(out).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})


def nearest(df: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", nearest: int = NEAREST) -> DataFrame:
    """(query_id, rank, vec_id, score): of each query the ``nearest`` other rows found of largest
    cosine, ties to the smaller id.

    ``queries`` has the same columns as ``df``.  Vectors that are null, zero or hold null or
    non-finite components, and rows without an id, take no part; vectors of different lengths
    aren't compared.  Of rows with the same id one counts.  Empty tables give empty tables.
    """
    scratch = Scratch(df.sparkSession, "ann")
    plain = lambda d: d.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector")).where(
        usable(F.col("vector")) & F.col("vec_id").isNotNull()).dropDuplicates(["vec_id"]).withColumn("length", F.size("vector"))
    vectors, asked = scratch.write(plain(df), "vectors"), scratch.write(plain(queries), "queries")
    v_blocks, q_blocks = (max(1, -(-t.count() // n)) for t, n in ((vectors, VECTORS_PER_BLOCK), (asked, QUERIES_PER_BLOCK)))
    block = lambda n, salt: F.pmod(mix("vec_id", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.withColumn("qb", block(q_blocks, 1)).withColumn("vb", every(v_blocks))
    right = vectors.withColumn("vb", block(v_blocks, 2)).withColumn("qb", every(q_blocks))
    key = ["length", "qb", "vb"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(
        lambda a, b: _search_block(a, b, nearest), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")


def op6_ann(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where(F.col("vec_id") % QUERY_EVERY == 0))
