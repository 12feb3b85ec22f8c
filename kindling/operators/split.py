"""M1: exact, repeatable train/test split without a single-partition sort.

Rows are ordered by (md5('<seed>:<key>'), key); the first ceil(test_size * n)
rows form the test set, as with a shuffled split of that size.  The cut row is
found by ``select_ranks`` (histogram refinement, no global sort), after which
both sides are plain filters against literal thresholds: no shuffle of the data,
and membership does not depend on partitioning.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindling.functions.columns import split_hash
from kindling.operators.selection import select_ranks_local
from kindling.schema import SPLIT_SEED, TEST_SIZE

_H = "__split_h"


def _test_count(test_size: float | int, n: int) -> int:
    if isinstance(test_size, int) and not isinstance(test_size, bool):
        n_test = test_size
    elif 0.0 < float(test_size) < 1.0:
        n_test = math.ceil(float(test_size) * n)
    else:
        raise ValueError(f"test_size must be a fraction in (0, 1) or a row count, got {test_size}")
    if not 0 < n_test < n:
        raise ValueError(f"split of {n} rows with test_size={test_size} leaves an empty side")
    return n_test


def _lex_le(cols: Sequence[Column], vals: Sequence) -> Column:
    """(c1, c2, ...) <= (v1, v2, ...) lexicographically, NULL ordered first (as the
    ranking window orders), never NULL itself: every row is on exactly one side."""
    expr = None
    for c, v in reversed(list(zip(cols, vals))):
        if v is None:
            lt, eq = F.lit(False), c.isNull()
        else:
            lit = F.lit(v)
            lt, eq = c.isNull() | (c < lit), c.isNotNull() & (c == lit)
        expr = (lt | eq) if expr is None else (lt | (eq & expr))
    return expr


def split_cut(df: DataFrame, key_cols: Sequence[str], test_size: float | int = TEST_SIZE,
              seed: int = SPLIT_SEED, **select_kw) -> tuple[int, int, tuple]:
    """(n, n_test, cut) where cut = (hash, *keys) of the last test row."""
    keys = list(key_cols)
    hashed = df.select(split_hash(seed, *keys).alias(_H), *keys)
    sort_key = F.conv(F.substring(F.col(_H), 1, 15), 16, 10).cast("long")
    counts = {}

    def rank(n: int) -> int:
        counts["n_test"] = _test_count(test_size, n)
        return counts["n_test"]

    # the first 15 hex digits are a 60-bit integer
    n, got = select_ranks_local(hashed, sort_key, {"cut": rank}, tiebreak=[_H, *keys], **select_kw)
    n_test = counts["n_test"]
    cut = tuple(got["cut"][c] for c in [_H, *keys])
    below = hashed.where(_lex_le([F.col(c) for c in [_H, *keys]], cut)).count()
    if below != n_test:
        raise ValueError(f"{below - n_test} rows beyond the test size share the key at the cut; the key must identify rows: {list(keys)}")
    return n, n_test, cut


def train_test_split(df: DataFrame, key_cols: Sequence[str] | str, test_size: float | int = TEST_SIZE,
                     seed: int = SPLIT_SEED, **select_kw) -> tuple[DataFrame, DataFrame]:
    """(train, test).  ``key_cols`` must identify rows uniquely."""
    keys = [key_cols] if isinstance(key_cols, str) else list(key_cols)
    _, _, cut = split_cut(df, keys, test_size, seed, **select_kw)
    in_test = _lex_le([split_hash(seed, *keys), *[F.col(k) for k in keys]], cut)
    return df.where(~in_test), df.where(in_test)


def split_column(df: DataFrame, key_cols: Sequence[str] | str, test_size: float | int = TEST_SIZE,
                 seed: int = SPLIT_SEED, name: str = "split") -> DataFrame:
    """Same split as a column: 'test' / 'train'."""
    keys = [key_cols] if isinstance(key_cols, str) else list(key_cols)
    _, _, cut = split_cut(df, keys, test_size, seed)
    in_test = _lex_le([split_hash(seed, *keys), *[F.col(k) for k in keys]], cut)
    return df.withColumn(name, F.when(in_test, F.lit("test")).otherwise(F.lit("train")))


def fold_column(df: DataFrame, key_cols: Sequence[str] | str, folds: int = 5, seed: int = 1,
                name: str = "fold") -> DataFrame:
    """Cross-validation fold in 0..folds-1 from a hash of the key (partition-independent)."""
    keys = [key_cols] if isinstance(key_cols, str) else list(key_cols)
    return df.withColumn(name, F.pmod(F.xxhash64(F.lit(seed), *[F.col(k) for k in keys]), F.lit(folds)).cast("int"))


def contiguous_fold_column(df: DataFrame, key_cols: Sequence[str] | str, folds: int = 5, seed: int = SPLIT_SEED,
                           name: str = "fold", **select_kw) -> DataFrame:
    """Cross-validation folds 0..folds-1 as contiguous blocks of the split's shuffled order, of sizes
    that differ by one at most (the first ``n % folds`` folds are larger).

    The blocks' last rows are found by exact rank (no global sort); a row's fold is the number of
    them that it comes after.  ``key_cols`` must identify rows.
    """
    keys = [key_cols] if isinstance(key_cols, str) else list(key_cols)
    if folds < 2:
        raise ValueError("folds must be >= 2")
    hashed = df.select(split_hash(seed, *keys).alias(_H), *keys)
    sort_key = F.conv(F.substring(F.col(_H), 1, 15), 16, 10).cast("long")

    def last_of(i: int):
        def rank(n: int) -> int:
            if n < folds:
                raise ValueError(f"{folds} folds of {n} rows leave an empty fold")
            return (i + 1) * (n // folds) + min(i + 1, n % folds)

        return rank

    _, got = select_ranks_local(hashed, sort_key, {f"cut{i}": last_of(i) for i in range(folds - 1)}, tiebreak=[_H, *keys], **select_kw)
    fold = F.lit(0)
    for cut in got.values():
        after = ~_lex_le([split_hash(seed, *keys), *[F.col(k) for k in keys]], tuple(cut[c] for c in [_H, *keys]))
        fold = fold + after.cast("int")
    return df.withColumn(name, fold)
