"""Mergeable pair sums: correlations of many columns and linear fits of many groups in one pass.

A state holds, for every pair of columns over the rows where both are present, the count, each
side's mean and centred square sum, and the centred product sum (four k x k arrays).  Tasks
build one from their rows with matrix products, states merge pairwise about a common mean, and
no sum is taken about a far origin, so large offsets don't cancel.  The plan is the same for
any number of columns and whether or not they hold NULLs.

States move as arrays (32 k^2 bytes each): one per task and group, merged first within
``FAN`` buckets, then across them, so no task merges every task's state.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindling.functions.columns import num

FAN = 256
#: Groups whose states a task holds at once; beyond it they are passed on early.
GROUPS_HELD = 1024

_PARTS = ("state_n", "state_m", "state_s", "state_c")  # counts, means, centred square sums, centred product sums


def _state_of(k: int, complete: bool) -> Callable:
    """Rows (r x k floats, NaN where missing) to a state; ``complete``: only rows without a missing value."""

    def state(x):
        import numpy as np

        if complete:
            x = x[~np.isnan(x).any(axis=1)]
        here = ~np.isnan(x)
        first = np.where(here.any(axis=0), x[here.argmax(axis=0), np.arange(k)], 0.0) if len(x) else np.zeros(k)
        p = here.astype(np.float64)
        with np.errstate(all="ignore"):
            z = np.where(here, x - first, 0.0)  # exactly 0 for a constant column
            mid = np.nan_to_num(z.sum(axis=0) / p.sum(axis=0))
            z, origin = np.where(here, z - mid, 0.0), first + mid
            n, sums = p.T @ p, z.T @ p
            off = np.where(n > 0, sums / n, 0.0)
            return n, np.where(n > 0, origin[:, None] + off, 0.0), np.maximum((z * z).T @ p - sums * off, 0.0), z.T @ z - off * off.T * n

    return state


def _merge(a, b):
    import numpy as np

    n = a[0] + b[0]
    share = np.divide(b[0], n, out=np.zeros_like(n), where=n > 0)
    d = np.where((a[0] > 0) & (b[0] > 0), b[1] - a[1], 0.0)
    mean = np.where(a[0] > 0, a[1] + d * share, b[1])
    both = a[0] * share
    return n, mean, a[2] + b[2] + d * d * both, a[3] + b[3] + d * d.T * both


def _names(group_cols: Sequence[str]) -> list[str]:
    """Groups go by names of their own until the end, so theirs clash with nothing."""
    return [f"group_{i}" for i in range(len(group_cols))]


def _group_type(df: DataFrame, group_cols: Sequence[str]) -> list[T.StructField]:
    return [T.StructField(n, df.schema[c].dataType) for n, c in zip(_names(group_cols), group_cols, strict=True)]


def pair_states(df: DataFrame, cols: Sequence[str], group_cols: Sequence[str] = (), complete: bool = False) -> DataFrame:
    """(group_0, ..., state_rows, state_n, state_m, state_s, state_c): one merged state per group; ``state_rows`` counts all its rows."""
    k, groups, held, parts_of = len(cols), _names(group_cols), GROUPS_HELD, _PARTS
    of, merge = _state_of(k, complete), _by_value(_merge)
    schema = T.StructType([*_group_type(df, group_cols), T.StructField("bucket", T.IntegerType()), T.StructField("state_rows", T.LongType()),
                           *[T.StructField(p, T.ArrayType(T.DoubleType())) for p in _PARTS]])
    names, fan = [f.name for f in schema], FAN
    data = df.select(*[F.col(g).alias(n) for n, g in zip(groups, group_cols, strict=True)], *[num(c).alias(f"_x{i}") for i, c in enumerate(cols)])

    def build(batches):
        import numpy as np
        import pandas as pd
        from pyspark import TaskContext

        bucket, states = TaskContext.get().partitionId() % fan, {}

        def frame():
            rows = [(*key, bucket, count, *[part.ravel().tolist() for part in state]) for key, (count, state) in states.items()]
            states.clear()
            return pd.DataFrame(rows, columns=names)

        for pdf in batches:
            x = pdf[[f"_x{i}" for i in range(k)]].to_numpy(dtype=np.float64)
            if groups:
                codes, order = pdf.groupby(groups, dropna=False, sort=False).ngroup().to_numpy(), pdf[groups].drop_duplicates()
                parts = [(tuple(None if pd.isna(v) else v for v in key), np.flatnonzero(codes == i)) for i, key in enumerate(order.itertuples(index=False, name=None))]
            else:
                parts = [((), np.arange(len(x)))]
            for key, at in parts:
                new = (len(at), of(x[at]))
                old = states.get(key)
                states[key] = new if old is None else (old[0] + new[0], merge(old[1], new[1]))
            if len(states) >= held:
                yield frame()
        if states:
            yield frame()

    out_names = [n for n in names if n != "bucket"]

    def combine(pdf):
        import numpy as np
        import pandas as pd

        rows, total = 0, None
        for r in pdf.itertuples(index=False):
            state = tuple(np.asarray(getattr(r, p), dtype=np.float64).reshape(k, k) for p in parts_of)
            rows, total = rows + int(r.state_rows), state if total is None else merge(total, state)
        first = pdf.iloc[0]
        return pd.DataFrame([(*[first[g] for g in groups], *([int(first["bucket"])] if "bucket" in pdf else []), rows, *[p.ravel().tolist() for p in total])],
                            columns=list(pdf.columns) if "bucket" in pdf else out_names)

    built = data.mapInPandas(build, schema)
    if not groups:  # a table without rows has a state too
        zeros = F.array_repeat(F.lit(0.0), k * k)
        built = built.unionByName(df.sparkSession.range(1).select(F.lit(0).alias("bucket"), F.lit(0).cast("long").alias("state_rows"), *[zeros.alias(p) for p in _PARTS]))
    built = built.groupBy(*groups, "bucket").applyInPandas(combine, schema).drop("bucket")
    return built.groupBy(*groups).applyInPandas(combine, T.StructType([f for f in schema if f.name != "bucket"]))


def _by_value(fn: Callable) -> Callable:
    """A copy of a module's function that workers needn't import the module for."""
    import types

    return types.FunctionType(fn.__code__, {"__builtins__": __builtins__}, fn.__name__)


def correlations(df: DataFrame, cols: Sequence[str], group_cols: Sequence[str] = ()) -> DataFrame:
    """(*group_cols, a, b, i, j, corr): pairwise-complete Pearson; NULL where a side is constant or a pair has no two rows."""
    cols, k, groups, parts_of = list(cols), len(cols), _names(group_cols), _PARTS
    schema = T.StructType([*_group_type(df, group_cols), *[T.StructField(c, t) for c, t in (("a", T.StringType()), ("b", T.StringType()), ("i", T.IntegerType()), ("j", T.IntegerType()), ("corr", T.DoubleType()))]])

    def cells(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                n, s, c = (np.asarray(getattr(r, p)).reshape(k, k) for p in (parts_of[0], parts_of[2], parts_of[3]))
                with np.errstate(all="ignore"):
                    corr = np.where((n > 1) & (s > 0) & (s.T > 0), c / (np.sqrt(s) * np.sqrt(s.T)), np.nan)
                np.fill_diagonal(corr, np.where((np.diag(s) > 0) & (np.diag(n) > 1), 1.0, np.nan))
                corr = np.clip(corr, -1.0, 1.0)
                key = [getattr(r, g) for g in groups]
                out += [(*key, cols[i], cols[j], i, j, None if np.isnan(corr[i, j]) else float(corr[i, j])) for i in range(k) for j in range(k)]
            yield pd.DataFrame(out, columns=[f.name for f in schema])

    return pair_states(df, cols, group_cols).mapInPandas(cells, schema).toDF(*group_cols, "a", "b", "i", "j", "corr")


def linear_fits(df: DataFrame, features: Sequence[str], label: str, group_cols: Sequence[str] = (), leave_out: bool = False) -> DataFrame:
    """M2 for every group in one pass: (*group_cols, n, dropped, term, coefficient, r2), the intercept as term ``intercept``.

    Ordinary least squares with intercept from the group's centred sums; a singular system gets
    its least-norm solution.  Rows with a missing feature or label are left out and counted in
    ``dropped``.  ``leave_out``: each group's fit is over all other groups (a fold's training
    rows); then one task merges the groups' states, so their number must be small, as folds are.
    """
    cols, groups, parts_of = [*features, label], _names(group_cols), _PARTS
    k, terms, merge = len(cols), [*features, "intercept"], _by_value(_merge)
    if leave_out and not groups:
        raise ValueError("leave_out needs groups")
    schema = T.StructType([*_group_type(df, group_cols), T.StructField("n", T.LongType()), T.StructField("dropped", T.LongType()),
                           T.StructField("term", T.StringType()), T.StructField("coefficient", T.DoubleType()), T.StructField("r2", T.DoubleType())])

    def solve(batches):
        import numpy as np
        import pandas as pd

        def state(r):
            return tuple(np.asarray(getattr(r, p), dtype=np.float64).reshape(k, k) for p in parts_of)

        def fitted(key, rows, st):
            n = int(st[0][0, 0])
            if n == 0:
                return [(*key, 0, rows, t, None, None) for t in terms]
            mean, xx, xy, yy = np.diag(st[1]), st[3][:-1, :-1], st[3][:-1, -1], st[2][-1, -1]
            scale = np.sqrt(np.maximum(np.diag(xx), 0.0))
            scale[scale == 0] = 1.0
            beta = np.linalg.lstsq(xx / np.outer(scale, scale), xy / scale, rcond=1e-12)[0] / scale
            left = yy - 2 * beta @ xy + beta @ xx @ beta
            r2 = float(1 - left / yy) if yy > 0 and n > 1 else None
            return [(*key, n, rows - n, t, float(b), r2) for t, b in zip(terms, [*beta, mean[-1] - beta @ mean[:-1]], strict=True)]

        if leave_out:
            all_ = [(tuple(getattr(r, g) for g in groups), int(r.state_rows), state(r)) for pdf in batches for r in pdf.itertuples(index=False)]
            out, zero = [], (0, tuple(np.zeros((k, k)) for _ in range(4)))
            add = lambda a, b: (a[0] + b[0], merge(a[1], b[1]))
            after = [zero]
            for _, rows, st in reversed(all_):
                after.append(add(after[-1], (rows, st)))
            before = zero
            for i, (key, rows, st) in enumerate(all_):
                out += fitted(key, *add(before, after[len(all_) - 1 - i]))
                before = add(before, (rows, st))
            yield pd.DataFrame(out, columns=[f.name for f in schema])
            return
        for pdf in batches:
            yield pd.DataFrame([row for r in pdf.itertuples(index=False) for row in fitted(tuple(getattr(r, g) for g in groups), int(r.state_rows), state(r))], columns=[f.name for f in schema])

    states = pair_states(df, cols, group_cols, complete=True)
    return (states.repartition(1) if leave_out else states).mapInPandas(solve, schema).toDF(*group_cols, "n", "dropped", "term", "coefficient", "r2")
