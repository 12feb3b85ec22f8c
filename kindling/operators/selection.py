"""Exact order statistics without a global sort or one big group.

``select_ranks`` finds, per group, the row at a given 1-based rank of the
order (value, *tiebreak).  It narrows a value range level by level: each level
is one scan of the candidate rows plus a ``groupBy(group, target, bucket)``
histogram; a cumulative count over those few rows names the bucket holding the
rank, and the next level looks only inside that bucket.

* A range that spans zero, infinities or more than a factor of four is bucketed
  by sign, binary exponent and leading bits of the mantissa; a narrower one by
  equal width (whole numbers in whole arithmetic).  Both put a range's ends into
  different buckets, so every level shrinks every open range, for any values:
  about six levels exhaust a double or a long, whatever the number of rows.
* Once a bucket holds at most ``final_max`` rows (or one distinct value) the rank
  is read with ``row_number`` over that small set.
* No step holds an unbounded group: a hot group is spread over its buckets and
  aggregated map-side first.
* Ungrouped selection serves any number of columns in the same passes.
* Small per-level state is written to the checkpoint folder (lineage cut) and
  broadcast only when its size, which is measured, is below a bound.
* NaN is missing, like NULL.
* Used for exact quantiles (``describe``, ``daily_summary``) and the exact
  train/test split.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from kindling.plans.materialize import materialize

BUCKETS = 4096
FINAL_MAX = 8192  # rows ranked in one task; more = one more histogram level
BROADCAST_MAX_BYTES = 64 << 20
MANTISSA_PARTS = 32  # buckets within a factor of two
_EXPONENTS = 1100  # beyond the exponents of a double on either side
_WHOLE = ("tinyint", "smallint", "int", "bigint")

_G0 = "__grp"


def _value(df: DataFrame, value: str | Column) -> tuple[Column, bool]:
    """(the value, whether it is whole): whole numbers as long, others as double with NaN as NULL."""
    v = F.col(value) if isinstance(value, str) else value
    if df.select(v.alias("v")).dtypes[0][1] in _WHOLE:
        return v.cast("long"), True
    v = v.cast("double")
    return F.when(~F.isnan(v), v), False


def _exponent_bucket(v: Column) -> Column:
    """Rising with ``v``: by sign, binary exponent, and the leading bits below it."""
    size = F.abs(v.cast("double"))
    e = F.least(F.floor(F.log2(size)), F.lit(_EXPONENTS - 1))
    part = F.floor((size / F.pow(F.lit(2.0), e.cast("double")) - 1) * MANTISSA_PARTS)
    part = F.greatest(F.lit(0), F.least(F.lit(MANTISSA_PARTS - 1), part))
    rank = F.when(size == float("inf"), F.lit(2 * _EXPONENTS * MANTISSA_PARTS)).otherwise((e + _EXPONENTS) * MANTISSA_PARTS + part + 1)
    return F.when(size == 0, F.lit(0)).when(v < 0, -rank).otherwise(rank).cast("int")


def _width_bucket(v: Column, lo: Column, hi: Column, buckets: int, whole: bool) -> Column:
    """Equal-width bucket of a range whose ends differ, are finite and have one sign."""
    if whole:
        width = F.floor((hi - lo - F.pmod(hi - lo, F.lit(buckets))).cast("double") / buckets).cast("long") + 1
        # (v - lo) less its remainder is a multiple of the width below 4097 times it, which rounding restores
        return F.round((v - lo - F.pmod(v - lo, width)).cast("double") / width.cast("double")).cast("int")
    return F.least(F.floor((v - lo) / (hi - lo) * buckets), F.lit(buckets - 1)).cast("int")


def _narrow_range(lo: Column, hi: Column) -> Column:
    """Whether a range is of one sign, finite, and spans a factor of four at most."""
    a, b = lo.cast("double"), hi.cast("double")
    return ((a > 0) & (b < float("inf")) & (b / 4 <= a)) | ((b < 0) & (a > float("-inf")) & (a / 4 >= b))


def _is_narrow(lo, hi) -> bool:
    return (lo > 0 and hi < math.inf and hi / 4 <= lo) or (hi < 0 and lo > -math.inf and lo / 4 >= hi)


def _broadcast_state(state: DataFrame, gcols: list[str], limit: int) -> DataFrame:
    """Broadcast hint for a written state table whose measured size is within ``limit`` bytes."""
    width = sum([F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in gcols], F.lit(0))
    row = state.agg(F.sum(width + 32 * len(state.columns)).alias("size")).first()
    return F.broadcast(state) if (row["size"] or 0) <= limit else state


def _join_state(left: DataFrame, state: DataFrame, gcols: list[str], limit: int,
                extra: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """left x state on the group columns (NULL-safe: a NULL group is a group) plus
    equalities ``left[a] == state[b]`` for (a, b) in ``extra``.  State columns
    keep their names except the renamed join keys, which are dropped."""
    ren = {c: f"__s_{c}" for c in [*gcols, *[b for _, b in extra]]}
    right = _broadcast_state(state, gcols, limit).select(*[F.col(c).alias(ren.get(c, c)) for c in state.columns])
    cond = None
    for g in gcols:
        e = left[g].eqNullSafe(right[ren[g]])
        cond = e if cond is None else cond & e
    for a, b in extra:
        cond = cond & (left[a] == right[ren[b]])
    return left.join(right, on=cond).drop(*ren.values())


def select_ranks(
    df: DataFrame,
    value: str | Column,
    targets: dict[str, Callable[[Column], Column]],
    group_cols: Sequence[str] = (),
    tiebreak: Sequence[str] = (),
    buckets: int = BUCKETS,
    final_max: int = FINAL_MAX,
    broadcast_max: int = BROADCAST_MAX_BYTES,
) -> DataFrame:
    """Rows at given ranks.

    ``targets`` maps a target name to a function of the group's non-null count
    ``n`` (a Column) giving a 1-based rank.  Returns one row per (group, target)
    whose rank is within 1..n, with columns ``group_cols``, ``target``, ``n``,
    ``value`` and the ``tiebreak`` columns of the selected row.
    """
    return _select_ranks(df, value, targets, group_cols, tiebreak, buckets, final_max, broadcast_max)[0]


def _select_ranks(df, value, targets, group_cols=(), tiebreak=(), buckets=BUCKETS, final_max=FINAL_MAX,
                  broadcast_max=BROADCAST_MAX_BYTES, extra=None) -> tuple[DataFrame, DataFrame]:
    """``select_ranks`` plus its per-group stats table (written, one row per group).

    ``extra`` maps names to aggregates of the value column over all of the
    group's rows (NULL values included), computed in the same stats pass.
    """
    vcol, whole = _value(df, value)
    gcols = list(group_cols) or [_G0]
    full = df.select(*([F.col(c) for c in group_cols] or [F.lit(0).alias(_G0)]),
                     vcol.alias("_v"), *[F.col(c) for c in tiebreak])
    base = full.where(F.col("_v").isNotNull())

    extra = extra or {}
    stats = materialize(full.groupBy(*gcols).agg(
        F.count("_v").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"),
        *[fn(F.col("_v")).alias(name) for name, fn in extra.items()]), "rank-stats")
    tstruct = F.array(*[F.struct(F.lit(name).alias("target"), fn(F.col("n")).cast("long").alias("r"))
                        for name, fn in targets.items()])
    state = (stats.select(*gcols, "n", "lo", "hi", F.explode(tstruct).alias("t"))
             .select(*gcols, "t.target", "n", "t.r", "lo", "hi", F.col("n").alias("c"))
             .where((F.col("r") >= 1) & (F.col("r") <= F.col("n"))))
    state = materialize(state, "rank-state")

    keys = gcols + ["target"]
    v, lo, hi = F.col("_v"), F.col("lo"), F.col("hi")
    open_ = (F.col("c") > final_max) & (lo < hi)
    while not (pending := state.where(open_)).isEmpty():
        cand = (_join_state(base, pending, gcols, broadcast_max).where(v.between(lo, hi))
                .withColumn("b", F.when(_narrow_range(lo, hi), _width_bucket(v, lo, hi, buckets, whole)).otherwise(_exponent_bucket(v))))
        hist = cand.groupBy(*keys, "n", "r", "b").agg(
            F.count(F.lit(1)).alias("cb"), F.min("_v").alias("blo"), F.max("_v").alias("bhi"))
        w = Window.partitionBy(*keys).orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        hist = hist.withColumn("cum", F.sum("cb").over(w))
        nxt = (hist.where((F.col("cum") - F.col("cb") < F.col("r")) & (F.col("cum") >= F.col("r")))
               .select(*keys, "n", (F.col("r") - (F.col("cum") - F.col("cb"))).alias("r"),
                       F.col("blo").alias("lo"), F.col("bhi").alias("hi"), F.col("cb").alias("c")))
        state = materialize(state.where(~open_).unionByName(nxt), "rank-state")

    if tiebreak and state.where((F.col("c") > final_max) & (F.col("lo") == F.col("hi"))).limit(1).count():
        raise ValueError(f"more than {final_max} rows share one order value; the tiebreak columns must make "
                         "the order (nearly) unique, e.g. a unique row key")
    parts = []
    if not tiebreak:
        # a range holding one distinct value answers itself, whatever its size
        parts.append(state.where(F.col("lo") == F.col("hi")).select(*keys, "n", F.col("lo").alias("_v")))
        state = state.where(F.col("lo") < F.col("hi"))
    # Targets that share a range share one ranking of its (at most final_max) rows.
    ranges = state.select(*gcols, "lo", "hi").distinct()
    cand = (_join_state(base, ranges, gcols, broadcast_max)
            .where(F.col("_v").between(F.col("lo"), F.col("hi"))))
    w = Window.partitionBy(*gcols, "lo", "hi").orderBy("_v", *tiebreak)
    ranked = cand.withColumn("_rn", F.row_number().over(w))
    picked = _join_state(ranked, state.select(*gcols, "target", "n", "r", F.col("lo").alias("slo"),
                                              F.col("hi").alias("shi")),
                         gcols, broadcast_max, extra=[("lo", "slo"), ("hi", "shi"), ("_rn", "r")])
    parts.append(picked.select(*keys, "n", "_v", *tiebreak))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    out = out.withColumnRenamed("_v", "value")
    stats_out = stats.select(*gcols, "n", *extra.keys())
    if not group_cols:
        return out.drop(_G0), stats_out.drop(_G0)
    return out, stats_out


def _range_histograms(df: DataFrame, values: list[tuple[Column, bool]], ranges: list[tuple], buckets: int) -> list[list]:
    """One scan: per range (column index, lo, hi) its buckets in order, with rows, min and max; a
    row is emitted once per range that holds it.  A range without ends holds all of its column."""
    cells, any_ = [], F.lit(False)
    for k, (c, lo, hi) in enumerate(ranges):
        v, whole = values[c]
        inside = v.isNotNull() if lo is None else v.between(lo, hi)
        b = _exponent_bucket(v) if lo is None or not _is_narrow(lo, hi) else _width_bucket(
            v, F.lit(lo).cast("long" if whole else "double"), F.lit(hi).cast("long" if whole else "double"), buckets, whole)
        cells.append(F.when(inside, F.struct(F.lit(k).alias("_k"), b.alias("_b"), v.alias("_v"))))
        any_ = any_ | inside
    rows = (df.where(any_).select(F.inline(F.array_compact(F.array(*cells))))
            .groupBy("_k", "_b").agg(F.count(F.lit(1)).alias("cb"), F.min("_v").alias("blo"), F.max("_v").alias("bhi")).collect())
    out: list[list] = [[] for _ in ranges]
    for h in sorted(rows, key=lambda h: (h["_k"], h["_b"])):
        out[h["_k"]].append(h)
    return out


def _narrow(entry: tuple, hist: list) -> tuple:
    """(column, rank, lo, hi, rows) -> the same for the bucket that holds the rank."""
    c, r = entry[:2]
    for h in hist:
        if h["cb"] >= r:
            return c, r, h["blo"], h["bhi"], h["cb"]
        r -= h["cb"]
    raise AssertionError("rank outside the histogram")


def _local(df: DataFrame, cols: Sequence[str | Column], targets: dict[str, Callable[[int], int]], tiebreak: Sequence[str] = (),
           buckets: int = BUCKETS, final_max: int = FINAL_MAX) -> tuple[list[int], dict]:
    """([n of each column], {(column index, target): Row or None}); the state, a few numbers, is the driver's.

    Jobs, whatever the number of columns: one histogram per level (the first
    over all rows, which also gives n) and one ranking of at most ``final_max``
    rows per range.
    """
    values = [_value(df, c) for c in cols]
    if len({w for _, w in values}) > 1:
        values = [(v.cast("double"), False) for v, _ in values]
    first = _range_histograms(df, values, [(c, None, None) for c in range(len(cols))], buckets)
    ns = [sum(h["cb"] for h in hist) for hist in first]
    state = {}
    for c, n in enumerate(ns):
        for name, fn in targets.items():
            r = fn(n)
            if r is not None and 1 <= r <= n:
                state[c, name] = _narrow((c, int(r)), first[c])
    while ranges := sorted({(c, lo, hi) for c, _, lo, hi, n in state.values() if n > final_max and lo < hi}):
        hists = dict(zip(ranges, _range_histograms(df, values, ranges, buckets), strict=True))
        state = {t: _narrow(e, hists[e[0], e[2], e[3]]) if (e[0], e[2], e[3]) in hists else e for t, e in state.items()}
    if tiebreak and any(n > final_max and lo == hi for _, _, lo, hi, n in state.values()):
        raise ValueError(f"more than {final_max} rows share one order value; the tiebreak columns must make "
                         "the order (nearly) unique, e.g. a unique row key")
    out: dict = {(c, name): None for c in range(len(cols)) for name in targets}
    out |= {t: Row(value=lo) for t, (_, _, lo, hi, _) in state.items() if lo == hi and not tiebreak}
    ranges = sorted({(c, lo, hi) for c, _, lo, hi, _ in state.values() if lo < hi or tiebreak})
    if ranges:
        cells = [F.when(values[c][0].between(lo, hi), F.struct(F.lit(k).alias("_k"), values[c][0].alias("_v"), *tiebreak))
                 for k, (c, lo, hi) in enumerate(ranges)]
        asked = {t: (ranges.index((e[0], e[2], e[3])), e[1]) for t, e in state.items() if (e[0], e[2], e[3]) in ranges}
        want = F.array(*[F.struct(F.lit(k).alias("_k"), F.lit(r).alias("_rn")) for k, r in sorted(set(asked.values()))])
        w = Window.partitionBy("_k").orderBy("_v", *tiebreak)
        ranked = (df.where(F.coalesce(*cells).isNotNull())
                  .select(F.inline(F.array_compact(F.array(*cells)))).withColumn("_rn", F.row_number().over(w))
                  .where(F.array_contains(want, F.struct("_k", F.col("_rn").cast("int").alias("_rn")))).collect())
        got = {(h["_k"], h["_rn"]): h for h in ranked}
        out |= {t: Row(value=got[kr]["_v"], **{x: got[kr][x] for x in tiebreak}) for t, kr in asked.items()}
    return ns, out


def select_ranks_local(df: DataFrame, value: str | Column, targets: dict[str, Callable[[int], int]],
                       tiebreak: Sequence[str] = (), buckets: int = BUCKETS, final_max: int = FINAL_MAX) -> tuple[int, dict]:
    """Ungrouped ``select_ranks``: ``targets`` maps a name to a function of the non-null count n (an
    int) giving a 1-based rank; returns (n, {target: Row(value, *tiebreak) or None})."""
    ns, got = _local(df, [value], targets, tiebreak, buckets, final_max)
    return ns[0], {name: got[0, name] for name in targets}


def exact_quantiles_of(df: DataFrame, cols: Sequence[str | Column], qs: Sequence[float], **select_kw) -> list[list]:
    """Per column its exact quantiles as numbers (None for an empty column), pandas'
    linear interpolation: x[floor h] + (x[ceil h] - x[floor h]) * (h - floor h),
    h = (n-1)q.  All columns share every pass; the interpolation runs on the two
    selected values only."""
    targets = {}
    for i, q in enumerate(qs):
        targets[f"{i}__lo"] = (lambda n, q=q: math.floor((n - 1) * float(q)) + 1)
        targets[f"{i}__hi"] = (lambda n, q=q: math.ceil((n - 1) * float(q)) + 1)
    ns, got = _local(df, cols, targets, **select_kw)
    out = []
    for c, n in enumerate(ns):
        row = []
        for i, q in enumerate(qs):
            lo, hi = got[c, f"{i}__lo"], got[c, f"{i}__hi"]
            if lo is None:
                row.append(None)
                continue
            h, a, b = (n - 1) * float(q), float(lo["value"]), float(hi["value"])
            row.append(a if a == b else a + (b - a) * (h - math.floor(h)))
        out.append(row)
    return out


def exact_quantile_values(df: DataFrame, col: str | Column, qs: Sequence[float], **select_kw) -> list:
    """``exact_quantiles_of`` one column."""
    return exact_quantiles_of(df, [col], qs, **select_kw)[0]


def exact_quantiles(df: DataFrame, col: str | Column, qs: Sequence[float],
                    group_cols: Sequence[str] = (), names: Sequence[str] | None = None,
                    extra: dict | None = None, **select_kw) -> DataFrame:
    """Linear-interpolated quantiles (pandas / ``quantile_cont``), exact, one row per group.

    With h = (n-1)q, the result is x[floor h] + (x[ceil h] - x[floor h]) * (h - floor h)
    over the sorted non-null values.
    """
    names = list(names or [f"q{i}" for i in range(len(qs))])
    targets = {}
    for name, q in zip(names, qs):
        targets[f"{name}__lo"] = (lambda n, q=q: F.floor((n - 1) * F.lit(float(q))) + 1)
        targets[f"{name}__hi"] = (lambda n, q=q: F.ceil((n - 1) * F.lit(float(q))) + 1)
    if not group_cols:
        vals = exact_quantile_values(df, col, qs, **select_kw)
        cols = [F.lit(v).cast("double").alias(name) for name, v in zip(names, vals)]
        if extra:
            c = F.col(col) if isinstance(col, str) else col
            row = df.agg(*[fn(c).alias(n) for n, fn in extra.items()]).first()
            cols += [F.lit(row[n]).alias(n) for n in extra]
        return df.sparkSession.range(1).select(*cols)
    if extra:
        picked, stats = _select_ranks(df, col, targets, group_cols=group_cols, extra=extra, **select_kw)
    else:
        picked = select_ranks(df, col, targets, group_cols=group_cols, **select_kw)
    aggs = []
    for name, q in zip(names, qs):
        lo = F.max(F.when(F.col("target") == f"{name}__lo", F.col("value")))
        hi = F.max(F.when(F.col("target") == f"{name}__hi", F.col("value")))
        h = (F.max("n") - 1) * F.lit(float(q))
        aggs.append(F.when(lo == hi, lo).otherwise(lo + (hi - lo) * (h - F.floor(h))).alias(name))
    q = picked.groupBy(*group_cols).agg(*aggs)
    if not extra:
        return q
    # one row per group from the stats pass (an all-NULL group keeps its row)
    qn = q.select(*[F.col(g).alias(f"__q_{g}") for g in group_cols], *names)
    cond = None
    for g in group_cols:
        e = stats[g].eqNullSafe(qn[f"__q_{g}"])
        cond = e if cond is None else cond & e
    return stats.join(qn, cond, "left").drop(*[f"__q_{g}" for g in group_cols])
