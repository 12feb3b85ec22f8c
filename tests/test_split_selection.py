import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindling.operators import selection
from kindling.operators.selection import exact_quantiles, exact_quantiles_of, select_ranks, select_ranks_local
from kindling.operators.split import fold_column, split_column, train_test_split


def _brute_test_keys(keys, frac, seed):
    order = sorted(keys, key=lambda k: (hashlib.md5(f"{seed}:{k}".encode()).hexdigest(), k))
    return set(order[: math.ceil(frac * len(keys))])


@pytest.mark.parametrize("final_max,buckets", [(1_000_000, 4096), (40, 8), (3, 4)])
def test_split_matches_brute_force(spark, final_max, buckets):
    keys = list(range(1, 1001))
    df = spark.createDataFrame([(k, float(k)) for k in keys], "k long, v double")
    train, test = train_test_split(df, "k", 0.25, 1, final_max=final_max, buckets=buckets)
    got = {r.k for r in test.collect()}
    assert got == _brute_test_keys(keys, 0.25, 1)
    tr = {r.k for r in train.collect()}
    assert len(got) == 250 and not (got & tr) and (got | tr) == set(keys)


def test_split_independent_of_partitioning_and_sizes(spark):
    df = spark.range(1, 5001).withColumnRenamed("id", "k")
    a = {r.k for r in train_test_split(df, "k", 0.3, 7)[1].collect()}
    b = {r.k for r in train_test_split(df.repartition(13), "k", 0.3, 7)[1].collect()}
    assert a == b and len(a) == math.ceil(0.3 * 5000)
    assert train_test_split(df, "k", 100, 7)[1].count() == 100
    labelled = split_column(df, "k", 0.3, 7)
    assert {r.k for r in labelled.where("split = 'test'").collect()} == a
    with pytest.raises(ValueError):
        train_test_split(df, "k", 1.5)


def test_split_composite_key(spark):
    rows = [(o, ln) for o in range(1, 101) for ln in range(1, 4)]
    df = spark.createDataFrame(rows, "o long, ln int")
    _, test = train_test_split(df, ["o", "ln"], 0.2, 3)
    order = sorted(rows, key=lambda r: (hashlib.md5(f"3:{r[0]}:{r[1]}".encode()).hexdigest(), r))
    assert {(r.o, r.ln) for r in test.collect()} == set(order[:60])


def test_folds_are_stable(spark):
    df = fold_column(spark.range(0, 2000), "id", 5, 1)
    c = {r.fold: r["count"] for r in df.groupBy("fold").count().collect()}
    assert set(c) == set(range(5)) and min(c.values()) > 300


@pytest.mark.parametrize("final_max,buckets", [(1_000_000, 4096), (50, 16), (2, 4)])
def test_quantiles_with_ties_and_hot_value(spark, final_max, buckets):
    rng = np.random.default_rng(3)
    vals = np.concatenate([rng.normal(0, 1, 600), np.full(400, 2.5), rng.integers(0, 5, 300).astype(float)])
    df = spark.createDataFrame([(float(v), int(i % 3)) for i, v in enumerate(vals)], "v double, g int")
    qs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = exact_quantiles(df, "v", qs, final_max=final_max, buckets=buckets).first()
    assert np.allclose(list(got), np.quantile(vals, qs), rtol=0, atol=1e-12)
    grouped = exact_quantiles(df, "v", qs, group_cols=["g"], final_max=final_max, buckets=buckets).collect()
    for r in grouped:
        exp = np.quantile(vals[np.arange(len(vals)) % 3 == r.g], qs)
        assert np.allclose([r[f"q{i}"] for i in range(len(qs))], exp, rtol=0, atol=1e-12)


def test_select_ranks_grouped_tiebreak_and_nulls(spark):
    data = [(None if i % 10 == 0 else "a" if i % 2 else "b", float(i // 7), i) for i in range(200)]
    df = spark.createDataFrame(data, "g string, v double, id int")
    out = select_ranks(df, "v", {"third": lambda n: F.lit(3), "last": lambda n: n}, group_cols=["g"],
                       tiebreak=["id"], final_max=5, buckets=4).collect()
    for r in out:
        members = sorted((v, i) for g, v, i in data if g == r.g)
        want = members[2] if r.target == "third" else members[-1]
        assert (r.value, r.id) == want and r.n == len(members)
    n, got = select_ranks_local(df, "v", {"mid": lambda n: n // 2}, tiebreak=["id"], final_max=7, buckets=4)
    assert n == 200 and (got["mid"]["value"], got["mid"]["id"]) == sorted((v, i) for _, v, i in data)[99]


def test_split_refuses_unbounded_ties(spark):
    df = spark.createDataFrame([(1,)] * 30 + [(2,)] * 30, "k long")
    with pytest.raises(ValueError, match="unique"):
        train_test_split(df, "k", 0.25, 1, final_max=10, buckets=4)


def test_grouped_quantiles_with_one_hot_group(spark):
    """One group holds ~60% of the rows; it is refined bucket by bucket, never ranked whole."""
    rng = np.random.default_rng(5)
    groups = np.where(rng.uniform(size=3000) < 0.6, "hot", rng.choice(["a", "b", "c"], 3000))
    vals = rng.exponential(10, 3000)
    df = spark.createDataFrame([(str(g), float(v)) for g, v in zip(groups, vals)], "g string, v double")
    got = {r.g: r for r in exact_quantiles(df, "v", [0.5, 0.99], group_cols=["g"], final_max=100, buckets=16)
           .collect()}
    for g in ["hot", "a", "b", "c"]:
        exp = np.quantile(vals[groups == g], [0.5, 0.99])
        assert np.allclose([got[g].q0, got[g].q1], exp, rtol=0, atol=1e-12)


try:
    from hypothesis import HealthCheck, given, settings
    from hypothesis import strategies as st

    @settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
    @given(values=st.lists(st.one_of(st.integers(-5, 5).map(float),
                                     st.floats(-1e6, 1e6, allow_nan=False, allow_infinity=False)),
                           min_size=1, max_size=60),
           q=st.floats(0, 1), final_max=st.integers(1, 30))
    def test_quantile_property(spark, values, q, final_max):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        got = exact_quantiles(df, "v", [q], final_max=final_max, buckets=4).first()[0]
        assert math.isclose(got, float(np.quantile(np.array(values), q)), rel_tol=1e-12, abs_tol=1e-9)
except ImportError:  # pragma: no cover
    pass


def test_local_selection_stops_when_buckets_cannot_split(spark):
    # 2^60-scale integers 1 apart collapse to one double: refinement cannot split them
    base = 2 ** 59
    df = spark.createDataFrame([(base + i, i) for i in range(50)], "v long, id int")
    n, got = select_ranks_local(df, "v", {"r": lambda n: 17}, tiebreak=["id"], final_max=5, buckets=4)
    assert n == 50 and got["r"]["value"] == base + 16


def test_grouped_selection_stops_when_buckets_cannot_split(spark):
    base = 2 ** 59
    df = spark.createDataFrame([(base + i, i % 2) for i in range(40)], "v long, g int")
    out = {(r.g, r.target): r.value for r in
           select_ranks(df, "v", {"third": lambda n: F.lit(3)}, group_cols=["g"], final_max=4, buckets=4).collect()}
    assert out == {(0, "third"): base + 4, (1, "third"): base + 5}


def test_wide_tails_infinities_and_zeros(spark):
    """No value of any size or sign keeps a range from shrinking; several columns share the passes."""
    rng = np.random.default_rng(9)
    tails = 10.0 ** rng.uniform(-300, 299, 1500) * rng.choice([-1.0, 1.0], 1500)
    odd = np.concatenate([rng.normal(0, 1, 1400), [np.inf, -np.inf, 5e-324, -5e-324, 1.7e308, -1.7e308], np.zeros(94)])
    whole = np.concatenate([rng.integers(-2**62, 2**62, 1498), [2**63 - 1, -2**63]])
    df = spark.createDataFrame([(float(a), float(b), int(c), i % 2) for i, (a, b, c) in enumerate(zip(tails, odd, whole))],
                               "a double, b double, c long, g int")
    qs = [0.0, 100 / 1499, 750 / 1499, 1400 / 1499, 1.0]  # whole ranks: no interpolation
    at = [0, 100, 750, 1400, 1499]
    seen = []
    orig = selection._range_histograms

    def spy(d, values, ranges, buckets):
        seen.append(len(ranges))
        return orig(d, values, ranges, buckets)

    selection._range_histograms = spy
    try:
        got = exact_quantiles_of(df, ["a", "b"], qs, final_max=3)
    finally:
        selection._range_histograms = orig
    for row, v in zip(got, (tails, odd)):
        assert np.allclose(row, np.sort(v)[at], rtol=1e-12, atol=0) or list(row) == list(np.sort(v)[at])
    assert len(seen) <= 6 and seen[0] == 2
    n, picked = select_ranks_local(df, "c", {str(k): (lambda n, k=k: k + 1) for k in at}, final_max=3, buckets=16)
    assert n == 1500 and [picked[str(k)]["value"] for k in at] == [int(x) for x in np.sort(whole)[at]]
    grouped = select_ranks(df, "b", {"first": lambda n: F.lit(1), "mid": lambda n: F.lit(300), "last": lambda n: n},
                           group_cols=["g"], final_max=3, buckets=64).collect()
    for r in grouped:
        v = np.sort(odd[np.arange(1500) % 2 == r.g])
        assert r.value == v[{"first": 0, "mid": 299, "last": 749}[r.target]]


def test_split_keeps_rows_with_null_key(spark):
    df = spark.createDataFrame([(None, 0.0)] + [(k, float(k)) for k in range(1, 200)], "k long, v double")
    train, test = train_test_split(df, "k", 0.25, 1)
    assert train.count() + test.count() == 200 and test.count() == 50
    assert train.where("k is null").count() + test.where("k is null").count() == 1


def test_exact_quantiles_extra_aggregates(spark):
    df = spark.createDataFrame([(1.0, "a"), (3.0, "a"), (None, "a"), (10.0, "b"), (None, "c")], "v double, g string")
    extra = {"rows": lambda v: F.count(F.lit(1)), "mx": F.max}
    one = exact_quantiles(df, "v", [0.5], names=["m"], extra=extra).first()
    assert (one.m, one.rows, one.mx) == (3.0, 5, 10.0)
    got = {r.g: (r.m, r.rows, r.mx) for r in
           exact_quantiles(df, "v", [0.5], group_cols=["g"], names=["m"], extra=extra).collect()}
    assert got == {"a": (2.0, 3, 3.0), "b": (10.0, 1, 10.0), "c": (None, 1, None)}
