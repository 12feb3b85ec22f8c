"""Pair sums, correlations and grouped least squares against NumPy and pandas."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kindling.operators import explore, gram


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(5)
    n = 4000
    pdf = pd.DataFrame({"a": rng.normal(1e9, 1, n), "b": rng.normal(0, 3, n), "k": np.full(n, 0.1), "g": rng.integers(0, 4, n), "s": rng.choice(["x", "y", None], n)})
    pdf["c"] = 0.5 * (pdf.a - 1e9) - 2 * pdf.b + rng.normal(0, 0.1, n)
    pdf["d"] = np.where(rng.random(n) < 0.3, np.nan, pdf.b * 2 + rng.normal(0, 1, n))
    pdf["e"] = np.where(rng.random(n) < 0.9, np.nan, 1.0 * rng.integers(0, 5, n))
    pdf["never"] = np.nan
    return pdf


@pytest.fixture(scope="module")
def table(spark, frame):
    schema = "a double, b double, k double, g int, s string, c double, d double, e double, never double"
    rows = [tuple(None if (isinstance(v, float) and np.isnan(v) and i % 2) else v for i, v in enumerate(r)) for r in frame.itertuples(index=False, name=None)]
    return spark.createDataFrame([(*r[:3], int(r[3]), r[4], *r[5:]) for r in rows], schema).repartition(7)


COLS = ["a", "b", "k", "c", "d", "e", "never"]


def _want(pdf):
    with np.errstate(all="ignore"):
        w = pdf[COLS].corr()
    w.loc["k"], w.loc[:, "k"] = np.nan, np.nan  # constant
    return w


def test_correlations_are_pairwise_complete(table, frame):
    want = _want(frame)
    for r in gram.correlations(table, COLS).collect():
        w = want.loc[r.a, r.b]
        assert (r["corr"] is None) == bool(np.isnan(w)), (r, w)
        assert r["corr"] is None or abs(r["corr"] - w) < 1e-6


def test_correlations_by_group_with_a_null_group(table, frame):
    got = {(r.s, r.a, r.b): r["corr"] for r in gram.correlations(table, COLS, ["s"]).collect()}
    assert len(got) == 3 * len(COLS) ** 2
    for s, part in frame.groupby("s", dropna=False):
        want = _want(part)
        key = None if pd.isna(s) else s
        for a in COLS:
            for b in COLS:
                w, g = want.loc[a, b], got[key, a, b]
                assert (g is None) == bool(np.isnan(w)) and (g is None or abs(g - w) < 1e-6)


def test_states_do_not_depend_on_partitions(table):
    one, many = (gram.pair_states(table.repartition(p), COLS).first() for p in (1, 23))
    assert one.state_rows == many.state_rows == 4000 and one.state_n == many.state_n
    for part in ("state_m", "state_s", "state_c"):
        assert np.allclose(one[part], many[part], rtol=1e-6, atol=1e-2)  # a mean of 1e9 has steps of 1e-7


def test_degenerate_tables(spark, table):
    none = gram.correlations(table.where("false"), ["a", "b"]).collect()
    assert len(none) == 4 and all(r["corr"] is None for r in none)
    assert all(r["corr"] is None for r in gram.correlations(table.limit(1), ["a", "b"]).collect())
    assert gram.linear_fits(table.where("false"), ["a"], "b", ["g"]).count() == 0
    top = explore.top_correlates(table, "c", COLS, 3).collect()
    assert [r.feature for r in top][0] == "a" and len(top) == 3


def test_forty_columns_plan_in_seconds(spark):
    df = spark.range(2000).select(*[F.when(F.col("id") % (i + 2) != 0, F.sin(F.col("id") * (i + 1))).alias(f"v{i}") for i in range(40)])
    began = time.time()
    plan = gram.correlations(df, df.columns)._jdf.queryExecution().executedPlan().toString()
    assert time.time() - began < 10 and plan.count("MapInPandas") == 2
    other = gram.correlations(df.fillna(0.0), df.columns)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == other.count("Exchange")


def _lstsq(part, feats, label):
    full = part.dropna(subset=[*feats, label])
    x = np.column_stack([full[feats].to_numpy(), np.ones(len(full))])
    x[:, :-1] -= x[:, :-1].mean(axis=0)
    beta = np.linalg.lstsq(x, full[label].to_numpy(), rcond=None)[0]
    return beta[:-1], full[label].mean() - beta[:-1] @ full[feats].mean().to_numpy(), len(full), len(part) - len(full)


@pytest.mark.parametrize("leave_out", [False, True])
def test_linear_fits(table, frame, leave_out):
    feats = ["a", "b", "d"]
    got = {}
    for r in gram.linear_fits(table, feats, "c", ["g"], leave_out).collect():
        got.setdefault(r.g, {})[r.term] = r
    for g in range(4):
        part = frame[(frame.g != g) if leave_out else (frame.g == g)]
        beta, intercept, n, dropped = _lstsq(part, feats, "c")
        rows = got[g]
        assert np.allclose([rows[f].coefficient for f in feats], beta, atol=1e-6)
        assert abs(rows["intercept"].coefficient - intercept) < 1e-6 * 1e9 and (rows["a"].n, rows["a"].dropped) == (n, dropped)
        assert rows["a"].r2 > 0.99


def test_linear_fit_of_a_constant_or_repeated_feature(table):
    df = table.withColumn("b2", F.col("b") * 2)
    got = {r.term: r.coefficient for r in gram.linear_fits(df, ["b", "b2", "k"], "c").collect()}
    assert got["k"] == 0.0 and abs(got["b"] + 2 * got["b2"] + 2) < 0.05  # the two share the slope of about -2
    with pytest.raises(ValueError):
        gram.linear_fits(df, ["b"], "c", leave_out=True)
