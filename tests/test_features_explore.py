import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindling.operators import explore, features


def test_ratio_zero_area_and_diff(spark):
    df = spark.createDataFrame([(10.0, 2.0, 0.5, 300.0, 290.0), (10.0, 0.0, 1.0, 1.0, 1.0), (None, 1.0, 1.0, 1.0, 1.0)],
                               "frp double, scan double, track double, brightness double, bright_t31 double")
    out = features.temperature_diff(features.frp_per_area(df)).collect()
    assert out[0].frp_per_area == 10.0 and out[1].frp_per_area is None and out[2].frp_per_area is None
    assert out[0].temperature_diff == 10.0


def test_log_transform(spark):
    df = spark.createDataFrame([(-2.0,), (-1.0,), (0.0,), (None,), (math.e - 1,)], "x double")
    got = [r.lx for r in features.log_transform(df, {"lx": "x", "ly": "absent"}).collect()]
    assert got[:4] == [None, None, 0.0, None] and abs(got[4] - 1.0) < 1e-12
    assert "ly" not in features.log_transform(df, {"ly": "absent"}).columns


def test_normalize_minmax_standard_constant(spark):
    df = spark.createDataFrame([(1.0, 5.0, None), (2.0, 5.0, None), (4.0, 5.0, None)], "a double, c double, z double")
    mm = features.normalize(df, ["a", "c", "z", "absent"], "min_max").orderBy("a").collect()
    assert [r.a_norm for r in mm] == [0.0, 1 / 3, 1.0]
    assert all(r.c_norm is None and r.z_norm is None for r in mm)
    st = features.normalize(df, ["a"], "standard").orderBy("a").collect()
    x = np.array([1.0, 2.0, 4.0])
    assert np.allclose([r.a_norm for r in st], (x - x.mean()) / x.std(ddof=1))
    with pytest.raises(ValueError):
        features.normalize(df, ["a"], "robust")


def test_select_base_and_numeric(spark):
    df = spark.createDataFrame([(1.0, 2, "x", 3.0)], "a double, b int, s string, t double")
    assert features.select_base_features(df, "t", ["a", "b"], keep=["s"]).columns == ["s", "a", "b", "t"]
    assert features.numeric_columns(df) == ["a", "b", "t"] and features.numeric_columns(df, 2) == ["a", "b"]


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(50, 10, 400)
    y = 2 * x + rng.normal(0, 5, 400)
    z = rng.uniform(0, 1, 400)
    data = [(float(a), float(b), float(c), 7.0) for a, b, c in zip(x, y, z)]
    return spark.createDataFrame(data, "x double, y double, z double, k double"), x, y, z


def test_column_stats_and_describe_match_numpy(spark, sample):
    df, x, *_ = sample
    d = explore.describe(df, ["x", "k"]).where("column = 'x'").first()
    assert d["count"] == 400 and abs(d.mean - x.mean()) < 1e-9 and abs(d.std - x.std(ddof=1)) < 1e-9
    for q, name in [(0.25, "p25"), (0.5, "p50"), (0.75, "p75")]:
        assert abs(d[name] - np.quantile(x, q)) < 1e-9
    k = explore.describe(df, ["k"]).first()
    assert k.p50 == 7.0 and k.std == 0.0
    approx = explore.describe(df, ["x"], exact=False).first()
    assert abs(approx.p50 - np.quantile(x, 0.5)) < 1.0


def test_correlation_matrix_symmetric_and_safe(spark, sample):
    df, x, y, z = sample
    cm = {(r.a, r.b): r.corr for r in explore.correlation_matrix(df, ["x", "y", "k"]).collect()}
    assert abs(cm[("x", "y")] - np.corrcoef(x, y)[0, 1]) < 1e-9 and cm[("x", "y")] == cm[("y", "x")]
    assert cm[("x", "x")] == 1.0 and cm[("k", "k")] is None and cm[("x", "k")] is None
    low = explore.lower_triangle(explore.correlation_matrix(df, ["x", "y", "k"]))
    assert sorted((r.a, r.b) for r in low.collect()) == [("k", "x"), ("k", "y"), ("y", "x")]


def test_correlation_pairwise_complete(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.1), (3.0, None), (None, 7.0), (4.0, 8.2)], "a double, b double")
    c = {(r.a, r.b): r.corr for r in explore.correlation_matrix(df, ["a", "b"]).collect()}
    assert abs(c[("a", "b")] - np.corrcoef([1, 2, 4], [2, 4.1, 8.2])[0, 1]) < 1e-12


def test_top_correlates_signed_order(spark, sample):
    df, *_ = sample
    neg = df.withColumn("w", -F.col("y"))
    top = explore.top_correlates(neg, "y", ["y", "x", "z", "w", "k"], k=5).collect()
    assert top[0].feature == "x" and top[-1].feature == "k" and top[-2].feature == "w"


def test_histogram_counts_and_closed_last_bin(spark, sample):
    df, x, *_ = sample
    h = explore.histogram(df, ["x", "k"], 30)
    hx = {r.bin: r["count"] for r in h.where("column = 'x'").collect()}
    counts, _ = np.histogram(x, bins=30)
    assert sum(hx.values()) == 400 and [hx.get(i, 0) for i in range(30)] == counts.tolist()
    hk = h.where("column = 'k'").collect()
    assert len(hk) == 1 and hk[0].bin == 15 and hk[0]["count"] == 400


def test_density_curve_integrates_to_one(spark, sample):
    df, x, *_ = sample
    d = explore.density_curve(df, "x", grid=200).orderBy("i").collect()
    xs = np.array([r.x for r in d])
    ys = np.array([r.density for r in d])
    assert len(d) == 200 and xs[0] == x.min() and abs(xs[-1] - x.max()) < 1e-9
    assert 0.9 < np.trapezoid(ys, xs) <= 1.0
    h = x.std(ddof=1) * len(x) ** -0.2
    exact = np.exp(-0.5 * ((xs[100] - x) / h) ** 2).sum() / (len(x) * h * math.sqrt(2 * math.pi))
    assert abs(ys[100] - exact) / exact < 0.01


def test_scatter_density_and_daily_summary(spark, sample):
    df, *_ = sample
    s = explore.scatter_density(df, "x", "y", 10)
    assert s.agg(F.sum("n")).first()[0] == 400
    ev = spark.createDataFrame([("2024-01-01 01:00:00", 1.0), ("2024-01-01 05:00:00", 3.0),
                                ("2024-01-01 23:00:00", 10.0), ("2024-01-02 00:00:00", 4.0), (None, 2.0),
                                ("2024-01-03 08:00:00", None), ("2024-01-03 09:00:00", None)],
                               "ts string, v double").withColumn("ts", F.to_timestamp("ts"))
    got = {str(r.d): (r.n, r.a, r.m, r.mx) for r in explore.daily_summary(ev, "ts", "v").collect()}
    assert got == {"2024-01-01": (3, 14 / 3, 3.0, 10.0), "2024-01-02": (1, 4.0, 4.0, 4.0), "None": (1, 2.0, 2.0, 2.0),
                   "2024-01-03": (2, None, None, None)}


def test_scatter_many_equals_single(spark, sample):
    df, *_ = sample
    many = {(r.feature, r.xb, r.yb): r.n for r in explore.scatter_density_many(df, ["x", "z"], "y", 7).collect()}
    for f in ("x", "z"):
        one = {(f, r.xb, r.yb): r.n for r in explore.scatter_density(df, f, "y", 7).collect()}
        assert one == {k: v for k, v in many.items() if k[0] == f}


def test_eda_tables(spark, sample):
    from kindling.plans.eda import eda_tables
    df, *_ = sample
    t = eda_tables(df, "y", top_k=2)
    assert [r.feature for r in t["top_correlates"].collect()] == ["x", "z"]
    assert t["heatmap_cells"].count() == 6 and t["correlations"].count() == 16
    assert t["scatter"].agg(F.sum("n")).first()[0] == 800
    assert t["target_density"].count() == 200 and t["histograms"].select("column").distinct().count() == 4


def test_null_values_have_no_bin(spark):
    df = spark.createDataFrame([(1.0, 1.0), (None, 2.0), (3.0, None), (2.0, 3.0)], "x double, y double")
    h = {r.bin: r["count"] for r in explore.histogram(df, ["x"], 4).collect()}
    assert sum(h.values()) == 3 and h == {0: 1, 2: 1, 3: 1}
    sc = explore.scatter_density(df, "x", "y", 2).collect()
    assert sum(r.n for r in sc) == 2
    allnull = spark.createDataFrame([(None,), (None,)], "x double")
    assert explore.histogram(allnull, ["x"]).count() == 0
