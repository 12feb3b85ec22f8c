import math

import pytest
from pyspark.sql import functions as F

from kindling.operators import clean
from kindling.schema import FORM_RANGES

NAN = float("nan")


def test_drop_missing_drops_null_and_nan(spark):
    df = spark.createDataFrame([(1, 1.0, "a"), (2, None, "b"), (3, NAN, "c"), (4, 2.0, None)],
                               "id int, x double, s string")
    assert [r.id for r in clean.drop_missing(df, ["x"]).orderBy("id").collect()] == [1, 4]
    assert [r.id for r in clean.drop_missing(df, ["x", "s"]).orderBy("id").collect()] == [1]
    with pytest.raises(KeyError):
        clean.drop_missing(df, ["nope"])


def test_nullify_nan_only_touches_floats(spark):
    df = spark.createDataFrame([(1, NAN, "NaN"), (2, 3.0, "x")], "id int, x double, s string")
    out = clean.nullify_nan(df).orderBy("id").collect()
    assert out[0].x is None and out[0].s == "NaN" and out[1].x == 3.0


def test_coerce_date_bad_values_become_null(spark):
    df = spark.createDataFrame([("2019-13-40",), ("x",), ("",), ("2019-10-01",), (None,)], "acq_date string")
    got = [r.acq_date for r in clean.coerce_date(df).collect()]
    assert [str(g) if g else None for g in got] == [None, None, None, "2019-10-01", None]
    assert clean.coerce_date(df.withColumnRenamed("acq_date", "other")).columns == ["other"]


def test_filter_region_is_inclusive(spark):
    pts = [(-44.0, 112.0), (-10.0, 154.0), (-44.0001, 120.0), (-9.9999, 120.0), (-20.0, 111.999),
           (-20.0, 154.0001), (-20.0, 130.0), (None, 130.0)]
    df = spark.createDataFrame(pts, "latitude double, longitude double")
    kept = clean.filter_region(df).collect()
    assert sorted((r.latitude, r.longitude) for r in kept) == [(-44.0, 112.0), (-20.0, 130.0), (-10.0, 154.0)]


def test_filter_outliers_strict_bounds_and_degenerate(spark):
    # values at exactly mean +- 1 sd are dropped with k=1 (strict inequality)
    df = spark.createDataFrame([(float(v),) for v in [0, 0, 10, 10]], "x double")
    mu, sd = 5.0, math.sqrt(100 / 3)
    out = [r.x for r in clean.filter_outliers(df, "x", 1.0).collect()]
    assert out == [v for v in [0.0, 0.0, 10.0, 10.0] if mu - sd < v < mu + sd]
    exact = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "x double")  # mean 2, sd 1
    assert sorted(r.x for r in clean.filter_outliers(exact, "x", 1.0).collect()) == [2.0]
    one = spark.createDataFrame([(5.0,)], "x double")
    assert clean.filter_outliers(one, "x").count() == 0          # NULL std, as in pandas
    const = spark.createDataFrame([(5.0,)] * 4, "x double")
    assert clean.filter_outliers(const, "x").count() == 0        # std 0: nothing strictly inside
    assert clean.filter_outliers(const, "absent").count() == 4   # absent column: skipped
    with_null = spark.createDataFrame([(1.0,), (2.0,), (None,)], "x double")
    assert clean.filter_outliers(with_null, "x", 3).count() == 2


def test_filter_outliers_stats_follow_earlier_filters(spark):
    df = spark.createDataFrame([(float(i), -20.0 if i < 50 else 0.0) for i in range(100)],
                               "brightness double, latitude double").withColumn("longitude", F.lit(130.0))
    out = clean.clean_detections(df.withColumn("scan", F.lit(1.0)).withColumn("track", F.lit(1.0)))
    # region drops i >= 50 first; the 3-sigma rule over 0..49 keeps all of them
    assert out.count() == 50


def test_require_target_and_features(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    with pytest.raises(ValueError):
        clean.require_target(df, "brightness")
    with pytest.raises(ValueError, match="c"):
        clean.require_features(df, ["a", "c"])
    assert clean.require_features(df, ["b", "a"]).columns == ["b", "a"]


def test_create_dataset_order_and_target(spark):
    data = [(float(v), 1.0, 1.0) for v in range(20)] + [(1000.0, 1.0, 1.0), (None, 1.0, 1.0)]
    df = spark.createDataFrame(data, "brightness double, latitude double, longitude double")
    out = clean.create_dataset(df, ["brightness"], outliers={"enabled": True, "column": "brightness",
                                                             "std_threshold": 2}, target="brightness")
    assert out.count() == 20
    with pytest.raises(ValueError):
        clean.create_dataset(df, [], target="frp")


def test_ensure_acq_date_three_inputs(spark):
    a = spark.createDataFrame([(1.0, "2019-10-05"), (2.0, "bad")], "latitude double, acquisition_date string")
    assert [str(r.acq_date) if r.acq_date else None for r in clean.ensure_acq_date(a).orderBy("latitude").collect()] \
        == ["2019-10-05", None]
    b = spark.createDataFrame([(2019, 1), (2020, 366), (2019, 366), (2019, 0)], "acq_year int, acq_day int")
    got = [str(r.acq_date) if r.acq_date else None for r in clean.ensure_acq_date(b).collect()]
    assert got == ["2019-01-01", "2020-12-31", None, None]
    c = spark.createDataFrame([(i,) for i in range(50)], "id int")
    assert clean.ensure_acq_date(c).where("acq_date is not null").count() == 0
    synth = clean.ensure_acq_date(c, fill="synthetic", row_id="id")
    st = synth.agg(F.min("acq_date").alias("lo"), F.max("acq_date").alias("hi"),
                   F.min(F.col("is_synthetic_date").cast("int")).alias("flag")).first()
    assert str(st.lo) >= "2019-10-01" and str(st.hi) <= "2020-01-11" and st.flag == 1
    keep = spark.createDataFrame([("2019-01-01",)], "acq_date string")
    assert clean.ensure_acq_date(keep).collect()[0].acq_date == "2019-01-01"


def test_range_check_and_counts(spark):
    df = spark.createDataFrame([(0.5, 10.0), (0.05, 10.0), (1.0, None), (6.0, 500.0)], "scan double, frp double")
    bounds = {k: FORM_RANGES[k] for k in ("scan", "frp")}
    got = {(r.scan, r.frp): (r.valid, list(r.violations)) for r in clean.range_check(df, bounds).collect()}
    assert got[(0.5, 10.0)] == (True, [])
    assert got[(0.05, 10.0)] == (False, ["scan"])
    assert got[(1.0, None)] == (False, ["frp"])
    assert got[(6.0, 500.0)] == (False, ["scan", "frp"])
    c = clean.range_violation_counts(df, bounds).first()
    assert (c.n, c.bad_scan, c.bad_frp) == (4, 2, 2)


def test_null_audit_counts_null_and_nan(spark):
    df = spark.createDataFrame([(1.0, "a"), (NAN, None), (None, "c")], "x double, s string")
    got = {r.column: r.nulls for r in clean.null_audit(df).collect()}
    assert got == {"x": 2, "s": 1}


def test_filter_dates_inclusive(spark):
    df = spark.createDataFrame([("2019-09-30",), ("2019-10-01",), ("2020-01-11",), ("2020-01-12",)], "d string")
    df = df.withColumn("d", F.to_date("d"))
    assert clean.filter_dates(df, "d", "2019-10-01", "2020-01-11").count() == 2


def test_nan_is_missing_everywhere_without_a_source_projection(spark):
    """Raw NaN (as in a Parquet source read without NaN->NULL) behaves like pandas' missing value."""
    df = spark.createDataFrame([(-20.0, 130.0, 300.0), (NAN, 130.0, 310.0), (-21.0, NAN, 320.0),
                                (-22.0, 131.0, NAN), (-23.0, 132.0, 330.0)],
                               "latitude double, longitude double, brightness double")
    assert clean.filter_region(df).count() == 3                 # NaN fails the box
    kept = clean.filter_outliers(df, "brightness", 3.0).collect()
    assert len(kept) == 4 and all(r.brightness == r.brightness for r in kept)   # stats ignore NaN, NaN row dropped
    out = clean.create_dataset(df, ["latitude"], region={"enabled": True}, target="brightness")
    rows = out.orderBy("latitude").collect()
    assert [r.latitude for r in rows] == [-23.0, -22.0, -20.0] and rows[1].brightness is None
    from kindling.operators import explore
    st = explore.column_stats(df, ["brightness"]).first()
    assert st["count"] == 4 and st.mean == 315.0 and st.max == 330.0


def test_date_layouts(spark):
    df = spark.createDataFrame([("2019-10-05",), ("2019-10-05 13:45:00",), ("2019/10/05",), ("10/05/2019",),
                                ("20191005",), ("5 Oct",)], "acq_date string")
    got = [str(r.acq_date) if r.acq_date else None for r in clean.coerce_date(df).collect()]
    assert got == ["2019-10-05"] * 5 + [None]
