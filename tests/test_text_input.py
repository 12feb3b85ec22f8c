"""Typed CSV reading: types, missing-value texts, rejects, and batch against stream."""

import io
import math

import pandas as pd
import pytest
from pyspark.sql import types as T

from kindling.models.specs import fit_linear
from kindling.schema import DETECTION_SCHEMA, FORM_RANGES, MISSING_TEXTS
from kindling.sources.readers import header_schema, read_detections, synthetic_detections
from kindling.sources.text import REJECTS, infer_types, read_text, reject_counts, rejected, typed
from kindling.streaming.scoring import read_stream, score_frame, start_scoring

FIELDS = {
    "ints": ["1", "-7", "+3", "0", "12", "5"],
    "gaps": ["1", "", "NA", "4", "null", "6"],
    "late_double": ["1", "2", "3", "4.5", "1e3", ".5"],
    "flags": ["True", "false", "TRUE", "False", "true", "FALSE"],
    "mixed": ["True", "1", "0", "False", "2", "3"],
    "words": ["x", "NaN", "None", "y", "n/a", "z z"],
    "empty": ["", "NA", "nan", "", "#N/A", "NULL"],
    "long_ints": ["9223372036854775807", "1", "9223372036854775808", "2", "3", "4"],
    "java_only": ["1d", "2", "3", "4", "5", "6"],
    "infinite": ["inf", "-Infinity", "1", "2", "3", "4"],
    "dates": ["2019-10-01", "2019-10-02", "", "2019-10-04", "2019-10-05", "x"],
}


@pytest.fixture(scope="module")
def csv_dir(tmp_path_factory):
    d = tmp_path_factory.mktemp("csv")
    names = list(FIELDS)
    rows = [[FIELDS[n][i] for n in names] for i in range(6)]
    for k, part in enumerate((rows[:2], rows[2:5], rows[5:])):  # a column's type needs all files
        (d / f"p{k}.csv").write_text("\n".join([",".join(names), *[",".join(r) for r in part]]) + "\n")
    return d


def test_inferred_types_and_values_equal_pandas(spark, csv_dir):
    df = read_detections(spark, str(csv_dir), schema=None)
    kinds = dict(df.dtypes)
    assert kinds == {"ints": "bigint", "gaps": "bigint", "late_double": "double", "flags": "boolean", "mixed": "string", "words": "string", "empty": "double",
                     "long_ints": "double", "java_only": "string", "infinite": "double", "dates": "string"}
    pdf = pd.read_csv(io.StringIO("\n".join([",".join(FIELDS), *[",".join(FIELDS[n][i] for n in FIELDS) for i in range(6)]])))
    rows = {r.ints: r for r in df.collect()}
    for i, key in enumerate(pdf["ints"].tolist()):
        for c in FIELDS:
            want, got = pdf[c].iloc[i], rows[key][c]
            missing = want is None or (isinstance(want, float) and math.isnan(want))
            assert (got is None) == missing, (c, want, got)
            if not missing:
                assert got == want or str(got) == str(want) or float(got) == float(want), (c, want, got)


def test_every_missing_text_is_null(spark, tmp_path):
    (tmp_path / "m.csv").write_text("k,s,n\n" + "".join(f'{i},"{t}","{t}"\n' for i, t in enumerate(MISSING_TEXTS)) + "99,word,1\n")
    got = typed(read_text(spark, str(tmp_path)), T.StructType.fromDDL("k int, s string, n double"))
    assert got.where("k < 99 and (s is not null or n is not null)").count() == 0 and got.count() == len(MISSING_TEXTS) + 1
    assert reject_counts(got).count() == 0


def test_rejects_name_column_value_and_reason(spark, csv_dir):
    schema = T.StructType.fromDDL("ints int, late_double int, flags boolean, words double, long_ints long, java_only double, dates date")
    got = typed(read_text(spark, str(csv_dir)), schema)
    assert {(r.column, r.reason, r.n) for r in reject_counts(got).collect()} == {
        ("late_double", "not a int", 2), ("words", "not a double", 3), ("long_ints", "not a bigint", 1), ("java_only", "not a double", 1), ("dates", "not a date", 1)}
    values = {(r.column, r.value) for r in rejected(got).collect()}
    assert ("late_double", "4.5") in values and ("late_double", ".5") in values and ("dates", "x") in values
    assert [r.late_double for r in got.orderBy("ints").collect() if r.late_double is not None and r.late_double > 999] == [1000]  # 1e3 is whole
    assert set(got.columns) == {*FIELDS, REJECTS}


def test_lines_with_other_numbers_of_fields(spark, tmp_path):
    (tmp_path / "r.csv").write_text('a,b,c\n1,2,3\n4,5\n6,7,8,9\n\n"x, ""y""",1,2\n')
    got = typed(read_text(spark, str(tmp_path)), T.StructType.fromDDL("b int, c int"))
    assert got.count() == 4 and {r.value for r in rejected(got).collect()} == {"4,5", "6,7,8,9"}
    assert {r.a for r in got.collect()} == {"1", "4", "6", 'x, "y"'}


def test_other_headers_raise(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,2\n")
    (tmp_path / "b.csv").write_text("b,a\n1,2\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_detections(spark, str(tmp_path), T.StructType.fromDDL("a int, b int")).collect()
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "x.csv").write_text(f"a,{REJECTS}\n1,2\n")
    with pytest.raises(ValueError):
        read_text(spark, str(tmp_path / "c"))


def test_quoted_line_breaks(spark, tmp_path):
    (tmp_path / "q.csv").write_text('a,b\n"x\ny",1\nz,2\n')
    assert [r.a for r in read_text(spark, str(tmp_path), multi_line=True).orderBy("b").collect()] == ["x\ny", "z"]


def test_csv_stream_scores_as_batch(spark, tmp_path):
    """Whole numbers written as "85.0", missing texts and bad fields score alike on both paths."""
    feats = ["scan", "track", "bright_t31", "frp", "confidence"]
    model = fit_linear(synthetic_detections(spark, 400, seed=3), feats, "brightness")
    lines = ["latitude,longitude,brightness,scan,track,bright_t31,frp,confidence,note", "-20,130,330,1.1,1.0,300,12,85.0,a", "-21,131,331,1.2,1.1,301,13,85,b",
             "-22,132,332,1.3,1.2,302,NA,81,c", "-23,133,333,oops,1.2,302,14,82,NaN", "-24,134,334,1.3,1.2,302,14,82.5,d", "-25,135,,1.3,1.2,302,14,200,e"]
    src = tmp_path / "src"
    src.mkdir()
    (src / "one.csv").write_text("\n".join(lines) + "\n")
    batch = score_frame(read_detections(spark, str(src)), model, feats, FORM_RANGES)
    stream = read_stream(spark, str(src), header_schema(spark, str(src), DETECTION_SCHEMA), "csv")
    out = str(tmp_path / "out")
    start_scoring(score_frame(stream, model, feats, FORM_RANGES), out, str(tmp_path / "ck"), available_now=True).awaitTermination()
    cols = [c for c in batch.columns if c != REJECTS]
    a, b = ({r.latitude: r for r in df.select(*cols).collect()} for df in (batch, spark.read.parquet(out)))
    assert a == b and len(a) == 6
    assert [a[k].prediction is not None for k in (-20.0, -21.0, -22.0, -23.0, -24.0, -25.0)] == [True, True, False, False, False, False]
    assert a[-20.0].confidence == 85 and infer_types(read_text(spark, str(src)))["confidence"].dataType == T.DoubleType()
