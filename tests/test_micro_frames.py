"""Hand-computed micro-frames for the semantic traps."""

import math

import pytest
from pyspark.sql import functions as F

from prepkit.operators import profile as P
from prepkit.operators.transforms import apply_templates
from prepkit.operators.balance import quantile_bin_oversample


def one_col(spark, vals, typ="double"):
    return spark.createDataFrame([(v,) for v in vals], f"x {typ}")


def test_skew_kurt(spark):
    r = P.univariate_numerical(one_col(spark, [1.0, 2.0, 3.0, 4.0, 10.0])).first()
    assert math.isclose(r["skewness"], 1.6970562748, rel_tol=1e-9)
    assert math.isclose(r["kurtosis"], 3.152, rel_tol=1e-9)
    assert math.isclose(r["std"], 3.5355339059, rel_tol=1e-9)


def test_constant_and_single(spark):
    r = P.univariate_numerical(one_col(spark, [1.0, 1.0, 1.0, 1.0])).first()
    assert r["std"] == 0 and r["skewness"] == 0 and r["kurtosis"] == 0
    r = P.univariate_numerical(one_col(spark, [5.0])).first()
    assert r["std"] is None and r["skewness"] == 0
    out = apply_templates(one_col(spark, [1.0, 1.0]), [{"column_name": "x", "fe_method": "standardization"}])
    assert [row["x_standardized"] for row in out.collect()] == [None, None]


def test_nan_is_missing(spark):
    df = one_col(spark, [1.0, float("nan"), 3.0, None])
    r = P.univariate_numerical(df).first()
    assert r["count"] == 2 and r["mean"] == 2.0
    m = P.missing_values(df).first()
    assert m["missing_count"] == 2 and m["missing_pct"] == 50.0


def test_empty_and_all_null(spark):
    assert P.univariate_numerical(one_col(spark, [])).count() == 0
    assert P.univariate_numerical(one_col(spark, [None, None])).count() == 0
    assert P.outliers(one_col(spark, [None, None])).count() == 0


def test_ties_mode_topk(spark):
    df = one_col(spark, ["1", "1", "2", "2", None], "string")
    r = P.univariate_categorical(df).first()
    assert r["mode"] == "1" and r["mode_count"] == 2 and r["unique_count"] == 2
    top = [(t["rank"], t["value"]) for t in P.top_values(df).orderBy("rank").collect()]
    assert top == [(1, "1"), (2, "2")]


def test_clip_keeps_null(spark):
    df = one_col(spark, [None, -5.0, 5.0, 500.0])
    out = apply_templates(df, [{"column_name": "x", "fe_method": "clip_outliers"}])
    got = sorted((r["x_clipped"] for r in out.collect()), key=lambda v: (v is None, v))
    assert got == [0.0, 5.0, 100.0, None]


def test_text_templates(spark):
    df = one_col(spark, ["\t a ", "", "ab12c3", "123456789012345678901234"], "string")
    out = apply_templates(df, [{"column_name": "x", "fe_method": "trim"},
                               {"column_name": "x", "fe_method": "string_length"},
                               {"column_name": "x", "fe_method": "extract_numbers"}])
    rows = {r["x"]: r for r in out.collect()}
    assert rows["\t a "]["x_trimmed"] == "a"
    assert rows["\t a "]["x_length"] == 4
    assert rows[""]["x_number"] is None
    assert rows["ab12c3"]["x_number"] == 12
    assert rows["123456789012345678901234"]["x_number"] is None


def test_truthy(spark):
    df = spark.createDataFrame([("Yes",), ("TRUE",), ("1",), ("no",), (None,)], "x string")
    out = apply_templates(df, [{"column_name": "x", "fe_method": "binary_encoding"}])
    assert sorted(r["x_binary"] for r in out.collect()) == [0, 0, 1, 1, 1]
    dfd = one_col(spark, [1.0, 0.0])
    out = apply_templates(dfd, [{"column_name": "x", "fe_method": "binary_encoding"}])
    assert sorted(r["x_binary"] for r in out.collect()) == [0, 1]


def test_qcut_duplicate_edges(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([1, 1, 1, 1, 2, 3])], "id long, x double")
    out = quantile_bin_oversample(df, "x", q=4, row_id=["id"])
    # edges 1,1,1.25,1.75,3 -> distinct 1,1.25,1.75,3 -> bins sizes 4,0,2 -> 4+? top-up to 4
    assert out.count() == 8
