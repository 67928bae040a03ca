"""One column per level, or one sparse vector."""

import pytest

from prepkit.operators.transforms import TemplateSet, apply_templates, level_columns
from prepkit.plans.feature_plan import FeaturePlan


def test_different_levels_have_different_columns(spark):
    df = spark.createDataFrame([("a b",), ("a_b",), ("c",), (None,)], "c string")
    out = apply_templates(df, [{"column_name": "c", "fe_method": "dummies"}])
    assert len(set(out.columns)) == 4 and "c_c" in out.columns
    assert all(sum(r[1:]) == (r[0] is not None) for r in out.collect())
    assert level_columns(["x", "y z"]) == ["x", "y_z"]


def test_both_ways_refuse_too_many_columns(spark):
    df = spark.range(30).selectExpr("concat('k', id) as c")
    ask = {"column_name": "c", "fe_method": "dummies", "max_levels": 20}
    with pytest.raises(ValueError, match="more than 20"):
        TemplateSet([ask]).fit(df)
    with pytest.raises(ValueError, match="more than 20"):
        FeaturePlan([ask]).fit(df)


def test_sparse_dummies_of_many_levels(spark):
    df = spark.range(20_000).selectExpr("concat('k', lpad(id, 6, '0')) as c")
    fitted = TemplateSet([{"column_name": "c", "fe_method": "dummies", "sparse": True}]).fit(df)
    new = spark.createDataFrame([("k000000",), ("k019999",), ("k000123",), ("new",), (None,)], "c string")
    got = {r["c"]: r["c_dummies"] for r in fitted.transform(new).collect()}
    assert {c: (v.size, v.indices.tolist(), v.values.tolist()) for c, v in got.items()} == {
        "k000000": (20_000, [0], [1.0]), "k019999": (20_000, [19_999], [1.0]), "k000123": (20_000, [123], [1.0]),
        "new": (20_000, [], []), None: (20_000, [], [])}
