"""The reference's own assertions, re-expressed."""

from prepkit.functions.columns import sanitize_column_name, validate_column_name
from prepkit.operators.transforms import REGISTRY, resolve_template
from prepkit.plans.feature_plan import FeaturePlan


def test_valid_names():
    assert validate_column_name("age")
    assert validate_column_name("column_name")
    assert not validate_column_name("123invalid")
    assert not validate_column_name("has space")


def test_sanitize():
    assert sanitize_column_name("has space") == "has_space"
    assert sanitize_column_name("123start") == "_123start"


def test_plan_output_names(spark):
    plan = FeaturePlan([{"column_name": "age", "fe_method": "standardization"},
                        {"column_name": "salary", "fe_method": "median_imputation"}],
                       target_column="target")
    rows = {r["original_column"]: r["output_column"] for r in plan.lineage(spark).collect()}
    assert rows == {"age": "age_scaled", "salary": "salary_imputed", "target": "target"}


def test_plan_rejects_empty():
    import pytest
    with pytest.raises(ValueError):
        FeaturePlan([{"column_name": "", "fe_method": ""}])


def test_registry_aliases():
    # every natural-language alias resolves, blanks/hyphens normalised
    assert resolve_template("Logarithmic Transformation") == "log_transformation"
    assert resolve_template("one-hot encoding") == "one_hot_encoding"
    assert resolve_template("IQR method") == "clip_iqr"
    assert resolve_template("z-score normalization") == "standardization"
    # 31 templates + the one-hot-as-hash variant + true dummies
    assert len(set(REGISTRY.values())) == 33
