"""Scale invariants: exact numbering and quantiles at any partition count,
no single-partition exchange, no Python UDF in the hot path."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from prepkit.functions import radix
from prepkit.functions.numbering import global_row_number, rank_within_group
from prepkit.functions.stats import exact_quantiles, unpivot_values
from prepkit.operators.balance import random_oversample, random_undersample
from prepkit.operators.transforms import apply_templates
from prepkit.sources import fixtures as FX

from folders import SF, SF01


@pytest.mark.parametrize("parts", [1, 4, 64])
def test_global_row_number_matches_window(spark, parts):
    o = spark.read.parquet(f"{SF01}/orders.parquet").select("o_orderkey", "o_totalprice")
    got = global_row_number(o, ["o_totalprice", "o_orderkey"], num_partitions=parts)
    exp = {r["o_orderkey"]: i + 1 for i, r in enumerate(o.orderBy("o_totalprice", "o_orderkey").collect())}
    assert {r["o_orderkey"]: r["rn"] for r in got.collect()} == exp


def test_rank_within_skewed_group(spark):
    # one class holds almost everything
    df = spark.range(0, 5000).withColumn("c", F.when(F.col("id") < 4990, "hot").otherwise("cold"))
    r = rank_within_group(df, ["c"], ["id"], name="r")
    got = {(x["c"], x["r"]) for x in r.collect()}
    assert len(got) == 5000
    assert max(x[1] for x in got if x[0] == "hot") == 4990


def test_quantiles_equal_numpy(spark):
    li = spark.read.parquet(f"{SF01}/lineitem.parquet")
    cols, probs = ["l_extendedprice", "l_quantity"], [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]
    long = unpivot_values(li, cols)
    got, disc = exact_quantiles(long, probs), exact_quantiles(long, [0.5], discrete=True)
    for c in cols:
        v = np.sort(np.array([r[0] for r in li.select(c).collect()], float))
        assert got[c] == pytest.approx(np.quantile(v, probs).tolist(), rel=1e-12)
        assert disc[c] == [v[math.ceil(len(v) / 2) - 1]]


def test_radix_image_keeps_the_order(spark):
    rng = np.random.default_rng(1)
    ends = [0.0, -0.0, math.inf, -math.inf, 5e-324, -5e-324, 1.7976931348623157e308, 1e-310]
    powers = [x for e in range(-1074, 1024, 41) for p in [math.ldexp(1.0, e)] for x in (p, -p, np.nextafter(p, 0), np.nextafter(p, np.inf))]
    values = [*ends, *powers, *(rng.normal(size=400) * 1e-300), *rng.normal(size=400), *(rng.normal(size=100) * 1e-320)]
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    rows = df.selectExpr("v", f"bigint({radix.coarse('v')}) as h", f"{radix.significand('v')} as l").collect()
    rows.sort(key=lambda r: r["v"])
    keys = [(r["h"], r["l"]) for r in rows]
    assert keys == sorted(keys)
    assert all((a == b) == (x["v"] == y["v"]) for a, b, x, y in zip(keys, keys[1:], rows, rows[1:]))


def test_quantiles_of_many_groups_and_null_keys(spark):
    """Ranks per group as tables: groups of one row, of equal values, a hot group and a null group."""
    rng = np.random.default_rng(3)
    rows = [(int(g), float(v)) for g, v in zip(rng.integers(0, 300, 3000), rng.normal(size=3000).round(2))]
    rows += [(999, float(v)) for v in rng.normal(size=5000)] + [(None, 1.0), (None, 3.0), (1000, None), (1001, 7.0)] + [(1002, 5.0)] * 50
    df = spark.createDataFrame(rows, "g int, v double").repartition(5)
    got = {r["g"]: r["q"] for r in radix.quantile_table(df, ["g"], [0.1, 0.5, 0.99], lower=[0.5]).collect()}
    want = {}
    for g, v in rows:
        if v is not None:
            want.setdefault(g, []).append(v)
    assert set(got) == set(want)
    for g, v in want.items():
        v = np.sort(v)
        assert got[g] == pytest.approx([*np.quantile(v, [0.1, 0.5, 0.99]), v[math.ceil(len(v) / 2) - 1]], rel=1e-12)
    by_rank = radix.rank_values(df, ["g"], spark.createDataFrame([(999, 0), (999, 4999), (999, 5000), (1001, 0)], "g int, rank long"))
    hot = np.sort(want[999])
    assert sorted(map(tuple, by_rank.collect())) == [(999, 5000, 0, hot[0], 0, 1), (999, 5000, 4999, hot[-1], 4999, 1), (1001, 1, 0, 7.0, 0, 1)]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_templates_have_no_single_partition_or_udf(spark):
    li = FX.li_nulls(spark, SF)
    out = apply_templates(li, [{"column_name": "l_quantity", "fe_method": "standardization"},
                               {"column_name": "l_quantity", "fe_method": "robust_scaling"},
                               {"column_name": "l_returnflag", "fe_method": "frequency_encoding"}])
    plan = _plan(out)
    assert "SinglePartition" not in plan
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_balancing_layout_independent(spark):
    d = FX.doc_binary(spark, SF01)
    res = []
    for parts in ("2", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        res.append(sorted(tuple(r) for r in random_oversample(d, "target", row_id=["doc_id"]).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert res[0] == res[1]
    counts = {}
    for r in res[0]:
        counts[r[-1]] = counts.get(r[-1], 0) + 1
    assert len(set(counts.values())) == 1


def test_undersample_counts(spark):
    d = FX.doc_binary(spark, SF01)
    out = random_undersample(d, "target", row_id=["doc_id"])
    c = {r["target"]: r["count"] for r in out.groupBy("target").count().collect()}
    assert len(set(c.values())) == 1


def test_cluster_oversample_invariants(spark):
    from prepkit.operators.balance import cluster_oversample
    d = FX.doc_binary(spark, SF01)
    out = cluster_oversample(d, "target", row_id=["doc_id"])
    c = {r["target"]: r["count"] for r in out.groupBy("target").count().collect()}
    assert len(set(c.values())) == 1
    # every produced row is a copy of an input row
    assert out.join(d, list(d.columns), "left_anti").count() == 0


def test_train_save_reload(spark, tmp_path):
    from prepkit.operators import model as M
    d = FX.doc_numeric(spark, SF01)
    res = M.train(d, "target", "logistic_regression", row_id=["doc_id"])
    m = res.metrics.first()
    assert 0.0 <= m["accuracy"] <= 1.0 and m["fit_status"] in ("good_fit", "overfitting", "underfitting")
    path = f"/tmp/prepkit-model-{tmp_path.name}"
    M.save_model(res, path)
    again = M.load_model(path)
    a = sorted((r["doc_id"], r["prediction"]) for r in res.model.transform(
        res.predictions.select("doc_id", "n_chars", "quality")).collect())
    b = sorted((r["doc_id"], r["prediction"]) for r in again.transform(
        res.predictions.select("doc_id", "n_chars", "quality")).collect())
    assert a == b


def test_independent_draws_take_as_many_exchanges_whatever_the_columns(spark):
    from prepkit.operators.balance import kde_resample
    plans = []
    for n in (2, 9):
        df = spark.range(50).select("id", *[(F.col("id") * k).cast("double").alias(f"c{k}") for k in range(1, n)])
        out = kde_resample(df, "c1", row_id=["id"])
        assert out.columns == df.columns and out.count() == 50
        plans.append(_plan(out).count("Exchange"))
    assert plans[0] == plans[1]


def test_rows_are_not_dealt_by_the_levels_of_a_column(spark):
    """Level tables of few levels are broadcast: a column of three levels does not bring the table to three tasks."""
    from prepkit.functions.numbering import small_levels
    from prepkit.plans.feature_plan import FeaturePlan
    li = FX.li_nulls(spark, SF)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        steps = [{"column_name": c, "fe_method": m} for c, m in (
            ("l_returnflag", "label_encoding"), ("l_linestatus", "frequency_encoding"), ("l_shipdate", "target_encoding"))]
        out = FeaturePlan(steps, target_column="l_linenumber").fit(li).transform(li)
        target = [{**s, "target_column": "l_quantity"} for s in steps]
        for df in (out, apply_templates(li, target)):
            plan = _plan(df)
            assert "hashpartitioning(" not in plan and plan.count("BroadcastHashJoin") >= 3
            assert df.count() == li.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    long = spark.range(40).select(F.repeat(F.lit("x"), 1 << 20).alias("_key"), F.col("id").alias("_code"))
    assert "broadcast" not in small_levels(long)._jdf.queryExecution().logical().toString()
