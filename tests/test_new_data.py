"""Fitted objects on data that the fit has not seen, infinities, raw rows, techniques by name."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from prepkit.functions.radix import quantile_table
from prepkit.functions.stats import exact_quantiles
from prepkit.operators import balance as B
from prepkit.operators import model as M
from prepkit.operators import neighbours as NB
from prepkit.operators.transforms import TemplateSet
from prepkit.plans.feature_plan import FeaturePlan
from prepkit.sources import fixtures as FX
from prepkit.sources import io

from folders import SF, SF01


def test_unseen_levels_keep_their_rows(spark):
    fit = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("a", 2.0)], "c string, y double")
    new = spark.createDataFrame([("a", 0.0), ("zz", 0.0), (None, 0.0)], "c string, y double")
    spec = TemplateSet([{"column_name": "c", "fe_method": m, "target_column": "y"}
                        for m in ("label_encoding", "frequency_encoding", "target_encoding", "hash_encoding")])
    got = {r["c"]: r for r in spec.fit(fit).transform(new).collect()}
    assert len(got) == 3
    assert (got["a"].c_encoded, got["a"].c_freq, got["a"].c_target_encoded) == (0, 2, 1.5)
    assert (got["zz"].c_encoded, got["zz"].c_freq, got["zz"].c_target_encoded) == (None, None, None)
    assert got["zz"].c_hash is not None and got[None].c_hash is None


def test_plan_on_odd_names_and_methods(spark):
    df = spark.createDataFrame([(1.0, "x"), (None, "y"), (3.0, None)], "`has space` double, c string")
    plan = FeaturePlan([{"column_name": "has space", "fe_method": "binary_encoding"}, {"column_name": "c", "fe_method": "hashing"},
                        {"column_name": "c", "fe_method": "bogus"}, {"column_name": "has space", "fe_method": "binning"}])
    assert sorted(s["reason"].split()[0] for s in plan.skipped) == ["Unknown", "binning"]
    rows = plan.fit(df).transform(df).collect()
    assert [r.has_space_encoded for r in rows] == [1, 0, 0]
    assert [r.c_encoded is None for r in rows] == [False, False, True]


def test_quantiles_with_infinities_and_heavy_tails(spark):
    values = [float("inf"), float("-inf")] + [math.exp(i / 10) for i in range(-300, 600)] + [5.0] * 300
    df = spark.createDataFrame([("k", v) for v in values], "k string, v double")
    probs = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    ordered = sorted(values)
    want = [ordered[max(math.ceil(len(ordered) * p) - 1, 0)] for p in probs]
    assert exact_quantiles(df, probs, discrete=True)["k"] == want
    finite = df.where("abs(v) < 1e300")
    got = quantile_table(finite, ["k"], [0.25, 0.5]).first()["q"]
    assert got == pytest.approx(np.quantile([v for v in values if abs(v) < 1e300], [0.25, 0.5]).tolist(), rel=1e-12)


def test_saved_model_scores_raw_rows(spark, tmp_path):
    d = FX.doc_numeric(spark, SF01)
    res = M.train(d, "target", "logistic_regression", row_id=["doc_id"])
    assert "doc_id" not in res.scaler
    M.save_model(res, f"{tmp_path}/m")
    again = {r.doc_id: r.prediction for r in M.load_model(f"{tmp_path}/m").transform(d).collect()}
    assert again == {r.doc_id: r.prediction for r in res.predictions.collect()}
    assert res.predictions.join(d, ["doc_id", "n_chars"]).count() == d.count()


def test_missing_features_are_an_error_unless_filled(spark):
    df = spark.range(60).select(F.col("id"), F.when(F.col("id") % 7 != 0, F.col("id") * 1.0).alias("x"), (F.col("id") % 2).alias("y"))
    with pytest.raises(Exception):
        M.train(df, "y", "logistic_regression", row_id=["id"]).predictions.collect()
    assert M.train(df, "y", "logistic_regression", row_id=["id"], fill_missing=0.0).predictions.count() == 60


def test_knn_model(spark):
    rows = [(i, float(i % 2) * 10 + (i % 5) * 0.1, i % 2) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, x double, y int")
    res = M.train(df, "y", "knn", row_id=["id"])
    assert res.metrics.first()["accuracy"] == 1.0


def test_auc_does_not_overflow(spark):
    p = spark.createDataFrame([(1.0, 0.9), (0.0, 0.1), (1.0, 0.4), (0.0, 0.4)], "label double, score double")
    assert M.roc_auc(p).first()[0] == pytest.approx(0.875)


def test_cluster_oversample_reaches_the_majority(spark):
    rows = [(i, "a" if i < 50 else "b", "same", f"level{i}") for i in range(56)]
    df = spark.createDataFrame(rows, "id long, t string, f string, many string")
    for cols in (["id", "t", "f"], ["id", "t", "f", "many"]):
        out = B.cluster_oversample(df.select(*cols), "t", row_id=["id"])
        assert {r["t"]: r["count"] for r in out.groupBy("t").count().collect()} == {"a": 50, "b": 50}


def test_noise_of_equal_rows_differs(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (1.0,), (5.0,)], "y double")
    assert len({r.y for r in B.gaussian_noise(df, "y").collect()}) == 4


def test_one_row_class_with_very_many_draws(spark, monkeypatch):
    monkeypatch.setattr(B, "DRAWS_PER_ROW", 50)
    monkeypatch.setattr(B, "DRAW_CHUNK", 100)
    df = spark.range(2001).select("id", F.when(F.col("id") == 0, "rare").otherwise("hot").alias("t"))
    out = B.random_oversample(df, "t", row_id=["id"])
    assert {r["t"]: r["count"] for r in out.groupBy("t").count().collect()} == {"rare": 2000, "hot": 2000}


def test_techniques_are_checked_against_the_target(spark):
    d, e = FX.doc_binary(spark, SF), FX.event_tail(spark, SF)
    with pytest.raises(ValueError):
        B.balance(d, "target", "KDE-based resampling", row_id=["doc_id"])
    with pytest.raises(ValueError):
        B.balance(e, "value", "smote", row_id=["event_id"])
    with pytest.raises(ValueError):
        B.balance(e, "value", "no such thing")
    with pytest.raises(ValueError):
        B.balance(d, "target", "smoter", row_id=["doc_id"])


@pytest.mark.parametrize("block", [7, 4000])
def test_nearest_is_exact_whatever_the_blocks(spark, monkeypatch, block):
    import numpy as np
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(300, 2)) * np.array([1, 5]), 1)
    cat = rng.integers(0, 3, 300)
    group = rng.integers(0, 2, 300)
    rows = [(i, float(a), float(b), f"c{k}", f"g{g}") for i, ((a, b), k, g) in enumerate(zip(x, cat, group))]
    df = spark.createDataFrame(rows, "_n long, a double, b double, k string, g string")
    monkeypatch.setattr(NB, "BLOCK", block)
    monkeypatch.setattr(NB, "QUERIES", 11)
    pts = NB.points(df, ["a", "b"], ["k"], "g")
    got = {(r._n, r["rank"]): (r.other, r.d2) for r in NB.nearest(pts, pts, 4, penalty=0.7).collect()}
    d = ((x[:, None, 0] - x[None, :, 0]) ** 2 + (x[:, None, 1] - x[None, :, 1]) ** 2) + 0.49 * (cat[:, None] != cat[None, :])
    for i in range(300):
        order = sorted((d[i, j], j) for j in range(300) if j != i and group[j] == group[i])[:4]
        for rank, (dist, j) in enumerate(order, 1):
            assert got[i, rank][1] == pytest.approx(dist)
            assert got[i, rank][0] == j or d[i, got[i, rank][0]] == pytest.approx(dist)


def test_synthetic_rows(spark):
    d = FX.doc_binary(spark, SF01)
    out = NB.smotenc(d, "target", row_id=["doc_id"])
    counts = {r["target"]: r["count"] for r in out.groupBy("target").count().collect()}
    assert len(set(counts.values())) == 1
    new = out.where("doc_id IS NULL").collect()
    langs = {r.lang for r in d.collect()}
    assert new and all(r.lang in langs and r.n_chars > 0 for r in new)
    one = spark.createDataFrame([(1, 2.0, 1), (2, 3.0, 1)], "id long, x double, y int")
    assert NB.smote(one, "y", row_id=["id"]).count() == 2
    lone = one.unionByName(spark.createDataFrame([(3, 9.0, 0)], "id long, x double, y int"))
    assert [r.x for r in NB.smote(lone, "y", row_id=["id"]).where("id IS NULL").collect()] == [9.0]


def test_status_log(spark, tmp_path):
    path = f"{tmp_path}/status"
    for status in ("running", "done"):
        io.upsert_status(spark, path, "lineitem", "eda", status)
    rows = io.latest_status(spark.read.parquet(path)).collect()
    assert [(r.table_name, r.phase, r.status) for r in rows] == [("lineitem", "eda", "done")]
