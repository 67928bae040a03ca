"""SMOTER: relevance, runs and new rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from prepkit.operators import balance as B
from prepkit.operators import smoter as S


def table(spark, n=300, seed=1):
    rnd = random.Random(seed)
    rows = [(i, rnd.gauss(50, 5), rnd.randrange(1, 100), rnd.choice("ab"), rnd.gauss(0, 1)) for i in range(n)]
    rows += [(n + i, 120 + rnd.gauss(0, 3), rnd.randrange(1, 100), rnd.choice("bcd"), rnd.gauss(5, 1)) for i in range(12)]
    rows += [(n + 20 + i, -30 + rnd.gauss(0, 3), rnd.randrange(1, 100), "z", rnd.gauss(-5, 1)) for i in range(5)]
    rows += [(n + 30, None, 1, "a", 0.0), (n + 31, float("nan"), 1, "a", 0.0)]
    return spark.createDataFrame(rows, "id long, ` y ` double, w int, c string, x double").repartition(4)


def test_relevance_is_flat_at_the_points_and_monotone(spark):
    points = [(0.0, 1.0), (10.0, 0.0), (30.0, 1.0)]
    values = [-5.0, 0.0, 2.5, 5.0, 7.5, 10.0, 15.0, 20.0, 25.0, 30.0, 99.0]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    got = [r[0] for r in df.select(S.relevance(F.col("v"), points)).collect()]
    assert got[-1] is None and got[:-1] == pytest.approx([1, 1, 0.84375, 0.5, 0.15625, 0, 0.15625, 0.5, 0.84375, 1, 1])


def test_runs_equal_a_walk_along_the_sorted_target(spark):
    df = table(spark).withColumnRenamed(" y ", "y").where("y is not null and not isnan(y)")
    points = S.control_points(df, "y")
    y = sorted(r["y"] for r in df.collect())
    q1, mid, q3 = np.quantile(y, [0.25, 0.5, 0.75])
    reach = 1.5 * (q3 - q1)
    assert [p for _, p in points] == [1.0, 0.0, 1.0]
    assert [v for v, _ in points] == pytest.approx([min(v for v in y if v >= q1 - reach), mid, max(v for v in y if v <= q3 + reach)])

    def phi(v):
        (a, _), (m, _), (b, _) = points
        if v <= a or v >= b:
            return 1.0
        s = (v - a) / (m - a) if v < m else (v - m) / (b - m)
        return 1 - s * s * (3 - 2 * s) if v < m else s * s * (3 - 2 * s)

    walk = []
    for v in y:
        if not walk or walk[-1][0] != (phi(v) >= 0.5):
            walk.append([phi(v) >= 0.5, 0])
        walk[-1][1] += 1
    runs = S.target_runs(df, "y", points)
    assert [[r.rare, r.n] for r in runs] == walk
    assert {r.want for r in runs} == {round(len(y) / len(walk))}


def test_new_rows(spark):
    df = table(spark)
    out = B.balance(df, " y ", "smoter", row_id=["id"])
    assert out.columns == ["id", "y", "w", "c", "x"]
    rows = out.collect()
    base = {r["id"]: r for r in df.withColumnRenamed(" y ", "y").where("` y ` is not null and not isnan(` y `)").collect()}
    old, new = [r for r in rows if r["id"] is not None], [r for r in rows if r["id"] is None]
    runs = S.target_runs(df.withColumnRenamed(" y ", "y").where("y is not null and not isnan(y)"), "y",
                         S.control_points(df.withColumnRenamed(" y ", "y").where("not isnan(y)"), "y"))
    assert len(rows) == sum(r.want for r in runs)
    assert all(tuple(r) == tuple(base[r["id"]]) for r in old) and len({r["id"] for r in old}) == len(old)
    assert len(new) == sum(r.want - r.n for r in runs if r.want > r.n)
    for run in runs:
        mine = [r for r in old if run.low <= r["y"] <= run.high]
        assert len(mine) == min(run.want, run.n)
    # features of new rows stay near those of their run, whole numbers whole and positive ones so, categories known
    rare = [[b for b in base.values() if run.low <= b["y"] <= run.high] for run in runs if run.rare]
    assert len(rare) == 2
    for r in new:
        mine = min(rare, key=lambda bs: min(abs(b["y"] - r["y"]) for b in bs))
        assert r["c"] in {b["c"] for b in mine} and isinstance(r["w"], int) and r["w"] >= 0
        assert min(b["x"] for b in mine) - 1 <= r["x"] <= max(b["x"] for b in mine) + 1
        assert min(b["y"] for b in mine) - 1 <= r["y"] <= max(b["y"] for b in mine) + 1
    # the draws are hashes: another layout gives the same rows
    again = B.balance(df.repartition(7), " y ", "smoter", row_id=["id"]).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_nothing_rare_gives_the_table_back(spark):
    df = spark.createDataFrame([(i, str(float(i)) if i else "no number") for i in range(20)], "id long, y string")
    out = S.smoter(df, "y", row_id=["id"])
    assert sorted(r["y"] for r in out.collect()) == [float(i) for i in range(1, 20)]
    assert S.smoter(df.limit(0), "y").count() == 0


def test_a_rare_run_of_one_row(spark):
    rows = [(i, 1.0, float(i % 5)) for i in range(60)] + [(99, 50.0, 3.0)]
    out = S.smoter(spark.createDataFrame(rows, "id long, y double, x double"), "y", row_id=["id"]).collect()
    assert len(out) == 2 * round(61 / 2)
    assert all(math.isfinite(r["y"]) and r["x"] == 3.0 for r in out if r["id"] is None)


def test_the_order_of_the_rows_is_hashed_once_a_row(spark, monkeypatch):
    """The sort compares a column, not the md5 of both rows anew."""
    from prepkit.functions import numbering

    seen = []
    plain = numbering.global_row_number
    monkeypatch.setattr(numbering, "global_row_number", lambda df, order, **kw: seen.append(order) or plain(df, order, **kw))
    df = table(spark)
    B.balance(df, " y ", "smoter", row_id=["id"])
    B.random_oversample(df, "c", row_id=["id"])
    assert len(seen) == 2 and not any("md5" in str(o) for order in seen for o in order)
