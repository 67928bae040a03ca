"""Exact neighbours by a tree of pivots, against all pairs."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from prepkit.operators import neighbours as NB

POINT = "g string, _n long, x array<double>, c array<long>"


def cloud(rng, n, dims=3):
    """Blobs, copies of one point, and far outliers."""
    middles = rng.normal(size=(8, dims)) * 10
    x = middles[rng.integers(0, 8, n)] + rng.normal(size=(n, dims))
    x[: n // 6] = x[0]
    x[n // 6: n // 6 + 5] *= 1000
    return x


def brute(rows, queries, k, penalty=0.0):
    out = set()
    for g, q, x, c in queries:
        d = sorted((sum((a - b) ** 2 for a, b in zip(x, y)) + penalty ** 2 * sum(a != b for a, b in zip(c, e)), m)
                   for h, m, y, e in rows if h == g and m != q)
        out |= {(q, rank, m) for rank, (_, m) in enumerate(d[:k], 1)}
    return out


@pytest.mark.parametrize("block", [60, 4000])
def test_nearest_equals_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(NB, "BLOCK", block)
    rng = np.random.default_rng(4)
    x = cloud(rng, 300)
    rows = [("ab"[i % 7 == 0], i, x[i].tolist(), [int(rng.integers(0, 3))]) for i in range(len(x))]
    rows += [("few", 900 + i, [float(i), 0.0, 0.0], [0]) for i in range(3)]
    base = spark.createDataFrame(rows, POINT).repartition(3)
    got = {(r["_n"], r["rank"], r["other"]) for r in NB.nearest(base, base, 4, 2.5).collect()}
    assert got == brute(rows, rows, 4, 2.5)
    new = [("a", 5000 + i, (rng.normal(size=3) * 12).tolist(), [1]) for i in range(40)] + [("none", 6000, [0.0] * 3, [0])]
    got = {(r["_n"], r["rank"], r["other"]) for r in NB.nearest(spark.createDataFrame(new, POINT), base, 5).collect()}
    assert got == brute(rows, new, 5)
    assert NB.nearest(base, base.limit(0), 3).count() == 0


def test_work_a_query_grows_slower_than_the_rows(spark, monkeypatch):
    """Four times the rows: a query visits hardly more leaves, though there are four times as many."""
    monkeypatch.setattr(NB, "BLOCK", 100)
    rng = np.random.default_rng(5)
    seen = {}
    for n in (800, 3200):
        rows = [("", i, x.tolist(), []) for i, x in enumerate(rng.normal(size=(n, 2)))]
        base = spark.createDataFrame(rows, POINT).repartition(4)
        tree, levels = NB._tree(base, 0.0)
        queries = NB._own_leaves(base.where("_n % 10 = 0"), levels, 5, 0.0)
        # the bound that the own leaf would give at best: the density sets it
        open_ = queries.withColumn("bound", F.least(F.lit(3.0 / n ** 0.5), "reach"))
        leaves = tree.select("cell").distinct().count()
        assert tree.groupBy("cell").count().agg(F.max("count")).first()[0] <= 100
        seen[n] = NB._visits(open_, levels, 0.0).count() / (n / 10), leaves
    assert seen[3200][1] > 3 * seen[800][1]
    assert seen[3200][0] < 2 * max(seen[800][0], 1.0), seen


def test_rows_that_ask_among_themselves_go_down_the_tree_once(spark, monkeypatch):
    """The rows know their leaf and reach from being dealt out: the same as going down again."""
    monkeypatch.setattr(NB, "BLOCK", 20)
    rng = np.random.default_rng(6)
    rows = [("ab"[i % 5 == 0], i, x.tolist(), [int(rng.integers(0, 3))]) for i, x in enumerate(cloud(rng, 400, 2))]
    base = spark.createDataFrame(rows, POINT).repartition(3)
    tree, levels = NB._tree(base, 1.0, 4)
    asked = NB._own_leaves(base, levels, 4, 1.0)
    assert len(levels) > 1 and asked.where("reach < double('inf')").count() > 300
    columns = ["g", "_n", "cell", "reach"]
    assert sorted(map(tuple, tree.select(columns).collect())) == sorted(map(tuple, asked.select(columns).collect()))


def test_a_block_holds_few_distances_at_once(monkeypatch):
    """Many queries against many rows: the matrix of all distances is never there."""
    seen = []

    def square(x, c, y, d, penalty, plain=NB.squared):
        seen.append(len(x) * len(y))
        return plain(x, c, y, d, penalty)

    monkeypatch.setattr(NB, "squared", square)
    rng = np.random.default_rng(7)
    x = rng.integers(0, 40, (1500, 1)).astype(float)
    rows = pa.table({"_n": pa.array(range(len(x))), "x": pa.array(x.tolist()), "c": pa.array([[]] * len(x), pa.list_(pa.int64()))})
    got = {tuple(r.values())[:2] for r in NB.block_nearest(rows.slice(0, 200), rows.take(rng.permutation(len(x))), 3, 0.0).to_pylist()}
    points = [("", i, [float(v[0])], []) for i, v in enumerate(x)]
    assert got == {(q, other) for q, _, other in brute(points, points[:200], 3)}
    assert max(seen) <= NB.CHUNK < 200 * len(x)
