"""Embedding near-dedup against all pairs."""

import math

import duckdb
import numpy as np
import pytest

from prepkit.llm import vector_dedup as V

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, digest string, part int"


def brute(rows, threshold=0.93):
    """[(vec_id, n_links, component_id, kept)] by comparing all rows."""
    ok = [label is not None and e is not None and all(v is not None and math.isfinite(v) for v in e) and any(e) for _, e, label in rows]
    unit = [np.float32(e).astype(float) / max(np.linalg.norm(np.float32(e).astype(float)), 1e-300) if o else None for o, (_, e, _) in zip(ok, rows)]
    near = [[j for j in range(len(rows)) if j != i and ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j])
             and unit[i] @ unit[j] >= threshold] for i in range(len(rows))]
    out = []
    for i, (me, _, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        least = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((me, len(near[i]), least, me == least))
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(i, e, label, "d", 1) for i, e, label in rows], SCHEMA).repartition(3)


def got(df, **kw):
    out = V.vector_dedup(df, **kw)
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


def planted(rng, n, dims=64, low=0.90, high=0.999):
    """n random directions, each third one with a partner at a cosine between low and high."""
    out = []
    for i in range(n):
        x = rng.normal(size=dims)
        x /= np.linalg.norm(x)
        out.append(x)
        if i % 3 == 0:
            y = rng.normal(size=dims)
            y -= (y @ x) * x
            y /= np.linalg.norm(y)
            c = rng.uniform(low, high)
            out.append(c * x + math.sqrt(1 - c * c) * y)
    return out


@pytest.mark.parametrize("block", [7, 2048])
def test_odd_vectors(spark, block):
    rng = np.random.default_rng(2)
    rows = [(i, (v * rng.uniform(0.1, 50)).tolist(), i % 2) for i, v in enumerate(planted(rng, 40, dims=16))]
    base = rng.normal(size=16)
    rows += [(1000 + i, (base + rng.normal(size=16) * 0.05).tolist(), 0) for i in range(40)]      # a group of near copies
    rows += [(2000 + i, base.tolist(), 0) for i in range(30)]                                     # copies
    rows += [(5, rows[5][1], rows[5][2]), (5, rows[6][1], rows[6][2]), (None, base.tolist(), 0), (None, [1.0] * 16, 1), (None, [1.0] * 16, 1),
             (3000, None, 0), (3001, [], 0), (3002, [0.0] * 16, 0), (3003, [0.0] * 16, 0), (3004, [float("nan")] + [1.0] * 15, 0),
             (3005, [None] + [1.0] * 15, 0), (3006, [float("inf")] * 16, 0), (3007, base.tolist(), None), (3008, base.tolist(), None),
             (3009, base.tolist() + [0.0], 0), (3010, (base * 2).tolist() + [0.0], 0), (3011, [3e38] * 16, 0), (3012, [1e-38] * 16, 0),
             (3013, base.tolist()[:3], 0), (3014, (2 * base).tolist()[:3], 0), (3015, [0.0, -0.0, 1.0], 1), (3016, [-0.0, 0.0, 2.0], 1)]
    want = [(i, n, c, True if i is None and c is None else k) for i, n, c, k in brute(rows)]
    # margin: sqrt(2 - 2 * 0.93) finds all links
    assert got(frame(spark, rows), block=block, cells=6, margin=0.375) == want


def test_none(spark):
    assert got(frame(spark, [])) == []
    assert got(frame(spark, [(1, None, 0), (2, [0.0], 1), (None, [1.0], None)])) == [(1, 0, 1, True), (2, 0, 2, True), (None, 0, None, True)]


def test_recall_and_no_false_links(spark):
    """With the margin of the query: nine links of ten at least among pairs near the threshold, none below it."""
    rng = np.random.default_rng(5)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(planted(rng, 1500, low=0.931, high=0.95))]
    want = {i: n for i, n, _, _ in brute_links(rows)}
    have = {i: n for i, n, _, _ in got(frame(spark, rows), cells=24)}
    assert all(have[i] <= want[i] for i in want)
    assert sum(have.values()) >= 0.9 * sum(want.values()) > 0
    print("recall", sum(have.values()) / sum(want.values()))


def brute_links(rows):
    x = np.array([r[1] for r in rows], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    n = (x @ x.T >= 0.93).sum(1) - 1
    return [(r[0], int(k), None, None) for r, k in zip(rows, n)]


def test_twin(table):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF}/embeddings.parquet')")
    rel = con.sql(V.oracle_sql())
    assert got(table("embeddings")) == sorted(rel.select("vec_id, n_links, component_id, kept").fetchall(), key=repr)
