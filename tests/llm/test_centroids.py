"""Centroid clustering against plain Lloyd rounds in Python integers."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from prepkit.llm import centroids as C

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, cluster string, x int"


def lloyd(rows, k=8, rounds=10, dims=64):
    kept = [(i, [math.floor(1024 * float(np.float32(v))) for v in e]) for i, e in rows
            if e is not None and len(e) == dims and all(v is not None and math.isfinite(v) for v in e)]

    def start(r):
        return (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])

    cent = [x for _, x in sorted(kept, key=start)[:k]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(cent))

    for _ in range(rounds):
        groups = {}
        for _, x in kept:
            groups.setdefault(nearest(x)[1], []).append(x)
        for j, xs in groups.items():
            cent[j] = [sum(col) // len(xs) for col in zip(*xs)]
    final = [(i, *nearest(x)) for i, x in kept]
    inertia = {}
    for _, d, j in final:
        inertia[j] = inertia.get(j, 0) + d
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, cent[j])).encode()).hexdigest())
                   for i, d, j in final), key=repr)


def got(spark, rows, **kw):
    df = spark.createDataFrame([(i, e, "c", 1) for i, e in rows], SCHEMA).repartition(3)
    out = C.centroid_clustering(df, **kw)
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


def test_odd_vectors(spark):
    rnd = random.Random(4)
    near = [[rnd.choice([-0.5, 0.0, 0.25, 1.0]) for _ in range(64)] for _ in range(12)]
    rows = [(i, [v + rnd.gauss(0, 0.05) for v in near[i % 12]]) for i in range(150)]
    rows += [(i, [0.25] * 64) for i in range(200, 260)]                   # copies
    rows += [(7, rows[7][1]), (8, [0.0] * 64), (None, [1.5] * 64), (None, [1.5] * 64)]
    rows += [(300, None), (301, []), (302, [0.1] * 63), (303, [0.1] * 65), (304, [float("nan")] * 64), (305, [0.1] * 63 + [None]),
             (306, [float("inf")] + [0.0] * 63), (307, [-70000.0] * 64), (308, [70000.0] * 64)]
    assert got(spark, rows) == lloyd(rows)


def test_few_and_none(spark):
    rows = [(1, [1.0] * 64), (2, [1.0] * 64), (None, [0.5] * 64)]
    assert got(spark, rows) == lloyd(rows)
    assert got(spark, []) == []
    assert got(spark, [(1, None)]) == []


def test_too_large_is_an_error(spark):
    with pytest.raises(Exception, match="beyond"):
        got(spark, [(1, [2e5] * 64)])


def test_search_is_exact():
    rng = np.random.default_rng(1)
    for k, d, top in ((1, 3, 5), (40, 8, 3), (300, 16, 1 << 26), (64, 64, 1000)):
        c, x = rng.integers(-top, top, (k, d)), rng.integers(-top, top, (500, d))
        x[:100] = c[rng.integers(0, k, 100)]
        c[k // 2:] = c[:k - k // 2]     # ties
        who, best = C.Search(c).nearest(x)
        all_ = ((x[:, None] - c[None]) ** 2).sum(2)
        assert (who == all_.argmin(1)).all() and (best == all_.min(1)).all()


def test_twin(table):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF}/embeddings.parquet')")
    rel = con.sql(C.oracle_sql())
    out = C.centroid_clustering(table("embeddings")).select(*rel.columns)
    assert sorted(tuple(r) for r in out.collect()) == sorted(rel.fetchall())
