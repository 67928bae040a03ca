"""Centroid clustering by equal-average equal-variance search, in exact integers.

Centroids stand sorted by their component mean.  A vector starts at its own mean and scans outward
on both sides.  With d components, mean m and deviation v (the norm of x - m),

    |x - c|^2  >=  d (m_x - m_c)^2 + (v_x - v_c)^2,

so the scan of a vector ends where the first term alone exceeds the best distance, and a centroid
is passed over where both do.  The terms are doubles, cut by a margin far above their rounding, so
nothing is rejected that could win; what is left is decided by integer distances.

A round is one pass over the vectors: every task adds up its vectors per cluster, Spark sums those
rows, and k x d sums reach the driver.  Vectors are never shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 1024
DIMS = 64
CLUSTERS = 8
ROUNDS = 10
SEED = "3"
#: integers beyond it are refused: squared distances of 64 components have to fit a long
LIMIT = 1 << 27
_MARGIN = 1e-9


class Search:
    """The centroids in the order of their means, with means and deviations."""

    def __init__(self, centroids: np.ndarray):
        mean = centroids.sum(1) / centroids.shape[1]
        self.number = np.argsort(mean, kind="stable")
        self.rows = centroids[self.number]
        self.mean = mean[self.number]
        self.dev = np.sqrt(((self.rows - self.mean[:, None]) ** 2).sum(1))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the nearest centroid, squared distance) per row of ``x``; ties: the smaller number."""
        n, d = x.shape
        k = len(self.rows)
        mean = x.sum(1) / d
        dev = np.sqrt(((x - mean[:, None]) ** 2).sum(1))
        best = np.full(n, np.iinfo(np.int64).max)
        who = np.full(n, k)
        right = np.searchsorted(self.mean, mean)
        left = right - 1
        edge = np.concatenate((self.mean, [np.inf]))    # place k is beyond the last, place -1 the same entry
        live = np.arange(n)
        for _ in range(k):
            down, up = np.abs(mean[live] - edge[left[live]]), np.abs(edge[right[live]] - mean[live])
            low = down <= up
            place = np.where(low, left[live], right[live])
            left[live[low]] -= 1
            right[live[~low]] += 1
            bound = d * np.minimum(down, up) ** 2 * (1 - _MARGIN)
            near = bound <= best[live]
            live, place, bound = live[near], place[near], bound[near]
            if not len(live):
                break
            asked = bound + (dev[live] - self.dev[place]) ** 2 * (1 - _MARGIN) <= best[live]
            rows, place = live[asked], place[asked]
            exact = ((x[rows] - self.rows[place]) ** 2).sum(1)
            number = self.number[place]
            better = (exact < best[rows]) | ((exact == best[rows]) & (number < who[rows]))
            best[rows[better]], who[rows[better]] = exact[better], number[better]
        return who, best


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, d)


def _sums(centroids: np.ndarray) -> Callable:
    """Batches (x) -> one row per cluster that a task met: (cluster, n, total)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, (k, d) = Search(centroids), centroids.shape
        count, total = np.zeros(k, np.int64), np.zeros((k, d), np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), d)
            if not len(x):
                continue
            who, _ = search.nearest(x)
            order = np.argsort(who, kind="stable")
            met, first = np.unique(who[order], return_index=True)
            total[met] += np.add.reduceat(x[order], first, axis=0)
            count += np.bincount(who, minlength=k)
        met = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(met, pa.int32()), pa.array(count[met]), pa.array(total[met].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "total"])
    return run


def _assign(centroids: np.ndarray) -> Callable:
    """Batches (vec_id, x) -> (vec_id, cluster, distance)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(centroids)
        for batch in batches:
            who, best = search.nearest(_matrix(batch.column(1), centroids.shape[1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(who, pa.int32()), pa.array(best)], ["vec_id", "cluster", "distance"])
    return run


def integer_vectors(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(vec_id, x array<int>): the vectors of exactly ``dims`` finite components, each floor(scale * component).

    An integer beyond ``LIMIT`` ends the job with an error that names the limit."""
    e = vectors["embedding"].cast("array<double>")
    bad = F.exists(e, lambda v: F.coalesce(F.isnan(v) | (F.abs(v) == float("inf")), F.lit(True)))
    whole = F.transform(e, lambda v: F.floor(F.lit(scale).cast("double") * v))
    over = F.exists(e, lambda v: F.abs(F.lit(scale).cast("double") * v) >= LIMIT)
    kept = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), e.alias("e"), bad.alias("bad"), over.alias("over"), whole.alias("w"))
    kept = kept.where((F.size("e") == dims) & ~F.col("bad"))
    return kept.select("vec_id", F.when(F.col("over"), F.raise_error(F.lit(f"a component times {scale} is beyond {LIMIT}")).cast("array<int>"))
                       .otherwise(F.col("w").cast("array<int>")).alias("x"))


def _start_hash(seed: str) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)


def fit(ints: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: str = SEED) -> np.ndarray:
    """Centroids (int64, k x d; fewer where there are fewer vectors) after ``rounds`` rounds of Lloyd."""
    start = ints.select(_start_hash(seed).alias("h"), "x").orderBy(F.asc_nulls_last("h"), "x").limit(k).collect()
    now = np.array([r["x"] for r in start], np.int64)
    for _ in range(rounds if len(now) else 0):
        sums = (ints.select("x").mapInArrow(_sums(now), "cluster int, n long, total array<long>")
                .select("cluster", "n", F.posexplode("total").alias("place", "v"))
                .groupBy("cluster", "place").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).collect())
        now = now.copy()
        for r in sums:      # k x d rows
            now[r["cluster"], r["place"]] = r["v"] // r["n"]
    return now


def centroid_clustering(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE,
                        seed: str = SEED) -> DataFrame:
    """embeddings(vec_id, embedding) -> vec_id, cluster int, distance long, cluster_inertia long, inertia
    long, centroid_sha256 string, one row per kept vector.

    Kept are vectors of exactly ``dims`` components, none null or non-finite, each made
    floor(scale * x).  The first centroids are the ``k`` kept vectors with the least sha256 of
    ``seed:vec_id``, in that order; equal ids are ordered by components, null ids come last.  With
    fewer kept vectors there are fewer clusters; with none there are no rows.  Equal distances go to
    the smaller number; an empty cluster keeps its centroid.  Repeated rows and null ids each count
    and give a row.  Components beyond ``LIMIT / scale`` end the job with an error, since distances
    would not fit.  Other columns are ignored.
    """
    ints = integer_vectors(vectors, dims, scale).checkpoint()
    final = fit(ints, k, rounds, seed)
    spark = vectors.sparkSession
    if not len(final):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    rows = ints.select("vec_id", "x").mapInArrow(_assign(final), "vec_id long, cluster int, distance long").checkpoint()
    sums = {r["cluster"]: r["s"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    about = spark.createDataFrame(      # one row per centroid
        [(j, sums.get(j, 0), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(final.tolist())],
        "cluster int, cluster_inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(about), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", F.lit(sum(sums.values())).cast("long").alias("inertia"), "centroid_sha256")


def oracle_sql() -> str:
    """The same rounds in DuckDB, each vector against each centroid."""
    steps = [f"""
v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS x
  FROM embeddings
  WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMS}),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h NULLS LAST, x) - 1 AS j, x AS c
  FROM (SELECT sha256('{SEED}:' || vec_id) AS h, x FROM v ORDER BY h NULLS LAST, x LIMIT {CLUSTERS}))"""]
    for r in range(ROUNDS + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (
  SELECT rid, any_value(vec_id) AS vec_id, any_value(x) AS x, min({{'d': d, 'j': j}}) AS best
  FROM (SELECT rid, vec_id, x, j,
               list_sum(list_transform(range(1, {DIMS + 1}), lambda i: (x[i] - c[i]) * (x[i] - c[i])))::BIGINT AS d
        FROM v, c{r}) GROUP BY rid)""")
        if r < ROUNDS:
            steps.append(f"""
s{r} AS (
  SELECT j, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c
  FROM (SELECT best.j AS j, i, sum(x[i]) AS s, count(*) AS n FROM a{r}, range(1, {DIMS + 1}) AS t(i) GROUP BY ALL) GROUP BY j),
c{r + 1} AS MATERIALIZED (
  SELECT c{r}.j, coalesce(s{r}.c::BIGINT[], c{r}.c) AS c FROM c{r} LEFT JOIN s{r} ON s{r}.j = c{r}.j)""")
    return f"""
WITH {",".join(steps)}
SELECT vec_id, best.j::INT AS cluster, best.d AS distance, (sum(best.d) OVER (PARTITION BY best.j))::BIGINT AS cluster_inertia,
       (sum(best.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} ON c{ROUNDS}.j = best.j"""
