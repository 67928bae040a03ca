"""Near-duplicate vectors: spherical k-means cells, blocked cosine products inside them, one kept per group.

1. Equal vectors of one label are one *node* (a digest), so copies are never compared with each other.
2. Unit centroids come from spherical k-means on a bounded sample; their number grows with the root
   of the rows.  Every vector belongs to the cell of its nearest centroid.  A vector that stands
   closer than ``margin`` to the border of another cell of a smaller number is also sent there, so
   a pair on both sides of a border meets once.
3. All that meet in one (label, cell) are compared by matrix products of at most ``BLOCK`` x
   ``BLOCK``.  A larger cell is cut into parts and each pair of parts is a place of its own: no
   group has to fit into one task and no pairs are written, only counts per node and a spanning
   forest of the links of a place.
4. Connected components over the forest edges; the least vec_id of a group names it.

With ``margin`` >= sqrt(2 - 2 * threshold) no link can be missed: the way from a vector to its
partner is not longer than that, so it cannot cross a border by more.  The default is smaller; in
64 components the way across one given border is seldom over a third of the whole way.  Tests
measure the recall against brute force.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepkit.functions.numbering import small_side
from prepkit.llm.components import components

THRESHOLD = 0.93
#: rows that the cells are fitted on, at most (chosen by digest)
SAMPLE_ROWS = 20_000
MARGIN = 0.12
#: vectors on one side of a product
BLOCK = 2048
MAX_CELLS = 4096
_SWEEPS = 8
_CHUNK = 256


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 (by their largest part first, against overflow); no row is zero."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _directions(column: pa.Array, dims: int) -> np.ndarray:
    """The vectors of a list column at length 1, then cut or filled with zeros to ``dims``.

    Only the cells look at these; cutting never drives two vectors apart."""
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = max(int(lengths.max(initial=1)), dims)
    if (lengths == dims).all():
        return _unit(flat.reshape(-1, dims))
    out = np.zeros((len(lengths), width))
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return _unit(out)[:, :dims]


def spherical_kmeans(x: np.ndarray, k: int, seed: int = 13) -> np.ndarray:
    """k unit centroids of unit rows ``x``: assign by cosine, replace by the direction of the sum."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(_SWEEPS):
        who = np.concatenate([(x[i:i + 4096] @ c.T).argmax(1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(c)
        np.add.at(sums, who, x)
        size = np.sqrt((sums * sums).sum(1, keepdims=True))
        c = np.where(size > 0, sums / np.where(size > 0, size, 1), c)
    return c


def cells_for(rows: int) -> int:
    """Number of cells: the root of the rows, by 16."""
    return min(max(1, round(math.sqrt(rows) / 16)), MAX_CELLS)


def _places(centroids: np.ndarray, margin: float) -> Callable:
    """Batches (digest, vector) -> (at, cell, guest) for the own cell and those smaller ones whose border is near."""
    gap = np.sqrt(np.maximum(2 - 2 * centroids @ centroids.T, 0))       # distances of centroids

    def run(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        score = x @ centroids.T
        own = score.argmax(1)
        # behind the border with every better centroid m by margin at most: s_m - s_i <= margin * |c_m - c_i|
        near = score[np.arange(len(x)), own][:, None] - score <= margin * gap[own]
        near &= np.arange(len(centroids)) < own[:, None]
        at, cell = np.nonzero(near)
        return (np.concatenate((np.arange(len(x)), at)), np.concatenate((own, cell)),
                np.concatenate((np.zeros(len(x), bool), np.ones(len(at), bool))))
    return run


def _placed(centroids: np.ndarray, margin: float, moved: bool) -> Callable:
    """Batches (digest, part, vector, weight) -> a row per cell: (digest, part, cell) and, if ``moved``,
    guest, vector and weight."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = _places(centroids, margin)
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                b = batch.slice(i, 4096)
                at, cell, guest = place(_directions(b.column(2), centroids.shape[1]))
                at = pa.array(at)
                cols = [b.column(0).take(at), b.column(1).take(at), pa.array(cell, pa.int32())]
                names = ["digest", "part", "cell"]
                if moved:
                    cols += [pa.array(guest), b.column(2).take(at), b.column(3).take(at)]
                    names += ["guest", "vector", "weight"]
                yield pa.RecordBatch.from_arrays(cols, names)
    return run


def _forest(linked: np.ndarray, label: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join what ``linked`` (left x right) joins; ``label`` is what is joined already, and kept up."""
    edges = []
    for i in np.flatnonzero(linked.any(1)):
        others = right[linked[i]]
        tops, first = np.unique(label[others], return_index=True)
        mine = label[left[i]]
        edges += [(int(left[i]), int(others[f])) for t, f in zip(tops, first) if t != mine]
        if len(tops) > 1 or tops[0] != mine:
            label[np.isin(label, tops)] = mine
    return edges


def _compared(threshold: float) -> Callable:
    """Rows (place, side, guest, digest, weight, vector) sorted by place -> (a, b, n).

    b null: n vectors that link with node a in this place; else a link of the spanning forest."""
    def found(side: list, guest: list, digest: list, weight: list, vector: list) -> pa.RecordBatch:
        x = _unit(np.array(vector, np.float64))
        side, guest, weight = np.array(side), np.array(guest), np.array(weight, np.int64)
        one = (side == 2).all()                     # a place of one part with itself
        left, right = (np.arange(len(x)),) * 2 if one else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        n, label, edges = np.zeros(len(x), np.int64), np.arange(len(x)), []
        for i in range(0, len(left), _CHUNK):
            rows = left[i:i + _CHUNK]
            linked = x[rows] @ x[right].T >= threshold
            # guests meet each other in another place
            linked &= ~(guest[rows][:, None] & guest[right][None, :])
            if one:
                linked &= rows[:, None] != right[None, :]
            n[rows] += linked @ weight[right]
            if not one:
                n[right] += weight[rows] @ linked
            edges += _forest(linked, label, rows, right)
        at = np.flatnonzero(n)
        return pa.RecordBatch.from_arrays(
            [pa.array([digest[i] for i in at] + [digest[i] for i, _ in edges], pa.binary()),
             pa.array([None] * len(at) + [digest[j] for _, j in edges], pa.binary()),
             pa.array(n[at].tolist() + [0] * len(edges), pa.int64())], ["a", "b", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, ([], [], [], [], [])
        for batch in batches:
            places = batch.column(0).to_pylist()
            cols = [batch.column(i).to_pylist() for i in range(1, 5)]
            ends = np.cumsum(pc.list_value_length(batch.column(5)).to_numpy(zero_copy_only=False))
            flat = batch.column(5).flatten().to_numpy(zero_copy_only=False)
            cols.append(np.split(flat, ends[:-1]))
            for i, here in enumerate(places):
                if here != now:
                    if len(rows[0]) > 1:
                        yield found(*rows)
                    now, rows = here, ([], [], [], [], [])
                for c, col in zip(rows, cols):
                    c.append(col[i])
        if len(rows[0]) > 1:
            yield found(*rows)
    return run


def _usable(e: Column, label: Column) -> Column:
    odd = F.exists(e, lambda v: F.coalesce(F.isnan(v) | (F.abs(v) == float("inf")), F.lit(True)))
    return F.coalesce(label.isNotNull() & ~odd & F.exists(e, lambda v: v != 0), F.lit(False))


def _nodes(vectors: DataFrame) -> DataFrame:
    """vec_id, digest (null where a vector links with nothing), part (label and length), vector."""
    e, label = vectors["embedding"], vectors["label"].cast("string")
    part = F.concat_ws(":", F.size(e), label)
    digest = F.unhex(F.substring(F.sha2(F.to_json(F.struct(part, e)), 256), 1, 32))
    return vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), F.when(_usable(e, label), digest).alias("digest"),
                          part.alias("part"), e.alias("vector"))


def fit_cells(rows: DataFrame, digests: DataFrame, cells: int | None, sample_rows: int) -> np.ndarray | None:
    """Unit centroids from the ``sample_rows`` different vectors of least digest; None without vectors.

    digests: a row per different vector."""
    n, last = digests.count(), digests.select("digest").orderBy("digest").limit(sample_rows).agg(F.max("digest")).first()[0]
    if not n:
        return None
    some = rows.where(F.col("digest") <= F.lit(last)).groupBy("digest").agg(F.first("vector").alias("vector"))
    found = [r["vector"] for r in some.orderBy("digest").collect()]
    dims = int(np.median([len(v) for v in found]))
    return spherical_kmeans(_directions(pa.array(found, pa.list_(pa.float64())), dims), cells or cells_for(n))


def near_links(rows: DataFrame, centroids: np.ndarray, threshold: float, margin: float, block: int) -> DataFrame:
    """(a, b, n) of all places, checkpointed: links per node where b is null, forest edges else."""
    rows = rows.where("digest is not null")
    # cells over one block, counted without moving vectors: at most rows / block of them
    sizes = (rows.select("digest", "part", "vector").mapInArrow(_placed(centroids, margin, False), "digest binary, part string, cell int")
             .distinct().groupBy("part", "cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)
             .select("part", "cell", F.ceil(F.col("n") / block).cast("int").alias("cuts")).checkpoint())
    nodes = rows.groupBy("digest").agg(F.first("part").alias("part"), F.first("vector").alias("vector"), F.count(F.lit(1)).alias("weight"))
    kind = rows.schema["vector"].dataType.simpleString()
    placed = nodes.select("digest", "part", "vector", "weight").mapInArrow(
        _placed(centroids, margin, True), f"digest binary, part string, cell int, guest boolean, vector {kind}, weight long")
    cut = placed.join(small_side(sizes), ["part", "cell"], "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
    own = F.pmod(F.xxhash64("digest"), F.col("cuts")).cast("int")
    # the part stands with every part: on the left of later ones, on the right of earlier ones
    pair = F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda o: F.struct(
        F.least(o, own).alias("p"), F.greatest(o, own).alias("q"),
        F.when(o == own, 2).when(own < o, 0).otherwise(1).alias("side")))
    moved = cut.select("part", "cell", "guest", "digest", "weight", "vector", F.explode(pair).alias("at"))
    moved = moved.select(F.struct("part", "cell", F.col("at.p").alias("p"), F.col("at.q").alias("q")).alias("place"),
                         F.col("at.side").alias("side"), "guest", "digest", "weight", "vector")
    return (moved.repartition("place").sortWithinPartitions("place")
            .select(F.to_json("place").alias("place"), "side", "guest", "digest", "weight", "vector")
            .mapInArrow(_compared(threshold), "a binary, b binary, n long").checkpoint())


def vector_dedup(vectors: DataFrame, threshold: float = THRESHOLD, margin: float = MARGIN, cells: int | None = None,
                 sample_rows: int = SAMPLE_ROWS, block: int = BLOCK) -> DataFrame:
    """embeddings(vec_id, embedding, label) -> vec_id, n_links long, component_id long, kept boolean, one row per row.

    Two rows link when their labels are equal and not null, their vectors have the same length and
    the cosine in doubles is at least ``threshold``; ``n_links`` counts the other rows linked
    directly.  ``component_id`` is the least vec_id reachable by links, ``kept`` says that it is the
    row's own.  Vectors that are null, empty, zero, or hold a null or non-finite component link with
    nothing and are kept.  Repeated rows link with each other and are all kept if theirs is the least
    id.  A row with a null vec_id takes part; a group of such rows alone has a null component and
    keeps them.  No rows give no rows; other columns are ignored.
    """
    rows = _nodes(vectors)
    ids = rows.select("vec_id", "digest").checkpoint()
    weights = ids.where("digest is not null").groupBy("digest").agg(
        F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("least")).checkpoint()
    free = ids.where("digest is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    centroids = fit_cells(rows, weights, cells, sample_rows)
    if centroids is None:
        return free
    found = near_links(rows, centroids, threshold, margin, block)
    links = found.where("b is null").groupBy(F.col("a").alias("digest")).agg(F.sum("n").alias("n"))
    groups = components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "digest")
    named = weights.join(groups, "digest", "left").withColumn("group", F.coalesce("component", "digest"))
    least = named.where("component is not null").groupBy("component").agg(F.min("least").alias("over"))
    # only nodes that link with something, copies of their own included
    about = named.join(least, "component", "left").join(links, "digest", "left").where("weight > 1 or n is not null").select(
        "digest", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("over", "least").alias("component_id"),
        F.lit(True).alias("linked")).checkpoint()
    out = ids.where("digest is not null").join(small_side(about), "digest", "left")
    group = F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("vec_id"))
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), group.alias("component_id"),
                     F.col("vec_id").eqNullSafe(group).alias("kept"))
    return out.union(free)


def oracle_sql() -> str:
    """All pairs of equal labels in DuckDB, and their closure."""
    return f"""
WITH RECURSIVE v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, label, embedding::DOUBLE[] AS e,
         coalesce(len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
                  AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AND label IS NOT NULL, false) AS ok
  FROM embeddings),
l AS MATERIALIZED (
  SELECT a.rid AS a, b.rid AS b, b.vec_id AS id FROM v AS a JOIN v AS b ON a.label = b.label AND len(a.e) = len(b.e)
  WHERE a.ok AND b.ok AND a.rid <> b.rid AND list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
r AS (SELECT a, b, id FROM l UNION SELECT r.a, l.b, l.id FROM r JOIN l ON l.a = r.b),
m AS (SELECT a, min(id) AS id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(vec_id, m.id) AS component_id,
       vec_id IS NOT DISTINCT FROM least(vec_id, m.id) AS kept
FROM v LEFT JOIN n ON n.a = v.rid LEFT JOIN m ON m.a = v.rid"""
