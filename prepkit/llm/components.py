"""Connected components of an edge table, as repeated joins (large star, small star)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: nodes of more neighbours than 2 * edges / HEAVY_NODES (and LEAST_HEAVY) are heavy; there are HEAVY_NODES at most
HEAVY_NODES = 20_000
LEAST_HEAVY = 32
#: up to so many edges every node learns its neighbour by a broadcast (counted before each round)
FEW_EDGES = 200_000
PART_EDGES = 5_000


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(edges: DataFrame, large: bool, many: int | None) -> DataFrame:
    """Hang the neighbours of every node on its smallest neighbour (or itself).

    Every node learns it by a broadcast where ``many`` is None (few edges); else only the nodes of
    over ``many`` neighbours do, so no task meets all of them.  There are at most 2 * edges / many of
    those."""
    near = _both_ways(edges)
    if not large:
        near = near.where("b < a")
    least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("n"))
    if many is None:
        hung = near.join(F.broadcast(least.select("a", "m")), "a")
    else:
        heavy = F.broadcast(least.where(F.col("n") > many).select("a", F.col("m").alias("over")))
        marked = near.join(heavy, "a", "left")
        light = marked.where("over is null").select("a", "b").join(least.where(F.col("n") <= many).select("a", "m"), "a")
        hung = light.select("a", "b", "m").union(marked.where("over is not null").select("a", "b", F.col("over").alias("m")))
    if large:
        hung = hung.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        hung = hung.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            least.select("a", F.col("m").alias("b")))
    return hung.where("a <> b")


def components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of one orderable type -> (node, component): the least node reachable.

    Every node named by an edge between different nodes gets one row.  The edge
    list shrinks to stars in a logarithmic number of rounds; each round is cut
    off by a reliable checkpoint.  A node with very many neighbours costs a
    pre-aggregated minimum; its neighbours learn it by a broadcast of at most
    ``HEAVY_NODES`` rows, or ``FEW_EDGES`` where there are no more edges than that.
    """
    now = edges.select("a", "b").where("a <> b").distinct().checkpoint()
    mark = None
    while True:
        n, total = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if (n, total) == mark or not n:
            break
        mark = n, total
        if n <= FEW_EDGES:
            # partitions by size, so that a short table leaves few files a round
            now = _star(_star(now, True, None), False, None).distinct().coalesce(1 + n // PART_EDGES).checkpoint()
        else:
            many = max(LEAST_HEAVY, 2 * n // HEAVY_NODES)
            now = _star(_star(now, True, many).checkpoint(), False, many).distinct().checkpoint()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select("b", "b").distinct())
