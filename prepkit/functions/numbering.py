"""Exact global row numbers without a single-partition window.

``row_number() over (order by ...)`` with no partition makes Spark move the
whole table into one task.  ``global_row_number`` instead

1. range-partitions by the (total) ordering and sorts inside each partition,
2. tags each row with ``monotonically_increasing_id`` (partition id in the high
   bits, position in the low 33 bits),
3. writes a reliable checkpoint, so partition ids and positions stay fixed if
   an executor is lost and the plan is recomputed,
4. counts rows per partition (one row per partition reaches the driver),
5. adds the prefix sum of earlier partitions to each local position.

Steps 4-5 touch only the checkpointed data; no further shuffle is needed.  A
key holding a third of the rows is no problem: the ordering includes a unique
tie-breaker, so the range partitioner splits the hot key across tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, shuffle_partitions

BROADCAST_GROUPS = 200_000
BROADCAST_TEXT = 32 << 20       # bytes of the keys of a level table
_LOW_BITS = 33
_LOW_MASK = (1 << _LOW_BITS) - 1


def global_row_number(df: DataFrame, order: list[Column | str], name: str = "rn",
                      num_partitions: int | None = None) -> DataFrame:
    """Add ``name`` = 1-based row number in ``order`` (which must be a total order)."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = num_partitions or shuffle_partitions(spark)
    order_cols = [F.col(o) if isinstance(o, str) else o for o in order]
    ranged = (df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols)
              .withColumn("_mid", F.monotonically_increasing_id()))
    ranged = ranged.checkpoint(eager=True)
    pid = F.shiftright(F.col("_mid"), _LOW_BITS)
    counts = ranged.groupBy(pid.alias("_pid")).agg(F.count(F.lit(1)).alias("_c")).collect()
    offsets = {}
    running = 0
    for r in sorted(counts, key=lambda r: r["_pid"]):
        offsets[r["_pid"]] = running
        running += r["_c"]
    if not offsets:
        return ranged.drop("_mid").withColumn(name, F.lit(None).cast("bigint"))
    # one row per partition: bounded by the number of shuffle partitions
    table = F.broadcast(spark.createDataFrame(sorted(offsets.items()), "_pid bigint, _off bigint"))
    rn = F.col("_off") + F.col("_mid").bitwiseAND(F.lit(_LOW_MASK)) + 1
    return ranged.withColumn("_pid", pid).join(table, "_pid").withColumn(name, rn).drop("_pid", "_off", "_mid")


def small_side(df: DataFrame, limit: int = BROADCAST_GROUPS) -> DataFrame:
    """``df`` marked for a broadcast join if it has at most ``limit`` rows (counted), else as it is."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def small_levels(table: DataFrame, key: str = "_key") -> DataFrame:
    """A fitted level table marked for a broadcast join if its levels are few and short together (counted).

    Otherwise every row of a column of a few levels would be shuffled to the few tasks of those levels."""
    n, text = table.agg(F.count(F.lit(1)), F.sum(F.octet_length(key))).first()
    return F.broadcast(table) if n <= BROADCAST_GROUPS and (text or 0) <= BROADCAST_TEXT else table


def rank_within_group(df: DataFrame, group: list[str], order: list[Column | str],
                      name: str = "grp_rn", size_col: str | None = None) -> DataFrame:
    """1-based row number inside each group, spread over many tasks.

    Numbers the table globally by ``(group..., order...)``; the first global
    number of each group (a grouped ``min``, one row per group) is subtracted.
    A group holding most of the table is split by the range partitioner like
    any other key range.  ``size_col`` optionally adds the group size.
    """
    numbered = global_row_number(df, [*group, *order], name="_g")
    starts = numbered.groupBy(*group).agg(F.min("_g").alias("_start"),
                                          F.count(F.lit(1)).alias("_size"))
    # one row per group; broadcast only after checking that it is small, so a
    # hot group is not hash-shuffled into a single task; beyond, adaptive
    # execution splits the rows of a hot group
    starts = small_side(starts)
    out = join_null_safe(numbered, starts, group)
    out = out.withColumn(name, F.col("_g") - F.col("_start") + 1)
    if size_col:
        out = out.withColumnRenamed("_size", size_col)
    else:
        out = out.drop("_size")
    return out.drop("_g", "_start")


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str],
                   how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where NULL matches NULL; right key copies dropped."""
    renamed = right.select(*[F.col(c).alias(f"_rk_{c}") if c in keys else F.col(c)
                             for c in right.columns])
    cond = [left[c].eqNullSafe(renamed[f"_rk_{c}"]) for c in keys]
    out = left.join(renamed, on=cond, how=how)
    return out.drop(*[f"_rk_{c}" for c in keys])
