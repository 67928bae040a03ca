"""Value counts and top-k per key without one task per key.

A plain ``row_number() over (partition by column ...)`` puts every distinct
value of a column into one task, which breaks on a column with 10^9 levels.
Here the grouped table is first cut by a salt derived from the value, each
salt slice keeps its own top-k, and only ``salts * k`` candidates per key go
through the final window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shuffle_partitions
from .columns import canonical_str, clean_value, trim_ws

LEAST_SALTS = 16


def long_values(df: DataFrame, cols: list[str], key: str = "column_name",
                value: str = "value", trim_blank: bool = False) -> DataFrame:
    """Wide -> long ``(column_name, value string)``, missing values dropped."""
    structs = []
    for c in cols:
        v = F.when(clean_value(df, c).isNotNull(), canonical_str(df, c))
        if trim_blank:
            v = trim_ws(v)
            v = F.when(v != "", v)
        structs.append(F.struct(F.lit(c).alias(key), v.alias(value)))
    return (df.select(F.explode(F.array(*structs)).alias("_kv")).select("_kv.*")
            .where(F.col(value).isNotNull()))


def value_counts(df: DataFrame, cols: list[str], key: str = "column_name",
                 value: str = "value", trim_blank: bool = False) -> DataFrame:
    """``(column_name, value, count)`` for every categorical column in one shuffle."""
    return (long_values(df, cols, key, value, trim_blank)
            .groupBy(key, value).agg(F.count(F.lit(1)).alias("count")))


def top_k(grouped: DataFrame, key: str | list[str], order: list[Column], k: int,
          rank_col: str = "rank", salt_of: Column | None = None,
          salts: int | None = None) -> DataFrame:
    """Top ``k`` rows per key by ``order`` (must be a total order), with rank 1..k.

    There are as many slices per key as shuffle partitions, so they fill the cluster."""
    salts = salts or max(LEAST_SALTS, shuffle_partitions(grouped.sparkSession))
    keys = [key] if isinstance(key, str) else list(key)
    salt = salt_of if salt_of is not None else F.col("value")
    salted = grouped.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(salts)))
    w1 = Window.partitionBy(*keys, "_salt").orderBy(*order)
    cand = salted.withColumn("_r1", F.row_number().over(w1)).where(F.col("_r1") <= k)
    w2 = Window.partitionBy(*keys).orderBy(*order)
    return (cand.withColumn(rank_col, F.row_number().over(w2)).where(F.col(rank_col) <= k)
            .drop("_salt", "_r1"))
