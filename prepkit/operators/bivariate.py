"""Bivariate statistics and chart data (C1-C8): the numbers behind the plots."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clean_value, column_types
from ..functions.numbering import small_side
from ..functions.radix import quantile_table
from ..functions.stats import safe_corr
from .profile import top_values


def histogram(df: DataFrame, cols: list[str] | None = None, bins: int = 30) -> DataFrame:
    """Equal-width histogram per numeric column, zero bins included.

    Rows ``(column_name, bin, bin_start, bin_end, count)``; the last bin is
    closed; a constant column uses the range (v - 0.5, v + 0.5).
    """
    cols = cols if cols is not None else column_types(df)["numerical"]
    structs = [F.struct(F.lit(c).alias("column_name"), clean_value(df, c).cast("double").alias("v"))
               for c in cols]
    long = df.select(F.explode(F.array(*structs)).alias("s")).select("s.*").where("v IS NOT NULL")
    rng = long.groupBy("column_name").agg(F.min("v").alias("mn"), F.max("v").alias("mx"))
    rng = rng.select("column_name",
                     F.when(F.col("mn") == F.col("mx"), F.col("mn") - 0.5).otherwise(F.col("mn")).alias("lo"),
                     F.when(F.col("mn") == F.col("mx"), F.col("mx") + 0.5).otherwise(F.col("mx")).alias("hi"))
    # one row per column: bounded, safe to broadcast
    j = long.join(F.broadcast(rng), "column_name")
    w = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    b = F.least(F.floor((F.col("v") - F.col("lo")) / w).cast("int"), F.lit(bins - 1))
    counts = j.groupBy("column_name", b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    grid = rng.select("column_name", "lo", "hi",
                      F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    out = grid.join(counts, ["column_name", "bin"], "left")
    return out.select("column_name", "bin",
                      (F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / bins).alias("bin_start"),
                      (F.col("lo") + (F.col("bin") + 1) * (F.col("hi") - F.col("lo")) / bins).alias("bin_end"),
                      F.coalesce("count", F.lit(0)).cast("bigint").alias("count"))


def kde_curve(df: DataFrame, col: str, grid: int = 200, cut: float = 3.0,
              fine_bins: int = 4096) -> DataFrame:
    """Gaussian KDE on a 200-point grid, Scott bandwidth n^(-1/5)*std.

    Values are pre-binned into ``fine_bins`` weighted centres, so the kernel
    sum touches at most ``fine_bins * grid`` pairs whatever the table size.
    """
    v = clean_value(df, col).cast("double")
    st = df.agg(F.count(v).alias("n"), F.stddev_samp(v).alias("sd"), F.min(v).alias("mn"),
                F.max(v).alias("mx")).first()
    n, sd, mn, mx = st["n"], st["sd"], st["mn"], st["mx"]
    spark = df.sparkSession
    if not n or sd is None or sd == 0:
        return spark.createDataFrame([], "x double, density double")
    bw = sd * n ** (-1.0 / 5.0)
    lo, hi = mn - cut * bw, mx + cut * bw
    width = (mx - mn) / fine_bins if mx > mn else 1.0
    centres = (df.select(v.alias("v")).where("v IS NOT NULL")
               .groupBy(F.least(F.floor((F.col("v") - F.lit(mn)) / F.lit(width)), F.lit(fine_bins - 1))
                        .alias("b"))
               .agg(F.count(F.lit(1)).alias("w"), F.avg("v").alias("c")))
    pts = spark.range(grid).select((F.lit(lo) + F.col("id") * F.lit((hi - lo) / (grid - 1))).alias("x"))
    # both sides are bounded (<= fine_bins and = grid rows): the pair table is small
    pairs = pts.crossJoin(F.broadcast(centres))
    z = (F.col("x") - F.col("c")) / F.lit(bw)
    dens = F.sum(F.col("w") * F.exp(-0.5 * z * z)) / F.lit(n * bw * math.sqrt(2 * math.pi))
    return pairs.groupBy("x").agg(dens.alias("density"))


def top_category_values(df: DataFrame, cols: list[str] | None = None, k: int = 10) -> DataFrame:
    """Blank-trimmed top-k levels per categorical column (NULL/blank dropped)."""
    return top_values(df, cols, k=k, trim_blank=True)


def correlation_with_target(df: DataFrame, target: str, cols: list[str] | None = None) -> DataFrame:
    """C4: Pearson correlation of each numeric column with the target (pairwise complete)."""
    cols = cols if cols is not None else [c for c in column_types(df)["numerical"] if c != target]
    y = clean_value(df, target).cast("double")
    aggs = [F.struct(F.lit(c).alias("column_name"),
                     safe_corr(clean_value(df, c).cast("double"), y).alias("correlation")).alias(f"_s{i}")
            for i, c in enumerate(cols)]
    row = df.agg(*aggs)
    return row.select(F.explode(F.array(*[F.col(f"_s{i}") for i in range(len(cols))])).alias("s")) \
        .select("s.*")


def mean_by_category(df: DataFrame, target: str, cats: list[str] | None = None) -> DataFrame:
    """Mean / count / std of the target for every level of every categorical column."""
    cats = cats if cats is not None else [c for c in column_types(df)["categorical"] if c != target]
    y = clean_value(df, target).cast("double")
    long = _long_with(df, cats, y)
    return long.groupBy("column_name", "value").agg(
        F.avg("_y").alias("mean"), F.count("_y").alias("count"), F.stddev_samp("_y").alias("std"))


def _long_with(df: DataFrame, cats: list[str], y) -> DataFrame:
    structs = [F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value"))
               for c in cats]
    return (df.select(F.explode(F.array(*structs)).alias("s"), y.alias("_y"))
            .select("s.*", "_y").where("value IS NOT NULL"))


def boxplot_stats(df: DataFrame, target: str, cols: list[str] | None = None) -> DataFrame:
    """Per target class and numeric column: quartiles, whiskers, flier count.

    Whiskers are the most extreme values inside [q1 - 1.5 IQR, q3 + 1.5 IQR].
    """
    cols = cols if cols is not None else [c for c in column_types(df)["numerical"] if c != target]
    cls = F.col(target).cast("string")
    structs = [F.struct(F.lit(c).alias("column_name"), clean_value(df, c).cast("double").alias("v"))
               for c in cols]
    long = (df.select(cls.alias("class"), F.explode(F.array(*structs)).alias("s"))
            .select("class", "s.*").where("v IS NOT NULL AND class IS NOT NULL"))
    q = quantile_table(long, ["column_name", "class"], [0.25, 0.5, 0.75])
    iqr = F.col("q")[2] - F.col("q")[0]
    bounds = q.select("column_name", "class", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"),
                      F.col("q")[2].alias("q3"), (F.col("q")[0] - 1.5 * iqr).alias("lo"),
                      (F.col("q")[2] + 1.5 * iqr).alias("hi"))
    j = long.join(small_side(bounds), ["column_name", "class"])
    inside = (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi"))
    return j.groupBy("column_name", "class").agg(
        F.first("q1").alias("q1"), F.first("median").alias("median"), F.first("q3").alias("q3"),
        F.min(F.when(inside, F.col("v"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("v"))).alias("whisker_high"),
        F.count_if(~inside).alias("fliers"))


def chi_square(df: DataFrame, target: str, cats: list[str] | None = None,
               yates: bool = True) -> DataFrame:
    """Chi-square statistic per categorical column against the target.

    Only observed cells are visited: an absent cell adds its expected count, and all
    expected counts add up to n.  Yates continuity correction for one degree of freedom,
    where all four cells are equally far from their expectation.
    """
    cats = cats if cats is not None else [c for c in column_types(df)["categorical"] if c != target]
    y = F.col(target).cast("string")
    structs = [F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value"))
               for c in cats]
    long = (df.select(F.explode(F.array(*structs)).alias("s"), y.alias("class"))
            .select("s.*", "class").where("value IS NOT NULL AND class IS NOT NULL"))
    obs = long.groupBy("column_name", "value", "class").agg(F.count(F.lit(1)).cast("double").alias("o"))
    rows_t = obs.groupBy("column_name", "value").agg(F.sum("o").alias("rt"))
    cols_t = obs.groupBy("column_name", "class").agg(F.sum("o").alias("ct"))
    # one row per column: bounded, safe to broadcast
    dims = F.broadcast(
        rows_t.groupBy("column_name").agg(F.count(F.lit(1)).alias("r"), F.sum("rt").alias("n"), F.sum(1 / F.col("rt")).alias("ir"))
        .join(cols_t.groupBy("column_name").agg(F.count(F.lit(1)).alias("c"), F.sum(1 / F.col("ct")).alias("ic")), "column_name"))
    cells = (obs.join(rows_t, ["column_name", "value"]).join(cols_t, ["column_name", "class"])
             .join(dims, "column_name"))
    e = F.col("rt") * F.col("ct") / F.col("n")
    stat = cells.groupBy("column_name").agg(
        F.sum((F.col("o") - e) * (F.col("o") - e) / e).alias("seen"), F.sum(e).alias("expected"),
        F.max(F.abs(F.col("o") - e)).alias("d"), F.first("n").alias("n"),
        F.first((F.col("r") - 1) * (F.col("c") - 1)).alias("dof"), F.first(F.col("ir") * F.col("ic")).alias("inverse"))
    chi2 = F.col("seen") + F.greatest(F.col("n") - F.col("expected"), F.lit(0.0))
    if yates:
        d = F.col("d") - F.least(F.lit(0.5), F.col("d"))
        chi2 = F.when(F.col("dof") == 1, d * d * F.col("n") * F.col("inverse")).otherwise(chi2)
    return stat.select("column_name", F.when(F.col("dof") > 0, chi2).otherwise(0.0).alias("chi2"),
                       F.col("dof").cast("bigint").alias("dof"))


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Contingency counts as tidy rows ``(a, b, count)`` (NULLs dropped)."""
    return (df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
            .groupBy(F.col(a).cast("string").alias(a), F.col(b).cast("string").alias(b))
            .agg(F.count(F.lit(1)).alias("count")))


def crosstab_wide(df: DataFrame, a: str, b: str, max_levels: int) -> DataFrame:
    """C8 wide form: one column per level of ``b``; the caller says how many columns it can take."""
    levels = [r[0] for r in df.where(F.col(b).isNotNull()).select(F.col(b).cast("string"))
              .distinct().limit(max_levels + 1).collect()]
    if len(levels) > max_levels:
        raise ValueError(f"{b} has more than {max_levels} levels")
    return (df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
            .groupBy(F.col(a).cast("string").alias(a)).pivot(b, sorted(levels)).count().na.fill(0))
