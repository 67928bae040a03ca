"""Profiling (EDA) operators E1-E10.

Each section is a tidy DataFrame (one row per column or per value).  Column
statistics for all columns come from a single aggregation; categorical
sections unpivot first so one shuffle serves every column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import (clean_value, column_types, datetime_columns,
                                 is_missing, round_half_even)
from ..functions.radix import histogram, quantile_table
from ..functions.stats import corrected_kurt, corrected_skew, unpivot_values
from ..functions.topk import top_k, value_counts


def _explode_structs(agg_row: DataFrame, names: list[str]) -> DataFrame:
    return agg_row.select(F.explode(F.array(*[F.col(n) for n in names])).alias("_s")) \
        .select("_s.*")


def overview(df: DataFrame) -> DataFrame:
    """Shape of the table (one row)."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit(len(df.columns)).cast("bigint").alias("n_columns"))


def overview_columns(df: DataFrame) -> DataFrame:
    """Column names and types in schema order."""
    rows = [(i + 1, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "ordinal int, column_name string, dtype string")


def sample_rows(df: DataFrame, order_by: list[str], n: int = 5) -> DataFrame:
    """First ``n`` rows in a caller-given order (top-k, not a full sort)."""
    return df.orderBy(*order_by).limit(n)


def missing_values(df: DataFrame) -> DataFrame:
    """Per column missing count and percentage (2 dp, half-even)."""
    cols = df.columns
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(cols):
        aggs.append(F.count_if(is_missing(df, c)).alias(f"_m{i}"))
    row = df.agg(*aggs)
    structs = [F.struct(F.lit(i + 1).alias("ordinal"), F.lit(c).alias("column_name"),
                        F.col(f"_m{i}").alias("missing_count")) for i, c in enumerate(cols)]
    out = row.select(F.col("_rows"), F.explode(F.array(*structs)).alias("_s")) \
        .select("_rows", "_s.*")
    pct = round_half_even(F.try_divide(F.col("missing_count") * F.lit(100.0), F.col("_rows")), 2)
    return out.select("ordinal", "column_name", "missing_count", pct.alias("missing_pct"))


def missing_summary(df: DataFrame) -> DataFrame:
    """E3 totals: total missing cells and number of columns with any missing."""
    per = missing_values(df)
    return per.agg(F.sum("missing_count").cast("bigint").alias("total_missing_cells"),
                   F.count_if(F.col("missing_count") > 0).alias("columns_with_missing"))


def numeric_histogram(df: DataFrame, cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """(long, hist): the values of the columns as rows (column_name, v), and their radix histogram with
    the moments of every bucket.  One scan feeds counts, moments and the first round of the quantiles."""
    long = unpivot_values(df, cols, key="column_name")
    hist = histogram(long, ["column_name"], extra=[
        F.avg("v").alias("mean"), F.var_pop("v").alias("var"), F.skewness("v").alias("g1"), F.kurtosis("v").alias("g2")])
    return long, hist


def _moments(hist: DataFrame) -> DataFrame:
    """Moments of a column from those of its buckets."""
    hist = hist.withColumnsRenamed({"_count": "c", "_low": "low", "_high": "high"})
    total = hist.groupBy("column_name").agg(F.expr("sum(c) as count"), F.expr("min(low) as min"), F.expr("max(high) as max"),
                                            F.expr("sum(c * mean) / sum(c) as all_mean"))
    # central sums of a bucket around its own mean, then around that of the column
    parts = hist.selectExpr("column_name", "c", "mean", "c * var as m2", "coalesce(nanvl(g1, 0D), 0D) * pow(var, 1.5D) * c as m3",
                            "coalesce(nanvl(g2 + 3, 0D), 0D) * var * var * c as m4")
    parts = parts.join(F.broadcast(total), "column_name").selectExpr("*", "mean - all_mean as d")       # one row per column
    sums = parts.groupBy("column_name").agg(
        *[F.expr(f"first({x}) as {x}") for x in ("count", "min", "max", "all_mean")], F.expr("sum(m2 + c * d * d) as s2"),
        F.expr("sum(m3 + 3 * d * m2 + c * d * d * d) as s3"), F.expr("sum(m4 + 4 * d * m3 + 6 * d * d * m2 + c * d * d * d * d) as s4"))
    return sums.selectExpr("column_name", "count", "all_mean as mean", "min", "max", "if(count > 1, sqrt(s2 / (count - 1)), null) as std",
                           "if(s2 > 0, sqrt(count) * s3 / pow(s2, 1.5D), null) as _g1", "if(s2 > 0, count * s4 / (s2 * s2) - 3, null) as _g2")


def univariate_numerical(df: DataFrame, cols: list[str] | None = None,
                         numbers: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Count, mean, std, min, max, median, quartiles, skewness, kurtosis.

    ``numbers`` is ``numeric_histogram`` of the columns where a caller has it already."""
    cols = cols if cols is not None else column_types(df)["numerical"]
    if not cols:
        return df.sparkSession.createDataFrame(
            [], "column_name string, count bigint, mean double, std double, min double, "
                "max double, median double, q25 double, q75 double, skewness double, "
                "kurtosis double")
    long, hist = numbers or numeric_histogram(df, cols)
    q = F.col("q")
    table = quantile_table(long, ["column_name"], [0.25, 0.5, 0.75], first=hist).select(
        "column_name", q[0].alias("q25"), q[1].alias("median"), q[2].alias("q75"))
    # one row per column
    t = _moments(hist).join(F.broadcast(table), "column_name")
    return t.select(
        "column_name", "count", "mean", "std", "min", "max", "median", "q25", "q75",
        corrected_skew(F.col("count"), F.col("_g1")).alias("skewness"),
        corrected_kurt(F.col("count"), F.col("_g2")).alias("kurtosis"))


def outlier_bounds(df: DataFrame, cols: list[str], numbers: tuple[DataFrame, DataFrame] | None = None) -> dict:
    """Quartile bounds per column (driver dict; O(columns))."""
    long, hist = numbers or numeric_histogram(df, cols)
    out = {}
    for r in quantile_table(long, ["column_name"], [0.25, 0.75], first=hist).collect():
        q1, q3 = r["q"]
        out[r["column_name"]] = (q1, q3, q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
    return out


def outliers(df: DataFrame, cols: list[str] | None = None,
             numbers: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """IQR outliers (strict) per numeric column; all-null columns skipped."""
    cols = cols if cols is not None else column_types(df)["numerical"]
    bounds = outlier_bounds(df, cols, numbers) if cols else {}
    kept = [c for c in cols if c in bounds]
    if not kept:
        return df.sparkSession.createDataFrame(
            [], "column_name string, outlier_count bigint, outlier_pct double, "
                "lower_bound double, upper_bound double")
    aggs, names = [], []
    for i, c in enumerate(kept):
        _, _, lo, hi = bounds[c]
        v = clean_value(df, c).cast("double")
        cnt = F.count_if((v < F.lit(lo)) | (v > F.lit(hi)))
        aggs.append(F.struct(F.lit(c).alias("column_name"), cnt.alias("outlier_count"),
                             F.count(v).alias("_n"), F.lit(lo).alias("lower_bound"),
                             F.lit(hi).alias("upper_bound")).alias(f"_s{i}"))
        names.append(f"_s{i}")
    t = _explode_structs(df.agg(*aggs), names)
    pct = round_half_even(F.col("outlier_count") * F.lit(100.0) / F.col("_n"), 2)
    return t.select("column_name", "outlier_count", pct.alias("outlier_pct"),
                    "lower_bound", "upper_bound")


def cardinality(df: DataFrame, cols: list[str] | None = None, exact: bool = True,
                high_threshold: int = 50) -> DataFrame:
    """E5: distinct non-missing values per column, ratio to all rows (4 dp)."""
    cols = cols if cols is not None else [
        f.name for f in df.schema.fields
        if f.dataType.typeName() not in ("array", "map", "struct", "binary", "variant")]
    n_rows = df.agg(F.count(F.lit(1)).alias("n"))
    if exact:
        uniq = (value_counts(df, cols).groupBy("column_name")
                .agg(F.count(F.lit(1)).alias("unique_values")))
        names = df.sparkSession.createDataFrame([(c,) for c in cols], "column_name string")
        # per-column result is O(columns) rows: broadcasting it is bounded
        uniq = F.broadcast(names).join(uniq, "column_name", "left") \
            .select("column_name", F.coalesce("unique_values", F.lit(0)).alias("unique_values"))
    else:
        aggs = [F.struct(F.lit(c).alias("column_name"),
                         F.approx_count_distinct(clean_value(df, c)).alias("unique_values"))
                .alias(f"_s{i}") for i, c in enumerate(cols)]
        uniq = _explode_structs(df.agg(*aggs), [f"_s{i}" for i in range(len(cols))])
    t = uniq.crossJoin(F.broadcast(n_rows))
    ratio = F.when(F.col("n") > 0, round_half_even(F.col("unique_values") / F.col("n"), 4)) \
        .otherwise(F.lit(0.0))
    return t.select("column_name", F.col("unique_values").cast("bigint").alias("unique_values"),
                    ratio.alias("cardinality_ratio"),
                    (F.col("unique_values") > high_threshold).alias("is_high_cardinality"))


def top_values(df: DataFrame, cols: list[str] | None = None, k: int = 5,
               trim_blank: bool = False) -> DataFrame:
    """Top-k ``(column_name, rank, value, count)``; ties by value ascending."""
    cols = cols if cols is not None else column_types(df)["categorical"]
    vc = value_counts(df, cols, trim_blank=trim_blank)
    return top_k(vc, "column_name", [F.desc("count"), F.asc("value")], k) \
        .select("column_name", "rank", "value", "count")


def univariate_categorical(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """E7 summary: unique_count, mode, mode_count per categorical column."""
    cols = cols if cols is not None else column_types(df)["categorical"]
    vc = value_counts(df, cols)
    uniq = vc.groupBy("column_name").agg(F.count(F.lit(1)).alias("unique_count"))
    mode = top_k(vc, "column_name", [F.desc("count"), F.asc("value")], 1) \
        .select("column_name", F.col("value").alias("mode"), F.col("count").alias("mode_count"))
    return uniq.join(mode, "column_name").select("column_name", "unique_count", "mode",
                                                  "mode_count")


def column_metadata(df: DataFrame, cols: list[str] | None = None, samples: int = 5) -> DataFrame:
    """Dtype, distinct count and the ``samples`` smallest distinct values as text."""
    cols = cols if cols is not None else [
        f.name for f in df.schema.fields
        if f.dataType.typeName() not in ("array", "map", "struct", "binary", "variant")]
    vc = value_counts(df, cols)
    uniq = vc.groupBy("column_name").agg(F.count(F.lit(1)).alias("unique_values"))
    smallest = top_k(vc, "column_name", [F.asc("value")], samples) \
        .groupBy("column_name").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))),
                        lambda s: s["value"]).alias("sample_values"))
    types = df.sparkSession.createDataFrame(
        [(c, df.schema[c].dataType.simpleString()) for c in cols], "column_name string, dtype string")
    return F.broadcast(types).join(uniq, "column_name", "left").join(smallest, "column_name", "left") \
        .select("column_name", "dtype", F.coalesce("unique_values", F.lit(0)).alias("unique_values"),
                "sample_values")


def dataset_context(df: DataFrame, target: str, class_limit: int = 20) -> DataFrame:
    """row/column counts, problem type and feature-kind counts (one row).

    problem_type = classification when the target has fewer than 20 distinct
    values.  Class shares are in ``class_distribution``.
    """
    roles = column_types(df)
    num = [c for c in roles["numerical"] if c != target]
    cat = [c for c in roles["categorical"] if c != target]
    tv = clean_value(df, target)
    counts = df.where(tv.isNotNull()).groupBy(tv.alias("_t")).agg(F.count(F.lit(1)).alias("_c"))
    stats = counts.agg(F.count(F.lit(1)).alias("n_distinct"), F.max("_c").alias("_mx"),
                       F.min("_c").alias("_mn"))
    base = df.agg(F.count(F.lit(1)).alias("num_rows"))
    t = base.crossJoin(stats)
    cls = F.col("n_distinct") < class_limit
    return t.select(
        "num_rows", F.lit(len(df.columns)).cast("bigint").alias("num_columns"),
        F.lit(target).alias("target_column"),
        F.when(cls, "classification").otherwise("regression").alias("problem_type"),
        F.when(cls, F.col("n_distinct")).alias("num_classes"),
        F.when(cls, F.col("_mx") / F.col("_mn")).alias("imbalance_ratio"),
        F.lit(len(num)).alias("n_numerical"), F.lit(len(cat)).alias("n_categorical"),
        F.lit(len(datetime_columns(df))).alias("n_datetime"))


SKEWED = 1.0


def dataset_details(df: DataFrame, target: str) -> DataFrame:
    """The lists of a dataset context as rows ``(section, item)``.

    Sections: numerical_features, categorical_features, datetime_features, binary_features (two
    values), high_cardinality_categoricals, skewed_features (|skewness| > 1), outliers_detected,
    columns_with_missing, and the flag imbalanced ('true' or 'false', by the minority share).
    """
    from .target import check_imbalance
    spark = df.sparkSession
    roles = column_types(df)
    num = [c for c in roles["numerical"] if c != target]
    cat = [c for c in roles["categorical"] if c != target]
    listed = [("numerical_features", c) for c in num] + [("categorical_features", c) for c in cat]
    listed += [("datetime_features", c) for c in datetime_columns(df)]
    rows = spark.createDataFrame(listed, "section string, item string")
    unique = cardinality(df, num + cat)

    def part(section, table, where):
        return table.where(where).select(F.lit(section).alias("section"), F.col("column_name").alias("item"))

    named = F.col("column_name").isin(cat)
    parts = [part("binary_features", unique, F.col("unique_values") == 2),
             part("high_cardinality_categoricals", unique, F.col("is_high_cardinality") & named),
             part("skewed_features", univariate_numerical(df, num), F.abs("skewness") > SKEWED),
             part("outliers_detected", outliers(df, num), F.col("outlier_count") > 0),
             part("columns_with_missing", missing_values(df), F.col("missing_count") > 0),
             check_imbalance(df, target).select(F.lit("imbalanced").alias("section"),
                                                (~F.col("is_balanced")).cast("string").alias("item"))]
    for p in parts:
        rows = rows.unionByName(p)
    return rows


def class_distribution(df: DataFrame, target: str) -> DataFrame:
    """Share of every class (NULLs excluded)."""
    tv = clean_value(df, target)
    counts = df.where(tv.isNotNull()).groupBy(tv.alias("class")).agg(
        F.count(F.lit(1)).alias("count"))
    total = counts.agg(F.sum("count").alias("_total"))
    return counts.crossJoin(F.broadcast(total)).select(
        F.col("class").cast("string").alias("class"), "count",
        (F.col("count") / F.col("_total")).alias("share"))


def eda_report(df: DataFrame, target: str | None = None, row_count: int | None = None,
               sample_by: list[str] | None = None) -> DataFrame:
    """Every section assembled into one JSON row (plus the fallback sentence).

    ``columns`` has names and types, ``sample`` the first rows in the order ``sample_by``;
    with a target, ``bivariate`` holds correlations and means per category for a numeric one,
    chi-square and box plots per class for any other."""
    from . import bivariate as C
    if row_count is None:
        row_count = df.count()
    missing = missing_values(df)
    numeric = column_types(df)["numerical"]
    numbers = numeric_histogram(df, numeric) if numeric else None       # for both numeric sections
    sections = {
        "overview": overview(df),
        "columns": overview_columns(df),
        "missing_values": missing,
        "outliers": outliers(df, numbers=numbers),
        "cardinality": cardinality(df),
        "univariate_numerical": univariate_numerical(df, numbers=numbers),
        "univariate_categorical": univariate_categorical(df),
        "top_values": top_values(df),
    }
    if sample_by:
        sections["sample"] = sample_rows(df, sample_by)
    if target is not None:
        if target in column_types(df)["numerical"]:
            sections["bivariate"] = C.correlation_with_target(df, target)
            sections["bivariate_categories"] = C.mean_by_category(df, target)
        else:
            sections["bivariate"] = C.chi_square(df, target)
            sections["bivariate_categories"] = C.boxplot_stats(df, target)
    parts = []
    for name, sdf in sections.items():
        parts.append(sdf.agg(F.to_json(F.collect_list(F.struct(*sdf.columns))).alias(name)))
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)            # one row each
    totals = missing.agg(F.sum("missing_count").cast("bigint").alias("total_missing_cells"),
                         F.count_if(F.col("missing_count") > 0).alias("columns_with_missing"))
    out = out.crossJoin(totals)
    summary = F.format_string(
        "The dataset has %d rows and %d columns; %d cells are missing across %d columns.",
        F.lit(row_count).cast("bigint"), F.lit(len(df.columns)).cast("bigint"), F.col("total_missing_cells"),
        F.col("columns_with_missing"))
    return out.select(F.lit(target).alias("target_column"), *sections.keys(),
                      summary.alias("summary"))
