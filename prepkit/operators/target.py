"""Target handling, imbalance checks and rule-based recommendations.

P7-P12 (target cleaning), I1-I8 (target typing and imbalance), R1/R2
(feature and bias recommendations).  Every check is one or two aggregations;
only one row per class (or per column) reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import (FLOAT_TYPES, NUMERIC_TYPES, canonical_str, clean_value,
                                 column_types)
from ..functions.stats import corrected_skew, exact_quantiles, unpivot_values
from .profile import missing_values
from .transforms import TRUTHY

# Preferred target names, in order; minority-share ladder.
TARGET_NAMES = ["target", "label", "class", "y", "output"]
IMBALANCE_LADDER = [(0.45, "balanced"), (0.30, "mildly_imbalanced"),
                    (0.10, "moderately_imbalanced")]
SEVERE = "severely_imbalanced"


# --- P7-P12 -------------------------------------------------------------------

def drop_null_target(df: DataFrame, t: str) -> DataFrame:
    """Drop rows whose target is NULL (or NaN)."""
    return df.where(clean_value(df, t).isNotNull())


def clean_binary_target(df: DataFrame, t: str) -> DataFrame:
    """To number (bad -> NULL), round half-even, keep 0/1, bigint."""
    v = F.col(t).cast("string").try_cast("double") if not isinstance(
        df.schema[t].dataType, NUMERIC_TYPES) else clean_value(df, t).cast("double")
    r = F.bround(v, 0)
    return df.withColumn(t, r).where(F.col(t).isin(0.0, 1.0)).withColumn(t, F.col(t).cast("bigint"))


def clean_binary_target_report(df: DataFrame, t: str) -> DataFrame:
    """P8 with the dropped-row count: one aggregation over the input."""
    v = F.col(t).cast("string").try_cast("double") if not isinstance(
        df.schema[t].dataType, NUMERIC_TYPES) else clean_value(df, t).cast("double")
    keep = F.bround(v, 0).isin(0.0, 1.0)
    return df.agg(F.count(F.lit(1)).alias("rows_before"),
                  F.count_if(keep).alias("rows_after")).withColumn(
        "rows_dropped", F.col("rows_before") - F.col("rows_after"))


def flatten_target_cell(df: DataFrame, t: str) -> DataFrame:
    """First element of nested arrays; floats rounded to int; NaN -> NULL; bool -> int."""
    c = F.col(t)
    dt = df.schema[t].dataType
    while isinstance(dt, T.ArrayType):
        c = F.get(c, 0)
        dt = dt.elementType
    if isinstance(dt, FLOAT_TYPES):
        c = F.bround(F.nanvl(c, F.lit(None).cast(dt)), 0).cast("bigint")
    elif isinstance(dt, T.BooleanType):
        c = c.cast("int")
    elif isinstance(dt, T.BinaryType):
        c = F.decode(c, "utf-8")
    return df.withColumn(t, c)


def find_target(columns: list[str]) -> str | None:
    """P10: first preferred name present (case-sensitive), else the last column."""
    for name in TARGET_NAMES:
        if name in columns:
            return name
    return columns[-1] if columns else None


def resolve_target(columns: list[str], candidate: str | None) -> str | None:
    """The column named like the candidate (exactly, else in any case); the first column if none is.

    Blanks inside the candidate stand for underscores."""
    wanted = (candidate or "").strip().replace(" ", "_")
    ranked = sorted(range(len(columns)), key=lambda i: (columns[i] != wanted, columns[i].lower() != wanted.lower(), i))
    return columns[ranked[0]] if ranked else None


def encode_binary_target(df: DataFrame, t: str, name: str = "target") -> Column:
    """Truthy text -> 1, anything else (NULL too) -> 0."""
    return F.when(canonical_str(df, t).isin(TRUTHY), 1).otherwise(0).alias(name)


# --- I1-I8 -------------------------------------------------------------------

def _status(minority: Column) -> Column:
    e = None
    for th, name in IMBALANCE_LADDER:
        e = F.when(minority >= th, name) if e is None else e.when(minority >= th, name)
    return e.otherwise(SEVERE)


def class_counts(df: DataFrame, t: str) -> DataFrame:
    v = clean_value(df, t)
    return df.where(v.isNotNull()).groupBy(v.alias("class")).agg(F.count(F.lit(1)).alias("count"))


def check_imbalance(df: DataFrame, t: str) -> DataFrame:
    """I1 + I3: status from the minority share; majority/minority ratio (one row)."""
    s = class_counts(df, t).agg(F.sum("count").alias("_n"), F.min("count").alias("_mn"),
                                F.max("count").alias("_mx"), F.count(F.lit(1)).alias("n_classes"))
    minority = F.col("_mn") / F.col("_n")
    return s.select(
        _status(minority).alias("status"), minority.alias("minority_ratio"),
        (F.col("_mx") / F.col("_mn")).alias("imbalance_ratio"), "n_classes",
        (minority >= 0.45).alias("is_balanced"))


def check_continuous_imbalance(df: DataFrame, t: str, skew_threshold: float = 1.0,
                               tail_threshold: float = 0.05) -> DataFrame:
    """Bias-corrected skew and share above the 95th percentile (one row)."""
    v = clean_value(df, t).cast("double")
    q95 = exact_quantiles(unpivot_values(df, [t]), [0.95]).get(t, [None])[0]
    row = df.agg(F.count(v).alias("_n"), F.skewness(v).alias("_g1"),
                 F.avg(F.coalesce(v > F.lit(q95), F.lit(False)).cast("double")).alias("rare_ratio"))
    skew = corrected_skew(F.col("_n"), F.col("_g1"))
    return row.select(
        ((F.abs(skew) > skew_threshold) | (F.col("rare_ratio") < tail_threshold)).alias("is_imbalanced"),
        skew.alias("skewness"), "rare_ratio")


def few_distinct(df: DataFrame, t: str, most: int) -> list[float] | None:
    """The different values of a numeric target if there are at most ``most``, else None.

    A sketch answers first, so a continuous target is never shuffled as a whole; its error is far
    below the factor of ten that is left between it and the exact answer."""
    v = clean_value(df, t).cast("double")
    if df.agg(F.approx_count_distinct(v)).first()[0] > 10 * most:
        return None
    found = df.select(v.alias("v")).where("v IS NOT NULL").distinct().limit(most + 1).collect()
    return None if len(found) > most else [r["v"] for r in found]


def target_type(df: DataFrame, t: str, rule: str = "default") -> str:
    """I4: categorical / continuous ('default' rule has the <=10 distinct test)."""
    if not isinstance(df.schema[t].dataType, NUMERIC_TYPES):
        return "categorical"
    values = few_distinct(df, t, 10 if rule == "default" else 2)
    if values is None:
        return "continuous"
    return "categorical" if rule == "default" or set(values) <= {0.0, 1.0} else "continuous"


def problem_type(df: DataFrame, t: str) -> str:
    """Text -> classification; <=20 values exactly 0..k-1 -> classification."""
    if isinstance(df.schema[t].dataType, (T.StringType, T.BooleanType)):
        return "classification"
    values = few_distinct(df, t, 20)
    return "classification" if values and sorted(values) == list(range(len(values))) else "regression"


def run_imbalance_analysis(df: DataFrame, t: str) -> DataFrame:
    """I4 then I1 or I2; one row ``target_type, is_balanced, status, ...``."""
    tt = target_type(df, t)
    if tt == "categorical":
        r = check_imbalance(df, t)
        return r.select(F.lit(tt).alias("target_type"), "is_balanced", "status",
                        "minority_ratio", F.lit(None).cast("double").alias("skewness"),
                        F.lit(None).cast("double").alias("rare_ratio"))
    r = check_continuous_imbalance(df, t)
    return r.select(F.lit(tt).alias("target_type"), (~F.col("is_imbalanced")).alias("is_balanced"),
                    F.when(F.col("is_imbalanced"), "imbalanced").otherwise("balanced").alias("status"),
                    F.lit(None).cast("double").alias("minority_ratio"), "skewness", "rare_ratio")


# Allowed balancing techniques per target kind.
TECHNIQUES = {
    "continuous": ["smoter", "gaussian_noise", "kde_resample", "quantile_bin_oversample",
                   "tail_resample"],
    "categorical_mixed": ["smotenc", "random_oversample", "random_undersample",
                          "cluster_oversample"],
    "categorical_numeric": ["smote", "adasyn", "random_oversample", "random_undersample",
                            "cluster_oversample"],
}


def recommend_balancing(spark, target_kind: str, has_mixed: bool) -> DataFrame:
    """I8: allowed techniques as rows (deterministic replacement of the LLM pick)."""
    key = target_kind if target_kind == "continuous" else (
        "categorical_mixed" if has_mixed else "categorical_numeric")
    return spark.createDataFrame([(i + 1, n) for i, n in enumerate(TECHNIQUES[key])],
                                 "priority int, technique string")


def imbalance_analysis(df: DataFrame, t: str | None = None) -> DataFrame:
    """Flatten + clean the target, type it, measure, count feature kinds (one row)."""
    t = t or find_target(df.columns)
    flat = clean_binary_target(flatten_target_cell(df, t), t)
    roles = column_types(flat)
    n_num = len(roles["numerical"])          # includes the target, as the service counts it
    n_cat = len([c for c in roles["categorical"] if c != t])
    has_mixed = n_num > 0 and n_cat > 0
    rep = run_imbalance_analysis(flat, t)
    techs = TECHNIQUES["categorical_mixed" if has_mixed else "categorical_numeric"]
    return rep.select(F.lit(t).alias("target_column"), "*",
                      F.lit(n_num).alias("n_numerical"), F.lit(n_cat).alias("n_categorical"),
                      F.lit(has_mixed).alias("has_mixed_features"),
                      F.lit(",".join(techs)).alias("techniques"))


# --- R1 / R2 -----------------------------------------------------------------

def recommend_features(df: DataFrame, target: str | None = None) -> DataFrame:
    """R1 rule fallback: rows ``(feature, step, technique, reason)``.

    numeric: median_imputation when anything is missing, then standardization;
    categorical: mode_imputation when anything is missing, then label_encoding.
    """
    roles = column_types(df)
    miss = missing_values(df).select("column_name", "missing_count")
    kinds = [(c, "numerical") for c in roles["numerical"] if c != target] + \
            [(c, "categorical") for c in roles["categorical"] if c != target]
    spark = df.sparkSession
    k = spark.createDataFrame(kinds, "feature string, kind string")
    j = k.join(F.broadcast(miss), k.feature == miss.column_name).drop("column_name")
    num = F.col("kind") == "numerical"
    imp = F.when(F.col("missing_count") > 0, F.struct(
        F.lit(1).alias("step"),
        F.when(num, "median_imputation").otherwise("mode_imputation").alias("technique"),
        F.when(num, "numeric column with missing values: fill with the median")
        .otherwise("categorical column with missing values: fill with the mode").alias("reason")))
    main = F.struct(F.lit(2).alias("step"),
                    F.when(num, "standardization").otherwise("label_encoding").alias("technique"),
                    F.when(num, "numeric column: scale to zero mean and unit variance")
                    .otherwise("categorical column: encode levels as integers").alias("reason"))
    arr = F.filter(F.array(imp, main), lambda x: x.isNotNull())
    return j.select("feature", F.explode(arr).alias("r")).select("feature", "r.*")


def representation_bias(df: DataFrame, sensitive: list[str], t: str,
                        min_share: float = 0.10, high_gap: float = 0.2,
                        medium_gap: float = 0.1) -> DataFrame:
    """R2: per group share and positive-outcome rate; gap to the overall rate; risk."""
    y = clean_value(df, t).cast("double")
    structs = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("group"))
               for c in sensitive]
    long = df.select(F.explode(F.array(*structs)).alias("s"), y.alias("y")).select("s.*", "y")
    g = long.groupBy("feature", "group").agg(F.count(F.lit(1)).alias("n"),
                                             F.avg("y").alias("outcome_rate"))
    tot = df.agg(F.count(F.lit(1)).alias("_total"), F.avg(y).alias("_overall"))
    j = g.crossJoin(F.broadcast(tot))
    share = F.col("n") / F.col("_total")
    gap = F.abs(F.col("outcome_rate") - F.col("_overall"))
    risk = (F.when((share < min_share) | (gap > high_gap), "high")
            .when(gap > medium_gap, "medium").otherwise("low"))
    return j.select("feature", "group", "n", share.alias("share"), "outcome_rate",
                    gap.alias("outcome_gap"), risk.alias("risk"))
