"""Leakage detection (K1-K5).

Deterministic rules over the whole table: correlation with the target,
suspicious names, columns identical to the target.  All correlations and
identity checks come from one aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clean_value, column_types, round_half_even
from ..functions.stats import safe_corr
from ..sources.io import drop_columns

# Name fragments that hint at information from the future.
SUSPICIOUS = ["future", "next", "will", "outcome", "result", "target", "label"]
HIGH_CORR = 0.95
REVIEW_CORR = 0.8

_SCHEMA = "feature string, check string, severity string, value double, reason string"


def _corr_table(df: DataFrame, target: str) -> DataFrame:
    feats = [c for c in column_types(df)["numerical"] if c != target]
    y = clean_value(df, target).cast("double")
    aggs = [F.struct(F.lit(c).alias("feature"),
                     safe_corr(clean_value(df, c).cast("double"), y).alias("corr")).alias(f"_s{i}")
            for i, c in enumerate(feats)]
    if not aggs:
        return df.sparkSession.createDataFrame([], "feature string, corr double")
    row = df.agg(*aggs)
    return row.select(F.explode(F.array(*[F.col(f"_s{i}") for i in range(len(aggs))])).alias("s")) \
        .select("s.*")


def leak_high_correlation(df: DataFrame, target: str, threshold: float = HIGH_CORR,
                          review: float | None = REVIEW_CORR) -> DataFrame:
    """K1: |Pearson| > threshold -> high; (review, threshold] -> low (needs review)."""
    t = _corr_table(df, target)
    a = F.abs(F.col("corr"))
    sev = F.when(a > threshold, "high")
    if review is not None:
        sev = sev.when(a > review, "low")
    v = round_half_even(F.col("corr"), 4)
    return t.where(sev.isNotNull()).select(
        "feature", F.lit("high_correlation").alias("check"), sev.alias("severity"),
        v.alias("value"),
        F.when(a > threshold, F.lit(f"absolute correlation with the target above {threshold}"))
        .otherwise(F.lit(f"absolute correlation with the target above {review}, needs review"))
        .alias("reason"))


def leak_suspicious_name(df: DataFrame, target: str) -> DataFrame:
    """K2: lower-cased name contains a suspicious fragment (first match only)."""
    named = {c: next((w for w in SUSPICIOUS if w in c.lower()), None) for c in df.columns if c != target}
    rows = [(c, "suspicious_name", "medium", None, f"column name contains '{w}'") for c, w in named.items() if w]
    return df.sparkSession.createDataFrame(rows, _SCHEMA)


def leak_identical(df: DataFrame, target: str) -> DataFrame:
    """K3: same type and equal to the target on every row (NULL equals NULL)."""
    tt = df.schema[target].dataType
    same = [c for c in df.columns if c != target and df.schema[c].dataType == tt]
    if not same:
        return df.sparkSession.createDataFrame([], _SCHEMA)
    row = df.agg(*[F.bool_and(F.col(c).eqNullSafe(F.col(target))).alias(f"_e{i}")
                   for i, c in enumerate(same)])
    structs = [F.struct(F.lit(c).alias("feature"), F.col(f"_e{i}").alias("eq"))
               for i, c in enumerate(same)]
    t = row.select(F.explode(F.array(*structs)).alias("s")).select("s.*")
    return t.where(F.coalesce("eq", F.lit(True))).select(
        "feature", F.lit("identical_to_target").alias("check"), F.lit("critical").alias("severity"),
        F.lit(None).cast("double").alias("value"),
        F.lit("column is identical to the target").alias("reason"))


def leakage_report(df: DataFrame, target: str) -> DataFrame:
    """K4: all warnings with the service's risk level (high / medium / low)."""
    u = (leak_high_correlation(df, target).unionByName(leak_suspicious_name(df, target))
         .unionByName(leak_identical(df, target)))
    risk = (F.when(F.col("severity").isin("critical", "high"), "high")
            .when(F.col("severity") == "medium", "medium").otherwise("low"))
    return u.withColumn("risk", risk)


def leakage_summary(report: DataFrame) -> DataFrame:
    """K4 totals: counts per risk and overall risk (one row)."""
    return report.agg(
        F.count_if(F.col("risk") == "high").alias("high_risk"),
        F.count_if(F.col("risk") == "medium").alias("medium_risk"),
        F.count_if(F.col("risk") == "low").alias("low_risk"),
        F.count_if(F.col("severity") == "critical").alias("critical"),
    ).withColumn("overall_risk", F.when(F.col("critical") > 0, "high")
                 .when(F.col("high_risk") + F.col("medium_risk") + F.col("low_risk") > 0, "medium")
                 .otherwise("low"))


def leakage_mitigation(df: DataFrame, columns: list[str], target: str | None = None):
    """K5: drop the named columns (never the target); returns (df, dropped, ignored)."""
    return drop_columns(df, columns, protect=target)
