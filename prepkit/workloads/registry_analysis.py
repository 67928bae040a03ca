"""Registered queries for plans, bivariate statistics, leakage and target checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bivariate as C
from ..operators import leakage as K
from ..operators import target as I
from ..plans.feature_plan import FeaturePlan, plan_from_recommendations
from ..sources import fixtures as FX
from ..sources.io import read_table
from . import sqlgen as S
from .registry import register

LI = f"li AS ({S.LI_NULLS})"
MODE_RF = ("(SELECT v FROM (SELECT l_returnflag AS v, count(*) AS c FROM li WHERE l_returnflag IS NOT NULL "
           "GROUP BY 1) ORDER BY c DESC, v LIMIT 1)")
TRUTHY_SQL = "('1','Yes','yes','YES','true','True','TRUE')"


def _scaled(col):
    return (f"(CAST({col}_imputed AS DOUBLE) - (SELECT avg({col}) FROM li)) / "
            f"NULLIF((SELECT stddev_samp({col}) FROM li), 0)")


# --- PL ------------------------------------------------------------------------

PLAN = [
    {"column_name": "l_quantity", "fe_method": "median_imputation"},
    {"column_name": "l_quantity", "fe_method": "standardization"},
    {"column_name": "l_extendedprice", "fe_method": "normalization"},
    {"column_name": "l_returnflag", "fe_method": "label_encoding"},
    {"column_name": "l_returnflag", "fe_method": "mode_imputation"},
    {"column_name": "l_discount", "fe_method": "log_transformation"},
    {"column_name": "l_tax", "fe_method": "sqrt_transformation"},
    {"column_name": "l_linestatus", "fe_method": "frequency_encoding"},
    {"column_name": "l_partkey", "fe_method": "hash_encoding"},
    {"column_name": "l_suppkey", "fe_method": "robust_scaling"},
]


@register("feature_plan_li_nulls",
          f"WITH {LI}, imputed AS (SELECT "
          "COALESCE(l_quantity, (SELECT quantile_disc(l_quantity, 0.5) FROM li)) AS l_quantity_imputed, "
          "l_extendedprice AS l_extendedprice_imputed, "
          f"COALESCE(l_returnflag, {MODE_RF}) AS l_returnflag_imputed, "
          "l_discount AS l_discount_imputed, l_tax AS l_tax_imputed, l_linestatus AS l_linestatus_imputed, "
          "l_partkey AS l_partkey_imputed, l_suppkey AS l_suppkey_imputed, l_linenumber AS l_linenumber_raw FROM li) "
          f"SELECT {_scaled('l_quantity')} AS l_quantity_imputed_scaled, "
          "(l_extendedprice_imputed - (SELECT min(l_extendedprice) FROM li)) / NULLIF((SELECT max(l_extendedprice) - "
          "min(l_extendedprice) FROM li), 0) AS l_extendedprice_scaled, "
          "DENSE_RANK() OVER (ORDER BY CAST(l_returnflag_imputed AS VARCHAR) NULLS FIRST) - 1 AS l_returnflag_imputed_encoded, "
          "ln(l_discount_imputed + 1) AS l_discount_log, sqrt(abs(l_tax_imputed)) AS l_tax_sqrt, "
          "COUNT(*) OVER (PARTITION BY CAST(l_linestatus_imputed AS VARCHAR)) AS l_linestatus_encoded, "
          "('0x' || substr(md5(CAST(l_partkey_imputed AS VARCHAR)), 1, 15))::BIGINT % 50 AS l_partkey_encoded, "
          "(CAST(l_suppkey_imputed AS DOUBLE) - (SELECT quantile_cont(l_suppkey, 0.5) FROM li)) / NULLIF((SELECT "
          "quantile_cont(l_suppkey, 0.75) - quantile_cont(l_suppkey, 0.25) FROM li), 0) AS l_suppkey_scaled, "
          f"CASE WHEN CAST(l_linenumber_raw AS VARCHAR) IN {TRUTHY_SQL} THEN 1 ELSE 0 END AS target FROM imputed")
def _q(spark, sf):
    df = FX.li_nulls(spark, sf)
    return FeaturePlan(PLAN, target_column="l_linenumber").fit(df).transform(df)


_REC_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
            "l_discount", "l_tax"]
_REC_CAT = ["l_returnflag"]


def _rec_sql():
    parts = []
    for c in _REC_NUM:
        parts.append(f"SELECT '{c}' AS feature, 'numerical' AS kind, count_if({c} IS NULL OR isnan({c})) AS mc FROM li"
                     if c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax") else
                     f"SELECT '{c}' AS feature, 'numerical' AS kind, count_if({c} IS NULL) AS mc FROM li")
    for c in _REC_CAT:
        parts.append(f"SELECT '{c}' AS feature, 'categorical' AS kind, count_if({c} IS NULL) AS mc FROM li")
    m = " UNION ALL ".join(parts)
    return (f"WITH {LI}, m AS ({m}) "
            "SELECT feature, 1 AS step, CASE WHEN kind = 'numerical' THEN 'median_imputation' ELSE 'mode_imputation' END "
            "AS technique, CASE WHEN kind = 'numerical' THEN 'numeric column with missing values: fill with the median' "
            "ELSE 'categorical column with missing values: fill with the mode' END AS reason FROM m WHERE mc > 0 "
            "UNION ALL SELECT feature, 2 AS step, CASE WHEN kind = 'numerical' THEN 'standardization' ELSE 'label_encoding' "
            "END AS technique, CASE WHEN kind = 'numerical' THEN 'numeric column: scale to zero mean and unit variance' "
            "ELSE 'categorical column: encode levels as integers' END AS reason FROM m")


@register("recommend_features_li_nulls", _rec_sql())
def _q(spark, sf):
    return I.recommend_features(FX.li_nulls(spark, sf), target="l_linestatus")


def _rec_plan_sql():
    imp = ["COALESCE(l_quantity, (SELECT quantile_disc(l_quantity, 0.5) FROM li)) AS l_quantity_imputed",
           f"COALESCE(l_returnflag, {MODE_RF}) AS l_returnflag_imputed"]
    imp += [f"{c} AS {c}_imputed" for c in _REC_NUM if c != "l_quantity"]
    out = [f"{_scaled('l_quantity')} AS l_quantity_imputed_scaled"]
    out += [f"{_scaled(c)} AS {c}_scaled" for c in _REC_NUM if c != "l_quantity"]
    out += ["DENSE_RANK() OVER (ORDER BY CAST(l_returnflag_imputed AS VARCHAR) NULLS FIRST) - 1 "
            "AS l_returnflag_imputed_encoded",
            f"CASE WHEN CAST(l_linestatus_raw AS VARCHAR) IN {TRUTHY_SQL} THEN 1 ELSE 0 END AS target"]
    return (f"WITH {LI}, imputed AS (SELECT {', '.join(imp)}, l_linestatus AS l_linestatus_raw FROM li) "
            f"SELECT {', '.join(out)} FROM imputed")


@register("feature_plan_recommended_li_nulls", _rec_plan_sql())
def _q(spark, sf):
    df = FX.li_nulls(spark, sf)
    plan = plan_from_recommendations(I.recommend_features(df, target="l_linestatus"))
    return FeaturePlan(plan, target_column="l_linestatus").fit(df).transform(df)


# --- C ---------------------------------------------------------------------------

def _corr_sql(x, y):
    b = f"({x} IS NOT NULL AND {y} IS NOT NULL)"
    xx, yy = f"CASE WHEN {b} THEN CAST({x} AS DOUBLE) END", f"CASE WHEN {b} THEN CAST({y} AS DOUBLE) END"
    return f"covar_pop({xx}, {yy}) / NULLIF(stddev_pop({xx}) * stddev_pop({yy}), 0)"


_HIST_COLS = [("l_quantity", "f"), ("l_extendedprice", "f"), ("l_discount", "f")]


@register("histogram_lineitem",
          f"WITH long AS ({S.long_numeric('lineitem', _HIST_COLS)}), "
          "r AS (SELECT column_name, CASE WHEN min(v) = max(v) THEN min(v) - 0.5 ELSE min(v) END AS lo, "
          "CASE WHEN min(v) = max(v) THEN max(v) + 0.5 ELSE max(v) END AS hi FROM long WHERE v IS NOT NULL GROUP BY 1), "
          "c AS (SELECT l.column_name, least(CAST(floor((v - lo) / ((hi - lo) / 30.0)) AS INTEGER), 29) AS bin, "
          "count(*) AS cnt FROM long l JOIN r USING (column_name) WHERE v IS NOT NULL GROUP BY ALL), "
          "g AS (SELECT column_name, lo, hi, CAST(unnest(range(0, 30)) AS INTEGER) AS bin FROM r) "
          "SELECT g.column_name, g.bin, lo + bin * (hi - lo) / 30 AS bin_start, lo + (bin + 1) * (hi - lo) / 30 "
          "AS bin_end, coalesce(c.cnt, 0) AS count FROM g LEFT JOIN c USING (column_name, bin)")
def _q(spark, sf):
    return C.histogram(read_table(spark, sf, "lineitem"), [c for c, _ in _HIST_COLS])


@register("kde_curve_events")
def _q(spark, sf):
    return C.kde_curve(read_table(spark, sf, "events"), "value")


@register("top_category_values_documents",
          "WITH long AS (SELECT 'lang' AS column_name, NULLIF(regexp_replace(CAST(lang AS VARCHAR), '^\\s+|\\s+$', '', 'g'), '') AS value FROM documents "
          "UNION ALL SELECT 'source', NULLIF(regexp_replace(CAST(source AS VARCHAR), '^\\s+|\\s+$', '', 'g'), '') FROM documents), "
          "vc AS (SELECT column_name, value, count(*) AS count FROM long WHERE value IS NOT NULL GROUP BY ALL) "
          "SELECT column_name, rank, value, count FROM (SELECT column_name, value, count, CAST(row_number() OVER "
          "(PARTITION BY column_name ORDER BY count DESC, value) AS INTEGER) AS rank FROM vc) WHERE rank <= 10")
def _q(spark, sf):
    return C.top_category_values(read_table(spark, sf, "documents"), ["lang", "source"])


@register("correlation_with_target_lineitem",
          " UNION ALL ".join(f"SELECT '{c}' AS column_name, {_corr_sql(c, 'l_extendedprice')} AS correlation "
                             "FROM lineitem" for c in ["l_quantity", "l_discount", "l_tax", "l_partkey"]))
def _q(spark, sf):
    return C.correlation_with_target(read_table(spark, sf, "lineitem"), "l_extendedprice",
                                     ["l_quantity", "l_discount", "l_tax", "l_partkey"])


@register("mean_by_category_documents",
          f"WITH d AS ({S.DOC_BINARY}), long AS (SELECT 'lang' AS column_name, CAST(lang AS VARCHAR) AS value, "
          "CAST(target AS DOUBLE) AS y FROM d UNION ALL SELECT 'source', CAST(source AS VARCHAR), CAST(target AS DOUBLE) "
          "FROM d) SELECT column_name, value, avg(y) AS mean, count(y) AS count, stddev_samp(y) AS std FROM long "
          "WHERE value IS NOT NULL GROUP BY ALL")
def _q(spark, sf):
    return C.mean_by_category(FX.doc_binary(spark, sf), "target", ["lang", "source"])


@register("boxplot_stats_documents",
          f"WITH d AS ({S.DOC_NUMERIC}), long AS (SELECT 'n_chars' AS column_name, CAST(target AS VARCHAR) AS class, "
          "CAST(n_chars AS DOUBLE) AS v FROM d UNION ALL SELECT 'quality', CAST(target AS VARCHAR), CAST(quality AS DOUBLE) "
          "FROM d), b AS (SELECT column_name, class, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, "
          "quantile_cont(v, 0.75) AS q3 FROM long WHERE v IS NOT NULL AND class IS NOT NULL GROUP BY ALL) "
          "SELECT l.column_name, l.class, any_value(q1) AS q1, any_value(median) AS median, any_value(q3) AS q3, "
          "min(CASE WHEN v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1) THEN v END) AS whisker_low, "
          "max(CASE WHEN v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1) THEN v END) AS whisker_high, "
          "count_if(NOT (v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1))) AS fliers "
          "FROM long l JOIN b USING (column_name, class) GROUP BY ALL")
def _q(spark, sf):
    return C.boxplot_stats(FX.doc_numeric(spark, sf), "target", ["n_chars", "quality"])


@register("chi_square_documents",
          f"WITH d AS ({S.DOC_BINARY}), long AS (SELECT 'lang' AS column_name, CAST(lang AS VARCHAR) AS value, "
          "CAST(target AS VARCHAR) AS class FROM d UNION ALL SELECT 'source', CAST(source AS VARCHAR), "
          "CAST(target AS VARCHAR) FROM d), "
          "obs AS (SELECT column_name, value, class, count(*) AS o FROM long WHERE value IS NOT NULL AND class IS NOT NULL "
          "GROUP BY ALL), rt AS (SELECT column_name, value, sum(o) AS rt FROM obs GROUP BY ALL), "
          "ct AS (SELECT column_name, class, sum(o) AS ct FROM obs GROUP BY ALL), "
          "tot AS (SELECT column_name, sum(o) AS n FROM obs GROUP BY ALL), "
          "dims AS (SELECT tot.column_name, (SELECT count(*) FROM rt WHERE rt.column_name = tot.column_name) AS r, "
          "(SELECT count(*) FROM ct WHERE ct.column_name = tot.column_name) AS c, n FROM tot), "
          "grid AS (SELECT rt.column_name, rt.rt, ct.ct, coalesce(obs.o, 0) AS o, dims.r, dims.c, dims.n FROM rt "
          "JOIN ct ON rt.column_name = ct.column_name LEFT JOIN obs ON obs.column_name = rt.column_name AND "
          "obs.value = rt.value AND obs.class = ct.class JOIN dims ON dims.column_name = rt.column_name), "
          "s AS (SELECT column_name, sum(power(CASE WHEN (r - 1) * (c - 1) = 1 THEN abs(o - rt * ct / n) - "
          "least(0.5, abs(o - rt * ct / n)) ELSE abs(o - rt * ct / n) END, 2) / (rt * ct / n)) AS chi2, "
          "any_value((r - 1) * (c - 1)) AS dof FROM grid GROUP BY column_name) "
          "SELECT column_name, CASE WHEN dof > 0 THEN chi2 ELSE 0.0 END AS chi2, CAST(dof AS BIGINT) AS dof FROM s")
def _q(spark, sf):
    return C.chi_square(FX.doc_binary(spark, sf), "target", ["lang", "source"])


@register("crosstab_orders",
          "SELECT CAST(o_orderstatus AS VARCHAR) AS o_orderstatus, CAST(o_orderpriority AS VARCHAR) AS o_orderpriority, "
          "count(*) AS count FROM orders WHERE o_orderstatus IS NOT NULL AND o_orderpriority IS NOT NULL GROUP BY ALL")
def _q(spark, sf):
    return C.crosstab(read_table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority")


# --- K ---------------------------------------------------------------------------

_LEAKY = (f"lk AS (SELECT *, CAST(l_linestatus = 'O' AS INTEGER) AS y, CAST(l_linestatus = 'O' AS INTEGER) AS y_copy, "
          "CAST(l_linestatus = 'O' AS INTEGER) + l_discount * 0.1 AS y_noisy, l_tax AS next_flag FROM li)")
_LEAK_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
             "l_discount", "l_tax", "y_copy", "y_noisy", "next_flag"]


@register("leakage_report_leaky",
          f"WITH {LI}, {_LEAKY}, corr AS ("
          + " UNION ALL ".join(f"SELECT '{c}' AS feature, {_corr_sql(c, 'y')} AS corr FROM lk" for c in _LEAK_NUM)
          + ") SELECT feature, 'high_correlation' AS \"check\", CASE WHEN abs(corr) > 0.95 THEN 'high' ELSE 'low' END "
          "AS severity, round_even(corr, 4) AS value, CASE WHEN abs(corr) > 0.95 THEN "
          "'absolute correlation with the target above 0.95' ELSE "
          "'absolute correlation with the target above 0.8, needs review' END AS reason, "
          "CASE WHEN abs(corr) > 0.95 THEN 'high' ELSE 'low' END AS risk FROM corr WHERE abs(corr) > 0.8 "
          "UNION ALL SELECT 'next_flag', 'suspicious_name', 'medium', NULL, 'column name contains ''next''', 'medium' "
          "UNION ALL SELECT 'y_copy', 'identical_to_target', 'critical', NULL, 'column is identical to the target', 'high' "
          "FROM lk HAVING bool_and(y_copy IS NOT DISTINCT FROM y) "
          "UNION ALL SELECT 'l_linenumber', 'identical_to_target', 'critical', NULL, 'column is identical to the target', "
          "'high' FROM lk HAVING bool_and(l_linenumber IS NOT DISTINCT FROM y)")
def _q(spark, sf):
    return K.leakage_report(FX.leaky(spark, sf), "y")


@register("leakage_mitigation_leaky",
          f"WITH {LI}, {_LEAKY} SELECT * EXCLUDE (y_copy, next_flag) FROM lk")
def _q(spark, sf):
    out, _, _ = K.leakage_mitigation(FX.leaky(spark, sf), [" Y_COPY", "next_flag", "y", "nope"], target="y")
    return out


# --- I / R -----------------------------------------------------------------------

@register("check_imbalance_documents",
          f"WITH d AS ({S.DOC_BINARY}), c AS (SELECT target, count(*) AS n FROM d WHERE target IS NOT NULL GROUP BY 1), "
          "s AS (SELECT sum(n) AS tot, min(n) AS mn, max(n) AS mx, count(*) AS k FROM c) "
          "SELECT CASE WHEN mn / tot >= 0.45 THEN 'balanced' WHEN mn / tot >= 0.30 THEN 'mildly_imbalanced' "
          "WHEN mn / tot >= 0.10 THEN 'moderately_imbalanced' ELSE 'severely_imbalanced' END AS status, "
          "mn / tot AS minority_ratio, mx / mn AS imbalance_ratio, k AS n_classes, mn / tot >= 0.45 AS is_balanced FROM s")
def _q(spark, sf):
    return I.check_imbalance(FX.doc_binary(spark, sf), "target")


@register("check_imbalance_lineitem_status",
          "WITH c AS (SELECT l_linestatus, count(*) AS n FROM lineitem GROUP BY 1), "
          "s AS (SELECT sum(n) AS tot, min(n) AS mn, max(n) AS mx, count(*) AS k FROM c) "
          "SELECT CASE WHEN mn / tot >= 0.45 THEN 'balanced' WHEN mn / tot >= 0.30 THEN 'mildly_imbalanced' "
          "WHEN mn / tot >= 0.10 THEN 'moderately_imbalanced' ELSE 'severely_imbalanced' END AS status, "
          "mn / tot AS minority_ratio, mx / mn AS imbalance_ratio, k AS n_classes, mn / tot >= 0.45 AS is_balanced FROM s")
def _q(spark, sf):
    return I.check_imbalance(read_table(spark, sf, "lineitem"), "l_linestatus")


def _cont_sql(table, col):
    return (f"WITH e AS (SELECT CAST({col} AS DOUBLE) AS v FROM {table}), q AS (SELECT quantile_cont(v, 0.95) AS q95, "
            "count(v) AS n, skewness(v) AS sk FROM e), r AS (SELECT avg(CASE WHEN v > (SELECT q95 FROM q) THEN 1.0 "
            "ELSE 0.0 END) AS rr FROM e) SELECT (abs(CASE WHEN n > 2 THEN coalesce(sk, 0) ELSE 0 END) > 1.0 OR rr < 0.05) "
            "AS is_imbalanced, CASE WHEN n > 2 THEN coalesce(sk, 0) ELSE 0 END AS skewness, rr AS rare_ratio FROM q, r")


@register("check_continuous_imbalance_events", _cont_sql("events", "value"))
def _q(spark, sf):
    return I.check_continuous_imbalance(read_table(spark, sf, "events"), "value")


@register("check_continuous_imbalance_orders", _cont_sql("orders", "o_totalprice"))
def _q(spark, sf):
    return I.check_continuous_imbalance(read_table(spark, sf, "orders"), "o_totalprice")


@register("imbalance_analysis_nested_target",
          "WITH c AS (SELECT toxic, count(*) AS n FROM labels WHERE toxic IN (0, 1) GROUP BY 1), "
          "s AS (SELECT sum(n) AS tot, min(n) AS mn FROM c) "
          "SELECT 'toxic' AS target_column, 'categorical' AS target_type, mn / tot >= 0.45 AS is_balanced, "
          "CASE WHEN mn / tot >= 0.45 THEN 'balanced' WHEN mn / tot >= 0.30 THEN 'mildly_imbalanced' "
          "WHEN mn / tot >= 0.10 THEN 'moderately_imbalanced' ELSE 'severely_imbalanced' END AS status, "
          "mn / tot AS minority_ratio, CAST(NULL AS DOUBLE) AS skewness, CAST(NULL AS DOUBLE) AS rare_ratio, "
          "3 AS n_numerical, 0 AS n_categorical, false AS has_mixed_features, "
          "'smote,adasyn,random_oversample,random_undersample,cluster_oversample' AS techniques FROM s")
def _q(spark, sf):
    return I.imbalance_analysis(FX.nested_target(spark, sf), "toxic")


@register("run_imbalance_analysis_events",
          "WITH e AS (SELECT value AS v FROM events), q AS (SELECT quantile_cont(v, 0.95) AS q95, count(v) AS n, "
          "skewness(v) AS sk FROM e), r AS (SELECT avg(CASE WHEN v > (SELECT q95 FROM q) THEN 1.0 ELSE 0.0 END) AS rr "
          "FROM e), x AS (SELECT (abs(CASE WHEN n > 2 THEN coalesce(sk, 0) ELSE 0 END) > 1.0 OR rr < 0.05) AS imb, "
          "CASE WHEN n > 2 THEN coalesce(sk, 0) ELSE 0 END AS sk2, rr FROM q, r) "
          "SELECT 'continuous' AS target_type, NOT imb AS is_balanced, CASE WHEN imb THEN 'imbalanced' ELSE "
          "'balanced' END AS status, CAST(NULL AS DOUBLE) AS minority_ratio, sk2 AS skewness, rr AS rare_ratio FROM x")
def _q(spark, sf):
    return I.run_imbalance_analysis(read_table(spark, sf, "events"), "value")


@register("representation_bias_documents",
          f"WITH d AS ({S.DOC_BINARY}), long AS (SELECT 'lang' AS feature, CAST(lang AS VARCHAR) AS \"group\", "
          "CAST(target AS DOUBLE) AS y FROM d UNION ALL SELECT 'source', CAST(source AS VARCHAR), CAST(target AS DOUBLE) "
          "FROM d), g AS (SELECT feature, \"group\", count(*) AS n, avg(y) AS outcome_rate FROM long GROUP BY ALL), "
          "t AS (SELECT count(*) AS tot, avg(CAST(target AS DOUBLE)) AS ov FROM d) "
          "SELECT feature, \"group\", n, n / tot AS share, outcome_rate, abs(outcome_rate - ov) AS outcome_gap, "
          "CASE WHEN n / tot < 0.10 OR abs(outcome_rate - ov) > 0.2 THEN 'high' WHEN abs(outcome_rate - ov) > 0.1 "
          "THEN 'medium' ELSE 'low' END AS risk FROM g, t")
def _q(spark, sf):
    return I.representation_bias(FX.doc_binary(spark, sf), ["lang", "source"], "target")


@register("clean_binary_target_report_nested",
          "SELECT count(*) AS rows_before, count_if(toxic IN (0, 1)) AS rows_after, "
          "count(*) - count_if(toxic IN (0, 1)) AS rows_dropped FROM labels")
def _q(spark, sf):
    df = I.flatten_target_cell(FX.nested_target(spark, sf), "toxic")
    return I.clean_binary_target_report(df, "toxic")


@register("encode_binary_target_orders",
          f"SELECT o_orderkey, CASE WHEN CAST(o_orderstatus AS VARCHAR) IN {TRUTHY_SQL} THEN 1 ELSE 0 END AS target "
          "FROM orders")
def _q(spark, sf):
    df = read_table(spark, sf, "orders")
    return df.select("o_orderkey", I.encode_binary_target(df, "o_orderstatus"))
