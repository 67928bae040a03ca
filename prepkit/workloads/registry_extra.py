"""Queries for sinks, target rules, plans on new data, balancing by name, neighbours and reports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.columns import sanitize_columns
from ..functions.stats import exact_quantiles, unpivot_values
from ..operators import balance as B
from ..operators import bivariate as C
from ..operators import leakage as K
from ..operators import model as M
from ..operators import neighbours as NB
from ..operators import profile as P
from ..operators import smoter as SM
from ..operators import target as I
from ..operators.transforms import TemplateSet
from ..plans.feature_plan import FeaturePlan
from ..session import ensure_checkpoint_dir
from ..sources import fixtures as FX
from ..sources import io
from ..sources.io import read_table
from . import sqlgen as S
from .registry import ORACLE, QUERIES, register
from .registry_analysis import _LEAKY, LI, TRUTHY_SQL
from .registry_model import _SPLIT, EV_COLS, h, vc, z

LI_KEYS = "l_orderkey, l_linenumber, l_quantity, l_extendedprice"


def _scratch(spark, name):
    """A fresh folder below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


# --- S: sources and sinks ------------------------------------------------------------


@register("scan_limit_orders", "SELECT * FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 1500")
def _q(spark, sf):
    return io.scan(spark, io.table_path(sf, "orders"), limit=1500, order_by=["o_totalprice", "o_orderkey"])


@register("column_list_lineitem",
          "SELECT CAST(row_number() OVER () AS INTEGER) AS ordinal, column_name, CASE column_type WHEN 'BIGINT' THEN 'bigint' "
          "WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' ELSE 'timestamp_ntz' END "
          "AS data_type, true AS nullable FROM (DESCRIBE lineitem)")
def _q(spark, sf):
    return io.column_list(read_table(spark, sf, "lineitem"))


@register("write_table_orders_by_status", "SELECT * FROM orders")
def _q(spark, sf):
    path = _scratch(spark, "orders")
    orders = read_table(spark, sf, "orders")
    io.write_table(orders, path, partition_by=["o_orderstatus"])
    io.write_table(orders, path, partition_by=["o_orderstatus"])          # replaces, does not add
    return spark.read.parquet(path).select(*orders.columns)


@register("write_normalised_li_nulls",
          f"WITH {LI} SELECT CAST(l_orderkey AS DOUBLE) AS l_orderkey, CAST(round_even(l_linenumber, 0) AS BIGINT) AS l_linenumber, "
          "CAST(l_quantity AS DOUBLE) AS l_quantity, l_returnflag FROM li")
def _q(spark, sf):
    path = _scratch(spark, "normalised")
    df = FX.li_nulls(spark, sf).select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    io.write_normalised(df, "l_linenumber", path)
    return spark.read.parquet(path)


@register("audit_leaky", "SELECT 'ds' AS dataset, 'leaky' AS table_name, 1 AS medium_risk, 'next_flag' AS medium_feature, "
                         "3 AS high_risk, 2 AS high_features")
def _q(spark, sf):
    path = _scratch(spark, "audit")
    io.append_audit(io.audit_rows(K.leakage_report(FX.leaky(spark, sf), "y"), "ds", "leaky"), path)
    return spark.read.parquet(path).select(
        "dataset", "table_name", "summary.medium_risk", F.col("medium_risk_features")[0]["feature"].alias("medium_feature"),
        "summary.high_risk", F.size(F.array_distinct("high_risk_features.feature")).alias("high_features"))


@register("leakage_summary_leaky", "SELECT 3 AS high_risk, 1 AS medium_risk, 0 AS low_risk, 1 AS critical, 'high' AS overall_risk")
def _q(spark, sf):
    return K.leakage_summary(K.leakage_report(FX.leaky(spark, sf), "y"))


@register("latest_status_events",
          "SELECT event_type AS table_name, 'u' || (user_id % 5) AS phase, max_by(status, (ts, status)) AS status, max(ts) AS last_updated "
          "FROM (SELECT event_type, user_id, ts, CASE WHEN value > 10 THEN 'done' ELSE 'open' END AS status FROM events) GROUP BY ALL")
def _q(spark, sf):
    log = read_table(spark, sf, "events").select(
        F.col("event_type").alias("table_name"), F.concat(F.lit("u"), (F.col("user_id") % 5).cast("string")).alias("phase"),
        F.when(F.col("value") > 10, "done").otherwise("open").alias("status"), F.col("ts").alias("last_updated"))
    return io.latest_status(log)


@register("write_report_missing_li_nulls", S.missing_values(S.LI_NULLS, S.LINEITEM))
def _q(spark, sf):
    path = _scratch(spark, "report")
    report = P.missing_values(FX.li_nulls(spark, sf))
    io.write_report(report, path)
    return spark.read.schema(report.schema).json(path)


# --- P, I: names and targets -----------------------------------------------------------


@register("sanitize_columns_orders",
          "SELECT o_orderkey AS _1st_key, o_totalprice AS total_price, o_orderstatus AS status FROM orders")
def _q(spark, sf):
    o = read_table(spark, sf, "orders")
    return sanitize_columns(o.select(F.col("o_orderkey").alias("1st key"), F.col("o_totalprice").alias("total price"),
                                     F.col("o_orderstatus").alias("status")))


@register("drop_null_target_li_nulls",
          f"WITH {LI} SELECT l_orderkey, l_linenumber, l_returnflag FROM li WHERE l_returnflag IS NOT NULL")
def _q(spark, sf):
    return I.drop_null_target(FX.li_nulls(spark, sf), "l_returnflag").select("l_orderkey", "l_linenumber", "l_returnflag")


_MESSY = ("CASE l_linenumber WHEN 1 THEN '0.4' WHEN 2 THEN '1.6' WHEN 3 THEN 'x' WHEN 4 THEN NULL WHEN 5 THEN '1' "
          "WHEN 6 THEN '0' ELSE '2' END")


def _messy(spark, sf):
    return read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.expr(_MESSY).alias("t"))


@register("clean_binary_target_lineitem",
          f"WITH x AS (SELECT l_orderkey, l_linenumber, round_even(TRY_CAST({_MESSY} AS DOUBLE), 0) AS r FROM lineitem) "
          "SELECT l_orderkey, l_linenumber, CAST(r AS BIGINT) AS t FROM x WHERE r IN (0, 1)")
def _q(spark, sf):
    return I.clean_binary_target(_messy(spark, sf), "t")


@register("clean_binary_target_report_lineitem",
          f"WITH x AS (SELECT round_even(TRY_CAST({_MESSY} AS DOUBLE), 0) AS r FROM lineitem) "
          "SELECT count(*) AS rows_before, count_if(r IN (0, 1)) AS rows_after, "
          "count(*) - count_if(r IN (0, 1)) AS rows_dropped FROM x")
def _q(spark, sf):
    return I.clean_binary_target_report(_messy(spark, sf), "t")


_YES = "CASE l_linenumber WHEN 1 THEN 'Yes' WHEN 2 THEN 'TRUE' WHEN 3 THEN '1' WHEN 4 THEN 'true ' WHEN 5 THEN NULL ELSE 'no' END"


@register("encode_binary_target_lineitem",
          f"SELECT l_orderkey, l_linenumber, CASE WHEN {_YES} IN {TRUTHY_SQL} THEN 1 ELSE 0 END AS target FROM lineitem")
def _q(spark, sf):
    df = read_table(spark, sf, "lineitem").withColumn("t", F.expr(_YES))
    return df.select("l_orderkey", "l_linenumber", I.encode_binary_target(df, "t"))


@register("targets_found",
          "SELECT 'lineitem' AS name, 'l_shipdate' AS found, 'l_returnflag' AS resolved, 'regression' AS problem, 'continuous' AS kind "
          "UNION ALL SELECT 'labels', 'toxic', 'quality', CASE WHEN (SELECT count(DISTINCT quality) FROM labels) = 2 THEN "
          "'classification' ELSE 'regression' END, 'categorical'")
def _q(spark, sf):
    rows = []
    for name, wanted, t in (("lineitem", "L_ReturnFlag", "l_extendedprice"), ("labels", "QUALITY", "quality")):
        df = read_table(spark, sf, name)
        rows.append((name, I.find_target(df.columns), I.resolve_target(df.columns, wanted), I.problem_type(df, t), I.target_type(df, t)))
    return spark.createDataFrame(rows, "name string, found string, resolved string, problem string, kind string")


@register("recommend_balancing_documents",
          "SELECT CAST(i AS INTEGER) AS priority, t AS technique FROM (SELECT unnest(range(1, 5)) AS i, "
          "unnest(['smotenc', 'random_oversample', 'random_undersample', 'cluster_oversample']) AS t)")
def _q(spark, sf):
    d = FX.doc_binary(spark, sf)
    return I.recommend_balancing(spark, I.target_type(d, "target"), bool(B.category_columns(d, "target")))


@register("fit_behaviour_events",
          "SELECT event_id, CASE WHEN a < 0.7 AND b < 0.7 THEN 'underfitting' WHEN a > 0.9 AND b < 0.75 THEN 'overfitting' "
          "ELSE 'good_fit' END AS status FROM (SELECT event_id, (event_id % 101) / 100.0 AS a, (event_id % 97) / 96.0 AS b FROM events)")
def _q(spark, sf):
    e = read_table(spark, sf, "events")
    return e.select("event_id", M.fit_behaviour(F.col("event_id") % 101 / 100.0, F.col("event_id") % 97 / 96.0).alias("status"))


# --- O, PL: fitted once, applied to more -------------------------------------------------


@register("fit_on_part_transform_whole",
          f"WITH {LI}, part AS (SELECT * FROM li WHERE l_returnflag <> 'R'), "
          "lab AS (SELECT v, dense_rank() OVER (ORDER BY v) - 1 AS c FROM (SELECT DISTINCT l_returnflag AS v FROM part)), "
          "fr AS (SELECT l_returnflag AS v, count(*) AS c, avg(l_discount) AS m FROM part GROUP BY 1) "
          "SELECT li.l_orderkey, li.l_linenumber, li.l_quantity, lab.c AS l_returnflag_encoded, fr.c AS l_returnflag_freq, "
          "fr.m AS l_returnflag_target_encoded FROM li LEFT JOIN lab ON lab.v = li.l_returnflag LEFT JOIN fr ON fr.v = li.l_returnflag")
def _q(spark, sf):
    li = FX.li_nulls(spark, sf)
    spec = TemplateSet([{"column_name": "l_returnflag", "fe_method": "label_encoding"},
                        {"column_name": "l_returnflag", "fe_method": "frequency_encoding"},
                        {"column_name": "l_returnflag", "fe_method": "target_encoding", "target_column": "l_discount"}])
    out = spec.fit(li.where("l_returnflag <> 'R'")).transform(li)
    return out.select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag_encoded", "l_returnflag_freq",
                      "l_returnflag_target_encoded")


@register("hash_encoding_nulls",
          f"WITH {LI} SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag IS NOT NULL THEN {h('l_returnflag')} % 100 END "
          "AS l_returnflag_hash FROM li")
def _q(spark, sf):
    li = FX.li_nulls(spark, sf)
    out = TemplateSet([{"column_name": "l_returnflag", "fe_method": "hashing"}]).fit(li).transform(li)
    return out.select("l_orderkey", "l_linenumber", "l_returnflag_hash")


_SPACED = "concat(chr(9), ' ', o_orderpriority, chr(10))"


@register("trim_and_numbers_orders",
          f"SELECT o_orderkey, regexp_replace(s, '^\\s+|\\s+$', '', 'g') AS s_trimmed, TRY_CAST(NULLIF(regexp_extract(s, "
          f"'[0-9]+', 0), '') AS BIGINT) AS s_number FROM (SELECT o_orderkey, {_SPACED} AS s FROM orders)")
def _q(spark, sf):
    o = read_table(spark, sf, "orders").select("o_orderkey", F.expr(_SPACED.replace("chr(", "char(")).alias("s"))
    out = TemplateSet([{"column_name": "s", "fe_method": "trim"}, {"column_name": "s", "fe_method": "extract_numbers"}]).fit(o).transform(o)
    return out.select("o_orderkey", "s_trimmed", "s_number")


_Q = "quantile_cont(l_extendedprice, {})"


@register("feature_plan_any_method",
          f"WITH {LI} SELECT l_orderkey, l_linenumber, greatest(least(l_extendedprice, (SELECT {_Q.format(0.95)} FROM li)), "
          f"(SELECT {_Q.format(0.05)} FROM li)) AS l_extendedprice, coalesce(l_quantity, -1) AS l_quantity_imputed, "
          f"CASE WHEN l_returnflag IS NOT NULL THEN {h('l_returnflag')} % 50 END AS l_returnflag_encoded, "
          "CASE WHEN l_discount = 1 OR CAST(l_discount AS VARCHAR) = '1' THEN 1 ELSE 0 END AS l_discount_encoded, "
          "dense_rank() OVER (ORDER BY CASE WHEN l_tax = floor(l_tax) THEN CAST(CAST(l_tax AS BIGINT) AS VARCHAR) "
          "ELSE CAST(l_tax AS VARCHAR) END NULLS FIRST) - 1 AS l_tax_encoded, l_partkey AS the_part, "
          f"CASE WHEN CAST(l_linenumber AS VARCHAR) IN {TRUTHY_SQL} THEN 1 ELSE 0 END AS target FROM li")
def _q(spark, sf):
    df = FX.li_nulls(spark, sf).withColumnRenamed("l_partkey", "the part")
    plan = FeaturePlan([{"column_name": "l_extendedprice", "fe_method": "winsorize"},
                        {"column_name": "l_quantity", "fe_method": "fillna", "fill_value": -1},
                        {"column_name": "l_returnflag", "fe_method": "onehot"},
                        {"column_name": "l_discount", "fe_method": "binary_encoding"},
                        {"column_name": "l_tax", "fe_method": "label_encoding"},
                        {"column_name": "the part", "fe_method": "fillna"},
                        {"column_name": "l_suppkey", "fe_method": "bogus"}],
                       target_column="l_linenumber", keep=["l_orderkey", "l_linenumber"])
    if [s["column"] for s in plan.skipped] != ["l_suppkey"]:
        raise AssertionError("the unknown method must be reported")
    return plan.fit(df).transform(df).withColumnRenamed("the_part_imputed", "the_part")


@register("feature_plan_chained",
          f"WITH {LI}, a AS (SELECT l_orderkey, l_linenumber, ln(coalesce(l_quantity, (SELECT avg(l_quantity) FROM li)) + 1) AS v FROM li) "
          "SELECT l_orderkey, l_linenumber, (v - (SELECT min(v) FROM a)) / NULLIF((SELECT max(v) - min(v) FROM a), 0) "
          "AS l_quantity_imputed_log_scaled FROM a")
def _q(spark, sf):
    df = FX.li_nulls(spark, sf)
    plan = FeaturePlan([{"column_name": "l_quantity", "fe_method": "mean_imputation"},
                        {"column_name": "l_quantity", "fe_method": "log_transformation"},
                        {"column_name": "l_quantity", "fe_method": "normalization"}],
                       keep=["l_orderkey", "l_linenumber"], chain=True)
    return plan.fit(df).transform(df)


@register("plan_lineage_lineitem",
          "SELECT column_name AS original_column, column_name || '_scaled' AS output_column, 'standardization' AS transformations "
          "FROM (DESCRIBE lineitem) WHERE column_type = 'DOUBLE' UNION ALL SELECT 'l_linestatus', 'target', 'auto_binary_encoding'")
def _q(spark, sf):
    li = read_table(spark, sf, "lineitem")
    plan = FeaturePlan([{"column_name": c, "fe_method": "standardization"} for c, k in li.dtypes if k == "double"],
                       target_column="l_linestatus")
    return plan.lineage(spark).withColumn("transformations", F.array_join("transformations", ","))


# --- E, C: quantiles by refinement, curves, reports --------------------------------------


@register("quantiles_refined_lineitem",
          f"SELECT column_name, quantile_cont(v, 0.05) AS q05, quantile_cont(v, 0.5) AS q50, quantile_cont(v, 0.95) AS q95 "
          f"FROM ({S.long_numeric('lineitem', [c for c in S.LINEITEM if c[1] in ('i', 'f')])}) GROUP BY column_name")
def _q(spark, sf):
    li = read_table(spark, sf, "lineitem")
    cols = S.numeric(S.LINEITEM)
    got = exact_quantiles(unpivot_values(li, cols), [0.05, 0.5, 0.95])
    return spark.createDataFrame([(c, *v) for c, v in got.items()], "column_name string, q05 double, q50 double, q95 double")


ORACLE["kde_curve_events"] = (
    "WITH e AS (SELECT CAST(value AS DOUBLE) AS v FROM events WHERE value IS NOT NULL), "
    "s AS (SELECT count(*) AS n, stddev_samp(v) * power(count(*), -1.0 / 5.0) AS bw, min(v) AS mn, max(v) AS mx, "
    "(max(v) - min(v)) / 4096 AS width FROM e), "
    "c AS (SELECT least(floor((v - mn) / width), 4095) AS b, count(*) AS w, avg(v) AS c FROM e, s GROUP BY 1), "
    "g AS (SELECT (mn - 3.0 * bw) + i * (((mx + 3.0 * bw) - (mn - 3.0 * bw)) / 199) AS x FROM s, (SELECT unnest(range(200)) AS i)) "
    "SELECT x, sum(w * exp(-0.5 * power((x - c) / bw, 2))) / any_value(n * bw * sqrt(2 * pi())) AS density FROM g, c, s GROUP BY x")


@register("eda_report_missing_orders", S.missing_values("SELECT * FROM orders", S.ORDERS))
def _q(spark, sf):
    schema = "array<struct<ordinal: int, column_name: string, missing_count: bigint, missing_pct: double>>"
    report = P.eda_report(read_table(spark, sf, "orders"), target="o_orderpriority")
    return report.select(F.inline(F.from_json("missing_values", schema)))


@register("eda_report_categories_orders",
          S.univariate_categorical("SELECT * FROM orders", S.ORDERS, ["o_orderstatus", "o_orderpriority"]))
def _q(spark, sf):
    schema = "array<struct<column_name: string, unique_count: bigint, mode: string, mode_count: bigint>>"
    report = P.eda_report(read_table(spark, sf, "orders"), target="o_orderpriority")
    return report.select(F.inline(F.from_json("univariate_categorical", schema)))


@register("chi_square_two_by_two",
          "WITH t AS (SELECT CAST(l_linestatus AS VARCHAR) AS a, CAST(l_quantity > 25 AS VARCHAR) AS b FROM lineitem), "
          "o AS (SELECT a, b, count(*)::DOUBLE AS o FROM t GROUP BY ALL), r AS (SELECT a, sum(o) AS rt FROM o GROUP BY 1), "
          "c AS (SELECT b, sum(o) AS ct FROM o GROUP BY 1), n AS (SELECT sum(o) AS n FROM o), "
          "g AS (SELECT coalesce(o.o, 0) AS o, rt * ct / n AS e FROM r CROSS JOIN c CROSS JOIN n LEFT JOIN o ON o.a = r.a AND o.b = c.b) "
          "SELECT 'l_linestatus' AS column_name, sum(power(abs(o - e) - least(0.5, abs(o - e)), 2) / e) AS chi2, CAST(1 AS BIGINT) AS dof FROM g")
def _q(spark, sf):
    li = read_table(spark, sf, "lineitem").withColumn("big", (F.col("l_quantity") > 25).cast("string"))
    return C.chi_square(li, "big", ["l_linestatus"])


@register("boxplot_stats_many_classes",
          "WITH b AS (SELECT CAST(l_suppkey AS VARCHAR) AS class, quantile_cont(l_quantity, 0.25) AS q1, "
          "quantile_cont(l_quantity, 0.5) AS median, quantile_cont(l_quantity, 0.75) AS q3 FROM lineitem GROUP BY 1) "
          "SELECT 'l_quantity' AS column_name, class, any_value(q1) AS q1, any_value(median) AS median, any_value(q3) AS q3, "
          "min(CASE WHEN v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1) THEN v END) AS whisker_low, "
          "max(CASE WHEN v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1) THEN v END) AS whisker_high, "
          "count_if(NOT (v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1))) AS fliers "
          "FROM (SELECT CAST(l_suppkey AS VARCHAR) AS class, l_quantity AS v FROM lineitem) JOIN b USING (class) GROUP BY class")
def _q(spark, sf):
    return C.boxplot_stats(read_table(spark, sf, "lineitem"), "l_suppkey", ["l_quantity"])


_DETAIL_NUM = [c for c in S.LINEITEM if c[1] in ("i", "f")]
_LONG = S.long_numeric("li", _DETAIL_NUM)


@register("dataset_details_li_nulls",
          f"WITH {LI}, long AS ({_LONG}), u AS ({S.univariate_numerical(S.LI_NULLS, S.LINEITEM)}), o AS ({S.outliers(S.LI_NULLS, S.LINEITEM)}), "
          f"m AS ({S.missing_values(S.LI_NULLS, S.LINEITEM)}), k AS ({S.cardinality(S.LI_NULLS, S.LINEITEM)}), "
          "c AS (SELECT l_returnflag, count(*) AS n FROM li WHERE l_returnflag IS NOT NULL GROUP BY 1) "
          "SELECT 'numerical_features' AS section, column_name AS item FROM u UNION ALL SELECT 'categorical_features', 'l_linestatus' "
          "UNION ALL SELECT 'datetime_features', 'l_shipdate' "
          "UNION ALL SELECT 'binary_features', column_name FROM k WHERE unique_values = 2 AND column_name NOT IN ('l_returnflag', 'l_shipdate') "
          "UNION ALL SELECT 'high_cardinality_categoricals', column_name FROM k WHERE column_name = 'l_linestatus' AND is_high_cardinality "
          "UNION ALL SELECT 'skewed_features', column_name FROM u WHERE abs(skewness) > 1 "
          "UNION ALL SELECT 'outliers_detected', column_name FROM o WHERE outlier_count > 0 "
          "UNION ALL SELECT 'columns_with_missing', column_name FROM m WHERE missing_count > 0 "
          "UNION ALL SELECT 'imbalanced', CASE WHEN min(n) / sum(n) >= 0.45 THEN 'false' ELSE 'true' END FROM c")
def _q(spark, sf):
    return P.dataset_details(FX.li_nulls(spark, sf), "l_returnflag")


@register("eda_report_bivariate_events", "SELECT column_name, correlation FROM ("
          + " UNION ALL ".join(f"SELECT '{c}' AS column_name, covar_pop(CAST({c} AS DOUBLE), value) / NULLIF(stddev_pop(CAST({c} AS DOUBLE)) * "
                               "stddev_pop(value), 0) AS correlation FROM events" for c in ("event_id", "user_id")) + ")")
def _q(spark, sf):
    e = read_table(spark, sf, "events").drop("props")
    report = P.eda_report(e, target="value", sample_by=["event_id"])
    return report.select(F.inline(F.from_json("bivariate", "array<struct<column_name: string, correlation: double>>")))


# --- B: many classes, techniques by name ---------------------------------------------------

_CUST = "SELECT o_orderkey, o_custkey, o_totalprice FROM orders"


@register("random_undersample_many_classes",
          f"WITH b AS ({_CUST}), c AS (SELECT o_custkey, count(*) AS cnt FROM b GROUP BY 1) SELECT o_orderkey, o_custkey, o_totalprice "
          f"FROM (SELECT b.*, row_number() OVER (PARTITION BY o_custkey ORDER BY {h(vc('o_orderkey'), chr(39) + '42' + chr(39))}, "
          "o_orderkey) AS r FROM b) WHERE r <= (SELECT min(cnt) FROM c)")
def _q(spark, sf):
    o = read_table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return B.random_undersample(o, "o_custkey", row_id=["o_orderkey"])


def _oversample_many():
    from .registry_model import _oversample_sql
    return _oversample_sql(f"src AS ({_CUST})", "o_custkey", "o_orderkey, o_custkey, o_totalprice", "o_orderkey")


@register("random_oversample_many_classes", _oversample_many())
def _q(spark, sf):
    o = read_table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return B.random_oversample(o, "o_custkey", row_id=["o_orderkey"])


def _by_name(technique, twin, source, target, key):
    def q(spark, sf):
        return B.balance(source(spark, sf), target, technique, row_id=[key])
    name = "balance_" + "_".join(technique.replace("+", " ").replace("-", " ").split())
    QUERIES[name] = q
    ORACLE[name] = ORACLE[twin]


for _technique, _twin in (("Random Oversampling", "random_oversample_documents"),
                          ("random undersampling", "random_undersample_documents")):
    _by_name(_technique, _twin, FX.doc_binary, "target", "doc_id")
for _technique, _twin in (("gaussian noise injection", "gaussian_noise_events"), ("kde-based resampling", "kde_resample_events"),
                          ("quantile-based binning + oversampling", "quantile_bin_oversample_events"),
                          ("tail-focused resampling", "tail_resample_events")):
    _by_name(_technique, _twin, FX.event_tail, "value", "event_id")


@register("balance_report_documents",
          f"WITH d AS ({S.DOC_BINARY}), c AS (SELECT target, count(*) AS n FROM d GROUP BY 1), "
          "s AS (SELECT sum(n) AS tot, min(n) AS mn, count(*) AS k FROM c), "
          "b AS (SELECT 'before' AS stage, mn / tot AS r FROM s UNION ALL SELECT 'after', 1 / k FROM s) "
          "SELECT stage, 'categorical' AS target_type, r >= 0.45 AS is_balanced, CASE WHEN r >= 0.45 THEN 'balanced' "
          "WHEN r >= 0.30 THEN 'mildly_imbalanced' WHEN r >= 0.10 THEN 'moderately_imbalanced' ELSE 'severely_imbalanced' END AS status, "
          "r AS minority_ratio, CAST(NULL AS DOUBLE) AS skewness, CAST(NULL AS DOUBLE) AS rare_ratio FROM b")
def _q(spark, sf):
    d = FX.doc_binary(spark, sf)
    return B.balance_report(d, B.balance(d, "target", "random oversampling", row_id=["doc_id"]), "target")


@register("cluster_oversample_counts",
          f"WITH d AS ({S.DOC_BINARY}), c AS (SELECT target, count(*) AS n FROM d GROUP BY 1) "
          "SELECT target, (SELECT max(n) FROM c) AS count, CAST(0 AS BIGINT) AS foreign_rows FROM c")
def _q(spark, sf):
    d = FX.doc_binary(spark, sf)
    out = B.cluster_oversample(d, "target", row_id=["doc_id"])
    known = d.withColumn("known", F.lit(True))
    return out.join(known, d.columns, "left").groupBy("target").agg(
        F.count(F.lit(1)).alias("count"), F.count_if(F.col("known").isNull()).alias("foreign_rows"))


# --- B3-B5, knn: neighbours ------------------------------------------------------------------

_D2 = ("power(CAST(a.n_chars AS DOUBLE) - CAST(b.n_chars AS DOUBLE), 2) + "
       "power(CAST(a.quality AS DOUBLE) - CAST(b.quality AS DOUBLE), 2)")
_NEAR = ("nn AS (SELECT a.doc_id, b.doc_id AS other, b.target AS other_target, {d2} AS d2, CAST(row_number() OVER "
         "(PARTITION BY a.doc_id ORDER BY {d2}, b.doc_id) AS INTEGER) AS rank FROM src a JOIN src b ON a.doc_id <> b.doc_id {more} "
         "QUALIFY row_number() OVER (PARTITION BY a.doc_id ORDER BY {d2}, b.doc_id) <= 5)").replace("{d2}", _D2)


@register("nearest_documents",
          f"WITH src AS ({S.DOC_NUMERIC}), {_NEAR.format(more='AND a.target = b.target')} SELECT doc_id, rank, other, d2 FROM nn")
def _q(spark, sf):
    d = FX.doc_numeric(spark, sf).withColumn("_n", F.col("doc_id"))
    pts = NB.points(d, ["n_chars", "quality"], [], "target")
    return NB.nearest(pts, pts, 5).select(F.col("_n").alias("doc_id"), "rank", "other", "d2")


_J = "CAST(j AS VARCHAR)"


def _seeded(*parts):
    return h(*[p if p.startswith("'") else vc(p) for p in parts])


@register("smote_documents",
          f"WITH src AS ({S.DOC_NUMERIC}), c AS (SELECT target, count(*) AS cnt FROM src GROUP BY 1), m AS (SELECT max(cnt) AS mx FROM c), "
          f"num AS (SELECT src.*, row_number() OVER (PARTITION BY target ORDER BY {h(vc('doc_id'), chr(39) + '42' + chr(39))}, doc_id) "
          f"AS idx FROM src), {_NEAR.format(more='AND a.target = b.target')}, "
          "dr AS (SELECT target, cnt, unnest(range(1, mx - cnt + 1)) AS j FROM c, m WHERE cnt < mx), "
          "dp AS (SELECT target, " + _seeded("target", "j", "'42'") + " % cnt + 1 AS pick, "
          "CAST(" + _seeded("target", "j", "'42'", "'u'") + " AS DOUBLE) / power(2, 60) AS u, "
          + _seeded("target", "j", "'42'", "'nn'") + " % least(5, cnt - 1) + 1 AS rk FROM dr) "
          "SELECT doc_id, n_chars, quality, target FROM src UNION ALL SELECT CAST(NULL AS BIGINT), "
          "CAST(round_even(a.n_chars + u * (o.n_chars - a.n_chars), 0) AS BIGINT), "
          "CAST(round_even(a.quality + u * (o.quality - a.quality), 0) AS INTEGER), a.target "
          "FROM dp JOIN num a ON a.target = dp.target AND a.idx = dp.pick JOIN nn ON nn.doc_id = a.doc_id AND nn.rank = dp.rk "
          "JOIN src o ON o.doc_id = nn.other")
def _q(spark, sf):
    return B.balance(FX.doc_numeric(spark, sf), "target", "SMOTE", row_id=["doc_id"]).withColumn("target", F.col("target").cast("int"))


@register("adasyn_shares_documents",
          f"WITH src AS ({S.DOC_NUMERIC}), {_NEAR.format(more='')}, c AS (SELECT target, count(*) AS cnt FROM src GROUP BY 1) "
          "SELECT a.target, a.doc_id, avg(CASE WHEN nn.other_target <> a.target THEN 1.0 ELSE 0.0 END) AS r FROM src a JOIN nn USING (doc_id) "
          "JOIN c ON c.target = a.target WHERE c.cnt < (SELECT max(cnt) FROM c) GROUP BY ALL")
def _q(spark, sf):
    d = FX.doc_numeric(spark, sf).withColumn("_n", F.col("doc_id"))
    counts = B.class_table(d, "target")
    small = counts.where(F.col("n") < counts.agg(F.max("n")).first()[0])
    return NB.adasyn_shares(d, d.join(small, "target", "left_semi"), "target", ["n_chars", "quality"]).withColumnRenamed("_n", "doc_id")


@register("knn_votes_documents",
          f"WITH src AS ({S.DOC_NUMERIC}), {_NEAR.format(more='')}, v AS (SELECT doc_id, other_target AS y, count(*) AS c FROM nn GROUP BY ALL) "
          "SELECT doc_id, CAST(arg_min(y, (-c, y)) AS DOUBLE) AS prediction, sum(CASE WHEN y = 1 THEN c ELSE 0 END) / sum(c) AS score "
          "FROM v GROUP BY doc_id")
def _q(spark, sf):
    d = FX.doc_numeric(spark, sf).withColumn("_n", F.col("doc_id"))
    return NB.knn_predict(d, d, "target", ["n_chars", "quality"]).select("doc_id", "prediction", "score")


_ND2 = ("power(a.n_chars - b.n_chars, 2) + pen * pen * (a.lang <> b.lang)::INT + pen * pen * (a.source <> b.source)::INT")


@register("smotenc_documents",
          f"WITH src AS (SELECT doc_id, lang, source, CAST(n_chars AS DOUBLE) AS n_chars, target FROM ({S.DOC_BINARY})), "
          "c AS (SELECT target, count(*) AS cnt FROM src GROUP BY 1), m AS (SELECT max(cnt) AS mx, greatest(1, least(5, min(cnt) - 1)) AS k FROM c), "
          "p AS (SELECT stddev_pop(n_chars) AS pen FROM src WHERE target = (SELECT arg_min(target, (cnt, target)) FROM c)), "
          f"num AS (SELECT src.*, row_number() OVER (PARTITION BY target ORDER BY {h(vc('doc_id'), chr(39) + '42' + chr(39))}, doc_id) AS idx FROM src), "
          f"nn AS (SELECT a.doc_id, b.n_chars AS x1, b.lang, b.source, row_number() OVER (PARTITION BY a.doc_id ORDER BY {_ND2}, b.doc_id) AS rank, k "
          "FROM src a JOIN src b ON a.target = b.target AND a.doc_id <> b.doc_id, p, m WHERE a.target IN (SELECT target FROM c WHERE cnt < (SELECT mx FROM m)) "
          "QUALIFY rank <= k), "
          "ml AS (SELECT doc_id, arg_min(lang, (-c, lang)) AS lang FROM (SELECT doc_id, lang, count(*) AS c FROM nn GROUP BY ALL) GROUP BY doc_id), "
          "ms AS (SELECT doc_id, arg_min(source, (-c, source)) AS source FROM (SELECT doc_id, source, count(*) AS c FROM nn GROUP BY ALL) GROUP BY doc_id), "
          "dg AS (SELECT doc_id, max(rank) AS degree FROM nn GROUP BY doc_id), "
          "dr AS (SELECT target, cnt, unnest(range(1, mx - cnt + 1)) AS j FROM c, m WHERE cnt < mx), "
          "dp AS (SELECT *, " + _seeded("target", "j", "'42'") + " % cnt + 1 AS pick, "
          "CAST(" + _seeded("target", "j", "'42'", "'u'") + " AS DOUBLE) / power(2, 60) AS u, " + _seeded("target", "j", "'42'", "'nn'") + " AS hn FROM dr) "
          "SELECT doc_id, lang, source, n_chars, target FROM src UNION ALL "
          "SELECT CAST(NULL AS BIGINT), ml.lang, ms.source, a.n_chars + u * (nn.x1 - a.n_chars), a.target "
          "FROM dp JOIN num a ON a.target = dp.target AND a.idx = dp.pick JOIN dg USING (doc_id) JOIN ml USING (doc_id) JOIN ms USING (doc_id) "
          "JOIN nn ON nn.doc_id = a.doc_id AND nn.rank = hn % degree + 1")
def _q(spark, sf):
    return NB.smotenc(FX.doc_binary(spark, sf), "target", row_id=["doc_id"])


@register("adasyn_documents",
          f"WITH src AS ({S.DOC_NUMERIC}), {_NEAR.format(more='')}, c AS (SELECT target, count(*) AS cnt FROM src GROUP BY 1), "
          "num AS (SELECT src.*, row_number() OVER (ORDER BY doc_id) AS n FROM src), "
          "sh AS (SELECT a.target, a.doc_id, avg(CASE WHEN nn.other_target <> a.target THEN 1.0 ELSE 0.0 END) AS r, "
          "any_value((SELECT max(cnt) FROM c) - c.cnt) AS miss FROM src a JOIN nn USING (doc_id) JOIN c ON c.target = a.target "
          "WHERE c.cnt < (SELECT max(cnt) FROM c) GROUP BY a.target, a.doc_id), "
          "gets AS (SELECT doc_id, CAST(round_even(r / sum(r) OVER (PARTITION BY target) * miss, 0) AS BIGINT) AS times FROM sh), "
          + _NEAR.format(more="AND a.target = b.target").replace("nn AS", "own AS", 1) + ", "
          "dg AS (SELECT doc_id, max(rank) AS degree FROM own GROUP BY doc_id), "
          "dr AS (SELECT num.*, degree, unnest(range(1, times + 1)) AS j FROM gets JOIN num USING (doc_id) JOIN dg USING (doc_id)), "
          "dp AS (SELECT *, CAST(" + _seeded("n", "j", "'42'", "'u'") + " AS DOUBLE) / power(2, 60) AS u, "
          + _seeded("n", "j", "'42'", "'nn'") + " % degree + 1 AS rk FROM dr) "
          "SELECT doc_id, n_chars, quality, CAST(target AS BIGINT) AS target FROM src UNION ALL SELECT CAST(NULL AS BIGINT), "
          "CAST(round_even(a.n_chars + u * (o.n_chars - a.n_chars), 0) AS BIGINT), "
          "CAST(round_even(a.quality + u * (o.quality - a.quality), 0) AS INTEGER), CAST(a.target AS BIGINT) "
          "FROM dp a JOIN own ON own.doc_id = a.doc_id AND own.rank = a.rk JOIN src o ON o.doc_id = own.other")
def _q(spark, sf):
    return B.balance(FX.doc_numeric(spark, sf), "target", "adasyn", row_id=["doc_id"])


# --- B7: SMOTER --------------------------------------------------------------------------------

_EV3 = "e AS (SELECT event_id, user_id, value FROM events)"
_RUNS = (
    "q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS mid, quantile_cont(value, 0.75) AS q3, "
    "min(value) AS least, max(value) AS most FROM e), "
    "w AS (SELECT mid, least, most, (SELECT min(value) FROM e WHERE value >= q1 - 1.5 * (q3 - q1)) AS low, "
    "(SELECT max(value) FROM e WHERE value <= q3 + 1.5 * (q3 - q1)) AS high FROM q), "
    "cp AS (SELECT mid, CASE WHEN least < low THEN low ELSE least END AS a, CASE WHEN least < low THEN 1.0 ELSE 0.0 END AS pa, "
    "CASE WHEN most > high THEN high ELSE most END AS b, CASE WHEN most > high THEN 1.0 ELSE 0.0 END AS pb FROM w), "
    "s AS (SELECT e.*, cp.*, CASE WHEN value < mid THEN (value - a) / (mid - a) ELSE (value - mid) / (b - mid) END AS x FROM e, cp), "
    "r AS (SELECT event_id, user_id, value, CAST(CASE WHEN value <= a THEN pa WHEN value >= b THEN pb WHEN value < mid "
    "THEN pa - pa * x * x * (3 - 2 * x) ELSE pb * x * x * (3 - 2 * x) END AS DOUBLE) AS relevance FROM s), "
    "f AS (SELECT *, relevance >= 0.5 AS rare FROM r), "
    "g AS (SELECT *, rare <> lag(rare, 1, rare) OVER (ORDER BY value, event_id) AS turn FROM f), "
    "runs AS (SELECT event_id, user_id, value, relevance, rare, CAST(sum(turn::INT) OVER (ORDER BY value, event_id) AS INTEGER) AS run FROM g), "
    "size AS (SELECT run, rare, count(*) AS n, CAST(round_even(sum(count(*)) OVER () / count(*) OVER (), 0) AS BIGINT) AS want FROM runs GROUP BY run, rare), "
    f"num AS (SELECT runs.*, n, want, row_number() OVER (PARTITION BY run ORDER BY {h(vc('event_id'), chr(39) + '42' + chr(39))}, event_id) AS place "
    "FROM runs JOIN size USING (run, rare))")


def _smoter_new() -> str:
    def at(tag):
        return _seeded("run", "place", "j", "'42'", f"'{tag}'")

    def noise(tag):
        return z(vc("run"), vc("place"), vc("j"), "'42'", f"'{tag}'")

    return (
        "m AS (SELECT * FROM num WHERE want > n), sd AS (SELECT run, stddev_samp(value) AS sy, stddev_samp(user_id) AS sx, "
        "min(user_id) > 0 AS pos FROM m GROUP BY run), "
        "nn AS (SELECT a.run, a.place, b.user_id AS x1, b.value AS y1, power(CAST(a.user_id AS DOUBLE) - CAST(b.user_id AS DOUBLE), 2) AS d2, "
        "row_number() OVER (PARTITION BY a.run, a.place ORDER BY power(CAST(a.user_id AS DOUBLE) - CAST(b.user_id AS DOUBLE), 2), b.place) AS rank "
        "FROM m a JOIN m b ON a.run = b.run AND a.place <> b.place QUALIFY rank <= 5), "
        "ar AS (SELECT run, place, count(*) AS k, median(sqrt(d2)) / 2 AS safe FROM nn GROUP BY run, place), "
        "dr AS (SELECT m.*, k, safe, sy, sx, pos, unnest(range(1, want // n + (place <= want % n)::INT)) AS j "
        "FROM m JOIN sd USING (run) LEFT JOIN ar USING (run, place)), "
        f"dp AS (SELECT *, {at('nn')} % k + 1 AS rank, CAST({at('u')} AS DOUBLE) / power(2, 60) AS u, least(coalesce(safe, 0.02), 0.02) AS step FROM dr), "
        "dn AS (SELECT dp.*, x1, y1, d2, coalesce(sqrt(d2) < safe, false) AS mid, sqrt(power(u, 2) * d2) AS a, sqrt(power(1 - u, 2) * d2) AS b "
        "FROM dp LEFT JOIN nn USING (run, place, rank)), "
        f"nx AS (SELECT *, CASE WHEN mid THEN user_id + u * (x1 - user_id) ELSE user_id + {noise('x0')} * step * sx END AS x, "
        f"CASE WHEN mid THEN CASE WHEN a = b THEN (value + y1) / 2 ELSE (b * value + a * y1) / (a + b) END ELSE value + {noise('y')} * step * sy END AS y FROM dn), "
        "made AS (SELECT CAST(NULL AS BIGINT) AS event_id, CAST(round_even(CASE WHEN pos THEN greatest(x, 0) ELSE x END, 0) AS BIGINT) AS user_id, y AS value FROM nx)")


def _ev3(spark, sf):
    return read_table(spark, sf, "events").select("event_id", "user_id", "value")


@register("smoter_relevance_events", f"WITH {_EV3}, {_RUNS} SELECT event_id, relevance, rare, run FROM runs")
def _q(spark, sf):
    e = _ev3(spark, sf)
    points = SM.control_points(e, "value")
    runs = SM.target_runs(e, "value", points)
    phi = SM.relevance(F.col("value"), points)
    return e.select("event_id", phi.alias("relevance"), (phi >= 0.5).alias("rare"), SM.run_of(F.col("value"), runs).cast("int").alias("run"))


@register("smoter_runs_events", f"WITH {_EV3}, {_RUNS} SELECT run, rare, n, want FROM size")
def _q(spark, sf):
    e = _ev3(spark, sf)
    runs = SM.target_runs(e, "value", SM.control_points(e, "value"))
    return spark.createDataFrame([(i, r.rare, r.n, r.want) for i, r in enumerate(runs)], "run int, rare boolean, n long, want long")


@register("smoter_events", f"WITH {_EV3}, {_RUNS}, {_smoter_new()} SELECT event_id, user_id, value FROM num WHERE place <= want "
          "UNION ALL SELECT event_id, user_id, value FROM made")
def _q(spark, sf):
    return B.balance(_ev3(spark, sf), "value", "SMOTER", row_id=["event_id"])


@register("smoter_events_with_categories")
def _q(spark, sf):
    return SM.smoter(FX.event_tail(spark, sf), "value", row_id=["event_id"])


# --- M: a model that SQL can fit ---------------------------------------------------------------


@register("train_linear_regression_part",
          f"WITH p AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS x, p_retailprice AS y, "
          f"CAST({h(vc('p_partkey'), chr(39) + '42' + chr(39))} AS DOUBLE) / power(2, 60) < 0.2 AS test FROM part), "
          "f AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM p WHERE NOT test), "
          "q AS (SELECT test, y, a + b * x AS yh FROM p, f), "
          "s AS (SELECT test, avg(abs(y - yh)) AS mae, avg((y - yh) * (y - yh)) AS mse, 1 - sum((y - yh) * (y - yh)) / (var_pop(y) * count(*)) AS r2 "
          "FROM q GROUP BY test) "
          "SELECT t.mae, t.mse, sqrt(t.mse) AS rmse FROM s t WHERE t.test")
def _q(spark, sf):
    p = read_table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")
    return M.train(p, "p_retailprice", "linear_regression", row_id=["p_partkey"]).metrics.select("mae", "mse", "rmse")
