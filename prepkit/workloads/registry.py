"""Registered queries over the given tables and their DuckDB twins.

``QUERIES[name](spark, sf_dir) -> DataFrame`` and ``ORACLE[name] -> SQL``.
Every query reads the whole given tables (or inputs Spark derives from them).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile as P
from ..operators.transforms import apply_templates
from ..sources import fixtures as FX
from ..sources.io import read_table
from . import sqlgen as S
from .templates_cases import CASES, case_sql

QUERIES: dict = {}
ORACLE: dict = {}


def register(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# --- E: profiling -------------------------------------------------------------

@register("overview_lineitem",
          "SELECT count(*) AS n_rows, CAST(11 AS BIGINT) AS n_columns FROM lineitem")
def _q(spark, sf):
    return P.overview(read_table(spark, sf, "lineitem"))


@register("sample_rows_orders", "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5")
def _q(spark, sf):
    return P.sample_rows(read_table(spark, sf, "orders"), [F.desc("o_totalprice"), "o_orderkey"])


@register("missing_values_li_nulls", S.missing_values(S.LI_NULLS, S.LINEITEM))
def _q(spark, sf):
    return P.missing_values(FX.li_nulls(spark, sf))


@register("missing_summary_li_nulls",
          f"WITH m AS ({S.missing_values(S.LI_NULLS, S.LINEITEM)}) SELECT CAST(sum(missing_count) AS BIGINT) "
          "AS total_missing_cells, count_if(missing_count > 0) AS columns_with_missing FROM m")
def _q(spark, sf):
    return P.missing_summary(FX.li_nulls(spark, sf))


@register("outliers_lineitem", S.outliers("SELECT * FROM lineitem", S.LINEITEM))
def _q(spark, sf):
    return P.outliers(read_table(spark, sf, "lineitem"))


@register("outliers_events", S.outliers("SELECT * FROM events", S.EVENTS))
def _q(spark, sf):
    return P.outliers(read_table(spark, sf, "events"))


@register("cardinality_orders", S.cardinality("SELECT * FROM orders", S.ORDERS))
def _q(spark, sf):
    return P.cardinality(read_table(spark, sf, "orders"))


@register("cardinality_li_nulls", S.cardinality(S.LI_NULLS, S.LINEITEM))
def _q(spark, sf):
    return P.cardinality(FX.li_nulls(spark, sf))


@register("univariate_numerical_lineitem", S.univariate_numerical("SELECT * FROM lineitem", S.LINEITEM))
def _q(spark, sf):
    return P.univariate_numerical(read_table(spark, sf, "lineitem"))


@register("univariate_numerical_li_nulls", S.univariate_numerical(S.LI_NULLS, S.LINEITEM))
def _q(spark, sf):
    return P.univariate_numerical(FX.li_nulls(spark, sf))


@register("univariate_numerical_events", S.univariate_numerical("SELECT * FROM events", S.EVENTS))
def _q(spark, sf):
    return P.univariate_numerical(read_table(spark, sf, "events"))


@register("top_values_orders",
          S.top_values("SELECT * FROM orders", S.ORDERS, ["o_orderstatus", "o_orderpriority"]))
def _q(spark, sf):
    return P.top_values(read_table(spark, sf, "orders"))


@register("top_values_customer_names",
          S.top_values("SELECT * FROM customer", [("c_name", "s"), ("c_mktsegment", "s")],
                       ["c_name", "c_mktsegment"]))
def _q(spark, sf):
    return P.top_values(read_table(spark, sf, "customer"), ["c_name", "c_mktsegment"])


@register("univariate_categorical_li_nulls",
          S.univariate_categorical(S.LI_NULLS, S.LINEITEM, ["l_returnflag", "l_linestatus"]))
def _q(spark, sf):
    return P.univariate_categorical(FX.li_nulls(spark, sf))


@register("column_metadata_orders",
          S.column_metadata("SELECT * FROM orders", S.ORDERS,
                            {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string",
                             "o_totalprice": "double", "o_orderdate": "timestamp_ntz",
                             "o_orderpriority": "string"}))
def _q(spark, sf):
    return P.column_metadata(read_table(spark, sf, "orders")).withColumn(
        "sample_values", F.array_join("sample_values", "|"))


@register("dataset_context_lineitem",
          "WITH c AS (SELECT l_returnflag AS t, count(*) AS n FROM lineitem WHERE l_returnflag IS NOT NULL "
          "GROUP BY 1), s AS (SELECT count(*) AS nd, max(n) AS mx, min(n) AS mn FROM c) "
          "SELECT (SELECT count(*) FROM lineitem) AS num_rows, CAST(11 AS BIGINT) AS num_columns, "
          "'l_returnflag' AS target_column, CASE WHEN nd < 20 THEN 'classification' ELSE 'regression' END "
          "AS problem_type, CASE WHEN nd < 20 THEN nd END AS num_classes, "
          "CASE WHEN nd < 20 THEN mx / mn END AS imbalance_ratio, 8 AS n_numerical, 1 AS n_categorical, "
          "1 AS n_datetime FROM s")
def _q(spark, sf):
    return P.dataset_context(read_table(spark, sf, "lineitem"), "l_returnflag")


@register("class_distribution_orders",
          "SELECT o_orderpriority AS class, count(*) AS count, count(*) / sum(count(*)) OVER () AS share "
          "FROM orders GROUP BY 1")
def _q(spark, sf):
    return P.class_distribution(read_table(spark, sf, "orders"), "o_orderpriority")


@register("eda_report_orders")
def _q(spark, sf):
    return P.eda_report(read_table(spark, sf, "orders"), target="o_orderpriority")


# --- O: one query per transform template ------------------------------------

_TABLE_BUILDERS = {"li": FX.li_nulls, "ordn": FX.ord_nulls,
                   "pt": lambda spark, sf: read_table(spark, sf, "part")}


def _template_query(table, keys, transformation, order_by):
    def q(spark, sf):
        df = _TABLE_BUILDERS[table](spark, sf)
        out = apply_templates(df, [dict(transformation)], order_by=order_by)
        new = [c for c in out.columns if c not in df.columns]
        return out.select(*keys, *new)
    return q


for _name, _table, _keys, _t, _exprs, _order in CASES:
    QUERIES[f"template_{_name}"] = _template_query(_table, _keys, _t, _order)
    ORACLE[f"template_{_name}"] = case_sql(_table, _keys, _exprs)


from . import registry_analysis  # noqa: E402,F401  (registers more queries)
from . import registry_model  # noqa: E402,F401
from . import registry_extra  # noqa: E402,F401
