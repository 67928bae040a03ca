"""Helpers that write the DuckDB twin of a profiling query.

These produce plain SQL text (UNION ALL unpivots, scalar subqueries) for the
correctness check; they are not used by the Spark side.
"""

from __future__ import annotations

LINEITEM = [("l_orderkey", "i"), ("l_partkey", "i"), ("l_suppkey", "i"), ("l_linenumber", "i"),
            ("l_quantity", "f"), ("l_extendedprice", "f"), ("l_discount", "f"), ("l_tax", "f"),
            ("l_returnflag", "s"), ("l_linestatus", "s"), ("l_shipdate", "t")]
ORDERS = [("o_orderkey", "i"), ("o_custkey", "i"), ("o_orderstatus", "s"), ("o_totalprice", "f"),
          ("o_orderdate", "t"), ("o_orderpriority", "s")]
EVENTS = [("event_id", "i"), ("ts", "t"), ("user_id", "i"), ("event_type", "s"), ("value", "f"),
          ("props", "s")]

LI_NULLS = ("SELECT * REPLACE (CASE WHEN l_orderkey % 10 = 0 THEN NULL ELSE l_quantity END AS l_quantity, "
            "CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_returnflag END AS l_returnflag) FROM lineitem")
ORD_NULLS = ("SELECT * REPLACE (CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_totalprice END "
             "AS o_totalprice) FROM orders")
DOC_BINARY = ("SELECT d.doc_id, d.lang, d.source, d.n_chars, l.toxic AS target "
              "FROM documents d JOIN labels l USING (doc_id)")
DOC_NUMERIC = ("SELECT d.doc_id, d.n_chars, l.quality, l.toxic AS target "
               "FROM documents d JOIN labels l USING (doc_id)")


def numeric(cols):
    return [c for c, t in cols if t in ("i", "f")]


def categorical(cols):
    return [c for c, t in cols if t == "s"]


def val(c, t):
    """Value with NaN as NULL, as double."""
    if t == "f":
        return f"CASE WHEN isnan({c}) THEN NULL ELSE CAST({c} AS DOUBLE) END"
    return f"CAST({c} AS DOUBLE)"


def text(c, t):
    """canonical text form (integral doubles without fraction)."""
    if t == "f":
        return (f"CASE WHEN isnan({c}) THEN NULL WHEN {c} = floor({c}) THEN CAST(CAST({c} AS BIGINT) AS VARCHAR) "
                f"ELSE CAST({c} AS VARCHAR) END")
    return f"CAST({c} AS VARCHAR)"


def missing(c, t):
    if t == "f":
        return f"({c} IS NULL OR isnan({c}))"
    return f"({c} IS NULL)"


def long_numeric(src, cols):
    parts = [f"SELECT '{c}' AS column_name, {val(c, t)} AS v FROM {src}" for c, t in cols
             if t in ("i", "f")]
    return " UNION ALL ".join(parts)


def long_text(src, cols, only=None):
    parts = [f"SELECT '{c}' AS column_name, {text(c, t)} AS value FROM {src}" for c, t in cols
             if (only is None or c in only)]
    return " UNION ALL ".join(parts)


def univariate_numerical(src_sql, cols):
    return (f"WITH src AS ({src_sql}), long AS ({long_numeric('src', cols)}) "
            "SELECT column_name, count(v) AS count, avg(v) AS mean, stddev_samp(v) AS std, "
            "min(v) AS min, max(v) AS max, quantile_cont(v, 0.5) AS median, "
            "quantile_cont(v, 0.25) AS q25, quantile_cont(v, 0.75) AS q75, "
            "CASE WHEN count(v) > 2 THEN coalesce(skewness(v), 0) ELSE 0 END AS skewness, "
            "CASE WHEN count(v) > 3 THEN coalesce(kurtosis(v), 0) ELSE 0 END AS kurtosis "
            "FROM long GROUP BY column_name HAVING count(v) > 0")


def missing_values(src_sql, cols):
    parts = [f"SELECT {i + 1} AS ordinal, '{c}' AS column_name, count_if({missing(c, t)}) AS missing_count, "
             f"count(*) AS n FROM src" for i, (c, t) in enumerate(cols)]
    return (f"WITH src AS ({src_sql}), m AS ({' UNION ALL '.join(parts)}) "
            "SELECT ordinal, column_name, missing_count, "
            "round_even(missing_count * 100.0 / NULLIF(n, 0), 2) AS missing_pct FROM m")


def outliers(src_sql, cols):
    num = [(c, t) for c, t in cols if t in ("i", "f")]
    return (f"WITH src AS ({src_sql}), long AS ({long_numeric('src', num)}), "
            "b AS (SELECT column_name, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 "
            "FROM long WHERE v IS NOT NULL GROUP BY column_name) "
            "SELECT l.column_name, count_if(v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS outlier_count, "
            "round_even(count_if(v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) * 100.0 / count(v), 2) AS outlier_pct, "
            "any_value(q1 - 1.5 * (q3 - q1)) AS lower_bound, any_value(q3 + 1.5 * (q3 - q1)) AS upper_bound "
            "FROM long l JOIN b USING (column_name) GROUP BY l.column_name")


def cardinality(src_sql, cols):
    return (f"WITH src AS ({src_sql}), long AS ({long_text('src', cols)}), "
            "u AS (SELECT column_name, count(DISTINCT value) AS unique_values FROM long GROUP BY column_name), "
            "n AS (SELECT count(*) AS n FROM src) "
            "SELECT column_name, unique_values, CASE WHEN n > 0 THEN round_even(unique_values / n, 4) ELSE 0.0 END "
            "AS cardinality_ratio, unique_values > 50 AS is_high_cardinality FROM u, n")


def value_counts(src_sql, cols, only):
    return (f"WITH src AS ({src_sql}), long AS ({long_text('src', cols, only)}), "
            "vc AS (SELECT column_name, value, count(*) AS count FROM long WHERE value IS NOT NULL "
            "GROUP BY column_name, value)")


def top_values(src_sql, cols, only, k=5):
    return (value_counts(src_sql, cols, only) +
            " SELECT column_name, rank, value, count FROM (SELECT column_name, value, count, "
            "CAST(row_number() OVER (PARTITION BY column_name ORDER BY count DESC, value) AS INTEGER) AS rank "
            f"FROM vc) WHERE rank <= {k}")


def univariate_categorical(src_sql, cols, only):
    return (value_counts(src_sql, cols, only) +
            " SELECT column_name, count(*) AS unique_count, "
            "arg_min(value, (-count, value)) AS mode, max(count) AS mode_count FROM vc GROUP BY column_name")


def column_metadata(src_sql, cols, types):
    only = [c for c, _ in cols]
    return (value_counts(src_sql, cols, only) +
            ", r AS (SELECT column_name, value, row_number() OVER (PARTITION BY column_name ORDER BY value) AS rn FROM vc) "
            ", t AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{types[c]}')" for c in only) +
            ") AS t(column_name, dtype)) "
            "SELECT t.column_name, t.dtype, coalesce(u.unique_values, 0) AS unique_values, s.sample_values FROM t "
            "LEFT JOIN (SELECT column_name, count(*) AS unique_values FROM vc GROUP BY column_name) u USING (column_name) "
            "LEFT JOIN (SELECT column_name, string_agg(value, '|' ORDER BY value) AS sample_values FROM r "
            "WHERE rn <= 5 GROUP BY column_name) s USING (column_name)")
