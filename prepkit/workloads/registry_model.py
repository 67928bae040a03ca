"""Registered queries for balancing, modelling and reply parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as J
from ..operators import balance as B
from ..operators import model as M
from ..sources import fixtures as FX
from ..sources.io import read_table
from . import sqlgen as S
from .registry import register


def h(*parts):
    """SQL twin of ``hash_bigint``: first 15 hex digits of md5 of the '|'-joined parts."""
    inner = ", ".join(parts)
    return f"('0x' || substr(md5(concat_ws('|', {inner})), 1, 15))::BIGINT"


def vc(x):
    return f"CAST({x} AS VARCHAR)"


def z(*parts):
    """SQL twin of the hash Box-Muller normal."""
    u1 = f"(CAST({h(*parts, chr(39) + 'u1' + chr(39))} AS DOUBLE) + 1.0) / (power(2, 60) + 1.0)"
    u2 = f"CAST({h(*parts, chr(39) + 'u2' + chr(39))} AS DOUBLE) / power(2, 60)"
    return f"(sqrt(-2.0 * ln({u1})) * cos(2 * pi() * {u2}))"


DOC_COLS = "doc_id, lang, source, n_chars, target"
EV_COLS = "event_id, user_id, event_type, value"
EV = "e AS (SELECT event_id, user_id, event_type, value FROM events)"


def _oversample_sql(src_cte, cls, cols, key):
    return (f"WITH {src_cte}, b AS (SELECT * FROM src WHERE {cls} IS NOT NULL), "
            f"c AS (SELECT {cls}, count(*) AS cnt FROM b GROUP BY 1), m AS (SELECT max(cnt) AS mx FROM c), "
            f"num AS (SELECT b.*, row_number() OVER (PARTITION BY {cls} ORDER BY {h(vc(key), chr(39) + '42' + chr(39))}, "
            f"{key}) AS idx FROM b), "
            f"dr AS (SELECT {cls}, cnt, unnest(range(1, mx - cnt + 1)) AS j FROM c, m WHERE cnt < mx), "
            f"dp AS (SELECT {cls}, {h(vc(cls), vc('j'), chr(39) + '42' + chr(39))} % cnt + 1 AS pick FROM dr) "
            f"SELECT {cols} FROM b UNION ALL SELECT {', '.join('num.' + c.strip() for c in cols.split(','))} "
            f"FROM dp JOIN num ON num.{cls} = dp.{cls} AND num.idx = dp.pick")


@register("random_oversample_documents",
          _oversample_sql(f"src AS ({S.DOC_BINARY})", "target", DOC_COLS, "doc_id"))
def _q(spark, sf):
    return B.random_oversample(FX.doc_binary(spark, sf), "target", row_id=["doc_id"])


@register("random_oversample_orders_priority",
          _oversample_sql("src AS (SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders)",
                          "o_orderpriority", "o_orderkey, o_orderpriority, o_totalprice", "o_orderkey"))
def _q(spark, sf):
    o = read_table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return B.random_oversample(o, "o_orderpriority", row_id=["o_orderkey"])


@register("random_undersample_documents",
          f"WITH src AS ({S.DOC_BINARY}), b AS (SELECT * FROM src WHERE target IS NOT NULL), "
          "c AS (SELECT target, count(*) AS cnt FROM b GROUP BY 1) "
          f"SELECT {DOC_COLS} FROM (SELECT b.*, row_number() OVER (PARTITION BY target ORDER BY "
          f"{h(vc('doc_id'), chr(39) + '42' + chr(39))}, doc_id) AS r FROM b) WHERE r <= (SELECT min(cnt) FROM c)")
def _q(spark, sf):
    return B.random_undersample(FX.doc_binary(spark, sf), "target", row_id=["doc_id"])


@register("random_undersample_orders_status",
          "WITH b AS (SELECT o_orderkey, o_orderstatus FROM orders), c AS (SELECT o_orderstatus, count(*) AS cnt "
          "FROM b GROUP BY 1) SELECT o_orderkey, o_orderstatus FROM (SELECT b.*, row_number() OVER (PARTITION BY "
          f"o_orderstatus ORDER BY {h(vc('o_orderkey'), chr(39) + '42' + chr(39))}, o_orderkey) AS r FROM b) "
          "WHERE r <= (SELECT min(cnt) FROM c)")
def _q(spark, sf):
    o = read_table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return B.random_undersample(o, "o_orderstatus", row_id=["o_orderkey"])


@register("gaussian_noise_events",
          f"WITH {EV} SELECT event_id, user_id, event_type, value + ({z(vc('event_id'), chr(39) + '42' + chr(39))} "
          "* (0.05 * (SELECT stddev_pop(value) FROM e))) AS value FROM e")
def _q(spark, sf):
    return B.gaussian_noise(FX.event_tail(spark, sf), "value", row_id=["event_id"])


_EV_NUM = (f"num AS (SELECT e.*, row_number() OVER (ORDER BY {h(vc('event_id'), chr(39) + '42' + chr(39))}, "
           "event_id) AS idx FROM e)")


def _pick(tag):
    return f"{h(vc('i'), chr(39) + tag + chr(39), chr(39) + '42' + chr(39))} % n + 1"


@register("kde_resample_events",
          f"WITH {EV}, {_EV_NUM}, k AS (SELECT count(*) AS n FROM e), i AS (SELECT unnest(range(0, n)) AS i, n FROM k) "
          f"SELECT a.event_id, b.user_id, c.event_type, CAST(d.value AS DOUBLE) + "
          f"{z(vc('i'), chr(39) + '42' + chr(39), chr(39) + 'kde' + chr(39))} * 0.2 AS value FROM i "
          f"JOIN num a ON a.idx = {_pick('event_id')} JOIN num b ON b.idx = {_pick('user_id')} "
          f"JOIN num c ON c.idx = {_pick('event_type')} JOIN num d ON d.idx = {_pick('value')}")
def _q(spark, sf):
    return B.kde_resample(FX.event_tail(spark, sf), "value", row_id=["event_id"])


_PROBS = "[" + ", ".join(repr(i / 10) for i in range(11)) + "]"


@register("quantile_bin_oversample_events",
          f"WITH {EV}, q AS (SELECT list_sort(list_distinct(quantile_cont(value, {_PROBS}))) AS edges FROM e), "
          "src AS (SELECT e.*, greatest(len(list_filter(edges, lambda x: x < value)) - 1, 0) AS bin FROM e, q "
          "WHERE value IS NOT NULL), "
          "c AS (SELECT bin, count(*) AS cnt FROM src GROUP BY 1), m AS (SELECT max(cnt) AS mx FROM c), "
          f"num AS (SELECT src.*, row_number() OVER (PARTITION BY bin ORDER BY {h(vc('event_id'), chr(39) + '42' + chr(39))}, "
          "event_id) AS idx FROM src), dr AS (SELECT bin, cnt, unnest(range(1, mx - cnt + 1)) AS j FROM c, m WHERE cnt < mx), "
          f"dp AS (SELECT bin, {h(vc('bin'), vc('j'), chr(39) + '42' + chr(39))} % cnt + 1 AS pick FROM dr) "
          f"SELECT {EV_COLS} FROM src UNION ALL SELECT num.event_id, num.user_id, num.event_type, num.value "
          "FROM dp JOIN num ON num.bin = dp.bin AND num.idx = dp.pick")
def _q(spark, sf):
    return B.quantile_bin_oversample(FX.event_tail(spark, sf), "value", row_id=["event_id"])


@register("tail_resample_events",
          f"WITH {EV}, q AS (SELECT quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi FROM e), "
          "t AS (SELECT e.* FROM e, q WHERE value <= lo OR value >= hi), "
          f"num AS (SELECT t.*, row_number() OVER (ORDER BY {h(vc('event_id'), chr(39) + '42' + chr(39))}, event_id) AS idx FROM t), "
          "k AS (SELECT (SELECT count(*) FROM e) - (SELECT count(*) FROM t) AS need, (SELECT count(*) FROM t) AS nt), "
          "dr AS (SELECT unnest(range(1, need + 1)) AS j, nt FROM k WHERE need > 0 AND nt > 0), "
          f"dp AS (SELECT {h(chr(39) + '1' + chr(39), vc('j'), chr(39) + '42' + chr(39))} % nt + 1 AS pick FROM dr) "
          f"SELECT {EV_COLS} FROM e UNION ALL SELECT num.event_id, num.user_id, num.event_type, num.value "
          "FROM dp JOIN num ON num.idx = dp.pick")
def _q(spark, sf):
    return B.tail_resample(FX.event_tail(spark, sf), "value", row_id=["event_id"])


# --- M ---------------------------------------------------------------------------

_SPLIT = (f"sp AS (SELECT b.*, CASE WHEN row_number() OVER (PARTITION BY target ORDER BY "
          f"{h(vc('doc_id'), chr(39) + '42' + chr(39))}, doc_id) <= round(count(*) OVER (PARTITION BY target) * 0.2) "
          "THEN 'test' ELSE 'train' END AS split FROM src b)")


@register("split_documents", f"WITH src AS ({S.DOC_BINARY}), {_SPLIT} SELECT {DOC_COLS}, split FROM sp")
def _q(spark, sf):
    return M.split(FX.doc_binary(spark, sf), "target", row_id=["doc_id"])


@register("standard_scale_documents",
          f"WITH src AS ({S.DOC_NUMERIC}), {_SPLIT.replace('FROM src b', 'FROM src b')}, "
          "st AS (SELECT avg(CAST(n_chars AS DOUBLE)) AS m1, stddev_pop(CAST(n_chars AS DOUBLE)) AS s1, "
          "avg(CAST(quality AS DOUBLE)) AS m2, stddev_pop(CAST(quality AS DOUBLE)) AS s2 FROM sp WHERE split = 'train') "
          "SELECT doc_id, split, (CAST(n_chars AS DOUBLE) - m1) / CASE WHEN s1 = 0 OR s1 IS NULL THEN 1.0 ELSE s1 END AS n_chars, "
          "(CAST(quality AS DOUBLE) - m2) / CASE WHEN s2 = 0 OR s2 IS NULL THEN 1.0 ELSE s2 END AS quality FROM sp, st")
def _q(spark, sf):
    parts = M.split(FX.doc_numeric(spark, sf), "target", row_id=["doc_id"])
    params = M.fit_standard_scale(parts.where("split = 'train'"), ["n_chars", "quality"])
    return M.apply_standard_scale(parts, params).select("doc_id", "split", "n_chars", "quality")


_SCORED = (f"WITH src AS ({S.DOC_NUMERIC}), p AS (SELECT CAST(target AS DOUBLE) AS label, "
           "least(CAST(n_chars AS DOUBLE) / 20000.0, 1.0) AS score FROM src), "
           "q AS (SELECT label, score, CASE WHEN score > 0.5 THEN 1.0 ELSE 0.0 END AS prediction FROM p)")


@register("classification_metrics_documents",
          _SCORED + ", cm AS (SELECT count_if(label = 0 AND prediction = 0) AS tn, count_if(label = 0 AND prediction = 1) AS fp, "
          "count_if(label = 1 AND prediction = 0) AS fn, count_if(label = 1 AND prediction = 1) AS tp, count(*) AS n, "
          "count_if(label = prediction) AS ok FROM q), "
          "r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM q), "
          "auc AS (SELECT (sum(CASE WHEN label = 1 THEN rk END) - count_if(label = 1) * (count_if(label = 1) + 1) / 2.0) / "
          "(count_if(label = 1) * count_if(label = 0)) AS roc_auc FROM r) "
          "SELECT ok / n AS accuracy, coalesce(tp / NULLIF(tp + fp, 0), 0.0) AS precision, "
          "coalesce(tp / NULLIF(tp + fn, 0), 0.0) AS recall, coalesce(2 * tp / NULLIF(2 * tp + fp + fn, 0), 0.0) AS f1_score, "
          "tn AS true_negative, fp AS false_positive, fn AS false_negative, tp AS true_positive, roc_auc FROM cm, auc")
def _q(spark, sf):
    d = FX.doc_numeric(spark, sf)
    score = F.least(F.col("n_chars").cast("double") / 20000.0, F.lit(1.0))
    p = d.select(F.col("target").cast("double").alias("label"), score.alias("score"))
    p = p.withColumn("prediction", F.when(F.col("score") > 0.5, 1.0).otherwise(0.0))
    return M.classification_metrics(p)


@register("regression_metrics_orders",
          "WITH p AS (SELECT o_totalprice AS label, 1000.0 + o_custkey * 100.0 AS prediction FROM orders), "
          "s AS (SELECT avg(abs(label - prediction)) AS mae, avg((label - prediction) * (label - prediction)) AS mse, "
          "sum((label - prediction) * (label - prediction)) AS sse, var_pop(label) * count(*) AS sst FROM p) "
          "SELECT mae, mse, sqrt(mse) AS rmse, CASE WHEN sst > 0 THEN 1 - sse / sst WHEN sse = 0 THEN 1.0 ELSE 0.0 END "
          "AS r2_score FROM s")
def _q(spark, sf):
    o = read_table(spark, sf, "orders")
    p = o.select(F.col("o_totalprice").alias("label"),
                 (F.lit(1000.0) + F.col("o_custkey") * 100.0).alias("prediction"))
    return M.regression_metrics(p)


@register("train_logistic_documents")
def _q(spark, sf):
    return M.train(FX.doc_numeric(spark, sf), "target", "logistic_regression", row_id=["doc_id"]).metrics


@register("train_random_forest_regressor_orders")
def _q(spark, sf):
    o = read_table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return M.train(o, "o_totalprice", "random_forest_regressor", features=["o_custkey"],
                   row_id=["o_orderkey"]).metrics


# --- J ---------------------------------------------------------------------------

_REPLIES_SQL = ("WITH r AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'Here you go:' || chr(10) || '```json' || chr(10) "
                "|| props || chr(10) || '```' WHEN 1 THEN props WHEN 2 THEN 'The answer is ' || props || ' as requested.' "
                "WHEN 3 THEN 'no structured answer' ELSE '```JSON' || chr(10) || substr(props, 1, 5) || chr(10) || '```' END "
                "AS reply FROM events), "
                "x AS (SELECT event_id, coalesce(NULLIF(trim(regexp_extract(reply, '(?i)```(?:json)?\\s*([\\s\\S]*?)\\s*```', 1)), ''), "
                "NULLIF(trim(regexp_extract(reply, '(\\{[\\s\\S]*\\})', 1)), '')) AS js FROM r) ")


@register("extract_json_replies",
          _REPLIES_SQL + "SELECT event_id, CASE WHEN json_valid(js) THEN CAST(json_extract(js, '$.k') AS BIGINT) END AS k FROM x")
def _q(spark, sf):
    r = FX.replies(spark, sf)
    return r.select("event_id", F.try_variant_get(J.extract_json(F.col("reply")), "$.k", "bigint").alias("k"))


@register("extract_json_list_replies",
          "WITH r AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN '```json' || chr(10) || '[' || props || ', ' || props "
          "|| ']' || chr(10) || '```' WHEN 1 THEN 'list: [' || props || '] done' ELSE 'none' END AS reply FROM events), "
          "x AS (SELECT event_id, coalesce(NULLIF(trim(regexp_extract(reply, '(?i)```(?:json)?\\s*(\\[[\\s\\S]*?\\])\\s*```', 1)), ''), "
          "NULLIF(trim(regexp_extract(reply, '(\\[[\\s\\S]*\\])', 1)), '')) AS js FROM r) "
          "SELECT event_id, CASE WHEN json_valid(js) THEN CAST(json_array_length(js) AS BIGINT) END AS n_items, "
          "CASE WHEN json_valid(js) THEN CAST(json_extract(js, '$[0].k') AS BIGINT) END AS first_k FROM x")
def _q(spark, sf):
    ev = read_table(spark, sf, "events")
    kind = F.col("event_id") % 3
    reply = (F.when(kind == 0, F.concat(F.lit("```json\n["), F.col("props"), F.lit(", "), F.col("props"), F.lit("]\n```")))
             .when(kind == 1, F.concat(F.lit("list: ["), F.col("props"), F.lit("] done"))).otherwise(F.lit("none")))
    v = J.extract_json_list(reply)
    return ev.select("event_id",
                     F.size(F.try_variant_get(v, "$", "array<variant>")).cast("bigint").alias("n_items"),
                     F.try_variant_get(v, "$[0].k", "bigint").alias("first_k")) \
        .withColumn("n_items", F.when(F.col("n_items") >= 0, F.col("n_items")))


@register("cluster_oversample_documents")
def _q(spark, sf):
    return B.cluster_oversample(FX.doc_binary(spark, sf), "target", row_id=["doc_id"])
