"""Derived inputs built from the given tables (both engines use the same rules).

``li_nulls`` and ``ord_nulls`` inject NULLs by a deterministic CASE because the
given tables have none; every row is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .io import read_table


def li_nulls(spark: SparkSession, sf: str) -> DataFrame:
    li = read_table(spark, sf, "lineitem")
    return li.withColumns({
        "l_quantity": F.when(F.col("l_orderkey") % 10 == 0, F.lit(None)).otherwise(F.col("l_quantity")),
        "l_returnflag": F.when(F.col("l_orderkey") % 7 == 0, F.lit(None)).otherwise(F.col("l_returnflag")),
    })


def ord_nulls(spark: SparkSession, sf: str) -> DataFrame:
    o = read_table(spark, sf, "orders")
    return o.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 10 == 0, F.lit(None))
                        .otherwise(F.col("o_totalprice")))


def doc_binary(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "documents")
    lab = read_table(spark, sf, "labels")
    return d.join(lab, "doc_id").select("doc_id", "lang", "source", "n_chars",
                                        F.col("toxic").alias("target"))


def doc_numeric(spark: SparkSession, sf: str) -> DataFrame:
    """Numeric-only binary table: doc_id, n_chars, quality, target."""
    d = read_table(spark, sf, "documents")
    lab = read_table(spark, sf, "labels")
    return d.join(lab, "doc_id").select("doc_id", "n_chars", "quality",
                                        F.col("toxic").alias("target"))


def event_tail(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")


def leaky(spark: SparkSession, sf: str) -> DataFrame:
    li = li_nulls(spark, sf)
    y = (F.col("l_linestatus") == "O").cast("int")
    return li.withColumns({"y": y, "y_copy": y, "y_noisy": y + F.col("l_discount") * 0.1,
                           "next_flag": F.col("l_tax")})


def nested_target(spark: SparkSession, sf: str) -> DataFrame:
    lab = read_table(spark, sf, "labels")
    return lab.select("doc_id", "quality",
                      F.array(F.array(F.col("toxic").cast("double"))).alias("toxic"))


def replies(spark: SparkSession, sf: str) -> DataFrame:
    """Model-reply text around ``events.props``: fenced, bare, inside prose, none, broken."""
    ev = read_table(spark, sf, "events")
    kind = F.col("event_id") % 5
    text = (F.when(kind == 0, F.concat(F.lit("Here you go:\n```json\n"), F.col("props"), F.lit("\n```")))
            .when(kind == 1, F.col("props"))
            .when(kind == 2, F.concat(F.lit("The answer is "), F.col("props"), F.lit(" as requested.")))
            .when(kind == 3, F.lit("no structured answer"))
            .otherwise(F.concat(F.lit("```JSON\n"), F.substring(F.col("props"), 1, 5), F.lit("\n```"))))
    return ev.select("event_id", text.alias("reply"))
