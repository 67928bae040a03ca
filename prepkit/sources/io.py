"""Sources and sinks.

Tables are parquet paths or catalog names; everything returns a lazy
DataFrame so Catalyst can push filters and prune columns into the scan.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import INTEGRAL_TYPES, NUMERIC_TYPES, resolve_columns

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def scan(spark: SparkSession, source: str, limit: int | None = None,
         order_by: list[str] | None = None) -> DataFrame:
    """Full scan of a parquet path or catalog table.

    ``limit`` reproduces the sample cap of the interactive service; it needs an
    explicit ``order_by`` so the sample is the same on every run.
    """
    if "/" in source or source.endswith(".parquet"):
        df = spark.read.parquet(source)
    else:
        df = spark.table(source)
    if limit is not None:
        if not order_by:
            raise ValueError("limit needs order_by for a repeatable sample")
        df = df.orderBy(*order_by).limit(limit)
    return df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def column_list(df: DataFrame) -> DataFrame:
    """S3: schema as rows ``(ordinal, column_name, data_type, nullable)``."""
    spark = df.sparkSession
    rows = [(i + 1, f.name, f.dataType.simpleString(), f.nullable)
            for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(
        rows, "ordinal int, column_name string, data_type string, nullable boolean")


def write_table(df: DataFrame, target: str, mode: str = "overwrite",
                fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    """Create-or-replace a table (path or catalog name)."""
    w = df.write.mode(mode).format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if "/" in target:
        w.save(target)
    else:
        w.saveAsTable(target)


def normalise_types(df: DataFrame, target: str, categorical_target: bool = True) -> DataFrame:
    """S5 projection: target bigint when categorical, numerics double, rest string.

    NULL stays NULL (no 'nan' text).
    """
    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if f.name == target and categorical_target:
            cols.append(F.bround(c.cast("double")).cast("bigint").alias(f.name))
        elif isinstance(f.dataType, NUMERIC_TYPES):
            cols.append(c.cast("double").alias(f.name))
        else:
            cols.append(c.cast("string").alias(f.name))
    return df.select(*cols)


def write_normalised(df: DataFrame, target_col: str, path: str,
                     categorical_target: bool = True) -> None:
    """Truncate-write with the forced schema of ``normalise_types``."""
    normalise_types(df, target_col, categorical_target).write.mode("overwrite").parquet(path)


AUDIT_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("dataset", T.StringType()),
    T.StructField("table_name", T.StringType()),
    T.StructField("summary", T.StructType([
        T.StructField("high_risk", T.IntegerType()),
        T.StructField("medium_risk", T.IntegerType()),
        T.StructField("low_risk", T.IntegerType())])),
    T.StructField("high_risk_features", T.ArrayType(T.StructType([
        T.StructField("feature", T.StringType()), T.StructField("reason", T.StringType())]))),
    T.StructField("medium_risk_features", T.ArrayType(T.StructType([
        T.StructField("feature", T.StringType()), T.StructField("reason", T.StringType())]))),
    T.StructField("low_risk_features", T.ArrayType(T.StructType([
        T.StructField("feature", T.StringType()), T.StructField("reason", T.StringType())]))),
    T.StructField("ld_full_output", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
])


def audit_rows(report: DataFrame, dataset: str, table_name: str) -> DataFrame:
    """S6 row builder: nested audit record(s) from a K4 leakage report.

    ``report`` has columns ``risk`` ('high'|'medium'|'low'), ``feature``,
    ``reason``.  One output row per call, built by a single aggregation.
    """
    feat = F.struct(F.col("feature"), F.col("reason"))

    def bucket(level: str) -> Column:
        return F.filter(F.collect_list(F.when(F.col("risk") == level, feat)),
                        lambda x: x.isNotNull())

    agg = report.agg(
        bucket("high").alias("high_risk_features"),
        bucket("medium").alias("medium_risk_features"),
        bucket("low").alias("low_risk_features"),
        F.to_json(F.collect_list(F.struct("risk", "feature", "reason"))).alias("ld_full_output"))
    return agg.select(
        F.xxhash64(F.expr("uuid()")).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF)).alias("id"),
        F.lit(dataset).alias("dataset"), F.lit(table_name).alias("table_name"),
        F.struct(F.size("high_risk_features").cast("int").alias("high_risk"),
                 F.size("medium_risk_features").cast("int").alias("medium_risk"),
                 F.size("low_risk_features").cast("int").alias("low_risk")).alias("summary"),
        "high_risk_features", "medium_risk_features", "low_risk_features", "ld_full_output",
        F.current_timestamp().alias("created_at"))


def append_audit(rows: DataFrame, path: str) -> None:
    """Append nested audit rows (fixed schema, no inference)."""
    rows.select(*[F.col(f.name).cast(f.dataType) for f in AUDIT_SCHEMA.fields]) \
        .write.mode("append").parquet(path)


STATUS_SCHEMA = "table_name string, phase string, status string, last_updated timestamp"


def upsert_status(spark: SparkSession, path: str, table_name: str, phase: str,
                  status: str) -> None:
    """Append-only status log; ``latest_status`` gives the upserted view."""
    spark.createDataFrame([(table_name, phase, status)],
                          "table_name string, phase string, status string") \
        .withColumn("last_updated", F.current_timestamp()) \
        .write.mode("append").parquet(path)


def latest_status(log: DataFrame) -> DataFrame:
    """S7 view: last row per (table_name, phase)."""
    return log.groupBy("table_name", "phase").agg(
        F.max_by("status", F.struct("last_updated", "status")).alias("status"), F.max("last_updated").alias("last_updated"))


def write_report(df: DataFrame, path: str) -> None:
    """JSON report section."""
    df.write.mode("overwrite").json(path)


def drop_columns(df: DataFrame, columns: list[str], protect: str | None = None):
    """Drop columns matched case-insensitively; never the protected target.

    Returns ``(df_out, dropped, ignored)``.
    """
    found, missing = resolve_columns(df, columns)
    dropped, ignored = [], list(missing)
    for c in found:
        if protect is not None and c.strip().lower() == protect.strip().lower():
            ignored.append(c)
        elif c not in dropped:
            dropped.append(c)
    return df.drop(*dropped), dropped, ignored


def integral_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, INTEGRAL_TYPES)]
