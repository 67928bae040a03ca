"""Registered queries of the training-data operators and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from prepkit.llm import (byte_bpe, centroids, decontaminate, filter_audit, gam, license_scan, line_dedup, main_text, ngram_join, rule_forest,
                         url_filter, vector_dedup, warc_store)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: without a twin: 2, 6, 7, 8, 9, 10 and 4, which SQL cannot express; tests hold them against brute force
ORACLE: dict[str, str] = {
    "op1_license_scan": license_scan.oracle_sql(),
    "op3_benchmark_decontamination": decontaminate.oracle_sql(),
    "op5_warc_archive": warc_store.oracle_sql(),
    "op11_filter_audit": filter_audit.oracle_sql(),
    "op12_centroid_clustering": centroids.oracle_sql(),
    "op13_vector_dedup": vector_dedup.oracle_sql(),
}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_license_scan(spark, sf_dir):
    return license_scan.license_scan(_table(spark, sf_dir, "documents")).drop("matches")


@query
def op2_url_filter(spark, sf_dir):
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"))


@query
def op3_benchmark_decontamination(spark, sf_dir):
    return decontaminate.contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@query
def op4_byte_bpe(spark, sf_dir):
    return byte_bpe.encode_documents(_table(spark, sf_dir, "documents"))


@query
def op5_warc_archive(spark, sf_dir):
    path = warc_store.new_archive(spark)
    warc_store.write_archive(_table(spark, sf_dir, "pages"), path)
    return warc_store.read_index(spark, path)


@query
def op6_main_text(spark, sf_dir):
    return main_text.main_text(_table(spark, sf_dir, "pages"))


@query
def op7_line_dedup(spark, sf_dir):
    return line_dedup.line_dedup(_table(spark, sf_dir, "documents"))


@query
def op8_ngram_jaccard_join(spark, sf_dir):
    return ngram_join.ngram_jaccard_join(_table(spark, sf_dir, "documents"))


@query
def op9_quality_classifier(spark, sf_dir):
    return gam.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@query
def op10_quality_rules(spark, sf_dir):
    return rule_forest.quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@query
def op11_filter_audit(spark, sf_dir):
    return filter_audit.filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@query
def op12_centroid_clustering(spark, sf_dir):
    return centroids.centroid_clustering(_table(spark, sf_dir, "embeddings"))


@query
def op13_vector_dedup(spark, sf_dir):
    return vector_dedup.vector_dedup(_table(spark, sf_dir, "embeddings"))
