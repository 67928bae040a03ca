"""Corpus pipeline: five operators in a row over the documents of a folder.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as
Parquet in the shared checkpoint folder and the next stage reads it again, so a stage
works on all that its predecessor kept and a lost executor costs one stage at most.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession

from prepkit.llm import byte_bpe, decontaminate, gam, line_dedup, ngram_join
from prepkit.session import ensure_checkpoint_dir, ship_package


def stage(fn):
    """A stage works in any session: it finds a checkpoint folder and the package on the executors."""
    @functools.wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ensure_checkpoint_dir(spark)
        ship_package(spark)
        return fn(spark, docs, sf_dir)
    return run_stage


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects."""
    return gam.without_low_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@stage
def line_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated passages out of the texts; a document of which no word is left goes."""
    return line_dedup.without_repeats(docs)


@stage
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies."""
    return ngram_join.without_near_copies(docs)


@stage
def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that contain a benchmark item."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@stage
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes the texts that are left and decodes them again."""
    return byte_bpe.encode_documents(docs)


STAGES = [("quality_classifier", quality), ("line_dedup", line_repeats), ("ngram_jaccard_join", near_copies),
          ("benchmark_decontamination", benchmark_leaks), ("byte_bpe", tokens)]

#: a boosted model and a tokenizer are no SQL; tests/llm/test_pipeline.py has a brute-force twin
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents`` of ``sf_dir``; the rows of the last one."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        step(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
