"""Structured Streaming entry points.

The reference has no streams.  What carries over is that a *fitted* feature
plan (or template set) is a narrow projection plus stream-static joins with
small level tables, so the same ``transform`` prepares records as they
arrive.  Sinks are idempotent per micro-batch (``foreachBatch`` + overwrite
of the batch's own folder), so a restarted query from its checkpoint does
not duplicate output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import json_text


def read_parquet_stream(spark: SparkSession, path: str, schema, max_files: int = 64) -> DataFrame:
    """File source: new parquet files under ``path`` become micro-batches."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def prepare_stream(fitted, stream: DataFrame) -> DataFrame:
    """Apply a fitted ``FeaturePlan`` / ``FittedTemplates`` to a streaming DataFrame."""
    return fitted.transform(stream)


def parse_replies_stream(stream: DataFrame, text_col: str, out_col: str = "parsed") -> DataFrame:
    """J1 on a stream: the JSON object each reply carries, as VARIANT (NULL if none)."""
    return stream.withColumn(out_col, F.try_parse_json(json_text(F.col(text_col))))


def write_batches(stream: DataFrame, out_path: str, checkpoint: str, available_now: bool = True):
    """Run the stream into ``out_path/batch=<id>`` (overwrite per batch id: idempotent)."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")

    w = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
