"""A fitted plan prepares a file stream exactly like the batch table."""

import os
import tempfile

from prepkit.plans.feature_plan import FeaturePlan
from prepkit.sources import fixtures as FX
from prepkit.streaming.scoring import prepare_stream, read_parquet_stream, write_batches

from folders import SF

PLAN = [{"column_name": "l_quantity", "fe_method": "median_imputation"},
        {"column_name": "l_quantity", "fe_method": "standardization"},
        {"column_name": "l_returnflag", "fe_method": "mode_imputation"},
        {"column_name": "l_returnflag", "fe_method": "frequency_encoding"}]


def test_plan_on_stream(spark):
    df = FX.li_nulls(spark, SF)
    fitted = FeaturePlan(PLAN, target_column="l_linenumber").fit(df)
    batch = sorted(tuple(r) for r in fitted.transform(df).collect())
    src = tempfile.mkdtemp(prefix="prepkit-src-", dir="/tmp")
    os.symlink(f"{SF}/lineitem.parquet", f"{src}/part-0.parquet")
    stream = read_parquet_stream(spark, src, spark.read.parquet(f"{SF}/lineitem.parquet").schema)
    from pyspark.sql import functions as F
    stream = stream.withColumns({
        "l_quantity": F.when(F.col("l_orderkey") % 10 == 0, F.lit(None)).otherwise(F.col("l_quantity")),
        "l_returnflag": F.when(F.col("l_orderkey") % 7 == 0, F.lit(None)).otherwise(F.col("l_returnflag"))})
    out = tempfile.mkdtemp(prefix="prepkit-stream-", dir="/tmp")
    q = write_batches(prepare_stream(fitted, stream), f"{out}/data", f"{out}/ckpt")
    q.awaitTermination(120)
    got = sorted(tuple(r) for r in spark.read.parquet(f"{out}/data").select(*fitted.transform(df).columns).collect())
    assert got == batch
