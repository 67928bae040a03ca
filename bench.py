"""Headline benchmark: prints ONE JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query runs once to warm up, then three timed runs; the reported time is
the median.  Execution is forced with the ``noop`` sink (every row computed,
nothing collected).  The optimized-plan hash of each query is reported too.
"""

from __future__ import annotations

import hashlib
import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from prepkit.operators import balance as B  # noqa: E402
from prepkit.operators import bivariate as C  # noqa: E402
from prepkit.operators import neighbours as NB  # noqa: E402
from prepkit.operators.profile import univariate_numerical  # noqa: E402
from prepkit.plans.feature_plan import FeaturePlan  # noqa: E402
from prepkit.session import get_session, ship_package  # noqa: E402
from prepkit.sources import fixtures as FX  # noqa: E402
from prepkit.sources.io import read_table  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))

E6_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_partkey", "l_suppkey"]
PL1 = [
    {"column_name": "l_quantity", "fe_method": "median_imputation"},
    {"column_name": "l_quantity", "fe_method": "standardization"},
    {"column_name": "l_extendedprice", "fe_method": "normalization"},
    {"column_name": "l_returnflag", "fe_method": "mode_imputation"},
    {"column_name": "l_returnflag", "fe_method": "label_encoding"},
    {"column_name": "l_discount", "fe_method": "log_transformation"},
    {"column_name": "l_linestatus", "fe_method": "frequency_encoding"},
    {"column_name": "l_partkey", "fe_method": "hash_encoding"},
]


def q_e6(spark):
    return univariate_numerical(read_table(spark, SF_DIR, "lineitem"), E6_COLS)


def q_pl1(spark):
    df = FX.li_nulls(spark, SF_DIR)
    return FeaturePlan(PL1, target_column="l_linenumber").fit(df).transform(df)


def q_b1(spark):
    li = read_table(spark, SF_DIR, "lineitem")
    return B.random_oversample(li, "l_returnflag")


def q_b2(spark):
    li = read_table(spark, SF_DIR, "lineitem")
    return B.random_undersample(li, "l_returnflag")


def q_b2_many(spark):
    return B.random_undersample(read_table(spark, SF_DIR, "orders"), "o_custkey", row_id=["o_orderkey"])


def q_b3(spark):
    """SMOTE on a skewed binary target: 1 of about 28 rows."""
    li = read_table(spark, SF_DIR, "lineitem").select(
        "l_orderkey", "l_quantity", "l_extendedprice", (F.col("l_linenumber") == 7).cast("int").alias("y"))
    return NB.smote(li, "y", row_id=["l_orderkey"])


def q_c7(spark):
    li = read_table(spark, SF_DIR, "lineitem")
    return C.chi_square(li, "l_returnflag", ["l_linestatus", "l_linenumber", "l_discount", "l_tax"])


QUERIES = {"e6_univariate_numerical": q_e6, "pl1_feature_plan": q_pl1,
           "b1_random_oversample_lineitem": q_b1, "b2_random_undersample_lineitem": q_b2,
           "b2_random_undersample_many_classes": q_b2_many, "c7_chi_square": q_c7}
if os.environ.get("BENCH_B3"):      # four runs of it take minutes
    QUERIES["b3_smote_lineitem"] = q_b3


def plan_hash(df) -> str:
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return hashlib.md5(plan.encode()).hexdigest()[:12]


def main():
    spark = get_session("prepkit-bench", master=f"local[{CPUS}]", shuffle_partitions=int(CPUS) * 2)
    ship_package(spark)
    times, plans = {}, {}
    for name, fn in QUERIES.items():
        runs = []
        for i in range(RUNS + 1):
            t0 = time.perf_counter()
            df = fn(spark)
            df.write.format("noop").mode("overwrite").save()
            dt = time.perf_counter() - t0
            if i > 0:
                runs.append(dt)
            else:
                plans[name] = plan_hash(df)
        times[name] = round(statistics.median(runs), 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_total_median_sec", "value": total, "unit": "sec",
                      "queries": times, "sf": os.path.basename(SF_DIR.rstrip("/")).replace("sf", ""),
                      "cpus": int(CPUS), "plans": plans}))


if __name__ == "__main__":
    main()
