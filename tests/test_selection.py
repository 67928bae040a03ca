"""First rows and NTILE bins by cuts, against sorting the rows."""

import random

import pytest
from pyspark.sql import functions as F

from prepkit.functions import selection as S
from prepkit.operators.balance import random_undersample
from prepkit.operators.model import split
from prepkit.sources import fixtures as FX

from folders import SF01


def bins(n, k):
    q, more = divmod(n, k)
    return [b + 1 for b in range(k) for _ in range(q + (b < more))]


@pytest.mark.parametrize("ids", ["unique", "repeated", "text", "null"])
def test_ntile_with_ties_and_nulls(spark, ids):
    rnd = random.Random(7)
    rows = []
    for i in range(600):
        v = rnd.choice([None, None, 1.0, 1.0, 1.0, 2.0, 3.5, -1.0, rnd.gauss(0, 1)])
        key = {"unique": i * 7 % 600, "repeated": i % 9, "text": f"k{i * 7 % 600:04}", "null": None if i % 50 == 0 else i * 7 % 600}[ids]
        rows.append((v, key, i))
    df = spark.createDataFrame(rows, f"v double, id {'string' if ids == 'text' else 'long'}, other long").repartition(4)
    for k in (1, 4, 10, 37, 700):
        got = {r["other"]: r["b"] for r in S.ntile(df, F.col("v"), ["id", "other"], k, "b").collect()}
        order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] if r[1] is not None else 0, r[2]))
        assert got == {r[2]: b for r, b in zip(order, bins(len(rows), k))}, (ids, k)


def test_ntile_of_few_rows(spark):
    df = spark.createDataFrame([(1.0, 1), (None, 2)], "v double, id long")
    assert {r["id"]: r["b"] for r in S.ntile(df, F.col("v"), ["id"], 5, "b").collect()} == {2: 1, 1: 2}
    assert S.ntile(df.limit(0), F.col("v"), ["id"], 5, "b").count() == 0


def test_mark_first_with_equal_hashes(spark):
    rnd = random.Random(3)
    rows = [(g, rnd.choice([-5, 0, 7, 7, 7, rnd.randrange(-(1 << 62), 1 << 62)]), i) for i in range(900) for g in [rnd.choice(["a", "a", "a", "b", None])]]
    rows += [("one", 5, 1000)]
    df = spark.createDataFrame(rows, "g string, h long, id long").repartition(3)
    got = {r["id"] for r in S.mark_first(df, ["g"], [F.col("h"), F.col("id")], lambda sizes: "round(_size * 0.37D)").where("_in").collect()}
    want = set()
    for g in {r[0] for r in rows}:
        mine = sorted((h, i) for x, h, i in rows if x == g)
        want |= {i for _, i in mine[:int(len(mine) * 0.37 + 0.5)]}
    assert got == want


def test_no_range_exchange_of_rows(spark):
    """B2 and M1 filter the table; nothing but the few rows of a cut may be sorted."""
    d = FX.doc_binary(spark, SF01)
    for df in (random_undersample(d, "target", row_id=["doc_id"]), split(d, "target", row_id=["doc_id"])):
        assert "rangepartitioning" not in df._jdf.queryExecution().executedPlan().toString()


def test_repeated_rows_of_a_class(spark):
    df = spark.createDataFrame([("a", 1)] * 50 + [("b", 2)] * 7 + [(None, 3)] * 4, "c string, x int")
    got = {(r["c"], r["count"]) for r in random_undersample(df, "c").groupBy("c").count().collect()}
    assert got == {("a", 7), ("b", 7)}
