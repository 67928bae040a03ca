"""Filter audit: every count against walking each document through each order."""

import collections
import itertools
import re

import duckdb
from pyspark.sql import functions as F

from prepkit.llm import filter_audit as A

SF = "/root/testdata/sf0.001"


def brute(docs, labels):
    marks = collections.defaultdict(lambda: [0, 0])
    for i, q, t in labels:
        marks[i][0] |= q == 1
        marks[i][1] |= t == 1
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    out = collections.Counter()
    first = collections.Counter()
    parts = set()
    for i, t, part in docs:
        t, part = t or "", part or ""
        parts.add(part)
        w = [x for x in re.split(r"[ \t-\r]+", t) if x]
        bad = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
               "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > least[t]}
        good, toxic = marks[i] if i is not None else (0, 0)
        for order in itertools.permutations("ABCDE"):
            gone = False
            for step, c in enumerate(order, 1):
                key = (part, "".join(order), step)
                out[*key, "kept"] += not (gone or bad[c])
                out[*key, "removed"] += not gone and bad[c]
                out[*key, "redundant"] += gone and bad[c]
                out[*key, "unique_fails"] += bad[c] and sum(bad.values()) == 1
                if not gone and bad[c]:
                    out[*key, "good_lost"] += good
                    out[*key, "toxic_lost"] += toxic
                    first[part, c] += 1
                gone |= bad[c]
    rows = set()
    for part in parts:
        for order in itertools.permutations("ABCDE"):
            for step, c in enumerate(order, 1):
                key = (part, "".join(order), step)
                rows.add((*key, *(int(out[*key, x]) for x in A.COUNTS[:-1]), first[part, c]))
    return rows


def test_audit_of_odd_rows(spark):
    many = " ".join(f"w{i}" for i in range(250))
    rows = [(1, None, "a"), (2, "", "a"), (3, " \n\t", None), (4, many, "b"), (4, many, "b"), (5, many, "a"), (6, many + " #", "b"),
            (7, "X" * 500, "b"), (8, "same " * 300, ""), (9, many.upper(), "a"), (None, many, "b"), (None, None, None),
            (10, "x" * 200_000 + " $", "b"), (11, "é" * 99 + "AB", "c"), (12, "same " * 300, "b")]
    marks = [(1, 1, 0), (4, 0, 1), (4, 1, None), (5, 1, 1), (6, None, 1), (None, 1, 1), (8, 1, 0), (12, 0, 0), (99, 1, 1)]
    docs = spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id long, text string, source string, part string, mask int").repartition(3)
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = A.filter_audit(docs, labels)
    assert got.columns == ["part", "filter_order", "step", *A.COUNTS]
    assert {tuple(r) for r in got.collect()} == brute(rows, marks)


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert A.filter_audit(docs, labels).count() == 0
    assert A.filter_audit(docs.union(spark.createDataFrame([(1, "a", "s")], docs.schema)), labels).agg(
        F.sum("removed")).first()[0] == 120


def test_twin(table):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    rel = con.sql(A.oracle_sql())
    got = A.filter_audit(table("documents"), table("labels")).select(*rel.columns)
    assert {tuple(r) for r in got.collect()} == set(rel.fetchall())
