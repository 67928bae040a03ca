"""Filter interaction audit: what each filter removes at each step of each order of five filters.

A document fails a set of filters, its mask.  Everything that is asked depends on the mask alone,
so the documents are counted into cells (part, mask) first.  Then SQL folds over the array of all
orders do the rest inside one cell: ``transform`` walks over the orders, ``aggregate`` folds the
filters of an order and leaves a struct weighted with the cell's counts at each step.  The structs
of the cells of a part are merged by elementwise sums.

The array of orders (120 arrays of five) is a constant of the plan, so every task has it; texts
are read once and never shuffled, only a digest of 32 bytes for the test on identical texts.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the filters by letter, their limits and the characters they look at
FILTERS = "ABCDE"
LEAST_WORDS = 200
DISTINCT_SHARE = 50
UPPER_SHARE = 2
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#$%&*|]"

ORDERS = list(permutations(range(len(FILTERS))))
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
_COPY = 1 << FILTERS.index("E")


def _bit(letter: str, fails: Column) -> Column:
    return F.when(fails, 1 << FILTERS.index(letter)).otherwise(0)


def text_mask(text: Column) -> Column:
    """The filters A to D that a text (not null) fails, as an int of bits."""
    words = F.array_remove(F.split(text, SPACES), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    upper = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return (_bit("A", n < LEAST_WORDS) + _bit("B", 100 * distinct < DISTINCT_SHARE * n)
            + _bit("C", F.lit(100).cast("long") * upper > F.lit(UPPER_SHARE).cast("long") * F.length(text))
            + _bit("D", text.rlike(SYMBOLS)))


def _marked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, digest, part, mask (A to D), n, good, toxic: equal rows counted together, checkpointed."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["source"].cast("string"), F.lit("")).alias("part"),
                       text_mask(text).alias("mask"), F.unhex(F.sha2(text, 256)).alias("digest"))
    rows = rows.groupBy("doc_id", "digest", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    marks = labels.select(labels["doc_id"].cast("long").alias("at"), (labels["quality"] == 1).alias("good"),
                          (labels["toxic"] == 1).alias("toxic")).where("at is not null")
    marks = marks.groupBy("at").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic")).withColumn("known", F.lit(True))
    # rows without an id find no label; they are dealt by their texts, not to one task
    rows = rows.withColumn("known", F.col("doc_id").isNotNull()).withColumn("at", F.coalesce("doc_id", F.xxhash64("digest")))
    return rows.join(marks, ["at", "known"], "left").select(
        "doc_id", "digest", "part", "mask", "n", F.coalesce(F.col("good").cast("int"), F.lit(0)).alias("good"),
        F.coalesce(F.col("toxic").cast("int"), F.lit(0)).alias("toxic")).checkpoint()


def mask_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): how many documents of a part fail exactly the filters of ``mask``."""
    rows = _marked(docs, labels)
    least = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    # the join is on the id too, so the copies of one text do not meet in one task
    first = rows.join(least, ["digest", "doc_id"], "left_semi").union(rows.where("doc_id is null").select(
        "digest", "doc_id", *[c for c in rows.columns if c not in ("digest", "doc_id")]))

    def weighed(df: DataFrame, mask: Column, sign: int) -> DataFrame:
        return df.select("part", mask.alias("mask"), (sign * F.col("n")).alias("n"), (sign * F.col("n") * F.col("good")).alias("good"),
                         (sign * F.col("n") * F.col("toxic")).alias("toxic"))

    # all rows count as copies, then the first of each text move to the cell without E
    copy, alone = F.col("mask").bitwiseOR(F.lit(_COPY)), F.col("mask")
    moved = weighed(rows, copy, 1).union(weighed(first, copy, -1)).union(weighed(first, alone, 1))
    return moved.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")]).where("n > 0")


def _fails(f: Column) -> Column:
    return F.col("mask").bitwiseAND(F.call_function("shiftleft", F.lit(1), f)) != 0


def _steps(order: Column) -> Column:
    """One struct a filter of the order, weighted with the counts of the cell."""
    n, good, toxic = F.col("n"), F.col("good"), F.col("toxic")
    none = F.lit(0).cast("long")

    def step(acc: Column, f: Column) -> Column:
        gone, fails = acc["gone"], _fails(f)
        out = ~gone & fails
        only = F.col("mask") == F.call_function("shiftleft", F.lit(1), f)
        here = F.struct(F.when(~gone & ~fails, n).otherwise(none).alias("kept"), F.when(out, n).otherwise(none).alias("removed"),
                        F.when(gone & fails, n).otherwise(none).alias("redundant"), F.when(only, n).otherwise(none).alias("unique_fails"),
                        F.when(out, good).otherwise(none).alias("good_lost"), F.when(out, toxic).otherwise(none).alias("toxic_lost"),
                        (n * F.element_at(F.col("first_fails"), f + 1)).alias("shapley"))
        return F.struct((gone | fails).alias("gone"), F.concat(acc["steps"], F.array(here)).alias("steps"))

    empty = F.expr("cast(array() as array<struct<" + ", ".join(f"{c}: bigint" for c in COUNTS) + ">>)")
    return F.aggregate(order, F.struct(F.lit(False).alias("gone"), empty.alias("steps")), step, lambda acc: acc["steps"])


def audit(cells: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic) -> one row per part, order and step with its counts."""
    orders = F.lit([list(o) for o in ORDERS])
    # per filter the number of orders in which it is the first that the cell fails
    first = F.transform(orders, lambda o: F.aggregate(
        o, F.lit(-1), lambda found, f: F.when((found < 0) & _fails(f), f).otherwise(found)))
    cells = cells.withColumn("first_of", first).withColumn("first_fails", F.transform(
        F.sequence(F.lit(0), F.lit(len(FILTERS) - 1)), lambda f: F.size(F.filter("first_of", lambda x: x == f)).cast("long")))
    steps = cells.select("part", F.posexplode(F.flatten(F.transform(orders, _steps))).alias("place", "s"))
    sums = steps.groupBy("part", "place").agg(*[F.sum(f"s.{c}").alias(c) for c in COUNTS])
    names = F.lit(["".join(FILTERS[f] for f in o) for o in ORDERS])
    k = len(FILTERS)
    return sums.select("part", F.element_at(names, F.floor(F.col("place") / k).cast("int") + 1).alias("filter_order"),
                       (F.col("place") % k + 1).cast("int").alias("step"), *COUNTS)


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """documents(doc_id, text, source), labels(doc_id, quality, toxic) -> one row per part, order and step.

    part, filter_order string, step int, and the long counts ``COUNTS`` of the documents of the part.
    A null text counts as empty, and equals every empty one; a null source is the part ''.  Of equal
    texts those with the least doc_id pass E, all of them if that id stands in several rows; a row
    with a null doc_id passes E, makes no other fail it and has no label.  A document is good
    (toxic) if any row of its id in ``labels`` says 1.  Repeated rows count each.  Empty documents
    give no rows.  Other columns are ignored.
    """
    return audit(mask_cells(docs, labels))


def oracle_sql() -> str:
    """The same rows in DuckDB: each document against each order, without cells or folds."""
    return rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, map {{
    'A': len(w) < {LEAST_WORDS}, 'B': 100 * len(list_distinct(w)) < {DISTINCT_SHARE} * len(w),
    'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {UPPER_SHARE} * length(t),
    'D': regexp_matches(t, '{SYMBOLS}'),
    'E': coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false)}} AS fails
  FROM d LEFT JOIN l ON l.doc_id = d.doc_id),
p AS (
  SELECT '' AS filter_order UNION ALL
  SELECT filter_order || c FROM p, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c) AS x WHERE NOT contains(filter_order, c)),
o AS (SELECT filter_order FROM p WHERE length(filter_order) = 5),
m AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
s AS (
  SELECT part, filter_order, step, filter_order[step] AS c, n, good, toxic, fails[filter_order[step]] AS bad,
         len(list_filter(range(1, step), lambda i: fails[filter_order[i]])) > 0 AS gone,
         len(list_filter(map_values(fails), lambda x: x)) = 1 AS lone
  FROM m, o, (SELECT unnest(range(1, 6)) AS step) AS x),
g AS (
  SELECT part, filter_order, step, c, sum(CASE WHEN NOT gone AND NOT bad THEN n ELSE 0 END)::BIGINT AS kept,
         sum(CASE WHEN NOT gone AND bad THEN n ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN gone AND bad THEN n ELSE 0 END)::BIGINT AS redundant,
         sum(CASE WHEN bad AND lone THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN NOT gone AND bad THEN good ELSE 0 END)::BIGINT AS good_lost,
         sum(CASE WHEN NOT gone AND bad THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM s GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, c))::BIGINT AS shapley FROM g"""
