"""First rows of a group and NTILE bins by cuts, without sorting or moving the rows.

The value at a wanted rank comes from a radix histogram (``radix.py``).  Rows before the cut are in,
rows after it are out; only rows that equal the cut are ordered further, and only where the cut goes
through them.  What is left of a plan is a filter on the table as it was scanned.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .numbering import join_null_safe, rank_within_group, small_side
from .radix import histogram, rank_values


def mark_first(df: DataFrame, group: list[str], order: list[Column], want: Callable[[DataFrame], str], name: str = "_in") -> DataFrame:
    """``df`` with the boolean ``name``: whether a row is among the first rows of its group.

    order: a total order whose first column is a bigint that is seldom equal (a hash).  ``want`` gets
    the table (group, _size) of all groups and gives SQL text for the number of rows wanted of a group
    of _size rows.  Groups may be as many as there are rows; a NULL group is a group."""
    rows = df.withColumn("_h", order[0])
    narrow = rows.select(*group, "_h")
    hist = histogram(narrow, group, "_h", whole=True)
    sizes = hist.groupBy(*group).agg(F.expr("sum(_count) as _size"))
    names = [f"`{g}`" for g in group]
    wants = sizes.selectExpr(*names, "_size", f"bigint({want(sizes)}) as _want").checkpoint()
    cuts = rank_values(narrow, group, wants.where("_want > 0 and _want < _size").selectExpr(*names, "_want - 1 as rank"), "_h", hist, whole=True)
    side = join_null_safe(wants, cuts.selectExpr(*names, "_value as _cut", "_below", "_count"), group, "left").selectExpr(
        *names, "_want >= _size as _all", "_cut", "_want - _below as _need", "_count as _same").checkpoint()
    state = ("case when _all then true when _cut is null or _h > _cut then false when _h < _cut or _need = _same then true end")
    marked = join_null_safe(rows, small_side(side), group).withColumn(name, F.expr(state))
    keep = [*df.columns, name]
    if not side.where("_need < _same").limit(1).count():
        return marked.select(*keep)
    tied = rank_within_group(marked.where(F.col(name).isNull()), group, order[1:] or [F.lit(0)], name="_place")
    return marked.where(F.col(name).isNotNull()).select(*keep).unionByName(
        tied.withColumn(name, F.col("_place") <= F.col("_need")).select(*keep))


def _starts(n: int, k: int) -> list[int]:
    """0-based rank of the first row of bins 2 to k of NTILE(k) over n rows; bins without rows are left out."""
    q, more = divmod(n, k)
    return [s for b in range(1, k) if (s := b * q + min(b, more)) < n]


def ntile(df: DataFrame, value: Column, order_by: list[str], k: int, name: str) -> DataFrame:
    """``df`` with ``name`` = NTILE(k) OVER (ORDER BY value NULLS FIRST, order_by): k - 1 cuts at most.

    Where a cut goes through equal values they are cut again by the first column of ``order_by`` if
    it is an integer, and numbered among themselves where that is equal (or no integer) too."""
    rows = df.withColumn("_v", value.cast("double")).withColumn("_g", F.lit(0))
    n, nulls = rows.agg(F.count(F.lit(1)), F.count_if(F.col("_v").isNull())).first()
    spark = df.sparkSession
    starts = _starts(n, k)
    # of each cut: the value (None: NULL) and how many rows of that value stand before it
    cuts = [(None, s) for s in starts if s < nulls]
    ranks = spark.createDataFrame([(0, s - nulls) for s in starts if s >= nulls], "_g int, rank long")
    cuts += [(r["_value"], r["_rank"] - r["_below"]) for r in rank_values(rows, ["_g"], ranks, "_v").orderBy("_rank").collect()]
    inner = {c for c in cuts if c[1]}
    tied_values = sorted({v for v, _ in inner}, key=lambda v: (v is not None, v))
    by, second = F.col(order_by[0]), {}
    if inner and isinstance(df.schema[order_by[0]].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        ties = rows.where(F.col("_v").isin([v for v in tied_values if v is not None]) | (F.col("_v").isNull() & F.lit(None in tied_values)))
        asked = spark.createDataFrame(sorted(inner, key=str), "_v double, rank long")
        for r in rank_values(ties.where(by.isNotNull()), ["_v"], asked, order_by[0], whole=True).collect():
            second[r["_v"], r["_rank"]] = r["_value"], r["_rank"] - r["_below"]
        if ties.where(by.isNull()).limit(1).count():        # a missing id has no place among integers
            second = {}
    # (value, id) that a cut goes through: those rows alone are numbered
    split = {(v, second[v, t][0]) if (v, t) in second else (v, None) for v, t in inner if second.get((v, t), (0, 1))[1]}

    def plain(x, kind: str) -> str:
        return f"cast('{x!r}' as {kind})" if x is not None else f"cast(null as {kind})"

    listed = []
    for v, t in cuts:
        i, u = second.get((v, t), (None, t))
        listed.append(f"struct({plain(v, 'double')} as v, {plain(t, 'bigint')} as t, {plain(i, 'bigint')} as i, {plain(u, 'bigint')} as u)")
    # a row counts the cuts that it stands at or after
    number = f"""1 + size(filter(array({", ".join(listed)}), c -> if(c.v is null, _v is not null, _v > c.v) or (_v <=> c.v and
        (c.t = 0 or (c.i is null and _at >= c.t) or _id > c.i or (_id = c.i and (c.u = 0 or _at >= c.u))))))""" if cuts else "1"

    def binned(part: DataFrame, at: Column) -> DataFrame:
        part = part.withColumns({"_at": at.cast("long"), "_id": by if second else F.lit(None).cast("long")})
        return part.withColumn(name, F.expr(number).cast("int")).select(*df.columns, name)

    if not split:
        return binned(rows, F.lit(None))
    through = F.lit(False)
    for v in sorted({v for v, _ in split}, key=str):
        ids = [i for x, i in split if x == v and i is not None]
        through = through | (F.col("_v").eqNullSafe(F.lit(v).cast("double")) & (by.isin(ids) if ids else F.lit(True)))
    numbered = rank_within_group(rows.where(through).withColumn("_i", by if second else F.lit(0)), ["_v", "_i"],
                                 [F.col(o) for o in order_by], name="_place")
    return binned(rows.where(~through), F.lit(None)).unionByName(binned(numbered, F.col("_place") - 1))
