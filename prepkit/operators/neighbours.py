"""Exact nearest neighbours as Spark jobs, and what is built on them (B3 SMOTE, B4 SMOTENC, B5 ADASYN, knn).

The rows of a group make a tree: a cell of more than ``BLOCK`` rows is split by pivots, a
few of its rows, each row going to the nearest one; its parts are split again until all are
small (or hold one point only).  Every cell knows the distance of its farthest row to its pivot.
A query goes down to its own leaf and searches that; the distance of its k-th neighbour
there, and that to the far side of the smallest cell around it with enough rows, bound
where better ones can be.  Then it walks down the tree once more, level by level as joins, into
cells with ``distance to the pivot - radius <= bound`` only (the triangle inequality).  Leaves
and the queries of a leaf are cut into blocks, so no task holds more than ``BLOCK`` rows
against ``QUERIES`` queries, however many points are equal; every block returns a partial
top-k.  Ties go to the smaller row number.  Nothing is approximate: on data that pivots cannot
separate, more cells are searched.  The tree is a table; nothing of it reaches the driver.

The distance is the Euclidean one over the numeric features plus ``penalty**2`` for each
differing category (which is Euclidean too, so the triangle inequality holds).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clean_value, hash_bigint, is_numeric
from ..functions.numbering import global_row_number, small_side
from ..session import ensure_checkpoint_dir
from .balance import _TWO60, _draws, _order, _ranked, _with_salts, class_table

BLOCK = 4000        # rows of a cell that one task searches; larger cells are split
QUERIES = 4000      # queries that one task answers
CHUNK = 1 << 15     # distances that a task has at once, so that they stay in the processor's cache
FAN = 32            # parts of a cell, at most
DEPTH = 11          # levels, at most: cell numbers fit a long, and 2000 * 16^11 rows do too
#: relative slack of the bound, so that rounding never hides a cell
SLACK = 1e-9

POINT = "g string, _n bigint, x array<double>, c array<bigint>"


def points(df: DataFrame, num: list[str], cats: list[str], group: str | None) -> DataFrame:
    """(g, _n, x, c) of the numbered rows without missing numeric features."""
    x = F.array(*[clean_value(df, c).cast("double") for c in num]) if num else F.array().cast("array<double>")
    c = (F.array(*[F.coalesce(F.xxhash64(F.col(k)), F.lit(0)) for k in cats]) if cats else F.array()).cast("array<bigint>")
    g = F.col(group).cast("string") if group else F.lit("")
    return df.select(g.alias("g"), "_n", x.alias("x"), c.alias("c")).where(~F.exists("x", lambda v: v.isNull()))


def _matrix(column: pa.Array, dtype) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype)
    return flat.reshape(rows, -1) if rows else np.zeros((0, 0), dtype)


def squared(x: np.ndarray, c: np.ndarray, y: np.ndarray, d: np.ndarray, penalty: float) -> np.ndarray:
    """Squared distances of all rows (x, c) to all rows (y, d), summed feature by feature."""
    out, one = np.zeros((len(x), len(y))), np.empty((len(x), len(y)))
    for f in range(x.shape[1]):
        np.subtract.outer(x[:, f], y[:, f], out=one)
        out += np.square(one, out=one)
    for f in range(c.shape[1]):
        out += np.multiply(np.not_equal.outer(c[:, f], d[:, f]), penalty ** 2, out=one)
    return out


def _square(kids: DataFrame, point: str, penalty: float) -> str:
    """SQL text: squared distance of the row's (x, c) to those of ``point``, one of ``kids``.

    All points have as many features, so the sum is written out: nothing is allocated for a distance."""
    first = kids.selectExpr("size(kids[0].x) as x", "size(kids[0].c) as c").first() or {"x": 0, "c": 0}
    far = [f"(x[{i}] - {point}.x[{i}]) * (x[{i}] - {point}.x[{i}])" for i in range(first["x"])]
    other = [f"if(c[{i}] <> {point}.c[{i}], 1, 0)" for i in range(first["c"])]
    return " + ".join(far or ["0D"]) + (f" + {penalty * penalty!r}D * ({' + '.join(other)})" if other else "")


def _at_nearest(rows: DataFrame, kids: DataFrame, penalty: float) -> DataFrame:
    """Rows with ``kids`` of their cell, the nearest of them (``_i``, from 0; ties: the first) and its distance ``_far``.

    All three are NULL in cells that are not split."""
    d2 = F.expr(f"transform(kids, p -> {_square(kids, 'p', penalty)})")
    return (rows.join(small_side(kids.select("g", "cell", "kids")), ["g", "cell"], "left").withColumn("_d2", d2)
            .withColumn("_least", F.array_min("_d2"))
            .withColumns({"_i": F.expr("int(array_position(_d2, _least)) - 1"), "_far": F.sqrt("_least")}))


def _down(rows: DataFrame, kids: DataFrame, penalty: float) -> DataFrame:
    """Rows one level down: ``cell`` is the nearest part (ties: the first), ``far`` the distance to its pivot.

    Rows of cells that are not split stay where they are."""
    keep = [c for c in rows.columns if c not in ("cell", "far")]
    return _at_nearest(rows, kids, penalty).select(*keep, F.expr(f"if(_i is null, cell, cell * {FAN + 1} + _i + 1)").alias("cell"),
                                                   F.coalesce("_far", "far").alias("far"))


def _tree(base: DataFrame, penalty: float, k: int | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """(rows with their leaf ``cell``, per level the split cells (g, cell, kids)), all checkpointed.

    kids: array of (x, c, radius, n) of the parts in their order; ``n`` 0 for a part without rows.
    With ``k`` the rows have their ``reach`` too (see ``_own_leaves``), from the distances that dealt them out."""
    rows = base.withColumns({"cell": F.lit(0).cast("long"), "far": F.lit(float("inf"))} | (
        {"reach": F.lit(float("inf"))} if k is not None else {})).checkpoint(eager=True)
    levels = []
    size = rows.groupBy("g", "cell").agg(F.max("far").alias("radius"), F.count(F.lit(1)).alias("n")).checkpoint(eager=True)
    for level in range(DEPTH):
        big = size.where((F.col("n") > BLOCK) & (F.col("radius") > 0)).select("g", "cell", "n")
        if not big.limit(1).count():
            break
        parts = F.least(F.lit(FAN), F.ceil(F.col("n") * 2 / BLOCK))
        # a hash picks about four times as many rows as are wanted, so a window over them is small
        h = F.xxhash64("_n", F.lit(level))
        some = rows.join(small_side(big), ["g", "cell"]).where(F.pmod(h, F.col("n")) < 4 * parts)
        some = some.withColumn("_k", F.row_number().over(Window.partitionBy("g", "cell").orderBy(h, "_n"))).where(F.col("_k") <= parts)
        pivots = some.groupBy("g", "cell").agg(F.sort_array(F.collect_list(F.struct("_k", "x", "c"))).alias("kids")).checkpoint(eager=True)
        rows = _down(rows, pivots, penalty).checkpoint(eager=True)
        size = rows.groupBy("g", "cell").agg(F.max("far").alias("radius"), F.count(F.lit(1)).alias("n")).checkpoint(eager=True)
        if k is not None:
            rows = rows.join(small_side(size), ["g", "cell"]).withColumn(
                "reach", F.least("reach", F.when(F.col("n") > k, F.col("far") + F.col("radius")))).select(*rows.columns)
        each = pivots.select("g", F.col("cell").alias("up"), F.posexplode("kids").alias("i", "p")).withColumn(
            "cell", F.col("up") * (FAN + 1) + F.col("i") + 1)
        each = each.join(size, ["g", "cell"], "left").groupBy("g", F.col("up").alias("cell")).agg(F.sort_array(F.collect_list(F.struct(
            "i", "p.x", "p.c", F.coalesce("radius", F.lit(0.0)).alias("radius"), F.coalesce("n", F.lit(0)).alias("n")))).alias("kids"))
        levels.append(each.checkpoint(eager=True))
    return rows, levels


def _visits(queries: DataFrame, levels: list[DataFrame], penalty: float) -> DataFrame:
    """(g, _n, x, c, cell) of the leaves besides the own one that can hold a neighbour within ``bound``."""
    at = queries.select("g", "_n", "x", "c", "bound", F.col("cell").alias("own"), F.lit(0).cast("long").alias("cell"))
    for kids in levels:
        parts = kids.select(F.col("g").alias("in_g"), F.col("cell").alias("in_cell"), F.posexplode("kids").alias("i", "p")).where("p.n > 0")
        near = (f"g = in_g and cell = in_cell and (sqrt({_square(kids, 'p', penalty)}) - p.radius) * {1 - SLACK!r}D "
                f"<= bound * {1 + SLACK!r}D")
        down = at.join(small_side(parts), F.expr(near)).withColumn("cell", F.expr(f"cell * {FAN + 1} + i + 1")).select(*at.columns)
        leaves = at.join(small_side(kids.select("g", "cell")), ["g", "cell"], "left_anti").select(*at.columns)
        at = down.union(leaves).checkpoint(eager=True)
    return at.where("cell <> own").select("g", "_n", "x", "c", "cell")


def _own_leaves(queries: DataFrame, levels: list[DataFrame], k: int, penalty: float) -> DataFrame:
    """Queries with their leaf and ``reach``: within it there are k other rows for certain (infinity if unknown)."""
    at = queries.withColumns({"cell": F.lit(0).cast("long"), "reach": F.lit(float("inf"))})
    for kids in levels:
        far = f"if(kids[_i].n > {k}, _far + kids[_i].radius, double('inf'))"
        at = _at_nearest(at, kids, penalty).select(
            "g", "_n", "x", "c", F.expr(f"if(_i is null, cell, cell * {FAN + 1} + _i + 1)").alias("cell"),
            F.expr(f"if(_i is null, reach, least(reach, {far}))").alias("reach"))
    return at.checkpoint(eager=True)


def block_nearest(queries: pa.Table, rows: pa.Table, k: int, penalty: float) -> pa.Table:
    """(_n, other, d2): the k nearest of ``rows`` for each of ``queries``, ``CHUNK`` distances at a time."""
    out = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
    if queries.num_rows and rows.num_rows:
        rows = rows.sort_by("_n")       # the first of equal distances is that of the smallest number
        ids, own = rows.column("_n").to_numpy(), queries.column("_n").to_numpy()
        x, c = _matrix(queries.column("x"), float), _matrix(queries.column("c"), np.int64)
        # feature by feature in memory
        y, d = (np.asfortranarray(m) for m in (_matrix(rows.column("x"), float), _matrix(rows.column("c"), np.int64)))
        step = max(1, CHUNK // len(ids))
        for at in range(0, len(own), step):
            mine = own[at:at + step]
            d2 = squared(x[at:at + step], c[at:at + step], y, d, penalty)
            np.fmin(d2, np.inf, out=d2)     # what is no number is no neighbour
            # rows with the number of the query, which may stand there more than once
            here, end = np.searchsorted(ids, mine), np.searchsorted(ids, mine, "right")
            while (same := np.flatnonzero(here < end)).size:
                d2[same, here[same]] = np.inf
                here += 1
            each = np.arange(len(mine))
            for _ in range(min(k, len(ids))):
                best = d2.argmin(axis=1)
                found = d2[each, best]
                good = np.isfinite(found)
                if not good.any():
                    break
                for column, values in zip(out, (mine, ids[best], found)):
                    column.append(values[good])
                d2[each, best] = np.inf
    return pa.table(dict(zip(("_n", "other", "d2"), map(np.concatenate, out))))


def _searched(visits: DataFrame, base: DataFrame, k: int, penalty: float) -> DataFrame:
    """Partial top-k (_n, other, d2) of every visit among the rows of its cell, block by block."""
    cells = base.groupBy("g", "cell").agg((1 + F.floor(F.count(F.lit(1)) / BLOCK)).cast("int").alias("blocks"))
    asked = visits.groupBy("g", "cell").agg((1 + F.floor(F.count(F.lit(1)) / QUERIES)).cast("int").alias("parts"))
    plan = cells.join(asked, ["g", "cell"]).checkpoint(eager=True)
    side = small_side(plan)
    left = (visits.join(side, ["g", "cell"])
            .withColumn("part", F.pmod(F.xxhash64("_n"), "parts").cast("int"))
            .withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)")))
            # names of its own, since queries and rows may be one table
            .select(*[F.col(n).alias(n) for n in ("g", "cell", "part", "block", "_n", "x", "c")]))
    right = (base.join(side, ["g", "cell"])
             .withColumn("block", F.pmod(F.xxhash64("_n"), "blocks").cast("int"))
             .withColumn("part", F.explode(F.expr("sequence(0, parts - 1)")))
             .select("g", "cell", "part", "block", "_n", "x", "c"))

    def search(queries: pa.Table, rows: pa.Table) -> pa.Table:
        return block_nearest(queries, rows, k, penalty)

    keys = ["g", "cell", "part", "block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, "_n bigint, other bigint, d2 double")


def nearest(queries: DataFrame, base: DataFrame, k: int, penalty: float = 0.0) -> DataFrame:
    """(_n, rank, other, d2): the k nearest rows of ``base`` for every row of ``queries``, in the same
    group ``g``, never the row with the same number; fewer where the group has no more."""
    spark = base.sparkSession
    ensure_checkpoint_dir(spark)
    if queries is base:     # the rows know their leaves
        base, levels = _tree(base, penalty, k)
        queries = base
    else:
        base, levels = _tree(base, penalty)
        queries = _own_leaves(queries, levels, k, penalty)
    ranked = Window.partitionBy("_n").orderBy("d2", "other")

    def top(rows: DataFrame) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)

    own = top(_searched(queries, base, k, penalty)).checkpoint(eager=True)
    if not levels:
        return own.select("_n", F.col("rank").cast("int").alias("rank"), "other", "d2")
    bound = own.where(F.col("rank") == k).select("_n", F.sqrt("d2").alias("bound"))
    open_ = queries.join(bound, "_n", "left").withColumn("bound", F.least(F.coalesce("bound", F.lit(float("inf"))), "reach"))
    visits = _visits(open_, levels, penalty)
    both = own.select("_n", "other", "d2").union(_searched(visits, base, k, penalty))
    return top(both).select("_n", F.col("rank").cast("int").alias("rank"), "other", "d2")


# --- synthetic rows ----------------------------------------------------------------


def _numbered(df: DataFrame, t: str, row_id: list[str] | None) -> DataFrame:
    """Rows with a target, ``_n`` in the order of the row id."""
    base = df.where(clean_value(df, t).isNotNull())
    return global_row_number(base, list(row_id) if row_id else _order(base, None, 0), name="_n")


def _features(df: DataFrame, t: str, row_id: list[str] | None, features: list[str] | None,
              cats: list[str]) -> list[str]:
    if features is None:
        features = [c for c in df.columns if c not in (t, *(row_id or []), *cats) and is_numeric(df, c)]
    if not features and not cats:
        raise ValueError("no features to measure distances with")
    return features


def _with_neighbours(rows: DataFrame, near: DataFrame, features: list[str], modes: DataFrame | None, t: str) -> DataFrame:
    """(_n, _t, _a0.., _near, modes): every row with the features of its neighbours in the order of their ranks.

    Draws are attached to this one table only, under salts, so a row of very many draws is no hot key."""
    other = rows.select(F.col("_n").alias("other"), F.array(*[F.col(c).cast("double") for c in features]).cast("array<double>").alias("b"))
    around = near.join(other, "other").groupBy("_n").agg(F.sort_array(F.collect_list(F.struct("rank", "b"))).alias("_near"))
    mine = rows.select("_n", F.col(t).alias("_t"), *[F.col(c).cast("double").alias(f"_a{i}") for i, c in enumerate(features)])
    mine = mine.join(around, "_n", "left")
    return mine if modes is None else mine.join(modes, "_n", "left")


def _synthetic(df: DataFrame, draws: DataFrame, features: list[str], cats: list[str], t: str, round_ints: bool) -> DataFrame:
    """One row per draw (a row of ``_with_neighbours``, _nn, _u): base + u * (neighbour - base); columns that are
    no feature are NULL, and so is everything drawn from a row that is missing."""
    types = {f.name: f.dataType for f in df.schema.fields}
    made = draws.withColumn("_to", F.get("_near", F.pmod("_nn", F.greatest(F.size("_near"), F.lit(1))).cast("int"))["b"])
    out = []
    for c in df.columns:
        if c == t:
            out.append(F.col("_t").cast(types[c]).alias(c))
        elif c in features:
            i = features.index(c)
            v = F.col(f"_a{i}") + F.col("_u") * (F.coalesce(F.col("_to")[i], F.col(f"_a{i}")) - F.col(f"_a{i}"))
            whole = types[c].typeName() in ("long", "integer", "short", "byte")
            out.append((F.rint(v).cast(types[c]) if whole and round_ints else v).alias(c))
        elif c in cats:
            out.append(F.col(f"_mode_{c}").alias(c))
        else:
            out.append(F.lit(None).cast(types[c]).alias(c))
    return made.select(*out)


def _interpolated(df: DataFrame, t: str, row_id: list[str] | None, features: list[str] | None, cats: list[str],
                  k: int, seed: int, round_ints: bool) -> DataFrame:
    features = _features(df, t, row_id, features, cats)
    rows = _numbered(df, t, row_id)
    counts = class_table(rows, t)
    span = counts.agg(F.max("n"), F.min("n"), F.count(F.lit(1))).first()
    original = rows.select(*df.columns)
    if not round_ints:
        original = original.withColumns({c: F.col(c).cast("double") for c in features})
    if not span[0] or span[2] < 2:
        return original
    penalty = 0.0
    if cats:
        k = max(1, min(k, span[1] - 1))
        smallest = counts.orderBy("n", t).first()[t]
        spread = rows.where(F.col(t) == F.lit(smallest)).agg(*[F.stddev_pop(clean_value(rows, c).cast("double")) for c in features]).first() \
            if features else [0.0]
        penalty = float(np.median([s or 0.0 for s in spread]))
    needs = counts.withColumn("k", F.lit(span[0]) - F.col("n")).where("k > 0")
    minority = rows.join(small_side(needs.select(t)), t, "left_semi").checkpoint(eager=True)
    mine = points(minority, features, cats, t)
    near = nearest(mine, mine, k, penalty).checkpoint(eager=True)
    places = _ranked(minority, [t], _order(minority.select(*df.columns), row_id, seed), "_pick").select(t, "_pick", "_n")
    modes = None
    if cats:
        pairs = near.join(minority.select(F.col("_n").alias("other"), *cats), "other")
        modes = pairs.groupBy("_n").agg(*[F.mode(c, True).alias(f"_mode_{c}") for c in cats])
    needs = _with_salts(needs.select(t, "n", "k")).checkpoint(eager=True)
    copies = (places.join(_with_neighbours(minority, near, features, modes, t), "_n").join(small_side(needs.select(t, "_salts")), t)
              .withColumn("_salt", F.explode(F.expr("sequence(0, _salts - 1)"))).drop("_salts"))
    draws = _draws(needs, t, seed).join(copies, [t, "_pick", "_salt"]).withColumns({"_nn": _nn(F.col(t), seed), "_u": _u(F.col(t), seed)})
    return original.unionByName(_synthetic(df, draws, features, cats, t, round_ints))


def _nn(key, seed: int):
    """Which neighbour draw ``_j`` takes, modulo the number there are."""
    return hash_bigint(key, F.col("_j"), F.lit(seed), F.lit("nn"))


def _u(key, seed: int):
    return hash_bigint(key, F.col("_j"), F.lit(seed), F.lit("u")).cast("double") / F.lit(_TWO60)


def smote(df: DataFrame, t: str, row_id: list[str] | None = None, features: list[str] | None = None, k: int = 5,
          seed: int = 42) -> DataFrame:
    """Every minority class topped up to the majority with rows between a row and one of its k
    nearest rows of the class.  Integer features are rounded; a row id is NULL in new rows; a
    class of one row is repeated."""
    return _interpolated(df, t, row_id, features, [], k, seed, True)


def smotenc(df: DataFrame, t: str, row_id: list[str] | None = None, cats: list[str] | None = None,
            features: list[str] | None = None, k: int = 5, seed: int = 42) -> DataFrame:
    """SMOTE with categories: a differing category adds the squared median spread of the numeric
    features of the smallest class, and a new row has the most frequent category among the neighbours
    (ties: the smallest).  Numeric features are double in the result."""
    if cats is None:
        from .balance import category_columns
        cats = category_columns(df, t)
    cats = [c for c in cats if c != t]
    return _interpolated(df, t, row_id, features, cats, k, seed, False)


def adasyn(df: DataFrame, t: str, row_id: list[str] | None = None, features: list[str] | None = None, k: int = 5,
           seed: int = 42) -> DataFrame:
    """Like SMOTE, but a minority row gets new rows in proportion to the share of other classes among
    its k nearest rows of the whole table."""
    features = _features(df, t, row_id, features, [])
    rows = _numbered(df, t, row_id).checkpoint(eager=True)
    counts = class_table(rows, t)
    most = counts.agg(F.max("n")).first()[0]
    if most is None:
        return rows.select(*df.columns)
    needs = counts.withColumn("k", F.lit(most) - F.col("n")).where("k > 0")
    minority = rows.join(small_side(needs.select(t)), t, "left_semi").checkpoint(eager=True)
    share = adasyn_shares(rows, minority, t, features, k).checkpoint(eager=True)
    total = share.groupBy(t).agg(F.sum("r").alias("total"))
    gets = (share.join(small_side(total.join(needs.select(t, "k"), t)), t).where("total > 0")
            .select(t, "_n", F.bround(F.col("r") / F.col("total") * F.col("k")).cast("bigint").alias("times")).where("times > 0"))
    mine = points(minority, features, [], t)
    near = nearest(mine, mine, k).checkpoint(eager=True)
    # times is at most the number of rows missing; it is dealt out in chunks
    draws = (gets.select("_n", "times").join(_with_neighbours(minority, near, features, None, t), "_n")
             .withColumn("_b", F.explode(F.expr("sequence(0L, (times - 1) div 10000)"))).repartition("_n", "_b")
             .withColumn("_j", F.explode(F.expr("sequence(_b * 10000 + 1, least(times, (_b + 1) * 10000))")))
             .withColumns({"_nn": _nn(F.col("_n"), seed), "_u": _u(F.col("_n"), seed)}))
    return rows.select(*df.columns).unionByName(_synthetic(df, draws, features, [], t, True))


def adasyn_shares(rows: DataFrame, minority: DataFrame, t: str, features: list[str], k: int = 5) -> DataFrame:
    """(t, _n, r): share of other classes among the k nearest rows of the whole table."""
    near = nearest(points(minority, features, [], None), points(rows, features, [], None), k)
    own = minority.select("_n", F.col(t).alias("_own"))
    other = rows.select(F.col("_n").alias("other"), F.col(t).alias("_other"))
    return (near.join(own, "_n").join(other, "other").groupBy(F.col("_own").alias(t), "_n")
            .agg(F.avg((F.col("_own") != F.col("_other")).cast("double")).alias("r")))


# --- the knn model -------------------------------------------------------------------


def knn_predict(train: DataFrame, test: DataFrame, label: str, features: list[str], k: int = 5,
                classify: bool = True) -> DataFrame:
    """``test`` (which has the row number ``_n``) with ``prediction`` and ``score`` by the k nearest rows of
    ``train`` (numbered apart).  Classification: majority vote, ties to the smaller label; score is the
    share of label 1.  Otherwise the mean."""
    near = nearest(points(test, features, [], None), points(train, features, [], None), k)
    voted = near.join(train.select(F.col("_n").alias("other"), F.col(label).cast("double").alias("_y")), "other")
    if classify:
        votes = voted.groupBy("_n", "_y").agg(F.count(F.lit(1)).alias("c"))
        found = votes.groupBy("_n").agg(
            F.max_by("_y", F.struct("c", -F.col("_y"))).alias("prediction"),
            (F.sum(F.when(F.col("_y") == 1, F.col("c")).otherwise(0)) / F.sum("c")).alias("score"))
    else:
        found = voted.groupBy("_n").agg(F.avg("_y").alias("prediction")).withColumn("score", F.col("prediction"))
    return test.join(found, "_n", "left")
