"""B7 SMOTER: regression balancing by the relevance of the target.

Relevance is a piecewise cubic through control points of the box plot: 1 at a whisker beyond which
there are extremes, 0 at the median (and at an end without extremes), flat at every control point
and beyond the ends, monotone in between.  Along the sorted target, rare values (relevance at least
the threshold) and normal ones form runs.  Between two control points the relevance crosses the
threshold once at most, so (segment, rare) groups never interleave: the runs follow from one grouped
count of a few rows, and the table is not sorted.

Every run ends with the same number of rows.  Larger ones keep the rows of smallest hash; in smaller
ones each row makes new rows from its k nearest rows of the run.  A neighbour nearer than half the
median distance is interpolated with, any other draw adds normal noise.  Neighbours stand with their
row (k of them), so draws need no join, however many a row makes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import clean_value, hash_bigint, is_numeric
from ..functions.numbering import small_side
from ..functions.radix import quantile_table
from ..functions.selection import mark_first
from ..functions.stats import unpivot_values
from . import balance as B
from . import neighbours as NB

DRAWS_AT_ONCE = 10_000
FEW_DRAWS = 16      # draws of a row that are made where it stands
WHOLE = (T.LongType, T.IntegerType, T.ShortType, T.ByteType)


@dataclass
class Run:
    rare: bool
    low: float
    high: float
    n: int
    want: int = 0


def control_points(df: DataFrame, t: str, coef: float = 1.5) -> list[tuple[float, float]]:
    """[(value, relevance)] of the box plot: whisker or end, median, whisker or end; none without values."""
    q = quantile_table(unpivot_values(df, [t]), ["k"], [0.25, 0.5, 0.75]).collect()
    if not q:
        return []
    q1, median, q3 = q[0]["q"]
    v, reach = clean_value(df, t).cast("double"), coef * (q3 - q1)
    low, high, least, most = df.agg(F.min(F.when(v >= q1 - reach, v)), F.max(F.when(v <= q3 + reach, v)), F.min(v), F.max(v)).first()
    return [(low, 1.0) if least < low else (least, 0.0), (median, 0.0), (high, 1.0) if most > high else (most, 0.0)]


def relevance(v: Column, points: list[tuple[float, float]]) -> Column:
    """Relevance (0 to 1) of the values ``v``; NULL stays NULL."""
    out = F.when(v <= points[0][0], F.lit(points[0][1]))
    for (a, p), (b, q) in zip(points, points[1:]):
        if b > a:
            s = (v - a) / (b - a)
            out = out.when(v < b, p + (q - p) * (s * s * (3 - 2 * s)))
    return out.when(v.isNotNull(), F.lit(points[-1][1]))


def target_runs(df: DataFrame, t: str, points: list[tuple[float, float]], threshold: float = 0.5) -> list[Run]:
    """The runs of rare and normal values along the sorted target, with the rows that each is to have."""
    v = clean_value(df, t).cast("double")
    segment = sum(((v >= p).cast("int") for p, _ in points), F.lit(0))
    groups = (df.where(v.isNotNull()).groupBy(segment.alias("s"), (relevance(v, points) >= threshold).alias("rare"))
              .agg(F.min(v).alias("low"), F.max(v).alias("high"), F.count(F.lit(1)).alias("n")).collect())    # two a segment
    runs: list[Run] = []
    for r in sorted(groups, key=lambda r: r["low"]):
        if runs and runs[-1].rare == r["rare"]:
            runs[-1].high, runs[-1].n = r["high"], runs[-1].n + r["n"]
        else:
            runs.append(Run(r["rare"], r["low"], r["high"], r["n"]))
    for run in runs:
        run.want = round(sum(r.n for r in runs) / len(runs))
    return runs


def run_of(v: Column, runs: list[Run]) -> Column:
    """Number of the run of a value, from 0."""
    return sum(((v >= r.low).cast("int") for r in runs[1:]), F.lit(0))


def _by_run(values: dict[int, float], kind: str = "double") -> Column:
    out = F.lit(None).cast(kind)
    for i, v in values.items():
        out = F.when(F.col("_run") == i, F.lit(v).cast(kind)).otherwise(out)
    return out


def smoter(df: DataFrame, t: str, row_id: list[str] | None = None, k: int = 5, pert: float = 0.02, threshold: float = 0.5,
           coef: float = 1.5, seed: int = 42) -> DataFrame:
    """``df`` balanced over the runs of its target.

    The target becomes double; text that is no number and NULL are dropped, and names lose blanks at
    the ends.  Features are the numeric columns and, as categories, the strings; in new rows a row
    id and all other columns are NULL.  Distances are Euclidean, with categories: over numbers scaled
    by their range in the run, a differing category adding 1.  Whole numbers stay whole, and a feature
    that is positive all over its run does not fall below 0.  Without both rare and normal values the
    table comes back as it is.
    """
    df = df.select(*[F.col(f"`{c}`").alias(c.strip()) for c in df.columns])
    cols, t = df.columns, t.strip()
    base = df.withColumn(t, F.col(t).try_cast("double"))
    base = base.where(clean_value(base, t).isNotNull())
    points = control_points(base, t, coef)
    runs = target_runs(base, t, points, threshold) if points else []
    if len(runs) < 2:
        return base
    order = B._order(base, row_id, seed)
    placed = base.withColumn("_run", run_of(F.col(t), runs))
    wants = " ".join(f"when {i} then {r.want}L" for i, r in enumerate(runs))
    kept = mark_first(placed, ["_run"], order, lambda sizes: f"case _run {wants} end").where("_in").select(*cols)
    small = {i: r for i, r in enumerate(runs) if r.want > r.n}
    rows = placed.where(F.col("_run").isin(list(small)))
    rows = B._ranked(rows, ["_run"], order, "_place").checkpoint()
    return kept.unionByName(_new_rows(rows, cols, t, row_id or [], small, k, pert, seed))


def _new_rows(rows: DataFrame, cols: list[str], t: str, row_id: list[str], runs: dict[int, Run], k: int, pert: float, seed: int) -> DataFrame:
    """want - n rows per run: every row makes want / n - 1 of them, and those of the first places one more."""
    nums = [c for c in cols if c not in (t, *row_id) and is_numeric(rows, c)]
    cats = [c for c in cols if c not in (t, *row_id) and isinstance(rows.schema[c].dataType, T.StringType)]
    x = {c: clean_value(rows, c).cast("double") for c in nums}
    stats = rows.groupBy("_run").agg(
        F.stddev_samp(t).alias("y"), *[F.struct(F.stddev_samp(x[c]).alias("sd"), F.min(x[c]).alias("low"), F.max(x[c]).alias("high")).alias(f"f{i}")
                                       for i, c in enumerate(nums)]).collect()       # one row per run
    spread = {i: _by_run({r["_run"]: r[f"f{i}"]["sd"] or 0.0 for r in stats}) for i in range(len(nums))}
    positive = {i: _by_run({r["_run"]: r[f"f{i}"]["low"] is not None and r[f"f{i}"]["low"] > 0 for r in stats}, "boolean") for i in range(len(nums))}
    scale = {i: _by_run({r["_run"]: ((r[f"f{i}"]["high"] or 0.0) - (r[f"f{i}"]["low"] or 0.0)) or 1.0 for r in stats}) if cats else F.lit(1.0)
             for i in range(len(nums))}
    y_spread = _by_run({r["_run"]: r["y"] or 0.0 for r in stats})
    rows = (rows.withColumns({f"_x{i}": x[c] / scale[i] for i, c in enumerate(nums)} | {f"_raw{i}": x[c] for i, c in enumerate(nums)})
            .withColumn("_n", F.col("_run").cast("long") * F.lit(1 << 48) + F.col("_place")))
    points = NB.points(rows, [f"_x{i}" for i in range(len(nums))], cats, "_run")
    near = NB.nearest(points, points, k, 1.0)
    side = rows.select(F.col("_n").alias("other"), F.struct(F.col(t).alias("y"), *[f"_raw{i}" for i in range(len(nums))], *[
        F.col(c).alias(f"_c{i}") for i, c in enumerate(cats)]).alias("row"))
    around = near.join(side, "other").groupBy("_n").agg(F.sort_array(F.collect_list(F.struct("rank", F.sqrt("d2").alias("d"), "row"))).alias("_near"))
    # half the median of the distances, which stand in their order
    middle = [F.get("_near", F.expr(f"int((size(_near) - {i}) div 2)"))["d"] for i in (1, 0)]
    around = around.withColumn("_safe", (middle[0] + middle[1]) / 2 / 2)
    times = _by_run({i: r.want // r.n - 1 for i, r in runs.items()}, "long") + (
        F.col("_place") <= _by_run({i: r.want % r.n for i, r in runs.items()}, "long")).cast("long")
    made = rows.join(around, "_n", "left").withColumn("_times", times).where("_times > 0")
    made = made.withColumn("_b", F.explode(F.expr(f"sequence(0L, (_times - 1) div {DRAWS_AT_ONCE})")))
    if max(r.want // r.n for r in runs.values()) > FEW_DRAWS:
        made = made.repartition("_n", "_b")
    made = made.withColumn("_j", F.explode(F.expr(f"sequence(_b * {DRAWS_AT_ONCE} + 1, least(_times, (_b + 1) * {DRAWS_AT_ONCE}))")))

    def drawn(tag: str) -> Column:
        return hash_bigint(F.col("_run"), F.col("_place"), F.col("_j"), F.lit(seed), F.lit(tag))

    def noise(tag: str) -> Column:
        return B._normal(F.col("_run"), F.col("_place"), F.col("_j"), F.lit(seed), F.lit(tag)) * F.col("_step")

    made = made.withColumns({"_one": F.get(F.col("_near"), F.pmod(drawn("nn"), F.greatest(F.size("_near"), F.lit(1))).cast("int")),
                             "_u": drawn("u").cast("double") / F.lit(B._TWO60),
                             "_step": F.least(F.coalesce("_safe", F.lit(pert)), F.lit(pert))})
    made = made.withColumn("_between", F.coalesce(F.col("_one.d") < F.col("_safe"), F.lit(False)))
    if cats:
        # a noisy row takes its categories from one drawn row of the run, so they keep its frequencies
        salts = _by_run({i: 1 + r.want // r.n // B.DRAWS_PER_ROW for i, r in runs.items()}, "int")
        pool = rows.select("_run", F.col("_place").alias("_pick"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("_salt"),
                           F.struct(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(cats)]).alias("_lot"))
        sizes = _by_run({i: r.n for i, r in runs.items()}, "long")
        made = made.withColumns({"_pick": F.pmod(drawn("lot"), sizes) + 1, "_salt": F.pmod(F.col("_j"), salts).cast("int")}).join(
            small_side(pool), ["_run", "_pick", "_salt"])
        made = made.withColumns({f"_new{i}": F.when(F.col("_between"), F.when(drawn(f"c{i}") % 2 == 0, F.col(c)).otherwise(F.col(f"_one.row._c{i}")))
                                 .otherwise(F.col(f"_lot._c{i}")) for i, c in enumerate(cats)})
    # distances of the new row to both ends weigh their targets
    gap = sum(((F.col(f"_one.row._raw{i}") - F.col(f"_raw{i}")) / scale[i]) ** 2 for i in range(len(nums))) if nums else F.lit(0.0)
    to_a = sum(((~F.col(f"_new{i}").eqNullSafe(F.col(c))).cast("int") for i, c in enumerate(cats)), F.lit(0))
    to_b = sum(((~F.col(f"_new{i}").eqNullSafe(F.col(f"_one.row._c{i}"))).cast("int") for i, c in enumerate(cats)), F.lit(0))
    a, b = F.sqrt(F.col("_u") ** 2 * gap + to_a), F.sqrt((1 - F.col("_u")) ** 2 * gap + to_b)
    y0, y1 = F.col(t), F.col("_one.row.y")
    out = []
    for c in cols:
        kind = rows.schema[c].dataType
        if c == t:
            v = F.when(F.col("_between"), F.when(a == b, (y0 + y1) / 2).otherwise((b * y0 + a * y1) / (a + b))).otherwise(y0 + noise("y") * y_spread)
        elif c in nums:
            i = nums.index(c)
            v = F.when(F.col("_between"), F.col(f"_raw{i}") + F.col("_u") * (F.col(f"_one.row._raw{i}") - F.col(f"_raw{i}"))).otherwise(
                F.col(f"_raw{i}") + noise(f"x{i}") * spread[i])
            v = F.when(positive[i], F.greatest(v, F.lit(0.0))).otherwise(v)
            v = F.rint(v) if isinstance(kind, WHOLE) else v
        elif c in cats:
            v = F.col(f"_new{cats.index(c)}")
        else:
            v = F.lit(None)
        out.append(v.cast(kind).alias(c))
    return made.select(*out)
