"""Collect every statistic a set of transforms needs and compute them together.

Scalars (mean, std, min, max) come from one ``agg`` over the table, all quantiles
from one radix histogram, all modes from one grouped count.  Only O(columns)
values reach the driver.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import clean_value
from .radix import quantile_table
from .stats import unpivot_values

SCALAR_AGGS = {
    "mean": F.avg,
    "std": F.stddev_samp,
    "std_pop": F.stddev_pop,
    "min": F.min,
    "max": F.max,
    "count": F.count,
}


class StatsRequest:
    def __init__(self, df: DataFrame):
        self.df = df
        self.scalars: set[tuple[str, str]] = set()
        self.quantiles: dict[str, set[float]] = defaultdict(set)
        self.lower_medians: set[str] = set()
        self.approx_medians: set[str] = set()
        self.modes: set[str] = set()

    def need(self, kind: str, col: str, p: float | None = None) -> None:
        if kind in SCALAR_AGGS:
            self.scalars.add((kind, col))
        elif kind == "q":
            self.quantiles[col].add(float(p))
        elif kind == "median_lower":
            self.lower_medians.add(col)
        elif kind == "median_approx":
            self.approx_medians.add(col)
        elif kind == "mode":
            self.modes.add(col)
        else:
            raise ValueError(kind)

    def run(self) -> dict:
        src = self.df
        cols = sorted({c for _, c in self.scalars} | self.approx_medians)
        # NaN -> NULL once, then plain column references
        df = src.select(*[clean_value(src, c).alias(c) for c in cols]) if cols else src
        out: dict = {}
        aggs, keys = [], []
        for kind, col in sorted(self.scalars):
            v = clean_value(df, col)
            if kind not in ("min", "max"):
                v = v.cast("double")
            aggs.append(SCALAR_AGGS[kind](v))
            keys.append((kind, col, None))
        for col in sorted(self.approx_medians):
            aggs.append(F.percentile_approx(clean_value(df, col).cast("double"), 0.5, 10000))
            keys.append(("median_approx", col, None))
        if aggs:
            out.update(zip(keys, df.agg(*aggs).first()))
        out.update(self._quantiles())
        out.update(modes_of(src, sorted(self.modes)))
        return out

    def _quantiles(self) -> dict:
        """All columns and probabilities together: one radix histogram."""
        cols = sorted(set(self.quantiles) | self.lower_medians)
        if not cols:
            return {}
        probs = sorted(set().union(*self.quantiles.values())) if self.quantiles else []
        lower = [0.5] if self.lower_medians else []
        table = quantile_table(unpivot_values(self.df, cols), ["k"], probs, lower=lower)
        found = {r["k"]: [float(x) for x in r["q"]] for r in table.collect()}       # one row per column
        none = [None] * (len(probs) + 1)
        out = {("q", c, p): found.get(c, none)[probs.index(p)] for c in self.quantiles for p in self.quantiles[c]}
        return out | {("median_lower", c, None): found.get(c, none)[-1] for c in self.lower_medians}


#: how values of a type are counted with those of other columns: as text, as long or as double
_KINDS = {"string": "string", "boolean": "bigint", "tinyint": "bigint", "smallint": "bigint", "int": "bigint", "bigint": "bigint",
          "float": "double", "double": "double"}


def modes_of(df: DataFrame, cols: list[str]) -> dict:
    """``{("mode", column, None): value}``: the most frequent non-missing value, ties to the smallest.

    All columns of the common types are counted in one aggregation; only a column of another type
    takes one of its own."""
    types = {c: df.schema[c].dataType for c in cols}
    out = {("mode", c, None): mode_of(df, c) for c in cols if types[c].simpleString() not in _KINDS}
    cols = [c for c in cols if types[c].simpleString() in _KINDS]
    if not cols:
        return out
    kinds = sorted(set(_KINDS.values()))
    structs = []
    for c in cols:
        v, mine = clean_value(df, c), _KINDS[types[c].simpleString()]
        structs.append(F.struct(F.lit(c).alias("k"), v.isNotNull().alias("has"),
                                *[(v.cast(kind) if kind == mine else F.lit(None).cast(kind)).alias(kind) for kind in kinds]))
    long = df.select(F.explode(F.array(*structs)).alias("s")).select("s.*").where("has")
    counts = long.groupBy("k", *kinds).agg(F.count(F.lit(1)).alias("c"))
    best = counts.groupBy("k").agg(F.min(F.struct((-F.col("c")).alias("c"), *kinds)).alias("m")).collect()     # one row per column
    found = {r["k"]: r["m"][_KINDS[types[r["k"]].simpleString()]] for r in best}
    for c in cols:
        v = found.get(c)
        out[("mode", c, None)] = bool(v) if types[c].simpleString() == "boolean" and v is not None else v
    return out


def mode_of(df: DataFrame, col: str):
    """Most frequent non-missing value; ties go to the smallest value."""
    v = clean_value(df, col)
    counts = df.where(v.isNotNull()).groupBy(v.alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    row = counts.agg(F.min_by("_v", F.struct((-F.col("_c")).alias("a"), F.col("_v").alias("b")))
                     .alias("m")).first()
    return row["m"] if row else None
