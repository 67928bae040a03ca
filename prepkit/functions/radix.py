"""Exact order statistics by a radix histogram, for every key and every requested rank at once.

A double has an order-preserving image: the binary logarithm cut into 256 steps a power of two, with
the sign, then the signed significand as an integer of 54 bits.  Round 1 counts the rows by the
first; each of three more rounds counts 16 to 24 more bits of the significand, but only of rows in
buckets that hold a wanted rank.  A bucket whose least and largest value agree is answered, so the
rounds end early where values are few; after the last every bucket is one value.  Per round there is
one aggregation with map-side combine; wanted ranks and buckets stay tables, whatever their number.

Nothing depends on the number of rows, and no key's values ever meet in one task: what a window
orders is a histogram, of at most 2^24 counters a bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .numbering import BROADCAST_GROUPS

STEPS = 256                     # buckets of round 1 in a power of two
ROUNDS = (30, 15, 0)            # bits of the significand that the further rounds leave out


def coarse(v: str) -> str:
    """The digit of round 1 (SQL text, bigint): never falling with ``v``; all of a bucket have one exponent.

    The logarithm is monotone, so a digit that is off by one next to a power of two keeps the order."""
    steps = f"floor((greatest(log2(nullif(abs({v}), 0D)), -1022D) + 1100) * {STEPS})"
    top = f"case when abs({v}) = double('inf') then {3000 * STEPS}L when {v} = 0 then 0L else {steps} end"
    return f"signum({v}) * {top}"


def significand(v: str) -> str:
    """SQL text of a bigint, ordered like the doubles ``v`` of one ``coarse`` digit, different for different ones.

    Scaling goes in two steps, since 2^(53 - e) can be beyond the doubles; both are exact."""
    e = f"double(floor(greatest(log2(nullif(abs({v}), 0D)), -1022D) + 1100) - 1100)"
    return f"bigint(case when {v} <> 0 and abs({v}) < double('inf') then {v} * pow(2D, -{e}) * {2.0 ** 53!r}D else 0D end)"


def _digits(v: str, whole: bool) -> tuple[str, str]:
    """SQL texts of the digit of round 1 and of what the further rounds cut; integers (bigint) are their own image."""
    return (f"shiftright({v}, 45)", v) if whole else (f"bigint({coarse(v)})", significand(v))


def _places(n: str, p: float, discrete: bool) -> list[str]:
    """The 0-based ranks that a probability needs among n rows, and the place between them (double) if there are two."""
    if discrete:
        return [f"bigint(greatest(ceil({n} * {p!r}D) - 1, 0))"]
    h = f"(({n} - 1) * {p!r}D)"
    return [f"bigint(floor({h}))", f"bigint(ceil({h}))", h]


def histogram(long: DataFrame, keys: list[str], value: str = "v", extra: list[Column] | None = None, whole: bool = False) -> DataFrame:
    """Round 1: (keys, _digit, _count, _low, _high, extra aggregates), checkpointed; NULL values do not count.

    ``whole``: the values are bigint, else double."""
    ensure_checkpoint_dir(long.sparkSession)
    v = f"`{value}`"
    return (long.where(f"{v} is not null").groupBy(*keys, F.expr(_digits(v, whole)[0]).alias("_digit"))
            .agg(F.expr("count(1) as _count"), F.expr(f"min({v}) as _low"), F.expr(f"max({v}) as _high"), *(extra or [])).checkpoint())


def _chosen(hist: DataFrame, part: list[str], wanted: DataFrame) -> DataFrame:
    """(keys, _rank, _below, _count, _low, _high): the bucket that holds each wanted rank.

    hist: (part, _digit, _count, _low, _high, _below); wanted: (part, rank), its columns with ``?`` before the name."""
    by = ", ".join(f"`{c}`" for c in part)
    hist = hist.selectExpr("*", f"_below + sum(_count) over (partition by {by} order by _digit rows unbounded preceding) as _to")
    on = " and ".join(f"`{c}` <=> `?{c}`" for c in part)
    return hist.join(wanted, F.expr(f"{on} and `?rank` < _to and `?rank` >= _to - _count")).selectExpr(
        *[f"`{c}`" for c in part if c != "_start"], "`?rank` as _rank", "_to - _count as _below", "_count", "_low", "_high")


def rank_values(long: DataFrame, keys: list[str], ranks: DataFrame | list[tuple[float, bool]], value: str = "v",
                first: DataFrame | None = None, whole: bool = False) -> DataFrame:
    """(keys, _size, _rank, _value, _below, _count): the values (double, or bigint if ``whole``) at the 0-based
    ranks of each key, with the rows of the key, the number of smaller rows and of equal ones.

    Ranks are given as a table (keys, rank) or follow from (probability, discrete); ``first`` is the
    histogram if there is one.  NULL values do not count; NULL keys are keys.  A rank beyond the rows
    of its key gives no row."""
    names = [f"`{k}`" for k in keys]
    long = long.selectExpr(*names, f"{'bigint' if whole else 'double'}(`{value}`) as _val").where("_val is not null")
    first = histogram(long, keys, "_val", whole=whole) if first is None else first
    first = first.selectExpr(*names, "_digit", "_count", "_low", "_high", "0L as _below")
    sizes = first.groupBy(*keys).agg(F.expr("sum(_count) as _size"))
    if isinstance(ranks, list):
        asked = ", ".join(r for p, discrete in ranks for r in _places("_size", p, discrete)[:2])
        ranks = sizes.selectExpr(*names, f"explode(array_distinct(array({asked}))) as rank")
    marked = [f"`{k}` as `?{k}`" for k in keys]
    now = _chosen(first, keys, ranks.selectExpr(*marked, "rank as `?rank`").distinct()).checkpoint()
    done = now.where("_low = _high")
    same = " and ".join(f"`{k}` <=> `?{k}`" for k in keys)
    for left_out in ROUNDS:
        pending = now.where("_low < _high")
        n = pending.count()
        if not n:
            break
        spans = pending.selectExpr(*marked, "_low as _start", "_high as _end", "_below").distinct()
        if n <= BROADCAST_GROUPS:
            spans = F.broadcast(spans)
        hist = (long.join(spans, F.expr(f"{same} and _val >= _start and _val <= _end"))
                .groupBy(*keys, "_start", "_below", F.expr(f"shiftright({_digits('_val', whole)[1]}, {left_out})").alias("_digit"))
                .agg(F.expr("count(1) as _count"), F.expr("min(_val) as _low"), F.expr("max(_val) as _high")))
        now = _chosen(hist, [*keys, "_start"], pending.selectExpr(*marked, "_low as `?_start`", "_rank as `?rank`")).checkpoint()
        done = done.union(now if left_out == 0 else now.where("_low = _high"))
    out = done.selectExpr(*marked, "_rank", "_low as _value", "_below", "_count")
    return out.join(sizes, F.expr(same)).selectExpr(*names, "_size", "_rank", "_value", "_below", "_count")


def quantile_table(long: DataFrame, keys: list[str], probs: list[float], value: str = "v", lower: list[float] | None = None,
                   first: DataFrame | None = None) -> DataFrame:
    """(keys, q array<double>): exact quantiles per key, one row per key with values.

    Those of ``probs`` are interpolated between ranks; then follow those of ``lower``, each the least
    value whose share of rows reaches the probability."""
    asked = [(float(p), False) for p in probs] + [(float(p), True) for p in lower or []]
    found = rank_values(long, keys, asked, value, first)
    per = found.groupBy(*keys, "_size").agg(F.expr("map_from_entries(collect_list(struct(_rank, _value))) as _at"))
    q = []
    for p, discrete in asked:
        low, *more = _places("_size", p, discrete)
        a = f"_at[{low}]"
        if more:
            high, h = more
            b = f"_at[{high}]"
            a = f"if({a} = {b}, {a}, ({high} - {h}) * {a} + ({h} - {low}) * {b})"
        q.append(a)
    return per.selectExpr(*[f"`{k}`" for k in keys], f"array({', '.join(q)}) as q")
