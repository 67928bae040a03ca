"""One-pass statistics shared by every operator.

Rules that keep the numbers identical to the pandas / warehouse semantics:

* NaN is missing (``clean_value``);
* skewness / kurtosis are bias corrected (Spark's are population moments);
* sample standard deviation unless a caller asks for the population one;
* correlation via ``covar_pop / (stddev_pop * stddev_pop)`` so a constant column
  gives NULL instead of raising under ANSI mode;
* percentiles are exact with linear interpolation.

Exact percentiles come from a radix histogram (``radix.py``), one path at every size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import clean_value
from .radix import quantile_table


def corrected_skew(n: Column, g1: Column) -> Column:
    """Bias-corrected sample skewness G1 from the population g1 (0 when n<=2)."""
    n = n.cast("double")
    g = F.sqrt(n * (n - 1)) / (n - 2) * g1
    return F.when(n > 2, F.coalesce(g, F.lit(0.0))).otherwise(F.lit(0.0))


def corrected_kurt(n: Column, g2: Column) -> Column:
    """Bias-corrected excess kurtosis G2 from the population g2 (0 when n<=3)."""
    n = n.cast("double")
    g = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)
    return F.when(n > 3, F.coalesce(g, F.lit(0.0))).otherwise(F.lit(0.0))


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation over pairwise-complete rows, NULL for constants."""
    both = x.isNotNull() & y.isNotNull()
    xx = F.when(both, x.cast("double"))
    yy = F.when(both, y.cast("double"))
    den = F.stddev_pop(xx) * F.stddev_pop(yy)
    return F.covar_pop(xx, yy) / F.nullif(den, F.lit(0.0))


def unpivot_values(df: DataFrame, cols: list[str], key: str = "k",
                   value: str = "v", extra: list[Column] | None = None) -> DataFrame:
    """Wide -> long ``(k, v)`` rows with NaN folded to NULL and NULLs dropped."""
    structs = [F.struct(F.lit(c).alias(key), clean_value(df, c).cast("double").alias(value))
               for c in cols]
    long = df.select(F.explode(F.array(*structs)).alias("_kv"), *(extra or []))
    out = long.select("_kv.*", *[c for c in long.columns if c != "_kv"])
    return out.where(F.col(value).isNotNull())


def exact_quantiles(long: DataFrame, probs: list[float], key: str = "k", value: str = "v", discrete: bool = False) -> dict:
    """``{key: [q(p) for p in probs]}``: exact quantiles of ``value`` per ``key``, for keys that are few (columns).

    Keys with no non-null values are absent."""
    table = quantile_table(long, [key], [], value, probs) if discrete else quantile_table(long, [key], probs, value)
    return {r[key]: [float(x) for x in r["q"]] for r in table.collect()}


def column_quantiles(df: DataFrame, cols: list[str], probs: list[float], **kw) -> dict:
    """``{column: [q(p)...]}`` for numeric columns of a wide DataFrame."""
    if not cols:
        return {}
    return exact_quantiles(unpivot_values(df, cols), probs, **kw)
