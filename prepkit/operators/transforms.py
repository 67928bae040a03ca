"""Scalar and windowed feature transforms (O1-O31) and the template registry.

A transform list ``[{"column_name": c, "fe_method": m, **params}, ...]`` is
resolved through the registry, every statistic the list needs is computed in
one pass (``StatsRequest``), and the result is ``df.select("*", *new_cols)``.

Statistics that the SQL templates take from ``OVER ()`` windows (mean, std,
min/max, percentiles) are fitted once and inlined as literals, so the output
is a narrow projection: no single-partition window anywhere.  Per-level
encodings (label, frequency, target) are grouped tables made by ``fit`` and joined
with a left join, so no row is lost on new data (a level the fit has not seen
gives NULL); AQE broadcasts them when their measured size allows and otherwise
keeps a shuffle join (with skew-join splitting for hot keys).
"""

from __future__ import annotations

import hashlib
import logging
import re
from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import canonical_str, clean_value, hash_bigint, is_float, trim_ws
from ..functions.fitting import StatsRequest
from ..functions.numbering import global_row_number, join_null_safe, small_levels
from ..functions.selection import ntile
from ..session import ensure_checkpoint_dir

log = logging.getLogger(__name__)

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference behaviour.
# Truthy text for binary encoding and for the auto-encoded target:
TRUTHY = ["Yes", "yes", "YES", "true", "True", "TRUE", "1"]
# Method names accepted by the registry, per template (normalised on lookup:
# lower case, blanks and hyphens become underscores):
ALIASES = {
    "standardization": ["standardization", "z-score normalization", "z_score_normalization",
                        "feature scaling"],
    "normalization": ["normalization", "min_max_normalization", "min-max scaling",
                      "min_max_scaling", "data normalization"],
    "log_transformation": ["log_transformation", "log_transform", "log transform",
                           "logarithmic transformation"],
    "sqrt_transformation": ["sqrt_transformation"],
    "power_transformation": ["power_transformation", "box-cox transformation",
                             "yeo-johnson transformation"],
    "binning": ["binning", "bucketing", "quartile binning", "quantile binning",
                "discretization"],
    "custom_binning": ["custom_binning", "equal width binning"],
    "robust_scaling": ["robust_scaling"],
    "label_encoding": ["label_encoding", "ordinal_encoding", "integer encoding",
                       "category encoding"],
    "frequency_encoding": ["frequency_encoding", "count encoding", "frequency count"],
    "target_encoding": ["target_encoding"],
    "binary_encoding": ["binary_encoding"],
    "hash_encoding": ["hash_encoding", "hashing"],
    "one_hot_encoding": ["one_hot_encoding", "one-hot_encoding", "one-hot encoding",
                         "onehot_encoding", "onehot", "dummy_encoding", "dummy_variables",
                         "get_dummies"],
    "lowercase": ["lowercase", "lower"],
    "uppercase": ["uppercase", "upper"],
    "trim": ["trim"],
    "string_length": ["string_length"],
    "extract_numbers": ["extract_numbers"],
    "impute_mean": ["impute_mean", "mean_imputation", "fill_mean", "mean imputation"],
    "impute_median": ["impute_median", "median_imputation", "fill_median",
                      "median imputation"],
    "impute_mode": ["impute_mode", "mode_imputation", "fill_mode", "mode imputation"],
    "impute_constant": ["impute_constant", "fill_constant", "fillna"],
    "missing_indicator": ["missing_indicator", "is_missing"],
    "clip_outliers": ["clip_outliers", "clip", "clipping"],
    "clip_iqr": ["clip_iqr", "iqr_clipping", "outlier removal", "outlier clipping",
                 "outlier treatment", "iqr method"],
    "winsorize": ["winsorize", "winsorization", "capping"],
    "polynomial_features": ["polynomial_features", "squared", "square"],
    "interaction": ["interaction", "multiply"],
    "ratio": ["ratio", "divide"],
    "extract_date_parts": ["extract_date_parts", "date_features", "datetime_features"],
    "date_diff": ["date_diff", "days_since"],
    "dummies": ["dummies"],
}
# Default parameters per template:
DEFAULTS = {
    "binning": {"num_bins": 4},
    "custom_binning": {"bin1": 25, "bin2": 50, "bin3": 75},
    "power_transformation": {"power": 0.5},
    "impute_constant": {"fill_value": 0},
    "clip_outliers": {"lower_bound": 0, "upper_bound": 100},
    "winsorize": {"lower_percentile": 0.05, "upper_percentile": 0.95},
    "hash_encoding": {"num_buckets": 100},
    "one_hot_encoding": {"num_buckets": 50},
    "dummies": {"max_levels": 1000},
}
# ---------------------------------------------------------------------------


def normalise_method(name: str) -> str:
    return str(name).strip().lower().replace(" ", "_").replace("-", "_")


REGISTRY: dict[str, str] = {}
for _tmpl, _names in ALIASES.items():
    for _n in _names:
        REGISTRY[normalise_method(_n)] = _tmpl


def resolve_template(method: str) -> str:
    """Method name (any alias, any spelling of blanks/hyphens) -> template."""
    key = normalise_method(method)
    if key not in REGISTRY:
        raise ValueError(f"Unknown template: '{method}'")
    return REGISTRY[key]


@dataclass
class Step:
    column: str
    method: str
    template: str
    params: dict = field(default_factory=dict)


@dataclass
class Fitted:
    stats: dict
    tables: dict  # id of the step -> DataFrame (level table)
    levels: dict  # id of the step -> list of levels (dummies)


# --- expression builders ----------------------------------------------------

def _num(df: DataFrame, c: str) -> Column:
    return clean_value(df, c).cast("double")


def _str(df: DataFrame, c: str) -> Column:
    return canonical_str(df, c)


def _lit(v) -> Column:
    return F.lit(None).cast("double") if v is None else F.lit(float(v))


def _clip(x: Column, lo: Column, hi: Column) -> Column:
    """GREATEST(LEAST(x, hi), lo) that keeps NULL x as NULL."""
    return F.when(x.isNotNull(), F.greatest(F.least(x, hi), lo))


def _needs(step: Step, req: StatsRequest, df: DataFrame) -> None:
    c, t, p = step.column, step.template, step.params
    if t == "standardization":
        req.need("mean", c)
        req.need("std", c)
    elif t == "normalization":
        req.need("min", c)
        req.need("max", c)
    elif t == "robust_scaling":
        for q in (0.25, 0.5, 0.75):
            req.need("q", c, q)
    elif t == "impute_mean":
        req.need("mean", c)
    elif t == "impute_median":
        req.need("q", c, 0.5)
    elif t == "impute_mode" and p.get("method", "mode") == "mode":
        req.need("mode", c)
    elif t == "clip_iqr":
        req.need("q", c, 0.25)
        req.need("q", c, 0.75)
    elif t == "winsorize":
        req.need("q", c, float(p["lower_percentile"]))
        req.need("q", c, float(p["upper_percentile"]))


def _expr(step: Step, df: DataFrame, fit: Fitted) -> list[Column]:
    """Output column(s) of one step, given the fitted statistics."""
    c, t, p, s = step.column, step.template, step.params, fit.stats
    x = _num(df, c) if t not in ("label_encoding", "frequency_encoding", "binary_encoding",
                                 "hash_encoding", "one_hot_encoding", "lowercase",
                                 "uppercase", "trim", "string_length", "extract_numbers",
                                 "impute_mode", "impute_constant", "missing_indicator",
                                 "extract_date_parts", "date_diff", "custom_binning",
                                 "dummies", "target_encoding", "binning") else None
    if t == "standardization":
        return [((x - _lit(s[("mean", c, None)])) /
                 F.nullif(_lit(s[("std", c, None)]), F.lit(0.0))).alias(f"{c}_standardized")]
    if t == "normalization":
        lo, hi = s[("min", c, None)], s[("max", c, None)]
        rng = None if lo is None else float(hi) - float(lo)
        return [((x - _lit(lo)) / F.nullif(_lit(rng), F.lit(0.0))).alias(f"{c}_normalized")]
    if t == "log_transformation":
        return [F.ln(x + 1).alias(f"{c}_log")]
    if t == "sqrt_transformation":
        return [F.sqrt(F.abs(x)).alias(f"{c}_sqrt")]
    if t == "power_transformation":
        pw = F.pow(x, F.lit(float(p["power"])))
        return [F.nanvl(pw, F.lit(None).cast("double")).alias(f"{c}_power")]
    if t == "custom_binning":
        v = clean_value(df, c)
        e = (F.when(v < F.lit(p["bin1"]), "low").when(v < F.lit(p["bin2"]), "medium")
             .when(v < F.lit(p["bin3"]), "high").otherwise("very_high"))
        return [e.alias(f"{c}_binned")]
    if t == "robust_scaling":
        med, q1, q3 = s[("q", c, 0.5)], s[("q", c, 0.25)], s[("q", c, 0.75)]
        iqr = None if q1 is None else q3 - q1
        return [((x - _lit(med)) / F.nullif(_lit(iqr), F.lit(0.0))).alias(f"{c}_robust_scaled")]
    if t == "binary_encoding":
        return [F.when(_str(df, c).isin(TRUTHY), 1).otherwise(0).alias(f"{c}_binary")]
    if t in ("hash_encoding", "one_hot_encoding"):
        n = int(p["num_buckets"])
        v = _str(df, c)
        return [F.when(v.isNotNull(), F.pmod(hash_bigint(v), F.lit(n))).alias(f"{c}_hash")]
    if t == "lowercase":
        return [F.lower(_str(df, c)).alias(f"{c}_lower")]
    if t == "uppercase":
        return [F.upper(_str(df, c)).alias(f"{c}_upper")]
    if t == "trim":
        return [trim_ws(_str(df, c)).alias(f"{c}_trimmed")]
    if t == "string_length":
        return [F.char_length(_str(df, c)).alias(f"{c}_length")]
    if t == "extract_numbers":
        digits = F.regexp_extract(_str(df, c), r"[0-9]+", 0)
        return [F.when(digits != "", digits).try_cast("bigint").alias(f"{c}_number")]
    if t == "impute_mean":
        return [F.coalesce(x, _lit(s[("mean", c, None)])).alias(f"{c}_imputed")]
    if t == "impute_median":
        return [F.coalesce(x, _lit(s[("q", c, 0.5)])).alias(f"{c}_imputed")]
    if t == "impute_mode":
        v = clean_value(df, c)
        if p.get("method", "mode") == "first":
            order = p.get("order_by")
            if not order:
                raise ValueError("impute_mode(method='first') needs order_by")
            fill = fit.stats[("first", c, None)]
        else:
            fill = s[("mode", c, None)]
        return [F.coalesce(v, F.lit(fill).cast(df.schema[c].dataType)).alias(f"{c}_imputed")]
    if t == "impute_constant":
        v = clean_value(df, c)
        return [F.coalesce(v, F.lit(p["fill_value"])).alias(f"{c}_imputed")]
    if t == "missing_indicator":
        v = clean_value(df, c)
        return [F.when(v.isNull(), 1).otherwise(0).alias(f"{c}_is_missing")]
    if t == "clip_outliers":
        return [_clip(x, F.lit(float(p["lower_bound"])), F.lit(float(p["upper_bound"])))
                .alias(f"{c}_clipped")]
    if t == "clip_iqr":
        q1, q3 = s[("q", c, 0.25)], s[("q", c, 0.75)]
        if q1 is None:
            return [F.lit(None).cast("double").alias(f"{c}_clipped")]
        iqr = q3 - q1
        return [_clip(x, F.lit(q1 - 1.5 * iqr), F.lit(q3 + 1.5 * iqr)).alias(f"{c}_clipped")]
    if t == "winsorize":
        lo = s[("q", c, float(p["lower_percentile"]))]
        hi = s[("q", c, float(p["upper_percentile"]))]
        return [_clip(x, _lit(lo), _lit(hi)).alias(f"{c}_winsorized")]
    if t == "polynomial_features":
        return [F.pow(x, F.lit(2.0)).alias(f"{c}_squared")]
    if t == "interaction":
        c1, c2 = p["column1"], p["column2"]
        return [(_num(df, c1) * _num(df, c2)).alias(f"{c1}_x_{c2}")]
    if t == "ratio":
        c1, c2 = p["column1"], p["column2"]
        return [F.try_divide(_num(df, c1), F.nullif(_num(df, c2), F.lit(0.0)))
                .alias(f"{c1}_div_{c2}")]
    if t == "extract_date_parts":
        d = F.col(c)
        return [F.year(d).alias(f"{c}_year"), F.month(d).alias(f"{c}_month"),
                F.dayofmonth(d).alias(f"{c}_day"), F.dayofweek(d).alias(f"{c}_dayofweek")]
    if t == "date_diff":
        as_of = p.get("as_of")
        ref = F.to_date(F.lit(as_of)) if as_of else F.current_date()
        return [F.datediff(ref, F.to_date(F.col(c))).alias(f"{c}_days_ago")]
    if t == "dummies":
        v = _str(df, c)
        return [F.when(v == F.lit(level), 1).otherwise(0).alias(f"{c}_{name}")
                for level, name in zip(fit.levels[id(step)], level_columns(fit.levels[id(step)]))]
    raise ValueError(f"no expression for {t}")


def _level_name(level: str) -> str:
    return re.sub(r"[^a-zA-Z0-9_]", "_", str(level))


def level_columns(levels: list[str]) -> list[str]:
    """A name per level, different for different levels: names that would be equal get a piece of the level's hash."""
    plain = [_level_name(x) for x in levels]
    names = [n if plain.count(n) == 1 else f"{n}_{hashlib.md5(x.encode()).hexdigest()[:8]}" for n, x in zip(plain, levels)] \
        if len(set(plain)) < len(plain) else plain
    return names


def dummy_levels(values: DataFrame, column: str, cap: int) -> list[str]:
    """The sorted levels of the column ``v``; an error beyond ``cap``, since each makes a column."""
    got = values.where("v IS NOT NULL").distinct().limit(cap + 1).collect()
    if len(got) > cap:
        raise ValueError(f"{column} has more than {cap} levels; use sparse dummies or hash encoding")
    return sorted(r["v"] for r in got)


def sparse_dummies(df: DataFrame, table: DataFrame, column: str, name: str) -> DataFrame:
    """``df`` with the one-hot vector ``name`` of a column, by a fitted table (_key, _code from 0).

    As long as there are levels, however many; NULL and levels unseen in the fit are all zeros."""
    from pyspark.ml.feature import OneHotEncoder

    n = table.count()
    known = F.coalesce(F.col("_code").cast("double"), F.lit(float(n)))
    # the encoder needs the number of levels only
    top = df.sparkSession.createDataFrame([(float(n),)], "_index double")
    model = OneHotEncoder(inputCols=["_index"], outputCols=[name], dropLast=True).fit(top)
    joined = df.withColumn("_key", _str(df, column)).join(table, "_key", "left").withColumn("_index", known)
    return model.transform(joined).select(*df.columns, name)


JOIN_TEMPLATES = ("label_encoding", "frequency_encoding", "target_encoding")


def level_table(step: Step, src: DataFrame) -> DataFrame:
    """Fitted levels ``(_key, _code)`` of a label, frequency or target encoding.

    Checkpointed, so every later ``transform`` uses the values of the fit.  The key
    of label encoding is the text with NULL as the empty string; sparse dummies number the
    levels alike, without NULL.
    """
    c, t = step.column, step.template
    if t in ("label_encoding", "dummies"):
        text = _str(src, c)
        levels = (src.select(F.coalesce(text, F.lit("")).alias("_key")) if t == "label_encoding"
                  else src.where(text.isNotNull()).select(text.alias("_key"))).distinct()
        coded = global_row_number(levels, ["_key"], name="_rn")
        return coded.select("_key", (F.col("_rn") - 1).cast("bigint").alias("_code"))
    groups = src.groupBy(_str(src, c).alias("_key"))
    if t == "frequency_encoding":
        table = groups.agg(F.count(F.lit(1)).alias("_code"))
    else:
        table = groups.agg(F.avg(_num(src, step.params["target_column"])).alias("_code"))
    ensure_checkpoint_dir(src.sparkSession)
    return table.checkpoint(eager=True)


CODE_SUFFIX = {"label_encoding": "encoded", "frequency_encoding": "freq", "target_encoding": "target_encoded"}


def _join_encoding(step: Step, df: DataFrame, table: DataFrame) -> DataFrame:
    """Left join with the fitted levels: every row stays, a level unseen in the fit gives NULL."""
    c = step.column
    key = _str(df, c)
    if step.template == "label_encoding":
        key = F.coalesce(key, F.lit(""))
    named = table.withColumnRenamed("_code", f"{c}_{CODE_SUFFIX[step.template]}")
    return join_null_safe(df.withColumn("_key", key), named, ["_key"], how="left").drop("_key")


def _binning(step: Step, df: DataFrame, order_by: list[str]) -> DataFrame:
    """NTILE(k) OVER (ORDER BY x NULLS FIRST, row ids) by its k - 1 cuts."""
    c, k = step.column, int(step.params["num_bins"])
    if not order_by:
        raise ValueError("binning needs a unique row id (order_by) for a repeatable order")
    return ntile(df, clean_value(df, c), order_by, k, f"{c}_bin")


def _is_sparse(step: Step) -> bool:
    return step.template == "dummies" and bool(step.params.get("sparse"))


class TemplateSet:
    """A list of template requests, fitted on one DataFrame and applied to any."""

    def __init__(self, transformations: list[dict], order_by: list[str] | None = None):
        self.steps: list[Step] = []
        self.skipped: list[dict] = []
        self.order_by = order_by or []
        for t in transformations:
            col, method = t.get("column_name"), t.get("fe_method")
            params = {k: v for k, v in t.items() if k not in ("column_name", "fe_method")}
            try:
                tmpl = resolve_template(method or "")
            except ValueError as e:
                log.warning("Skipping transformation for %s: %s", col, e)
                self.skipped.append({"column": col, "reason": str(e)})
                continue
            merged = dict(DEFAULTS.get(tmpl, {}))
            merged.update(params)
            missing = _missing_params(tmpl, merged)
            if missing:
                msg = f"Missing required parameter: {missing}"
                log.warning("Skipping transformation for %s: %s", col, msg)
                self.skipped.append({"column": col, "reason": msg})
                continue
            self.steps.append(Step(col, method, tmpl, merged))

    def fit(self, df: DataFrame) -> "FittedTemplates":
        req = StatsRequest(df)
        for st in self.steps:
            _needs(st, req, df)
        stats = req.run()
        levels = {}
        for st in self.steps:
            if st.template == "impute_mode" and st.params.get("method") == "first":
                order = st.params["order_by"]
                order = [order] if isinstance(order, str) else order
                v = clean_value(df, st.column)
                row = df.where(v.isNotNull()).orderBy(*order).select(v).limit(1).first()
                stats[("first", st.column, None)] = row[0] if row else None
            if st.template == "dummies" and not st.params.get("sparse"):
                levels[id(st)] = dummy_levels(df.select(_str(df, st.column).alias("v")), st.column, int(st.params["max_levels"]))
        tables = {id(st): small_levels(level_table(st, df)) for st in self.steps if st.template in JOIN_TEMPLATES or _is_sparse(st)}
        return FittedTemplates(self, Fitted(stats, tables, levels))


def _missing_params(tmpl: str, params: dict) -> list[str]:
    req = {"interaction": ["column1", "column2"], "ratio": ["column1", "column2"],
           "target_encoding": ["target_column"]}.get(tmpl, [])
    return [r for r in req if r not in params]


class FittedTemplates:
    def __init__(self, spec: TemplateSet, fit: Fitted):
        self.spec, self.fit = spec, fit

    def transform(self, df: DataFrame, include_original: bool = True) -> DataFrame:
        out_cols: list[Column] = []
        join_steps, bin_steps = [], []
        for st in self.spec.steps:
            if st.template in JOIN_TEMPLATES or _is_sparse(st):
                join_steps.append(st)
            elif st.template == "binning":
                bin_steps.append(st)
            else:
                out_cols.extend(_expr(st, df, self.fit))
        base_cols = list(df.columns)
        res = df.select("*", *out_cols) if out_cols else df
        for st in join_steps:
            if _is_sparse(st):
                res = sparse_dummies(res, self.fit.tables[id(st)], st.column, f"{st.column}_dummies")
            else:
                res = _join_encoding(st, res, self.fit.tables[id(st)])
        for st in bin_steps:
            res = _binning(st, res, self.spec.order_by)
        if not include_original:
            res = res.drop(*base_cols)
        return res


def apply_templates(df: DataFrame, transformations: list[dict], include_original: bool = True,
                    order_by: list[str] | None = None) -> DataFrame:
    """``SELECT *, <template expr> AS <col>_<suffix> ... FROM df``."""
    spec = TemplateSet(transformations, order_by=order_by)
    return spec.fit(df).transform(df, include_original=include_original)
