"""Two-stage "ML-ready" feature plan (PL1-PL8).

Stage 1 imputes every planned column (first imputation wins), stage 2 applies one
more template to the imputed column; the output holds only the derived columns and
the auto-encoded ``target``.  Every method name is resolved through the template
registry, which also gives its place in the order and its suffix; a name that it
does not know is reported in ``skipped``.

``fit`` runs one aggregation for every scalar statistic of every column (plus one
grouped table per encoded column); ``transform`` is a few projections and, for label,
frequency and target encoding, left joins with those tables.  Because ``transform`` only
needs fitted values, it also runs on new data and on streaming DataFrames.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import canonical_str, clean_value, is_missing, sanitize_column_name, sanitize_columns
from ..functions.fitting import StatsRequest
from ..functions.numbering import global_row_number, join_null_safe, small_levels
from ..operators.transforms import (DEFAULTS, JOIN_TEMPLATES, TRUTHY, Fitted, Step, _binning, _expr, dummy_levels,
                                    _missing_params, _needs, level_table, resolve_template)
from ..session import ensure_checkpoint_dir

#: (place in the order, suffix) per template; every other template has (2, no suffix)
FAMILY = {
    **{t: (1, "imputed") for t in ("impute_mean", "impute_median", "impute_mode", "impute_constant")},
    **{t: (2, "scaled") for t in ("standardization", "normalization", "robust_scaling")},
    "log_transformation": (2, "log"),
    "sqrt_transformation": (2, "sqrt"),
    **{t: (3, "encoded") for t in ("label_encoding", "frequency_encoding", "target_encoding", "binary_encoding",
                                   "hash_encoding", "one_hot_encoding")},
}
#: buckets of hash and one-hot encoding inside a plan (fixed value)
PLAN_BUCKETS = 50


def _family(step: Step) -> tuple[int, str | None]:
    return FAMILY.get(step.template, (2, None))


def _imputes(step: Step) -> bool:
    return _family(step)[0] == 1


class FeaturePlan:
    """PL1: ``FeaturePlan(transformations, target_column).fit(df).transform(df)``.

    ``chain=True`` applies the steps after the imputation one after the other, each
    fitted on what the step before it gives; by default the last one replaces the
    earlier ones and works on the imputed column.  Invalid column names are made valid
    in the plan and in every DataFrame it sees.
    """

    def __init__(self, transformations: list[dict], target_column: str | None = None,
                 include_target: bool = True, exact_median: bool = True,
                 keep: list[str] | None = None, chain: bool = False):
        self.target = sanitize_column_name(target_column) if target_column else target_column
        self.include_target = include_target
        self.exact_median = exact_median
        self.keep = [sanitize_column_name(k) for k in keep or []]
        self.chain = chain
        self.skipped: list[dict] = []
        by_column: dict[str, list[Step]] = defaultdict(list)
        for t in transformations:
            step = self._step(t)
            if step:
                by_column[step.column].append(step)
        if not by_column:
            raise ValueError("No valid transformations provided")
        self.grouped = {c: sorted(steps, key=lambda s: _family(s)[0]) for c, steps in by_column.items()}

    def _step(self, t: dict) -> Step | None:
        col, method = t.get("column_name", ""), t.get("fe_method", "")

        def skip(reason):
            self.skipped.append({"column": col, "reason": reason})

        if not col or not method:
            return skip("Missing column_name or fe_method")
        try:
            template = resolve_template(method)
        except ValueError as e:
            return skip(str(e))
        params = {**DEFAULTS.get(template, {}), **{k: v for k, v in t.items() if k not in ("column_name", "fe_method")}}
        if template in ("hash_encoding", "one_hot_encoding"):
            params["num_buckets"] = t.get("num_buckets", PLAN_BUCKETS)
        if template == "target_encoding":
            if not self.target:
                return skip("target_encoding needs target_column")
            params.setdefault("target_column", self.target)
        if template == "binning":
            params["order_by"] = [params["order_by"]] if isinstance(params.get("order_by"), str) else params.get("order_by")
            if not params["order_by"] or not set(params["order_by"]) <= set(self.keep):
                return skip("binning needs order_by, a row id among the kept columns")
        missing = _missing_params(template, params)
        if missing:
            return skip(f"Missing required parameter: {missing}")
        return Step(sanitize_column_name(col), method, template, params)

    # PL7
    def lineage(self, spark) -> DataFrame:
        rows = []
        for col, steps in self.grouped.items():
            if col == self.target:
                continue
            rows.append((col, self._output_name(col, steps), [s.method for s in steps]))
        if self.target and self.include_target:
            rows.append((self.target, "target", ["auto_binary_encoding"]))
        return spark.createDataFrame(
            rows, "original_column string, output_column string, transformations array<string>")

    def _output_name(self, col: str, steps: list[Step]) -> str:
        suffixes = list(dict.fromkeys(s for s in (_family(x)[1] for x in steps) if s))
        return "_".join([col, *suffixes])

    def columns(self) -> list[str]:
        return [c for c in self.grouped if c != self.target]

    def layers(self) -> list[dict[str, Step]]:
        """Steps after the imputation, by column: one layer, or as many as the longest chain."""
        rest = {c: [s for s in self.grouped[c] if not _imputes(s)] for c in self.columns()}
        if not self.chain:
            rest = {c: steps[-1:] for c, steps in rest.items()}
        depth = max((len(steps) for steps in rest.values()), default=0)
        return [{c: steps[i] for c, steps in rest.items() if len(steps) > i} for i in range(depth)]

    def imputations(self) -> dict[str, Step]:
        return {c: s for c in self.columns() for s in reversed(self.grouped[c]) if _imputes(s)}

    def fit(self, df: DataFrame) -> "FittedPlan":
        df = sanitize_columns(df)
        fitted = FittedPlan(self)
        layers = self.layers()
        req = StatsRequest(df)
        for col, s in self.imputations().items():
            if s.template == "impute_median":
                req.need("median_lower" if self.exact_median else "median_approx", col)
            else:
                _needs(s, req, df)
        if layers and not self.chain:
            for s in layers[0].values():
                _needs(s, req, df)
        fitted.stats = req.run()
        now = fitted.stage1(df)
        for layer in layers:
            stats = fitted.stats
            if self.chain:
                req = StatsRequest(now)
                for s in layer.values():
                    _needs(_on_imputed(s), req, now)
                stats = {(k, c.removesuffix("_imputed"), q): v for (k, c, q), v in req.run().items()}
            tables = {c: small_levels(self._levels(s, now)) for c, s in layer.items() if s.template in JOIN_TEMPLATES}
            levels = {c: dummy_levels(now.select(canonical_str(now, f"{c}_imputed").alias("v")), c, int(s.params["max_levels"]))
                      for c, s in layer.items() if s.template == "dummies"}
            fitted.layers.append((layer, stats, tables, levels))
            if self.chain:
                now = fitted.apply(now, fitted.layers[-1])
        return fitted

    def _levels(self, step: Step, now: DataFrame) -> DataFrame:
        s = _on_imputed(step)
        if step.template == "label_encoding":
            # without the template's empty string: NULL is a level of its own and sorts first
            levels = now.select(canonical_str(now, s.column).alias("_key")).distinct()
            coded = global_row_number(levels, [F.col("_key").asc_nulls_first()], name="_rn")
            ensure_checkpoint_dir(now.sparkSession)
            return coded.select("_key", (F.col("_rn") - 1).alias("_code"))
        if step.template == "target_encoding":
            s = replace(s, params={**s.params, "target_column": f"{self.target}_raw"})
        return level_table(s, now)


def _on_imputed(step: Step) -> Step:
    params = {k: f"{v}_imputed" if k in ("column1", "column2") else v for k, v in step.params.items()}
    return replace(step, column=f"{step.column}_imputed", params=params)


class FittedPlan:
    """Fitted values; ``layers`` holds (steps, statistics, level tables, dummy levels) per layer."""

    def __init__(self, plan: FeaturePlan):
        self.plan = plan
        self.stats: dict = {}
        self.layers: list[tuple[dict, dict, dict, dict]] = []

    # stage 1 ---------------------------------------------------------------
    def _impute_expr(self, df: DataFrame, col: str) -> Column:
        v = clean_value(df, col)
        s = self.plan.imputations().get(col)
        if s is None:
            return v
        if s.template == "impute_median":
            fill = self.stats[("median_lower" if self.plan.exact_median else "median_approx", col, None)]
            return F.coalesce(v, F.lit(fill).cast(df.schema[col].dataType))
        if s.template == "impute_mode" and s.params.get("method", "mode") != "mode":
            raise ValueError("a plan imputes the true mode only")
        return _expr(s, df, Fitted(self.stats, {}, {}))[0]

    def _partners(self) -> set[str]:
        """Columns that an interaction or a ratio reads without being planned themselves."""
        named = {s.params[k] for steps in self.plan.grouped.values() for s in steps for k in ("column1", "column2")
                 if k in s.params}
        return named - set(self.plan.columns())

    def _flagged(self) -> list[str]:
        return [c for c in self.plan.columns() if any(s.template == "missing_indicator" for s in self.plan.grouped[c])]

    def stage1(self, df: DataFrame) -> DataFrame:
        cols = [self._impute_expr(df, c).alias(f"{c}_imputed") for c in self.plan.columns()]
        cols += [clean_value(df, c).alias(f"{c}_imputed") for c in sorted(self._partners())]
        cols += [is_missing(df, c).cast("int").alias(f"{c}_was_missing") for c in self._flagged()]
        keep = [F.col(k) for k in self.plan.keep]
        if self.plan.target:
            keep.append(F.col(self.plan.target).alias(f"{self.plan.target}_raw"))
        return df.select(*keep, *cols)

    # stage 2 ---------------------------------------------------------------
    def outputs(self, now: DataFrame, layer: tuple) -> tuple[DataFrame, dict[str, list[tuple[str, Column]]]]:
        """The (suffix, expression) pairs of a layer per column, and the rows with the joined codes."""
        steps, stats, tables, levels = layer
        out, found = now, {}
        for col, step in steps.items():
            imp = f"{col}_imputed"
            if step.template in JOIN_TEMPLATES:
                table = tables[col].withColumnRenamed("_code", f"_code_{col}")
                out = join_null_safe(out.withColumn("_key", canonical_str(now, imp)), table, ["_key"], how="left").drop("_key")
                found[col] = [("", F.col(f"_code_{col}"))]
            elif step.template == "binning":
                out = _binning(_on_imputed(step), out, step.params["order_by"])
                found[col] = [("", F.col(f"{imp}_bin"))]
            elif step.template == "missing_indicator":
                found[col] = [("", F.col(f"{col}_was_missing"))]
            else:
                s = _on_imputed(step)
                keyed = {(k, f"{c}_imputed", q): v for (k, c, q), v in stats.items()}
                exprs = _expr(s, now, Fitted(keyed, {}, {id(s): levels.get(col, [])}))
                names = now.select(*exprs).columns
                found[col] = [("" if len(exprs) == 1 else n.replace(f"{imp}_", "", 1), e) for n, e in zip(names, exprs)]
        return out, found

    def apply(self, now: DataFrame, layer: tuple) -> DataFrame:
        """A chained layer: every column is replaced by what its step gives (of several columns, the first)."""
        out, found = self.outputs(now, layer)
        return out.withColumns({f"{c}_imputed": pairs[0][1] for c, pairs in found.items()}).select(*now.columns)

    def transform(self, df: DataFrame) -> DataFrame:
        now = self.stage1(sanitize_columns(df))
        for layer in self.layers[:-1]:
            now = self.apply(now, layer)
        out, found = self.outputs(now, self.layers[-1]) if self.layers else (now, {})
        finals: list[Column] = [F.col(k) for k in self.plan.keep]
        for col in self.plan.columns():
            name = self.plan._output_name(col, self.plan.grouped[col])
            for suffix, e in found.get(col, [("", F.col(f"{col}_imputed"))]):
                finals.append(e.alias(f"{name}_{suffix}" if suffix else name))
        if self.plan.target and self.plan.include_target:
            raw = f"{self.plan.target}_raw"
            finals.append(F.when(canonical_str(out, raw).isin(TRUTHY), 1).otherwise(0).alias("target"))
        return out.select(*finals)

    def validate(self, df_out: DataFrame) -> DataFrame:
        """Null count and numeric-ness of every output column (one aggregation)."""
        from ..functions.columns import is_numeric
        aggs = [F.struct(F.lit(c).alias("column_name"),
                         F.count_if(F.col(c).isNull()).alias("null_count"),
                         F.lit(is_numeric(df_out, c)).alias("is_numeric")).alias(f"_s{i}")
                for i, c in enumerate(df_out.columns)]
        row = df_out.agg(*aggs)
        return row.select(F.explode(F.array(*[F.col(f"_s{i}") for i in range(len(aggs))]))
                          .alias("s")).select("s.*")


def plan_from_recommendations(recs: DataFrame) -> list[dict]:
    """PL8: recommendation rows ``(feature, technique, ...)`` -> transformation list.

    The recommendation table has one row per (column, technique): O(columns).
    """
    rows = recs.select("feature", "technique", "step").orderBy("feature", "step").collect()
    return [{"column_name": r["feature"], "fe_method": r["technique"]} for r in rows]
