"""Modelling (M1-M8): split, scale, train with pyspark.ml, score, judge the fit.

Splits are hash-ranked per class (layout independent, exact per-class
sizes); scaling uses population statistics of the training rows; metrics are
single aggregations, and ROC AUC is exact (average ranks for ties) via a
cumulative count over distinct scores computed with range partitioning.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml import classification as MC
from pyspark.ml import regression as MR
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clean_value, hash_bigint, is_numeric
from ..functions.numbering import global_row_number
from ..functions.selection import mark_first
from ..session import ensure_checkpoint_dir, shuffle_partitions
from .target import few_distinct, problem_type

# --- M1 ------------------------------------------------------------------------


def split(df: DataFrame, t: str, test: float = 0.2, seed: int = 42, stratify: bool = True,
          row_id: list[str] | None = None, col: str = "split") -> DataFrame:
    """M1: add ``split`` = 'test' | 'train'.

    Stratified: inside every class the ``round(test * count)`` rows with the
    smallest ``md5(row_id | seed)`` are test rows.  Otherwise a hash threshold.
    """
    keys = row_id or [f.name for f in df.schema.fields
                      if f.dataType.typeName() not in ("array", "map", "struct", "binary")]
    h = hash_bigint(*[F.col(k) for k in keys], F.lit(seed))
    if not stratify:
        return df.withColumn(col, F.when(h.cast("double") / F.lit(float(1 << 60)) < test, "test")
                             .otherwise("train"))
    marked = mark_first(df, [t], [h, *[F.col(k) for k in keys]], lambda sizes: f"round(_size * {float(test)!r}D)", "_test")
    return marked.withColumn(col, F.when(F.col("_test"), "test").otherwise("train")).drop("_test")


# --- M2 ------------------------------------------------------------------------


def fit_standard_scale(train: DataFrame, cols: list[str]) -> dict:
    """M2 fit: mean and population std per column on the training rows (std 0 -> 1)."""
    row = train.agg(*[F.avg(clean_value(train, c).cast("double")).alias(f"m{i}") for i, c in enumerate(cols)],
                    *[F.stddev_pop(clean_value(train, c).cast("double")).alias(f"s{i}")
                      for i, c in enumerate(cols)]).first()
    out = {}
    for i, c in enumerate(cols):
        s = row[f"s{i}"]
        out[c] = (row[f"m{i}"], 1.0 if (s is None or s == 0) else s)
    return out


def apply_standard_scale(df: DataFrame, params: dict) -> DataFrame:
    """M2 transform: (x - mean) / std for every fitted column (a projection)."""
    return df.withColumns({c: (clean_value(df, c).cast("double") - F.lit(m)) / F.lit(s)
                           for c, (m, s) in params.items()})


# --- M4 ------------------------------------------------------------------------

# Model names accepted per problem type.
CLASSIFIERS = ["logistic_regression", "decision_tree", "random_forest", "xgboost", "lightgbm",
               "catboost", "svm", "naive_bayes", "deep_neural_network", "knn"]
REGRESSORS = ["linear_regression", "ridge_regression", "lasso_regression", "decision_tree_regressor",
              "random_forest_regressor", "xgboost_regressor", "lightgbm_regressor",
              "catboost_regressor"]
# Models whose features are scaled.
SCALED = {"logistic_regression", "svm", "knn", "deep_neural_network",
          "linear_regression", "ridge_regression", "lasso_regression"}


def make_estimator(name: str, problem: str, n_train: int, n_features: int, n_classes: int = 2,
                   label: str = "label", features: str = "features", seed: int = 42):
    """M4: name -> pyspark.ml estimator (unknown or wrong-type names raise).

    xgboost, lightgbm and catboost are one gradient-boosted tree estimator under three names."""
    kw = {"labelCol": label, "featuresCol": features}
    if problem == "classification":
        if name not in CLASSIFIERS:
            raise ValueError(f"Unknown classification model: {name}")
        if name == "logistic_regression":
            return MC.LogisticRegression(maxIter=1000, regParam=1.0 / max(n_train, 1),
                                         standardization=False, **kw)
        if name == "decision_tree":
            return MC.DecisionTreeClassifier(maxDepth=30, seed=seed, **kw)
        if name == "random_forest":
            return MC.RandomForestClassifier(numTrees=100, maxDepth=30, seed=seed, **kw)
        if name in ("xgboost", "lightgbm", "catboost"):
            return MC.GBTClassifier(seed=seed, **kw)
        if name == "svm":
            return MC.LinearSVC(**kw)
        if name == "naive_bayes":
            return MC.NaiveBayes(modelType="gaussian", **kw)
        return MC.MultilayerPerceptronClassifier(layers=[n_features, 100, 50, n_classes],
                                                 maxIter=500, seed=seed, **kw)
    if name not in REGRESSORS:
        raise ValueError(f"Unknown regression model: {name}")
    if name == "linear_regression":
        return MR.LinearRegression(regParam=0.0, **kw)
    if name == "ridge_regression":
        return MR.LinearRegression(elasticNetParam=0.0, regParam=1.0 / max(n_train, 1),
                                   standardization=False, **kw)
    if name == "lasso_regression":
        return MR.LinearRegression(elasticNetParam=1.0, regParam=1.0, standardization=False, **kw)
    if name == "decision_tree_regressor":
        return MR.DecisionTreeRegressor(maxDepth=30, seed=seed, **kw)
    if name == "random_forest_regressor":
        return MR.RandomForestRegressor(numTrees=100, maxDepth=30, seed=seed, **kw)
    return MR.GBTRegressor(seed=seed, **kw)


# --- M5 / M6 -------------------------------------------------------------------


def roc_auc(pred: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Exact ROC AUC (ties averaged), one row ``roc_auc``.

    Distinct scores are range partitioned; negatives below each score come from
    per-partition totals (one row per partition) plus a running sum inside the
    partition, so no task ever holds more than one range of scores.
    """
    spark = pred.sparkSession
    ensure_checkpoint_dir(spark)
    y = F.col(label).cast("double")
    g = pred.groupBy(F.col(score).cast("double").alias("_s")).agg(
        F.sum(F.when(y == 1, 1.0).otherwise(0.0)).alias("_p"),
        F.sum(F.when(y == 1, 0.0).otherwise(1.0)).alias("_n"))
    ranged = (g.repartitionByRange(shuffle_partitions(spark), "_s")
              .withColumn("_pid", F.spark_partition_id()).checkpoint(eager=True))
    tot = ranged.groupBy("_pid").agg(F.sum("_n").alias("_tn")).collect()
    offs, acc = {}, 0.0
    for r in sorted(tot, key=lambda r: r["_pid"]):
        offs[r["_pid"]] = acc
        acc += r["_tn"]
    if not offs:
        return spark.createDataFrame([(None,)], "roc_auc double")
    # one row per partition; counts are doubles, so their products do not overflow
    table = F.broadcast(spark.createDataFrame(sorted(offs.items()), "_pid int, _off double"))
    w = Window.partitionBy("_pid").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    below = F.col("_off") + F.coalesce(F.sum("_n").over(w), F.lit(0.0))
    contrib = ranged.join(table, "_pid").withColumn("_c", F.col("_p") * (below + F.col("_n") * 0.5))
    return contrib.agg(F.try_divide(F.sum("_c"), F.sum("_p") * F.sum("_n")).alias("roc_auc"))


def classification_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction",
                           score: str | None = "score") -> DataFrame:
    """M5: accuracy, precision, recall, F1 (positive class 1), ROC AUC, confusion cells."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    cm = pred.agg(F.count_if((y == 0) & (p == 0)).alias("true_negative"),
                  F.count_if((y == 0) & (p == 1)).alias("false_positive"),
                  F.count_if((y == 1) & (p == 0)).alias("false_negative"),
                  F.count_if((y == 1) & (p == 1)).alias("true_positive"),
                  F.count(F.lit(1)).alias("_n"), F.count_if(y == p).alias("_ok"))
    tp, fp, fn = F.col("true_positive"), F.col("false_positive"), F.col("false_negative")
    prec = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0))
    rec = F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0))
    out = cm.select((F.col("_ok") / F.col("_n")).alias("accuracy"), prec.cast("double").alias("precision"),
                    rec.cast("double").alias("recall"), f1.cast("double").alias("f1_score"),
                    "true_negative", "false_positive", "false_negative", "true_positive")
    if score:
        out = out.crossJoin(roc_auc(pred, label, score))
    return out


def regression_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """M6: mae, mse, rmse, r2 = 1 - sse/sst (constant truth: 1 if perfect else 0)."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    s = pred.agg(F.avg(F.abs(y - p)).alias("mae"), F.avg((y - p) * (y - p)).alias("mse"),
                 F.sum((y - p) * (y - p)).alias("_sse"), F.var_pop(y).alias("_vy"),
                 F.count(F.lit(1)).alias("_n"))
    sst = F.col("_vy") * F.col("_n")
    r2 = F.when(sst > 0, 1 - F.col("_sse") / sst).when(F.col("_sse") == 0, 1.0).otherwise(0.0)
    return s.select("mae", "mse", F.sqrt("mse").alias("rmse"), r2.alias("r2_score"))


def fit_behaviour(train_score: Column, test_score: Column) -> Column:
    """M7: underfitting / overfitting / good_fit from the two scores."""
    return (F.when((train_score < UNDER) & (test_score < UNDER), "underfitting")
            .when((train_score > OVER_TRAIN) & (test_score < OVER_TEST), "overfitting").otherwise("good_fit"))


# --- M3 / M8 -------------------------------------------------------------------


# Scores that tell a fit apart.
UNDER, OVER_TRAIN, OVER_TEST = 0.7, 0.9, 0.75


@dataclass
class TrainResult:
    model: PipelineModel | None     #: fill + scale + assemble + estimator; None for knn, which has no model
    scaler: dict
    metrics: DataFrame
    predictions: DataFrame
    problem: str


def _score_col(model_name: str) -> Column:
    if model_name == "svm":
        raw = vector_to_array(F.col("rawPrediction"))
        return 1 / (1 + F.exp(-F.element_at(raw, 2)))
    return F.element_at(vector_to_array(F.col("probability")), 2)


def _prepared(feats: list[str], scaler: dict, fill_missing: float | None) -> SQLTransformer:
    """Pipeline stage that adds ``_x0, _x1, ...``: the features as doubles, filled and scaled.

    It is saved with the model, so raw rows are scored as the training rows were."""
    exprs = []
    for i, c in enumerate(feats):
        v = f"nanvl(CAST(`{c}` AS DOUBLE), CAST(NULL AS DOUBLE))"
        if fill_missing is not None:
            v = f"coalesce({v}, {float(fill_missing)!r}D)"
        if c in scaler:
            mean, std = scaler[c]
            v = f"({v} - ({float(mean or 0.0)!r}D)) / {float(std)!r}D"
        exprs.append(f"{v} AS _x{i}")
    return SQLTransformer(statement=f"SELECT *, {', '.join(exprs)} FROM __THIS__")


def train(df: DataFrame, t: str, model_name: str, features: list[str] | None = None,
          seed: int = 42, row_id: list[str] | None = None, test: float = 0.2,
          fill_missing: float | None = None) -> TrainResult:
    """M3: split -> scale (train stats) -> fit -> predict -> metrics -> fit check.

    The row id is no feature by default.  A missing feature value is an error unless
    ``fill_missing`` says what to use instead.  The input columns stay as they are in
    ``predictions``.
    """
    problem = problem_type(df, t)
    feats = features or [c for c in df.columns if c != t and c not in (row_id or []) and is_numeric(df, c)]
    base = df.where(clean_value(df, t).isNotNull())
    parts = split(base, t, test=test, seed=seed, stratify=problem == "classification", row_id=row_id)
    parts = parts.withColumn("label", F.col(t).cast("double"))
    tr = parts.where(F.col("split") == "train")
    scaler = fit_standard_scale(tr, feats) if model_name in SCALED else {}
    stages = [_prepared(feats, scaler, fill_missing)]
    names = [f"_x{i}" for i in range(len(feats))]
    model = None
    if model_name == "knn":
        if problem != "classification":
            raise ValueError("Unknown regression model: knn")
        pred = _knn_both(stages[0].transform(parts), names, row_id)
    else:
        n_classes = len(few_distinct(base, t, 1000) or []) if problem == "classification" and is_numeric(base, t) else 2
        est = make_estimator(model_name, problem, tr.count(), len(feats), max(n_classes, 2), seed=seed)
        model = Pipeline(stages=[*stages, VectorAssembler(inputCols=names, outputCol="features"), est]).fit(tr)
        pred = model.transform(parts)
        if problem == "classification":
            pred = pred.withColumn("score", _score_col(model_name))
    pred = pred.drop(*names)
    metrics, key = ((classification_metrics, "accuracy") if problem == "classification" else (regression_metrics, "r2_score"))
    m = {s: metrics(pred.where(F.col("split") == s)) for s in ("train", "test")}
    both = (m["test"].crossJoin(m["train"].select(F.col(key).alias("train_score")))
            .withColumn("fit_status", fit_behaviour(F.col("train_score"), F.col(key)))
            .withColumn("model_name", F.lit(model_name)))
    return TrainResult(model, scaler, both, pred, problem)


def _knn_both(rows: DataFrame, names: list[str], row_id: list[str] | None) -> DataFrame:
    """All rows with the vote of their 5 nearest training rows (a training row votes for others only)."""
    from .neighbours import knn_predict
    order = [F.col(c) for c in (row_id or [])] or [F.xxhash64(*[c for c in rows.columns if c != "split"])]
    numbered = global_row_number(rows, order, name="_n")
    out = knn_predict(numbered.where("split = 'train'"), numbered, "label", names)
    return out.drop("_n")


def save_model(result: TrainResult, path: str) -> None:
    """M8: the whole pipeline (fill, scale, assemble, estimator), written with overwrite."""
    if result.model is None:
        raise ValueError("a knn result has no model to save")
    result.model.write().overwrite().save(f"{path}/model")


def load_model(path: str) -> PipelineModel:
    """M8: the pipeline; it scores raw rows."""
    return PipelineModel.load(f"{path}/model")
