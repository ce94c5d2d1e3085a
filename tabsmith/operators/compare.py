"""Leaderboards, top-k and display (L1-L7), feature importance
and tuned-model selection (G8).

Inputs are per-model tables (one row per model, a few dozen rows), so the
global windows here rank a bounded number of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabsmith.operators.evaluate import (classification_metrics, regression_metrics, roc_auc)

ERROR_METRICS = {"mae", "mse", "rmse"}
TOP_N = 3
SCORE_MODELS = 5
TOP_FEATURES = 10
HIGHLIGHT_FEATURES = 8


def leaderboard_classification(pred: DataFrame) -> DataFrame:
    """L1: accuracy, precision, recall, F1, ROC-AUC; rank by accuracy desc, model asc."""
    m = classification_metrics(pred).join(roc_auc(pred), "model", "left")
    w = Window.orderBy(F.desc("accuracy"), F.asc("model"))
    return m.withColumn("rank", F.row_number().over(w))


def leaderboard_regression(pred: DataFrame) -> DataFrame:
    """L2: rank by R2 desc, then RMSE asc, then model."""
    m = regression_metrics(pred)
    w = Window.orderBy(F.desc_nulls_last("r2"), F.asc("rmse"), F.asc("model"))
    return m.withColumn("rank", F.row_number().over(w))


def top_models(board: DataFrame, n: int = TOP_N) -> DataFrame:
    """L3."""
    return board.where(F.col("rank") <= n)


def best_model(board: DataFrame) -> DataFrame:
    """L4."""
    return board.where(F.col("rank") == 1)


def leaderboard_by_metric(board: DataFrame, metrics: list[str]) -> DataFrame:
    """One rank per metric; error metrics rank ascending (the reference's
    browser sorts every metric descending, which ranks the worst model first
    for errors - a deviation kept on record)."""
    long = board.select("model", F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])))
    order = F.when(F.col("metric").isin(*ERROR_METRICS), F.col("value")).otherwise(-F.col("value"))
    w = Window.partitionBy("metric").orderBy(order.asc_nulls_last(), F.asc("model"))
    return long.withColumn("rank", F.row_number().over(w))


def score_distribution(board: DataFrame, metric: str, percent: bool) -> DataFrame:
    """The first five models and their primary metric (x100 for classification)."""
    v = F.col(metric) * (100.0 if percent else 1.0)
    return board.where(F.col("rank") <= SCORE_MODELS).select("model", "rank", v.alias("score"))


def display_value(c, percent: bool):
    """Percent with one decimal for classification, three decimals
    otherwise, an em dash when there is no value."""
    if percent:
        txt = F.format_string("%.1f%%", F.round(c * 100, 1))
    else:
        txt = F.format_string("%.3f", F.round(c, 3))
    return F.when(c.isNull(), F.lit("—")).otherwise(txt)


def leaderboard_display(board: DataFrame, metrics: list[str], percent: bool) -> DataFrame:
    return board.select("model", "rank", *[display_value(F.col(m), percent).alias(m) for m in metrics])


# ------------------------------------------------------------ importance ---

def feature_importance(raw: DataFrame, top: int = TOP_FEATURES) -> DataFrame:
    """Importances normalised to sum 1 per model (left as they are when
    the sum is 0), top 10 by importance, then only those above 0.
    ``raw`` is ``(model, feature, importance)``."""
    tot = Window.partitionBy("model")
    norm = raw.withColumn("s", F.sum("importance").over(tot)).withColumn(
        "importance", F.when(F.col("s") != 0, F.col("importance") / F.col("s")).otherwise(F.col("importance")))
    w = Window.partitionBy("model").orderBy(F.desc("importance"), F.asc("feature"))
    ranked = norm.withColumn("rank", F.row_number().over(w))
    return ranked.where((F.col("rank") <= top) & (F.col("importance") > 0)) \
        .select("model", "feature", "importance", "rank")


def importance_highlights(importance: DataFrame, winner: DataFrame, n: int = HIGHLIGHT_FEATURES) -> DataFrame:
    """The winner's top 8 features as percentages. ``winner`` is a one-row
    frame with a ``model`` column (e.g. ``best_model``)."""
    return importance.join(F.broadcast(winner.select("model")), "model") \
        .where(F.col("rank") <= n).select("model", "feature", (F.col("importance") * 100).alias("percent"), "rank")


def model_importances(spark, fitted: dict, features: list[str]) -> DataFrame:
    """Raw importance table of fitted Spark models: tree importances, or the
    mean absolute coefficient over classes. Models with neither are left out."""
    import numpy as np
    rows = []
    for name, m in fitted.items():
        vals = None
        if hasattr(m, "featureImportances"):
            vals = np.asarray(m.featureImportances.toArray(), dtype=float)
        elif hasattr(m, "coefficientMatrix"):
            vals = np.abs(m.coefficientMatrix.toArray()).mean(axis=0)
        elif hasattr(m, "coefficients"):
            vals = np.abs(np.asarray(m.coefficients.toArray(), dtype=float))
        if vals is None or len(vals) != len(features):
            continue
        rows += [(name, f, float(v)) for f, v in zip(features, vals)]
    return spark.createDataFrame(rows, "model string, feature string, importance double")


# --------------------------------------------------------- keep-if-better ---

def select_tuned(original: DataFrame, tuned: DataFrame, metric: str, higher_is_better: bool = True) -> DataFrame:
    """The tuned model replaces the original only when strictly better;
    the result is ranked again."""
    o = original.select("model", F.col(metric).alias("orig"))
    t = tuned.select("model", F.col(metric).alias("tuned"))
    j = o.join(t, "model", "left")
    better = (F.col("tuned") > F.col("orig")) if higher_is_better else (F.col("tuned") < F.col("orig"))
    better = F.coalesce(better, F.lit(False))
    out = j.select("model", F.when(better, "tuned").otherwise("original").alias("version"),
                   F.when(better, F.col("tuned")).otherwise(F.col("orig")).alias(metric))
    order = F.desc(metric) if higher_is_better else F.asc(metric)
    return out.withColumn("rank", F.row_number().over(Window.orderBy(order, F.asc("model"))))
