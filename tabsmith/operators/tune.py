"""Hyper-parameter search.

A fold engine over any estimator of the registries, KNN, SVM, SVR and one-vs-rest
included: folds by key hash (repeatable under any partitioning), every (setting,
fold) a fit of its own (neighbour settings of a metric share one search), some at a time, and its score from one
aggregate over the predictions held out, of which nothing is kept. The result is the long table (setting,
fold, score, rows) beside the averages. The reference's grids are translated to
Spark parameters; random search draws ``n_iter`` settings without replacement
from those that differ in Spark, with a seeded generator.
"""

from __future__ import annotations

import itertools
import random

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark import StorageLevel
from pyspark.ml import Pipeline
from pyspark.ml.classification import OneVsRest
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsmith.functions.expr import hash_unit
from tabsmith.operators import models as K
from tabsmith.operators.stages import NearestNeighbours

FOLDS = 3
N_ITER = 5
SEED = 42
PARALLELISM = 2

# Fixed values of the reference: search spaces per model.
CLASSIFICATION_GRIDS = {
    "Logistic Regression": {"C": [0.01, 0.1, 1, 10], "solver": ["liblinear", "lbfgs"], "max_iter": [500, 1000]},
    "Decision Tree": {"criterion": ["gini", "entropy"], "max_depth": [None, 5, 10, 20],
                      "min_samples_split": [2, 5, 10], "min_samples_leaf": [1, 2, 4]},
    "Random Forest": {"n_estimators": [50, 100], "criterion": ["gini", "entropy"], "max_depth": [None, 10, 20],
                      "min_samples_split": [2, 5], "min_samples_leaf": [1, 2]},
    "KNN": {"n_neighbors": [3, 5, 7, 9], "weights": ["uniform", "distance"], "metric": ["euclidean", "manhattan"]},
    "SVM": {"C": [0.1, 1, 10], "kernel": ["linear", "rbf"], "gamma": ["scale", "auto"]},
    "Naive Bayes": {"var_smoothing": [1e-9, 1e-8, 1e-7]},
    "Gradient Boosting": {"n_estimators": [100, 200], "learning_rate": [0.01, 0.1], "max_depth": [3, 5]},
    "XGBoost": {"n_estimators": [50, 100], "learning_rate": [0.01, 0.1, 0.2], "max_depth": [3, 5, 7],
                "subsample": [0.8, 1.0], "colsample_bytree": [0.8, 1.0]},
    "LightGBM": {"n_estimators": [100, 200], "learning_rate": [0.01, 0.1], "max_depth": [-1, 10, 20],
                 "num_leaves": [31, 50]},
}
REGRESSION_GRIDS = {
    "Linear Regression": {"fit_intercept": [True, False]},
    "Decision Tree Regressor": {"criterion": ["squared_error", "friedman_mse", "absolute_error"],
                                "max_depth": [None, 5, 10, 20], "min_samples_split": [2, 5, 10],
                                "min_samples_leaf": [1, 2, 4]},
    "Random Forest Regressor": {"n_estimators": [50, 100], "max_depth": [None, 10, 20],
                                "min_samples_split": [2, 5], "min_samples_leaf": [1, 2]},
    "KNN Regressor": {"n_neighbors": [3, 5, 7, 9], "weights": ["uniform", "distance"],
                      "metric": ["euclidean", "manhattan"]},
    "SVR": {"C": [0.1, 1, 10], "kernel": ["linear", "rbf"], "gamma": ["scale", "auto"]},
    "Gradient Boosting Regressor": {"n_estimators": [100, 200], "learning_rate": [0.01, 0.1], "max_depth": [3, 5]},
    "XGBoost Regressor": {"n_estimators": [50, 100], "learning_rate": [0.01, 0.1, 0.2], "max_depth": [3, 5, 7],
                          "subsample": [0.8, 1.0], "colsample_bytree": [0.8, 1.0]},
    "LightGBM Regressor": {"n_estimators": [100, 200, 300], "learning_rate": [0.01, 0.1],
                           "max_depth": [-1, 10, 20], "num_leaves": [31, 50]},
}
# our registry names for the two boosting slots
SLOT_NAMES = {"Boosted Trees Deep": "XGBoost", "Boosted Trees Histogram": "LightGBM",
              "Boosted Trees Deep Regressor": "XGBoost Regressor",
              "Boosted Trees Histogram Regressor": "LightGBM Regressor"}
# cheap models are searched exhaustively, the rest at random
GRID_SEARCHED = {"Decision Tree", "KNN", "Naive Bayes", "Linear Regression",
                 "Decision Tree Regressor", "KNN Regressor"}


def grid_size(grid: dict) -> int:
    n = 1
    for v in grid.values():
        n *= len(v)
    return n


def reference_settings(grid: dict) -> list[dict]:
    keys = list(grid)
    return [dict(zip(keys, vals)) for vals in itertools.product(*[grid[k] for k in keys])]


def random_settings(grid: dict, n_iter: int = N_ITER, seed: int = SEED) -> list[dict]:
    """n_iter distinct settings drawn with a seeded generator."""
    allset = reference_settings(grid)
    rng = random.Random(seed)
    return rng.sample(allset, min(n_iter, len(allset)))


def searchable(est) -> dict:
    """Parameters by name, those of the estimators inside a pipeline or one-vs-rest too."""
    if isinstance(est, Pipeline):
        return {n: p for stage in est.getStages() for n, p in searchable(stage).items()}
    if isinstance(est, OneVsRest):
        return searchable(est.getClassifier())
    return {p.name: p for p in est.params}


def to_param_map(est, setting: dict, n_train: int) -> dict:
    """Translate one reference setting to Spark parameters of ``est``;
    settings without a counterpart (solver, min_samples_split,
    var_smoothing: Spark fixes the Gaussian variance floor)
    are dropped, and settings that become equal are searched once."""
    pm = {}
    names = searchable(est)

    def put(name, value):
        if name in names:
            pm[names[name]] = value
    for k, v in setting.items():
        if k == "C":
            put("C", float(v))
            put("regParam", 1.0 / (v * max(1, n_train)))
        elif k == "n_neighbors":
            put("k", int(v))
        elif k in ("weights", "metric", "kernel"):
            put(k, v)
        elif k == "gamma":
            if setting.get("kernel") != "linear":    # a linear kernel has none
                put("gamma", v)
        elif k in ("max_iter",):
            put("maxIter", int(v))
        elif k == "n_estimators":
            put("numTrees", int(v))
            put("maxIter", int(v))
        elif k == "max_depth":
            # an unbounded depth under a bound on leaves is the depth that many leaves need
            leaves = (int(setting["num_leaves"]) - 1).bit_length() if "num_leaves" in setting else 30
            put("maxDepth", leaves if v in (None, -1) else min(int(v), leaves))
        elif k == "min_samples_leaf":
            put("minInstancesPerNode", int(v))
        elif k == "criterion":
            put("impurity", v if v in ("gini", "entropy") else "variance")
        elif k == "learning_rate":
            put("stepSize", float(v))
        elif k == "subsample":
            put("subsamplingRate", float(v))
        elif k == "colsample_bytree":
            put("featureSubsetStrategy", "all" if v >= 1.0 else str(v))
        elif k == "fit_intercept":
            put("fitIntercept", bool(v))
    return pm


def distinct_maps(est, settings: list[dict], n_train: int) -> list[dict]:
    """The settings as parameters of ``est``, equal ones once."""
    maps, seen = [], set()
    for s in settings:
        pm = to_param_map(est, s, n_train)
        key = tuple(sorted((p.name, str(v)) for p, v in pm.items()))
        if key not in seen:
            seen.add(key)
            maps.append(pm)
    return maps


def fold_score(problem_type: str) -> Column:
    """Accuracy, or R2 (null where the labels do not vary), of a group of predictions."""
    if problem_type == "classification":
        return F.avg((F.col("label") == F.col("prediction")).cast("double"))
    error = F.col("label") - F.col("prediction")
    return 1.0 - F.try_divide(F.avg(error * error), F.var_pop("label"))


def fits_at_once(train: DataFrame) -> int:
    """Small frames leave cores idle: as many fits run together as their partitions leave room for, two at least."""
    cores = train.sparkSession.sparkContext.defaultParallelism
    return max(PARALLELISM, cores // max(1, train.rdd.getNumPartitions()))


def fold_scores(est, maps: list[dict], train: DataFrame, problem_type: str, folds: int = FOLDS, seed: int = SEED,
                parallelism: int | None = None) -> DataFrame:
    """(setting, fold, score, rows) of every setting on every fold. A fit's predictions
    go into its scores at once: none are cached, and no plan holds those of all fits."""
    data = train.withColumn("__fold", F.floor(hash_unit("row_key", seed=seed) * folds).cast("int")).persist(StorageLevel.MEMORY_AND_DISK)

    def parts(fold):
        return data.where(F.col("__fold") != fold), data.where(F.col("__fold") == fold)

    def held(out, setting):
        return out.select(F.lit(setting).alias("setting"), "label", F.col("prediction").cast("double").alias("prediction"))

    def scored(out, fold):
        rows = out.groupBy("setting").agg(fold_score(problem_type).alias("score"), F.count("*").alias("rows")).collect()
        return [(r["setting"], fold, r["score"], r["rows"]) for r in rows]

    def one(job):
        (setting,), fold = job
        fitted, asked = parts(fold)
        model = est.copy(maps[setting]).fit(fitted)
        out = scored(held(model.transform(asked), setting), fold)
        K.release(model)
        return out

    def shared(job):
        """Neighbour settings of one metric: the k nearest are the first of more, so the largest search serves all."""
        settings, fold = job
        fitted, asked = parts(fold)
        model = est.copy(maps[settings[0]]).fit(fitted)
        answers = {s: model.copy({model.getParam(p.name): v for p, v in maps[s].items()}) for s in settings}
        rows, nn = model.found(asked, max(m.getOrDefault("k") for m in answers.values()))
        rows, nn = (x.persist(StorageLevel.MEMORY_AND_DISK) for x in (rows.select("label", "__query"), nn))
        out = scored(reduce(DataFrame.unionByName, [held(m.answered(rows, nn.where(F.col("rank") <= m.getOrDefault("k"))), s) for s, m in answers.items()]), fold)
        rows.unpersist()
        nn.unpersist()
        K.release(model)
        return out

    groups = [(s,) for s in range(len(maps))]
    if isinstance(est, NearestNeighbours):
        metric = lambda s: est.copy(maps[s]).getOrDefault("metric")
        groups = [tuple(s for s in range(len(maps)) if metric(s) == m) for m in dict.fromkeys(map(metric, range(len(maps))))]
    jobs = [(g, f) for g in groups for f in range(folds)]
    with ThreadPoolExecutor(max_workers=parallelism or fits_at_once(train)) as pool:
        done = [x for part in pool.map(shared if isinstance(est, NearestNeighbours) else one, jobs) for x in part]
    data.unpersist()
    return train.sparkSession.createDataFrame(done, "setting int, fold int, score double, rows bigint")


@dataclass
class Search:
    """Every fold's score, the averages in the order tried, and the refitted winner."""
    params: list[dict]                # by setting, as text
    folds: DataFrame                  # (setting, fold, score, rows)
    averages: list[float | None]
    best: int
    best_model: object

    @property
    def best_params(self) -> dict:
        return self.params[self.best]

    @property
    def best_score(self) -> float | None:
        return self.averages[self.best]

    @property
    def results(self) -> list[tuple[dict, float | None]]:
        return list(zip(self.params, self.averages))


def tune_model(est, grid: dict, train: DataFrame, problem_type: str, search: str = "grid",
               n_iter: int = N_ITER, seed: int = SEED, folds: int = FOLDS) -> Search:
    """Score the settings on all folds, refit the best on
    all rows. The first of equal averages wins; a fold without rows, or whose
    labels do not vary (R2), is left out of its average."""
    if search not in ("grid", "random"):
        raise ValueError("Search type must be grid or random")
    maps = distinct_maps(est, reference_settings(grid), train.count())
    if search == "random":   # drawn from settings that differ in Spark
        maps = random.Random(seed).sample(maps, min(n_iter, len(maps)))
    maps = maps or [{}]
    scores = fold_scores(est, maps, train, problem_type, folds, seed)
    mean = {r["setting"]: r["s"] for r in scores.groupBy("setting").agg(F.avg("score").alias("s")).collect()}
    averages = [mean.get(i) for i in range(len(maps))]
    best = max(range(len(maps)), key=lambda i: (averages[i] is not None, averages[i] or 0.0, -i))
    params = [{p.name: str(v) for p, v in pm.items()} for pm in maps]
    return Search(params, scores, averages, best, est.copy(maps[best]).fit(train))
