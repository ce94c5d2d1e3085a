"""Model registries (K1-K10, R1-R9) and the fit loop.

Every entry is a Spark ML estimator under the reference's name, so each can be
fitted, searched (``tune``), saved and applied alike. Spark ML does
the training (tree aggregation, L-BFGS, OWL-QN). Models the library lacks are
built in ``stages``:

* KNN - exact search through a metric index (``knn``);
* SVM - random Fourier features (Rahimi & Recht, 2007) + ``LinearSVC``,
  calibrated by Platt scaling on out-of-fold margins;
* SVR - random Fourier features + Huber ``LinearRegression``;
* boosted-deep / boosted-histogram - ``GBT*`` stand-ins for the two
  external boosting libraries, named as stand-ins. Boosting of more than
  two classes is one-vs-rest with the classes' shares as probabilities.

``profile="reference"`` uses the reference's sizes (100 trees / rounds);
``profile="fast"`` caps trees at 20 and depth at 8 for benchmarking.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any, Callable

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LogisticRegression, NaiveBayes, OneVsRest,
                                       RandomForestClassifier)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import (DecisionTreeRegressor, GBTRegressor, LinearRegression,
                                   RandomForestRegressor)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsmith.functions.expr import right_size
from tabsmith.operators.stages import SEED, ClassShares, KernelMachine, NearestNeighbours


@dataclass
class Spec:
    name: str
    fit: Callable[[DataFrame], Any]
    predict: Callable[[Any, DataFrame], DataFrame]
    engine: str
    estimator: Any = None          # the Spark ML estimator (search, saving)


# -------------------------------------------------------- adapter helpers ---

def predictions(model, rows: DataFrame, binary_score: bool = False) -> DataFrame:
    """(row_key, label, prediction, score); ``score`` is the probability of class 1 of two."""
    out = model.transform(rows)
    if binary_score and "probability" in out.columns:
        score = vector_to_array("probability")[1]
    else:
        score = F.lit(None).cast("double")
    return out.select("row_key", "label", F.col("prediction").cast("double").alias("prediction"), score.alias("score"))


def release(model) -> None:
    """Drop what a fitted model keeps cached."""
    if isinstance(model, PipelineModel):
        for stage in model.stages:
            release(stage)
    elif hasattr(model, "release"):
        model.release()


def _ml(name, est, engine, binary_score=False) -> Spec:
    return Spec(name, lambda tr: est.fit(tr), lambda m, rows: predictions(m, rows, binary_score), engine, est)


# ------------------------------------------------------------- registries ---

#: Depth beyond which rows remember the node that they have reached. Otherwise every pass sends
#: the trees as grown so far to every task; the trees are the same either way.
SHALLOW = 10


def _sizes(profile: str):
    if profile == "fast":
        return dict(trees=20, rounds=20, forest_depth=8, tree_depth=8, iters=50)
    return dict(trees=100, rounds=100, forest_depth=30, tree_depth=30, iters=1000)


def classifiers(n_train: int, num_classes: int, d: int, profile: str = "reference") -> list[Spec]:
    """K1-K9 in the reference's order."""
    s = _sizes(profile)
    deep = {k: s[f"{k}_depth"] > SHALLOW for k in ("tree", "forest")}
    binary = num_classes <= 2

    def boosted(**kw):
        g = GBTClassifier(seed=SEED, **kw)
        return g if binary else Pipeline(stages=[OneVsRest(classifier=g), ClassShares(scale=2.0)])
    return [
        _ml("Logistic Regression", LogisticRegression(maxIter=s["iters"], regParam=1.0 / max(1, n_train),
                                                      elasticNetParam=0.0, standardization=False),
            "LogisticRegression, C=1 as regParam=1/n", True),
        _ml("Decision Tree", DecisionTreeClassifier(maxDepth=s["tree_depth"], maxBins=256, cacheNodeIds=deep["tree"], seed=SEED),
            "DecisionTreeClassifier", True),
        _ml("Random Forest", RandomForestClassifier(numTrees=s["trees"], maxDepth=s["forest_depth"],
                                                    featureSubsetStrategy="sqrt", cacheNodeIds=deep["forest"], seed=SEED),
            "RandomForestClassifier", True),
        _ml("KNN", NearestNeighbours(), "exact k-nearest neighbours (k=5) through a metric index", binary),
        _ml("SVM", KernelMachine(maxIter=s["iters"]), "random Fourier features + LinearSVC + Platt scaling", binary),
        _ml("Gradient Boosting", boosted(maxIter=s["rounds"], maxDepth=3, stepSize=0.1),
            "GBTClassifier (one-vs-rest above two classes)", binary),
        _ml("Naive Bayes", NaiveBayes(modelType="gaussian"), "NaiveBayes gaussian", True),
        _ml("Boosted Trees Deep", boosted(maxIter=s["rounds"], maxDepth=6, stepSize=0.3),
            "stand-in for the reference's XGBoost slot: GBT depth 6, step 0.3", binary),
        _ml("Boosted Trees Histogram", boosted(maxIter=s["rounds"], maxDepth=5, stepSize=0.1,
                                               minInstancesPerNode=20, maxBins=255),
            "stand-in for the reference's LightGBM slot: GBT depth 5, 255 bins, 20 rows per leaf", binary),
    ]


def regressors(n_train: int, d: int, profile: str = "reference") -> list[Spec]:
    """R1-R8 in the reference's order."""
    s = _sizes(profile)
    deep = {k: s[f"{k}_depth"] > SHALLOW for k in ("tree", "forest")}
    solver = "normal" if d <= 4096 else "l-bfgs"
    return [
        _ml("Linear Regression", LinearRegression(solver=solver, regParam=0.0), "LinearRegression"),
        _ml("Decision Tree Regressor", DecisionTreeRegressor(maxDepth=s["tree_depth"], maxBins=256, cacheNodeIds=deep["tree"], seed=SEED),
            "DecisionTreeRegressor"),
        _ml("Random Forest Regressor", RandomForestRegressor(numTrees=s["trees"], maxDepth=s["forest_depth"],
                                                             featureSubsetStrategy="all", cacheNodeIds=deep["forest"], seed=SEED),
            "RandomForestRegressor"),
        _ml("KNN Regressor", NearestNeighbours(regression=True), "exact k-nearest neighbours (k=5) through a metric index"),
        _ml("SVR", KernelMachine(regression=True, maxIter=s["iters"]), "random Fourier features + Huber linear regression (kernel Huber)"),
        _ml("Gradient Boosting Regressor", GBTRegressor(maxIter=s["rounds"], maxDepth=3, stepSize=0.1, seed=SEED),
            "GBTRegressor"),
        _ml("Boosted Trees Deep Regressor", GBTRegressor(maxIter=s["rounds"], maxDepth=6, stepSize=0.3, seed=SEED),
            "stand-in for the reference's XGBoost slot"),
        _ml("Boosted Trees Histogram Regressor",
            GBTRegressor(maxIter=s["rounds"], maxDepth=5, stepSize=0.1, minInstancesPerNode=20, maxBins=255, seed=SEED),
            "stand-in for the reference's LightGBM slot"),
    ]


# ------------------------------------------------------------- equal rows ---

def equal_rows(train: DataFrame, features: str = "features", label: str = "label") -> tuple[DataFrame, int] | None:
    """(cached rows of label, features and ``weight``, the number of equal rows
    that each stands for; rows of ``train``), or None where most rows have no equals."""
    f = vector_to_array(features)
    seen = train.agg(F.count("*").alias("n"), F.approx_count_distinct(F.xxhash64(label, f), 0.02).alias("d"), F.max(F.size(f)).alias("width")).first()
    if not seen["n"] or 2 * seen["d"] > seen["n"]:
        return None
    rows = train.groupBy(F.col(label), f.alias("f")).agg(F.count("*").cast("double").alias("weight"))
    rows = right_size(rows, seen["d"], seen["width"] + 2, label, "f", trees=True)
    return rows.select(label, array_to_vector("f").alias(features), "weight").persist(StorageLevel.MEMORY_AND_DISK), seen["n"]


def weighing(est, n: int):
    """``est`` for rows of a ``weight``, ``n`` in all: its model is that of the single
    rows. None where it can't be: bags draw single rows, other stages know no weights."""
    if isinstance(est, Pipeline):
        first, *rest = est.getStages()
        return (w := weighing(first, n)) and Pipeline(stages=[w, *rest])
    if isinstance(est, OneVsRest):
        return (w := weighing(est.getClassifier(), n)) and OneVsRest(classifier=w, weightCol="weight")
    if est is None or not est.hasParam("weightCol") or isinstance(est, (RandomForestClassifier, RandomForestRegressor)):
        return None
    extra = {est.weightCol: "weight"}
    if est.hasParam("minInstancesPerNode") and (least := est.getOrDefault("minInstancesPerNode")) > 1:
        # that parameter counts weighted rows once; half a row less, as the share is multiplied again
        share = (least - 0.5) / n
        if share >= 0.5:
            return None
        extra |= {est.minInstancesPerNode: 1, est.minWeightFractionPerNode: share}
    return est.copy(extra)


def train_all(specs: list[Spec], train: DataFrame, test: DataFrame, only: list[str] | None = None,
              progress: Callable[[int, int, str], None] | None = None, parallelism: int = 3):
    """Fit each model on one cached training frame and predict the
    test rows. Where most rows have equals, models that know weights are fitted
    on one row of each kind. Up to ``parallelism`` models are fitted at once from driver
    threads (their Spark jobs share the cluster, as ``CrossValidator`` does);
    each model's predictions are cached as soon as they exist. Returns
    (fitted by name, long predictions ``(row_key, model, label, prediction,
    score)``)."""
    from concurrent.futures import ThreadPoolExecutor
    chosen = [s for s in specs if only is None or s.name in only]
    equal = equal_rows(train) if any(weighing(s.estimator, float("inf")) for s in chosen) else None

    def one(i_spec):
        i, spec = i_spec
        if progress:
            progress(i, len(chosen), spec.name)
        weighted = equal and weighing(spec.estimator, equal[1])
        m = weighted.fit(equal[0]) if weighted else spec.fit(train)
        p = spec.predict(m, test).select(
            "row_key", F.lit(spec.name).alias("model"), "label", "prediction", "score")
        p = p.persist(StorageLevel.MEMORY_AND_DISK)
        p.count()
        return spec.name, m, p

    with ThreadPoolExecutor(max_workers=max(1, min(parallelism, len(chosen)))) as pool:
        done = list(pool.map(one, enumerate(chosen)))
    if equal:
        equal[0].unpersist()
    fitted, preds = {}, None
    for name, m, p in done:              # registry order
        fitted[name] = m
        preds = p if preds is None else preds.unionByName(p)
    return fitted, preds
