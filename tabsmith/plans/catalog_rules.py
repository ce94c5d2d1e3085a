"""Registered queries whose models SQL can check: fits on ``rule_orders``,
where a rule decides the target with a wide margin; saving, loading and
scoring of any model; neighbours and fold scores that SQL computes itself.

The fits use the fast profile (20 trees or rounds): the rule needs no more.
"""

from __future__ import annotations

import json
import uuid
from functools import lru_cache

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from tabsmith.operators import knn as KNN
from tabsmith.operators import models as K
from tabsmith.operators import split as D
from tabsmith.operators import tune as G
from tabsmith.operators.stages import NearestNeighbours
from tabsmith.plans import automl
from tabsmith.plans.catalog import rounded
from tabsmith.session import checkpoint_dir
from tabsmith.sources import fixtures as X

RULE_QUERIES = {}
BINARY = ["signal", "priority"]
FAMILY = ["first_axis", "second_axis", "priority"]
AMOUNT = ["step", "priority"]


TARGETS = {"binary": (BINARY, "target"), "family": (FAMILY, "family"), "amount": (AMOUNT, "amount")}


@lru_cache(maxsize=4)
def _rule_prepared(spark, sf: str, kind: str):
    columns, target = TARGETS[kind]
    return automl.prepare_data(X.rule_orders(spark, sf).select("o_orderkey", *columns, target), target, ["o_orderkey"])


@lru_cache(maxsize=32)
def _rule_run(spark, sf: str, kind: str, only: tuple | None = None):
    """The run over all models, or over those that a query asks for."""
    return automl.train_and_rank(_rule_prepared(spark, sf, kind), "fast", list(only) if only else None)


CLASSIFIERS = {"logistic": "Logistic Regression", "tree": "Decision Tree", "forest": "Random Forest", "knn": "KNN", "svm": "SVM",
               "gbt": "Gradient Boosting", "naive_bayes": "Naive Bayes", "gbt_deep": "Boosted Trees Deep", "gbt_hist": "Boosted Trees Histogram"}
REGRESSORS = {"linear": "Linear Regression", "tree": "Decision Tree Regressor", "forest": "Random Forest Regressor", "knn": "KNN Regressor",
              "gbt": "Gradient Boosting Regressor", "gbt_deep": "Boosted Trees Deep Regressor",
              "gbt_hist": "Boosted Trees Histogram Regressor"}


def level(prediction):
    """The level of ``amount`` that a prediction is nearest to."""
    return F.round((prediction - 1010) / 100).cast("int")


def _classifier(kind, name):
    def run(spark, sf):
        p = _rule_run(spark, sf, kind, (name,)).predictions
        return p.select(F.col("row_key").alias("o_orderkey"), "label", "prediction")
    return run


def _regressor(name):
    def run(spark, sf):
        p = _rule_run(spark, sf, "amount", (name,)).predictions
        return p.select(F.col("row_key").alias("o_orderkey"), "label", level(F.col("prediction")).alias("level"))
    return run


for _key, _name in CLASSIFIERS.items():
    RULE_QUERIES[f"rule_clf_{_key}"] = _classifier("binary", _name)
    RULE_QUERIES[f"rule_multiclass_{_key}"] = _classifier("family", _name)
for _key, _name in REGRESSORS.items():
    RULE_QUERIES[f"rule_reg_{_key}"] = _regressor(_name)


def q_rule_leaderboard(spark, sf):
    """L1 of a whole run: all models find the rule, so names rank."""
    return rounded(_rule_run(spark, sf, "binary").leaderboard)


def q_rule_summary(spark, sf):
    """Q1."""
    return rounded(_rule_run(spark, sf, "binary").summary())


def q_rule_evaluation(spark, sf):
    """Seven metrics a model, the matrix and the class report as text."""
    return rounded(_rule_run(spark, sf, "binary").evaluation_long())


def q_rule_best_parameters(spark, sf):
    """Winner and feature names as the saved JSON holds them."""
    row = _rule_run(spark, sf, "binary").best_parameters()
    return row.select("problem_type", "selected_model", F.get_json_object("payload", "$.best_model.accuracy").cast("double").alias("accuracy"),
                      F.get_json_object("payload", "$.input_feature_names").alias("input_features"),
                      (F.size(F.from_json(F.get_json_object("payload", "$.parameters"), "map<string,string>")) > 0).alias("has_parameters"))


def q_dirty_dataset_report(spark, sf):
    """Q2 on a table with nulls, copies and empty rows."""
    return _dirty_prep(spark, sf).dataset_report(spark)


def q_dirty_preprocessing_report(spark, sf):
    """Q3 on the same table: cleaning, filling, encoding, scaling, selection."""
    return _dirty_prep(spark, sf).preprocessing_report(spark)


@lru_cache(maxsize=2)
def _dirty_prep(spark, sf: str):
    return automl.prepare_data(X.dirty_orders(spark, sf), "target", fit_on="all").prep


# ------------------------------------------------------- saving and scoring ---

def _saved(spark, sf: str, kind: str, name: str | None = None) -> str:
    path = f"{checkpoint_dir(spark).rstrip('/')}/bundles/{kind}-{uuid.uuid4().hex}"
    _rule_run(spark, sf, kind, None if name is None else (name,)).save(path, name)
    return path


def _raw(spark, sf, columns):
    return X.rule_orders(spark, sf).select("o_orderkey", *columns)


def _scored(kind, columns, name):
    """Save, load, score every raw row: the class, or the level of the amount."""
    def run(spark, sf):
        model = automl.load_scoring_model(_saved(spark, sf, kind, name))
        out = level(F.col("prediction")).alias("level") if kind == "amount" else F.col("predicted_label")
        return model.transform(_raw(spark, sf, columns)).select("o_orderkey", out)
    return run


# the winner, and one of each kind of stage; tests save and load every entry
for _key, _name in {"winner": None, "svm": "SVM", "knn": "KNN"}.items():
    RULE_QUERIES[f"score_saved_{_key}"] = _scored("binary", BINARY, _name)
for _key in ("svm", "gbt"):
    RULE_QUERIES[f"score_saved_multiclass_{_key}"] = _scored("family", FAMILY, CLASSIFIERS[_key])
for _key in ("forest", "knn"):
    RULE_QUERIES[f"score_saved_reg_{_key}"] = _scored("amount", AMOUNT, REGRESSORS[_key])


def q_score_probabilities(spark, sf):
    """Every classifier gives each raw row a probability of every class;
    on three classes: the likeliest class and the sum (to six places)."""
    out, r = None, _rule_run(spark, sf, "family")
    classes = F.array(*[F.lit(x["name"]) for x in r.prep.class_names().orderBy("label").collect()])
    for name in CLASSIFIERS.values():
        scored = r.scoring_model(name).transform(_raw(spark, sf, FAMILY))
        p = vector_to_array("probability")
        part = scored.select("o_orderkey", F.lit(name).alias("model"), F.get(classes, (F.array_position(p, F.array_max(p)) - 1).cast("int")).alias("likeliest"),
                             F.round(F.aggregate(p, F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.size(p).alias("n_classes"))
        out = part if out is None else out.unionByName(part)
    return out


def _streamed(spark, sf: str):
    """A stream of raw rows, numbers as text and some of them no numbers, through the saved KNN."""
    from tabsmith.streaming.score import rejected, score_stream
    path = _saved(spark, sf, "binary", "KNN")
    work = f"{checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    bad = F.when(F.col("o_orderkey") % 11 == 0, F.lit("n/a")).when(F.col("o_orderkey") % 13 == 0, F.concat("priority", F.lit("?")))
    raw = _raw(spark, sf, BINARY).withColumn("signal", F.coalesce(bad, F.col("signal").cast("string")))
    raw.repartition(3).write.parquet(f"{work}/source")
    scored = score_stream(spark, path, f"{work}/source", f"{work}/sink", raw.schema, f"{work}/ckpt", "o_orderkey", ["signal"], f"{work}/rejects")
    return scored, rejected(spark, f"{work}/rejects", "o_orderkey")


def q_score_stream(spark, sf):
    """P5: accepted rows of the stream with their prediction."""
    return _streamed(spark, sf)[0]


def q_score_stream_rejects(spark, sf):
    """Rejected values of the stream."""
    return _streamed(spark, sf)[1]


# ------------------------------------------------------ neighbours and folds ---

def _emb_parts(spark, sf):
    emb = X.table(spark, sf, "embeddings").cache()
    out, _ = D.assign_split(emb, ["vec_id"], None, stratify=False)
    return out.where(F.col("__part") == "train"), out.where(F.col("__part") == "test")


def _answer(metric, weights, regress=False):
    def run(spark, sf):
        train, test = _emb_parts(spark, sf)
        nn = KNN.neighbours(train, test, "vec_id", "embedding", "label", metric=metric, cells=32)
        out = KNN.knn_regress(nn, weights, metric) if regress else KNN.knn_classify(nn, weights, metric)
        return rounded(out.select(F.col("qid").alias("vec_id"), "prediction"))
    return run


RULE_QUERIES["knn_manhattan"] = _answer("manhattan", "uniform")
RULE_QUERIES["knn_distance_weighted"] = _answer("euclidean", "distance")
RULE_QUERIES["knn_regress_weighted"] = _answer("manhattan", "distance", True)


@lru_cache(maxsize=4)
def _folds_knn(spark, sf: str):
    emb = X.table(spark, sf, "embeddings").select(F.col("vec_id").alias("row_key"), F.col("label").cast("double").alias("label"),
                                                  array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    return G.tune_model(NearestNeighbours(), G.CLASSIFICATION_GRIDS["KNN"], emb, "classification", "grid")


@lru_cache(maxsize=4)
def _folds_linear(spark, sf: str):
    docs = X.labelled_docs(spark, sf).select(F.col("doc_id").alias("row_key"), F.col("n_chars").cast("double").alias("label"), "n_words")
    docs = VectorAssembler(inputCols=["n_words"], outputCol="features").transform(docs)
    return G.tune_model(LinearRegression(solver="normal", regParam=0.0), G.REGRESSION_GRIDS["Linear Regression"], docs, "regression", "grid")


def _named(spark, res):
    names = spark.createDataFrame([(i, json.dumps(p, sort_keys=True)) for i, p in enumerate(res.params)], "setting int, params string")
    return rounded(res.folds.join(F.broadcast(names), "setting").select("params", "fold", "score", "rows"))


def q_fold_scores_knn(spark, sf):
    """The whole KNN grid (16 settings, 3 folds) on ``embeddings``."""
    return _named(spark, _folds_knn(spark, sf))


def q_fold_scores_linear(spark, sf):
    """The linear grid on one feature, every fold's R2."""
    return _named(spark, _folds_linear(spark, sf))


def q_search_results(spark, sf):
    """Best setting and its average of both searches."""
    rows = [(kind, json.dumps(r.best_params, sort_keys=True), float(r.best_score), len(r.results))
            for kind, r in (("knn", _folds_knn(spark, sf)), ("linear", _folds_linear(spark, sf)))]
    return rounded(spark.createDataFrame(rows, "search string, best_params string, best_score double, settings int"))


for _n, _f in list(globals().items()):
    if _n.startswith("q_") and callable(_f):
        RULE_QUERIES[_n[2:]] = _f
