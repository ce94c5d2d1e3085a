"""Neighbour settings of one metric share a search; tasks of a search follow the pairs they compare."""

import numpy as np
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tabsmith.operators import knn as KNN
from tabsmith.operators import models as K
from tabsmith.operators import tune as G
from tabsmith.operators.stages import NearestNeighbours


def _rows(spark, n):
    rng = np.random.default_rng(5)
    rows = [(i, float(rng.integers(0, 3)), Vectors.dense(np.round(rng.normal(size=2), 1).tolist())) for i in range(n)]
    return spark.createDataFrame(rows, ["row_key", "label", "features"]).cache()


def test_grid_searches_once_a_metric_and_fold(spark, monkeypatch):
    train, calls, search = _rows(spark, 60), [], KNN.search
    est = NearestNeighbours()
    maps = G.distinct_maps(est, [{"n_neighbors": k, "weights": w, "metric": m} for m in ("euclidean", "manhattan")
                                                 for w in ("uniform", "distance") for k in (3, 7)], 60)
    monkeypatch.setattr(KNN, "search", lambda *a, **k: calls.append(1) or search(*a, **k))
    got = {(r["setting"], r["fold"]): (r["score"], r["rows"]) for r in G.fold_scores(est, maps, train, "classification").collect()}
    assert len(calls) == 2 * G.FOLDS
    data = train.withColumn("__fold", F.floor(G.hash_unit("row_key", seed=G.SEED) * G.FOLDS).cast("int"))
    for s in (0, 3, 6):
        model = est.copy(maps[s]).fit(data.where("__fold != 1"))
        out = K.predictions(model, data.where("__fold = 1"))
        assert got[s, 1] == tuple(out.agg(G.fold_score("classification").alias("s"), F.count("*")).first())


def test_tasks_follow_the_pairs(spark, monkeypatch):
    train, test = _rows(spark, 400), _rows(spark, 300)
    plain = sorted(map(tuple, KNN.neighbours(train, test, "row_key", "features", "label", cells=4).select("qid", "tid", "rank").collect()))
    monkeypatch.setattr(KNN, "TASK_PAIRS", 1000)
    index = KNN.build_index(train, "row_key", "features", "label", cells=4)
    asked = KNN._as_array(test.select(F.col("row_key").alias("qid"), F.col("features").alias("f")), "f") \
        .withColumn("bound", F.lit(float("inf"))).withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(len(index.pivots) - 1))))
    assert KNN._round(index, asked, 5, 50, None).rdd.getNumPartitions() > 16
    got = KNN.neighbours(train, test, "row_key", "features", "label", block_rows=50, cells=4)
    assert sorted(map(tuple, got.select("qid", "tid", "rank").collect())) == plain


def test_no_prediction_is_kept(spark, monkeypatch):
    """A fit's predictions are one aggregate: nothing is cached for them, no plan unites those of all fits."""
    from pyspark.ml.regression import LinearRegression
    kept, persist = [], type(spark.range(1)).persist
    train = _rows(spark, 60)
    train.count()
    monkeypatch.setattr(type(train), "persist", lambda self, *a: kept.append(self.columns) or persist(self, *a))
    est = LinearRegression(solver="normal")
    scores = G.fold_scores(est, G.distinct_maps(est, [{"fit_intercept": x} for x in (True, False)], 60), train, "regression")
    assert not [c for c in kept if "prediction" in c]
    got = scores.collect()
    assert len(got) == 6 and sum(r["rows"] for r in got) == 120
    assert "InMemory" not in scores._jdf.queryExecution().toString()


def test_manhattan_distances_are_those_of_plain_sums(monkeypatch):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(37, 9)), rng.normal(size=(50, 9))
    plain = np.zeros((37, 50))
    for j in range(9):
        plain += np.abs(a[:, j, None] - b[None, :, j])
    for cells in (1, 120, 1 << 14):
        monkeypatch.setattr(KNN, "CACHE_CELLS", cells)
        assert (KNN._far(a, b, "manhattan") == plain).all()
    assert KNN._far(a[:0], b, "manhattan").shape == (0, 50) and KNN._far(a, b[:0], "manhattan").shape == (37, 0)
