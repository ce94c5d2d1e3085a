"""The metric index against comparing every pair."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsmith.operators import knn as KNN


def frame(spark, X, y=None, first=0):
    y = np.zeros(len(X)) if y is None else y
    rows = [(first + i, [float(v) for v in x], float(t)) for i, (x, t) in enumerate(zip(X, y))]
    return spark.createDataFrame(rows, "id long, f array<double>, y double")


def by_pairs(X, Q, k, metric):
    out = {}
    for j, q in enumerate(Q):
        d = np.abs(X - q).sum(axis=1) if metric == "manhattan" else ((X - q) ** 2).sum(axis=1)
        out[j] = np.lexsort((np.arange(len(X)), d))[:k].tolist()
    return out


def found(nn):
    out = {}
    for r in nn.orderBy("qid", "rank").collect():
        out.setdefault(r["qid"], []).append(r["tid"])
    return out


def clouds(rng, n, centres, spread=0.05, dims=3):
    at = rng.normal(size=(centres, dims)) * 10
    return at[rng.integers(0, centres, n)] + rng.normal(size=(n, dims)) * spread


@pytest.mark.parametrize("metric", KNN.METRICS)
@pytest.mark.parametrize("shape", ["clouds", "uniform", "ties", "far", "one point"])
def test_equal_to_every_pair(spark, metric, shape):
    rng = np.random.default_rng(7)
    X = {"clouds": clouds(rng, 400, 8), "uniform": rng.random((400, 4)), "ties": rng.integers(0, 4, (400, 2)).astype(float),
         "far": 1e7 + rng.random((400, 3)), "one point": np.ones((400, 2))}[shape]
    Q = X[rng.choice(400, 30)] + (0 if shape in ("ties", "one point") else rng.normal(size=(30, X.shape[1])) * 0.1)
    nn = KNN.neighbours(frame(spark, X), frame(spark, Q), "id", "f", "y", 5, block_rows=70, metric=metric, cells=12)
    assert found(nn) == by_pairs(X, Q, 5, metric)


def test_fewer_rows_than_neighbours_and_no_rows(spark):
    X = np.random.default_rng(1).random((3, 2))
    assert found(KNN.neighbours(frame(spark, X), frame(spark, X), "id", "f", "y", 5, cells=3)) == by_pairs(X, X, 5, "euclidean")
    none = frame(spark, X).where("false")
    assert KNN.neighbours(none, frame(spark, X), "id", "f", "y").collect() == []
    assert KNN.neighbours(frame(spark, X), none, "id", "f", "y").collect() == []
    with pytest.raises(ValueError):
        KNN.build_index(none, "id", "f", "y", "cosine")


def test_few_distances_on_clustered_rows(spark):
    rng = np.random.default_rng(5)
    X, Q = clouds(rng, 4000, 40), None
    Q = X[:300] + 0.01
    counted = spark.sparkContext.accumulator(0)
    nn = KNN.neighbours(frame(spark, X), frame(spark, Q), "id", "f", "y", 5, cells=80, counted=counted)
    assert found(nn) == by_pairs(X, Q, 5, "euclidean")
    assert 0 < counted.value < 0.15 * len(X) * len(Q)


def test_weights(spark):
    X = np.array([[0.0], [1.0], [1.0], [4.0], [9.0]])
    y = np.array([2.0, 1.0, 1.0, 0.0, 0.0])
    nn = KNN.neighbours(frame(spark, X, y), frame(spark, np.array([[0.0], [3.0], [7.0]])), "id", "f", "y", 5).cache()
    vote = lambda **kw: {r["qid"]: r["prediction"] for r in KNN.knn_classify(nn, **kw).collect()}
    assert vote() == {0: 0.0, 1: 0.0, 2: 0.0}                       # two votes each for 0 and 1: the smaller
    assert vote(weights="distance") == {0: 2.0, 1: 0.0, 2: 0.0}     # at no distance one neighbour decides
    mean = {r["qid"]: r["prediction"] for r in KNN.knn_regress(nn, "distance").collect()}
    w = lambda q: np.array([1 / abs(x - q) for x in X[:, 0]])
    assert mean[0] == 2.0 and mean[1] == pytest.approx((w(3) * y).sum() / w(3).sum())
    with pytest.raises(ValueError):
        KNN.knn_regress(nn, "gauss")


def test_a_hot_cell_is_many_tasks(spark):
    X = np.concatenate((np.zeros((500, 2)), np.random.default_rng(2).random((100, 2)) + 5))
    index = KNN.build_index(frame(spark, X), "id", "f", "y", cells=10)
    assert index.sizes.max() >= 500 and index.rows == 600
    nn = KNN.search(index, frame(spark, np.zeros((3, 2))), "id", "f", 5, block_rows=50)
    assert found(nn) == by_pairs(X, np.zeros((3, 2)), 5, "euclidean")
    index.release()
    assert not index.table.is_cached
