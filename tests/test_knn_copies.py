"""Equal training rows: a search carries k of each, and few answers reach the rows by broadcast."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from tabsmith.operators import knn as KNN
from tabsmith.operators.stages import NearestNeighbours
from tests.test_knn_index import by_pairs, found, frame


@pytest.mark.parametrize("metric", KNN.METRICS)
def test_copies_beyond_k_are_not_searched(spark, metric):
    rng = np.random.default_rng(3)
    X = rng.integers(0, 3, (900, 2)).astype(float)          # nine points, about a hundred rows each
    Q = np.concatenate((X[:4], X[:4] + 0.4))
    index = KNN.build_index(frame(spark, X), "id", "f", "y", metric, cells=4)
    few = index.nearest(5)
    assert few.rows == few.table.count() == 45 and index.rows == 900
    counted = spark.sparkContext.accumulator(0)
    nn = KNN.search(index, frame(spark, Q), "id", "f", 5, counted=counted)
    assert found(nn) == by_pairs(X, Q, 5, metric)
    assert 0 < counted.value <= 2 * 45 * len(Q)
    assert found(KNN.search(index, frame(spark, Q), "id", "f", 40)) == by_pairs(X, Q, 40, metric)   # as many as are asked for
    index.release()
    assert not few.table.is_cached and not index.held


def test_single_rows_stay(spark):
    X = np.random.default_rng(4).random((300, 2))
    index = KNN.build_index(frame(spark, X), "id", "f", "y", cells=4)
    assert index.nearest(5) is index


@pytest.mark.parametrize("regression", [True, False])
def test_rows_are_not_shuffled_for_few_answers(spark, regression):
    rows = [(i, float(i % 4 // 2), Vectors.dense([float(i % 4)])) for i in range(400)]
    train = spark.createDataFrame(rows, ["row_key", "label", "features"]).cache()
    model = NearestNeighbours(regression=regression).fit(train)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = model.transform(train)
        assert "SortMergeJoin" not in out._jdf.queryExecution().toString()
        assert out.where("prediction != label").count() == 0 and out.count() == 400
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        model.release()
