"""Deep trees are grown without sending them to every pass; they are the same trees."""

import pytest
from pyspark.ml.linalg import Vectors

from tabsmith.operators import models as K


def _rows(spark, n=400):
    rows = [(i, float(i * 37 % 101 > 50), Vectors.dense([float(i * 7 % 97), float(i * 13 % 89), float(i % 5)])) for i in range(n)]
    return spark.createDataFrame(rows, ["row_key", "label", "features"]).repartition(2, "row_key").cache()


@pytest.mark.parametrize("registry,names", [(lambda p: K.classifiers(400, 2, 3, p), ("Decision Tree", "Random Forest")),
                                            (lambda p: K.regressors(400, 3, p), ("Decision Tree Regressor", "Random Forest Regressor"))])
def test_deep_trees_stay_with_the_rows(spark, registry, names):
    rows = _rows(spark)
    for name in names:
        deep, shallow = (next(s.estimator for s in registry(p) if s.name == name) for p in ("reference", "fast"))
        assert deep.getCacheNodeIds() and not shallow.getCacheNodeIds()
        if deep.hasParam("numTrees"):
            deep = deep.copy({deep.numTrees: 5})
        grown, sent = deep.fit(rows), deep.copy({deep.cacheNodeIds: False}).fit(rows)
        text = lambda m: m.toDebugString.split("\n")[1:]
        assert text(grown) == text(sent)
