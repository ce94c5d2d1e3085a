"""Rows with equals are weighted rows; training frames have partitions of bounded size; a rule query fits its own model."""

import numpy as np
import pytest
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors

from tabsmith.functions.expr import right_size
from tabsmith.operators import stages as S


def _copies(spark, n, kinds):
    rows = [(i, float((i % kinds) % 2 if i % 23 else 1), Vectors.dense([float(i % kinds), float(i % kinds % 3)])) for i in range(n)]
    return spark.createDataFrame(rows, ["row_key", "label", "features"]).repartition(3, "row_key").cache()


def test_equal_rows_cost_once_and_weigh_their_number(spark, monkeypatch):
    train = _copies(spark, 3000, 8)
    seen = []
    monkeypatch.setattr(S, "right_size", lambda df, rows, *a, **k: seen.append(rows) or right_size(df, rows, *a, **k))
    model = S.KernelMachine(kernel="linear", maxIter=500).fit(train)
    assert seen and max(seen) <= 8 * 2 * S.PLATT_FOLDS
    plain = LinearSVC(maxIter=500, tol=S.MARGIN_TOL, regParam=1 / 3000).fit(train.select("label", "features"))
    got, want = (m.transform(train).select("row_key", vector_to_array("rawPrediction")[1].alias("m")).orderBy("row_key").toPandas()["m"].to_numpy()
                 for m in (model, plain))
    assert np.abs(got - want).max() < 0.05 * np.abs(want).max()


def test_penalty_of_weights():
    assert S._penalty(0.1, {0: (50.0, 50.0), 1: (50.0, 50.0)}) == pytest.approx(0.1)
    x = np.repeat([1.0, 2.0, 5.0], [10, 20, 30])
    w = np.array([10.0, 20.0, 30.0])
    n, squares = w.sum(), (w ** 2).sum()
    spread = ((x - x.mean()) ** 2).sum()
    # the deviation that the solver takes, against that of single rows
    assert S._penalty(1.0, {0: (n, squares)}) == pytest.approx((spread / (n - 1)) / (spread / (n - squares / n)))


def test_partitions_are_bounded_both_ways(spark):
    one = spark.range(1000).coalesce(1)
    assert right_size(one, 1_000_000, 40, "id").rdd.getNumPartitions() == 10
    assert right_size(one, 1_000_000, 4, "id").rdd.getNumPartitions() == 1
    assert right_size(one, 1_000_000, 4, "id", trees=True).rdd.getNumPartitions() == 64
    assert right_size(spark.range(1000).repartition(8), 1000, 4, "id", trees=True).rdd.getNumPartitions() == 1


def test_single_rows_stay_as_they_are(spark):
    rows = [(i, float(i % 2), Vectors.dense([float(i)])) for i in range(50)]
    train = spark.createDataFrame(rows, ["row_key", "label", "features"])
    got, n, distinct, held, high = S.KernelMachine()._weighted(train)
    assert (n, distinct, high, got.count()) == (50, 50, 1, 50)
    assert sum(x[0] for x in held.values()) == sum(x[1] for x in held.values()) == 50


def test_rule_query_fits_its_own_model(spark):
    from tabsmith.plans import catalog_rules as R
    sf = "/root/testdata/sf0.001"
    out = R.RULE_QUERIES["rule_clf_tree"](spark, sf)
    assert set(R._rule_run(spark, sf, "binary", ("Decision Tree",)).fitted) == {"Decision Tree"}
    assert out.where("label != prediction").count() == 0 and out.count() > 0
