"""Models that know weights are fitted on one row of each kind, and are those of the single rows."""

import numpy as np
import pytest
from pyspark.ml import Estimator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors

from tabsmith.operators import models as K

WEIGHTED = {"Logistic Regression", "Decision Tree", "Naive Bayes", "Gradient Boosting", "Boosted Trees Deep", "Boosted Trees Histogram"}


def _rows(spark, n=900, classes=2, regression=False):
    """Few kinds of rows, some of a kind with another label; one kind has 13 rows, fewer than a leaf of the histogram slot."""
    kinds = [99 if i < 13 else i % 9 for i in range(n)]
    label = [(100.0 * (k % 4) + i // 9 % 3 if regression else float((k + (i % 17 == 0)) % classes)) for i, k in enumerate(kinds)]
    rows = [(i, y, Vectors.dense([float(k), float(k % 3), float(k % 2)])) for i, (k, y) in enumerate(zip(kinds, label))]
    return spark.createDataFrame(rows, ["row_key", "label", "features"]).coalesce(1).cache()


def _out(model, rows, column):
    c = vector_to_array(column) if column == "probability" else column
    return np.array([r[0] for r in model.transform(rows).select(c, "row_key").orderBy("row_key").collect()], float)


@pytest.mark.parametrize("classes", [2, 3])
def test_classifiers_of_equal_rows(spark, classes):
    train = _rows(spark, classes=classes)
    equal, n = K.equal_rows(train)
    assert n == 900 and equal.count() <= 10 * classes and equal.agg({"weight": "sum"}).first()[0] == 900
    specs = [s for s in K.classifiers(900, classes, 3, "fast") if K.weighing(s.estimator, n)]
    assert {s.name for s in specs} == WEIGHTED
    for s in specs:
        if classes > 2 and s.name in ("Gradient Boosting", "Boosted Trees Deep"):
            continue            # one-vs-rest like the histogram slot
        assert _out(K.weighing(s.estimator, n).fit(equal), train, "probability") == pytest.approx(_out(s.fit(train), train, "probability"), abs=1e-4), s.name


def test_regressors_of_equal_rows(spark):
    train = _rows(spark, regression=True)
    equal, n = K.equal_rows(train)
    specs = [s for s in K.regressors(900, 3, "fast") if K.weighing(s.estimator, n)]
    assert len(specs) == 5
    for s in specs:
        assert _out(K.weighing(s.estimator, n).fit(equal), train, "prediction") == pytest.approx(_out(s.fit(train), train, "prediction"), abs=1e-6), s.name


def test_fit_loop_takes_equal_rows_once(spark, monkeypatch):
    train, seen, fit = _rows(spark), {}, Estimator.fit
    monkeypatch.setattr(Estimator, "fit", lambda self, df, *a: seen.setdefault(type(self).__name__, []).append(df.count()) or fit(self, df, *a))
    names = ["Decision Tree", "Random Forest", "Boosted Trees Histogram"]
    fitted, preds = K.train_all(K.classifiers(900, 2, 3, "fast"), train, train, names)
    assert list(fitted) == names and preds.count() == 3 * 900
    assert max(seen["DecisionTreeClassifier"] + seen["GBTClassifier"]) <= 20
    assert seen["RandomForestClassifier"] == [900]     # bags draw single rows


def test_rows_without_equals_stay(spark):
    rows = [(i, float(i % 2), Vectors.dense([float(i)])) for i in range(60)]
    train = spark.createDataFrame(rows, ["row_key", "label", "features"])
    assert K.equal_rows(train) is None and K.equal_rows(train.where("false")) is None
    # too few rows for a share of them to stand for a leaf's least number
    hist = next(s.estimator for s in K.classifiers(30, 2, 1, "fast") if s.name == "Boosted Trees Histogram")
    assert K.weighing(hist, 30) is None and K.weighing(hist, 60) is not None
