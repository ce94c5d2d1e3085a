import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsmith.operators import evaluate as V
from tabsmith.operators import knn as KNN


def _preds(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(400):
        y = float(rng.integers(0, 2))
        s = float(np.round(rng.random() * 0.5 + 0.4 * y, 2))
        rows.append((i, "m", y, float(s >= 0.5), s))
        rows.append((i, "never", y, 0.0, 0.1))
    return spark.createDataFrame(rows, "row_key long, model string, label double, prediction double, score double")


def _auc_bruteforce(y, s):
    pos = [b for a, b in zip(y, s) if a == 1]
    neg = [b for a, b in zip(y, s) if a == 0]
    tot = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


def test_auc_exact_ties_and_buckets(spark):
    p = _preds(spark)
    rows = p.where(F.col("model") == "m").collect()
    want = _auc_bruteforce([r["label"] for r in rows], [r["score"] for r in rows])
    one = {r["model"]: r["roc_auc"] for r in V.roc_auc(p, buckets=1).collect()}
    many = {r["model"]: r["roc_auc"] for r in V.roc_auc(p, buckets=7).collect()}
    assert one["m"] == pytest.approx(want) and many["m"] == pytest.approx(want)
    neg = {r["model"]: r["roc_auc"] for r in V.roc_auc(p.withColumn("score", -F.col("score"))).collect()}
    assert neg["m"] == pytest.approx(1 - want)


def test_zero_division_and_confusion(spark):
    p = _preds(spark)
    m = {r["model"]: r for r in V.classification_metrics(p).collect()}
    assert m["never"]["recall"] == pytest.approx(m["never"]["accuracy"])
    cm = V.confusion_matrix(p).where(F.col("model") == "never").collect()
    assert len(cm) == 4 and sum(r["count"] for r in cm) == 400


def test_knn_matches_bruteforce(spark, monkeypatch):
    monkeypatch.setattr(KNN, "BLOCK_ROWS", 40)  # several blocks on each side
    rng = np.random.default_rng(3)
    X = rng.normal(size=(150, 4))
    y = rng.integers(0, 3, size=150).astype(float)
    rows = [(i, [float(v) for v in X[i]], float(y[i])) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, f array<double>, y double")
    train, test = df.where(F.col("id") >= 50), df.where(F.col("id") < 50)
    nn = KNN.neighbours(train, test, "id", "f", "y", k=5)
    got = {r["qid"]: r["prediction"] for r in KNN.knn_classify(nn).collect()}
    for q in range(50):
        d = ((X[50:] - X[q]) ** 2).sum(axis=1)
        idx = np.lexsort((np.arange(50, 150), d))[:5]
        labels, counts = np.unique(y[50:][idx], return_counts=True)
        assert got[q] == labels[np.argmax(counts)]
