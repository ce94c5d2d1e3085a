"""Targets of any number of classes: dictionary, split, grid."""
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from tabsmith.operators import classes as C
from tabsmith.operators import evaluate as V
from tabsmith.operators import split as D


def test_dictionary_is_the_sorted_index(spark, monkeypatch):
    names = sorted({f"c{i * 7919 % 1000:04d}" for i in range(700)} | {"", "é", "Z", "\U0001F600"})
    df = spark.createDataFrame([(n,) for n in names for _ in range(1 + len(n) % 3)] + [(None,)], "y string").repartition(7)
    got = sorted((r["label"], r["value"], r["n"]) for r in C.class_dictionary(df, "y").collect())
    assert [(v, n) for _, v, n in got] == [(n, 1 + len(n) % 3) for n in sorted(names, key=str.encode)]
    assert [x for x, _, _ in got] == [float(i) for i in range(len(names))]
    out = C.labelled(df, "y", C.class_dictionary(df, "y"))
    assert out.count() == df.count() and out.where("label IS NULL").count() == 1
    assert C.class_dictionary(df.where("false"), "y").collect() == []


def test_two_hundred_thousand_classes(spark, monkeypatch):
    """No class reaches the driver, none is in a literal, and beyond the bound none is broadcast."""
    fetched, collect = [], DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: fetched.append(collect(self)) or fetched[-1])
    df = spark.range(1_200_000).select(F.col("id").alias("k"), F.concat(F.lit("c"), F.col("id") % 200_000).alias("y")).cache()
    classes = C.class_dictionary(df, "y")
    out, warnings = D.assign_split(df, ["k"], "y", classes=classes)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" not in plan and len(plan) < 20_000
    tests = out.groupBy("y").agg(F.count_if(F.col("__part") == "test").alias("t")).groupBy("t").count()
    assert not warnings and {r["t"]: r["count"] for r in tests.toLocalIterator()} == {D.n_test_stratified(6): 200_000}
    labels = C.labelled(out, "y", classes).agg(F.count_distinct("label").alias("k"), F.max("label").alias("m")).first()
    assert (labels["k"], labels["m"]) == (200_000, 199_999.0)
    assert max(map(len, fetched)) <= 10


def test_split_equals_ranks_by_hash(spark, monkeypatch):
    monkeypatch.setattr(D, "FINAL_BUCKET_ROWS", 7)       # several levels
    rng = np.random.default_rng(2)
    rows = [(i, None if c == 0 else f"c{c}") for i, c in enumerate(rng.choice(5, 2000, p=[0.05, 0.6, 0.2, 0.1, 0.05]))]
    df = spark.createDataFrame(rows, "k long, y string").cache()
    out, _ = D.assign_split(df, ["k"], "y")
    ranked = df.selectExpr("k", "row_number() OVER (PARTITION BY y ORDER BY md5(concat('42|', k))) AS r", "count(*) OVER (PARTITION BY y) AS n")
    want = {r["k"] for r in ranked.collect() if r["r"] <= D.n_test_stratified(r["n"])}
    assert {r["k"] for r in out.where("__part = 'test'").collect()} == want


@pytest.mark.parametrize("n", [0, 1, 2, 5, 7, 8, 12, 13, 1000003])
def test_sizes_of_the_test_part(spark, n):
    df = spark.createDataFrame([("a", n)], "value string, n long")
    k = F.call_function("div", F.col("n") * 2 + 5, F.lit(10))
    assert df.select(k).first()[0] == D.n_test_stratified(n)


def test_a_grid_of_many_classes(spark, monkeypatch):
    monkeypatch.setattr(V, "GRID_BLOCK", 16)
    n = 300
    pred = spark.range(n).select(F.lit("m").alias("model"), F.col("id").cast("double").alias("label"),
                                 ((F.col("id") * 7) % n).cast("double").alias("prediction"))
    grid = V.confusion_matrix(pred)
    assert grid.count() == n * n and grid.agg(F.sum("count")).first()[0] == n
    assert grid.where("count > 0 AND prediction <> (label * 7) % 300").count() == 0


def test_report_text(spark):
    pred = spark.createDataFrame([("m", 0.0, 0.0), ("m", 1.0, 0.0), ("m", 2.0, 2.0), ("m", 2.0, 2.0), ("m", 2.0, 1.0)], "model string, label double, prediction double")
    # Fixed text: the usual table of these five predictions.
    want = """              precision    recall  f1-score   support

           0       0.50      1.00      0.67         1
           1       0.00      0.00      0.00         1
           2       1.00      0.67      0.80         3

    accuracy                           0.60         5
   macro avg       0.50      0.56      0.49         5
weighted avg       0.70      0.60      0.61         5
"""
    assert V.report_text(pred).first()["report"] == want
    assert V.confusion_json(pred).first()["matrix"] == "[[1,0,0],[1,0,0],[0,1,2]]"
