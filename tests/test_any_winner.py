"""Whatever model wins is saved, loaded and applied alike."""
import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabsmith.operators import models as K
from tabsmith.operators import stages as S
from tabsmith.plans import automl


def table(spark, classes=2, n=240, spread=2.0):
    rng = np.random.default_rng(11)
    y = rng.integers(0, classes, n)
    rows = [(i, float(rng.normal(3 * c, spread)), float(rng.normal(-c, spread)), "ab"[i % 2], f"c{c}", float(10 * c + rng.normal())) for i, c in enumerate(y)]
    return spark.createDataFrame(rows, "k long, x double, z double, t string, y string, amount double")


#: The models whose stages differ; three classes make SVM and boosting one-vs-rest.
MODELS = {2: ["Logistic Regression", "Random Forest", "KNN", "SVM", "Gradient Boosting", "Naive Bayes"], 3: ["KNN", "SVM", "Gradient Boosting"]}


def run(spark, classes):
    return automl.fit(table(spark, classes).drop("amount"), "y", ["k"], "fast", only=MODELS[classes])


@pytest.mark.parametrize("classes", [2, 3])
def test_every_classifier_scores_alike_after_loading(spark, tmp_path, classes):
    r = run(spark, classes)
    raw = table(spark, classes).drop("y", "amount")
    for name in r.fitted:
        r.scoring_model(name).write().save(str(tmp_path / name / "model"))
        out = automl.load_scoring_model(str(tmp_path / name)).transform(raw)
        fitted = r.predictions.where(F.col("model") == name).select("row_key", F.col("prediction").alias("p0"), F.col("score").alias("s0"))
        p = vector_to_array("probability")
        both = out.join(fitted, out["k"] == fitted["row_key"]).select("prediction", "p0", "s0", "predicted_label", p.alias("p")).collect()
        assert len(both) == r.test.count()
        for b in both:
            assert b["prediction"] == b["p0"] and b["predicted_label"] == f"c{int(b['p0'])}", name
            assert len(b["p"]) == classes and sum(b["p"]) == pytest.approx(1)
            assert classes > 2 or b["p"][1] == pytest.approx(b["s0"])
            assert max(b["p"]) == pytest.approx(b["p"][int(b["p0"])]), name
        assert S.parameters(r.fitted[name])
    assert {r["model"] for r in r.evaluation_long().where("metric = 'Classification Report'").collect()} == set(r.fitted)


def test_every_regressor_scores_alike_after_loading(spark, tmp_path):
    r = automl.fit(table(spark).drop("y"), "amount", ["k"], "fast", only=["Linear Regression", "KNN Regressor", "SVR"])
    raw = table(spark).drop("y", "amount")
    for name in r.fitted:
        r.save(str(tmp_path / name), name)
        out = automl.load_scoring_model(str(tmp_path / name)).transform(raw)
        fitted = r.predictions.where(F.col("model") == name).select("row_key", F.col("prediction").alias("p0"))
        both = out.join(fitted, out["k"] == fitted["row_key"]).select("prediction", "p0").collect()
        assert len(both) == r.test.count() and all(b["prediction"] == pytest.approx(b["p0"]) for b in both), name
    payload = automl.json.loads(r.best_parameters().first()["payload"])
    assert payload["parameters"]


def test_neighbours_need_no_key_and_keep_rows(spark, tmp_path):
    train = spark.createDataFrame([(i, float(i % 2), [float(i % 2), float(i)]) for i in range(40)], "row_key long, label double, f array<double>")
    train = train.select("row_key", "label", S.array_to_vector("f").alias("features"))
    m = S.NearestNeighbours(k=3, weights="distance", metric="manhattan").fit(train)
    m.write().save(str(tmp_path / "m"))
    back = S.NearestNeighboursModel.load(str(tmp_path / "m"))
    assert (back.getOrDefault("k"), back.getOrDefault("weights"), back.getOrDefault("metric"), back.classes) == (3, "distance", "manhattan", 2)
    twice = train.unionByName(train).drop("row_key")
    a, b = (sorted((r["label"], r["prediction"], r["probability"].toArray().tolist()) for r in x.transform(twice).collect()) for x in (m, back))
    assert a == b and len(a) == 80 and all(y == p for y, p, _ in a)
    m.release()
    assert not m.index.held


def test_kernel_machine_stages(spark):
    train = spark.createDataFrame([(i, float(i % 2), [float(i % 2) * 4 - 2 + (i % 5) / 10, float(i % 3)]) for i in range(90)],
                                  "row_key long, label double, f array<double>").select("row_key", "label", S.array_to_vector("f").alias("features"))
    for kernel, gamma in (("rbf", "scale"), ("rbf", "auto"), ("linear", "scale")):
        m = S.KernelMachine(kernel=kernel, gamma=gamma, maxIter=50).fit(train)
        assert isinstance(m, PipelineModel) and len(m.stages) == (3 if kernel == "rbf" else 2)
        assert K.predictions(m, train, True).where("label <> prediction OR abs(score - label) > 0.5").count() == 0
        K.release(m)
    with pytest.raises(ValueError):
        S.KernelMachine(kernel="poly").fit(train)
    numbers = train.withColumn("label", F.col("label") * 100 + 7)
    fit = S.KernelMachine(regression=True, maxIter=200, C=1000.0).fit(numbers)
    assert fit.transform(numbers).where("abs(prediction - label) > 5").count() == 0


def test_shares_keep_the_order_of_scores(spark):
    rows = spark.createDataFrame([([-900.0, -800.0, -1000.0],), ([1.0, 2.0, -1.0],), ([0.0, 0.0, 0.0],)], "r array<double>")
    out = S.ClassShares(scale=2.0).transform(rows.select(S.array_to_vector("r").alias("rawPrediction"))).collect()
    for r in out:
        p = r["probability"].toArray()
        assert p.sum() == pytest.approx(1) and (p >= 0).all()
    assert out[1]["probability"].toArray().argmax() == 1
