"""Runs and saved pipelines on inputs that ordinary tables have."""

from datetime import date, datetime
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsmith.operators import knn, tune
from tabsmith.operators.classes import class_dictionary, labelled
from tabsmith.operators import models as K
from tabsmith.plans import automl
from tabsmith.plans.prep import PrepConfig, prepare
from tabsmith.sources.readers import json_records


def rows(spark, n=120):
    """A target that one column decides, awkward level names, NaN and nulls."""
    title = ["Mr.", "Mrs.", "red", "Red"]
    data = [(k // 2, k % 2, float("nan") if k % 11 == 0 else float(k % 10), title[k % 4], float(k % 7), "high" if k % 10 > 4 else "low")
            for k in range(n)]
    return spark.createDataFrame(data, "g long, k long, x double, title string, `title_Mr.` double, y string")


def test_run_without_keys_saves_and_scores_raw_rows(spark, tmp_path):
    df = rows(spark)
    run = automl.fit(df, "y", only=["Decision Tree", "KNN"], profile="fast")
    run.save(str(tmp_path / "b"), "Decision Tree")
    model = automl.load_scoring_model(str(tmp_path / "b"))
    out = model.transform(df.drop("y"))
    assert out.count() == df.count()
    got = out.select("prediction", "predicted_label", "features").collect()
    assert {r["predicted_label"] for r in got} <= {"high", "low"}
    assert not any(np.isnan(r["features"].toArray()).any() for r in got)  # NaN is filled as in training
    known = df.where("NOT isnan(x)")
    counts = {r[0]: r[1] for r in model.transform(known).groupBy("predicted_label").count().collect()}
    assert counts == {r[0]: r[1] for r in known.groupBy("y").count().collect()}  # x decides
    run.save(str(tmp_path / "k"), "KNN")
    known = df.where("NOT isnan(x)")
    near = automl.load_scoring_model(str(tmp_path / "k")).transform(known.drop("y")).groupBy("predicted_label").count().collect()
    assert sum(r["count"] for r in near) == known.count()


def test_awkward_levels_become_features_of_their_own(spark):
    model, prepared, _ = prepare(rows(spark), PrepConfig(target="y"))
    assert len(set(model.input_features)) == len(model.input_features)
    assert sum(c.startswith("title_") for c in model.input_features) == 4  # three indicators and the column of that name
    automl.assemble(prepared, model.feature_columns()).select("features").collect()


def test_composite_and_repeated_keys_do_not_multiply_predictions(spark):
    df = rows(spark)
    for keys in (["g", "k"], ["g"], ["k"], []):
        p = automl.prepare_data(df, "y", keys)
        run = automl.train_and_rank(p, "fast", only=["Decision Tree", "KNN"])
        assert run.predictions.count() == 2 * p.test.count()
        assert run.predictions.select("model", "row_key").distinct().count() == 2 * p.test.count()
        assert not {"g", "k"} & set(p.prep.selected) if keys == ["g", "k"] else True


@pytest.mark.parametrize("values,kind", [([Decimal("1.50"), Decimal("2.00")], "decimal(12,2)"), ([date(2020, 1, 2), date(2021, 1, 1)], "date"),
                                         ([datetime(2020, 1, 2, 3, 4, 5, 120000), datetime(2020, 1, 2)], "timestamp"), (["it's", "b\\c"], "string")])
def test_label_index_of_any_type(spark, values, kind):
    df = spark.createDataFrame([(v,) for v in values], f"y {kind}")
    levels = sorted(values)
    got = {r[0]: r[1] for r in labelled(df, "y", class_dictionary(df, "y")).select("y", "label").collect()}
    assert got == {v: float(levels.index(v)) for v in values}


def test_knn_is_exact_far_from_the_origin(spark):
    train = spark.createDataFrame([(k, float(k), [1e8 + k]) for k in range(5)], "id long, label double, f array<double>")
    test = spark.createDataFrame([(9, [1e8 + 4.2])], "id long, f array<double>")
    got = knn.neighbours(train, test, "id", "f", "label", k=3).orderBy("rank").collect()
    assert [r["tid"] for r in got] == [4, 3, 2] and abs(got[0]["dist"] - 0.04) < 1e-6


def test_json_fields_of_late_rows_survive(spark):
    df = spark.range(2000).select("id", F.when(F.col("id") == 1900, F.lit('{"a": 1, "late": {"z": [1.5, 2]}}'))
                                  .when(F.col("id") == 5, F.lit("no json")).otherwise(F.lit('{"a": 2}')).alias("j"))
    out = json_records(df, "j")
    assert out.where("late.z[0] = 1.5").count() == 1 and out.where("a = 2").count() == 1998 and out.count() == 2000


def test_settings_of_the_searches():
    tree = next(s.estimator for s in K.classifiers(100, 2, 3) if s.name == "Decision Tree")
    forest = next(s.estimator for s in K.classifiers(100, 2, 3) if s.name == "Random Forest")
    boosted = next(s.estimator for s in K.classifiers(100, 2, 3) if s.name == "Boosted Trees Histogram")
    grid = tune.reference_settings(tune.CLASSIFICATION_GRIDS["Decision Tree"])
    assert len(tune.distinct_maps(tree, grid, 100)) == 24
    assert len(tune.distinct_maps(forest, tune.reference_settings(tune.CLASSIFICATION_GRIDS["Random Forest"]), 100)) >= 5
    depths = {m[boosted.maxDepth] for m in tune.distinct_maps(boosted, tune.reference_settings(tune.CLASSIFICATION_GRIDS["LightGBM"]), 100)}
    assert max(depths) <= 6
    assert "Logistic Regression" not in tune.GRID_SEARCHED
