"""Save -> load -> score equals in-session scoring; stream scoring equals batch."""
import os
import tempfile

from pyspark.sql import functions as F

from tabsmith.plans import automl
from tabsmith.sources import fixtures as X
from tests.conftest import SF


def test_save_load_score_and_stream(spark):
    docs = X.labelled_docs(spark, SF)
    run = automl.fit(docs, "quality", keys=["doc_id"], profile="fast", only=["Logistic Regression"])
    # predictions of the fit loop on the test part
    fitted = {r["row_key"]: r["prediction"] for r in run.predictions.collect()}
    d = tempfile.mkdtemp(prefix="t-bundle-", dir="/tmp")
    run.save(d, "Logistic Regression")
    model = automl.load_scoring_model(d)
    raw = docs.drop("quality")
    scored = {r["doc_id"]: r["prediction"] for r in model.transform(raw).select("doc_id", "prediction").collect()}
    assert len(scored) == raw.count()
    for k, p in fitted.items():
        assert scored[k] == p
    # stream of the same raw rows
    from tabsmith.streaming.score import score_stream
    src = os.path.join(d, "src")
    raw.write.parquet(src)
    out = score_stream(spark, d, src, os.path.join(d, "sink"), raw.schema, os.path.join(d, "ck"), "doc_id")
    streamed = {r["doc_id"]: r["prediction"] for r in out.collect()}
    assert streamed == {k: round(v, 6) for k, v in scored.items()}
    # evaluation and comparison files were written
    assert spark.read.option("header", True).csv(os.path.join(d, "evaluation_report")).count() > 0
    meta = automl.load_meta(spark, d)
    assert meta["classes"] == ["0", "1"]


def test_report_tables(spark):
    docs = X.labelled_docs(spark, SF)
    run = automl.fit(docs, "quality", keys=["doc_id"], profile="fast", only=["Naive Bayes", "Decision Tree"])
    s = run.summary().first()
    assert s["rows"] == docs.count() and s["problem_type"] == "Classification"
    stages = {r["stage"] for r in run.preprocessing_report().collect()}
    assert {"encoding", "scaling"} <= stages
    assert run.leaderboard.count() == 2
    assert run.evaluation_long().where(F.col("metric") == "Confusion Matrix").count() == 2


def test_fit_on_all_rows_reference_order(spark):
    docs = X.labelled_docs(spark, SF)
    run = automl.fit(docs, "quality", keys=["doc_id"], profile="fast", only=["Naive Bayes"], fit_on="all")
    assert run.leaderboard.count() == 1
    # scaling was fitted on every row: the scaled features have mean 0 over all rows
    feats = run.prep.transform(docs)
    means = feats.agg(*[F.avg(c).alias(c) for c in run.prep.selected]).first()
    assert all(abs(v) < 1e-9 for v in means)


def test_regression_run(spark):
    docs = X.labelled_docs(spark, SF).drop("quality")
    run = automl.fit(docs, "n_chars", keys=["doc_id"], profile="fast", only=["Linear Regression", "KNN Regressor"])
    board = {r["model"]: r for r in run.leaderboard.collect()}
    assert run.problem_type == "regression" and set(board) == {"Linear Regression", "KNN Regressor"}
    assert board["Linear Regression"]["r2"] > 0.5
