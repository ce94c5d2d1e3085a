"""The end-to-end run (Q1-Q5): table + target -> prepared features ->
trained models -> evaluation -> leaderboard -> importance -> saved bundle.

Jobs, in order: raw counts, dedup counts, class counts, two or three split
levels, profile scans (a)+(b), moments, correlations, then one fit per model
over the cached training frame and one evaluation aggregate over all
predictions. Only statistics and fitted models reach the driver.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsmith.functions.expr import right_size
from tabsmith.operators import compare as L
from tabsmith.operators import evaluate as V
from tabsmith.operators import models as K
from tabsmith.operators.stages import ClassNames, parameters
from tabsmith.plans.prep import PrepConfig, PrepModel, prepare

# Fixed values of the reference: metric lists per problem type (Q4).
METRIC_OPTIONS = {"classification": ["Accuracy", "Precision", "Recall", "F1 Score", "ROC-AUC"],
                  "regression": ["R2", "RMSE", "MAE", "MSE"]}
PRIMARY_METRIC = {"classification": "Accuracy", "regression": "R2"}
LEADERBOARD_METRICS = {"classification": ["Accuracy", "F1 Score"], "regression": ["R2", "RMSE"]}
METRIC_COLUMN = {"Accuracy": "accuracy", "Precision": "precision", "Recall": "recall", "F1 Score": "f1",
                 "ROC-AUC": "roc_auc", "R2": "r2", "RMSE": "rmse", "MAE": "mae", "MSE": "mse"}

#: Classes up to which the bundle's description lists them.
META_CLASSES = 1_000


@dataclass
class RunResult:
    prep: PrepModel
    problem_type: str
    train: DataFrame
    test: DataFrame
    fitted: dict
    specs: list
    predictions: DataFrame
    leaderboard: DataFrame
    best_model_name: str
    importance: DataFrame
    extra: dict = field(default_factory=dict)

    def evaluation_long(self) -> DataFrame:
        """S5, worked out once a run."""
        if "evaluation" not in self.extra:
            self.extra["evaluation"] = V.evaluation_long(self.predictions, self.problem_type).persist(StorageLevel.MEMORY_AND_DISK)
        return self.extra["evaluation"]

    def summary(self) -> DataFrame:
        """Q1: one row: type, raw rows / columns / missing, winner, metric."""
        spark = self.predictions.sparkSession
        primary = PRIMARY_METRIC[self.problem_type]
        best = self.leaderboard.where(F.col("rank") == 1).select(METRIC_COLUMN[primary]).first()
        c = self.prep.counts
        return spark.createDataFrame(
            [(self.problem_type.title(), c["raw_rows"], c["raw_columns"], c["missing_total"],
              self.best_model_name, primary, None if best is None else best[0])],
            "problem_type string, rows bigint, columns bigint, missing_values bigint, best_model string, "
            "best_metric_label string, best_metric_value double")

    def preprocessing_report(self) -> DataFrame:
        """Q3: (stage, column, action)."""
        return self.prep.preprocessing_report(self.predictions.sparkSession)

    def dataset_report(self) -> DataFrame:
        """Q2: (item, col_name, value)."""
        return self.prep.dataset_report(self.predictions.sparkSession)

    def best_parameters(self) -> DataFrame:
        """One row with winner, its metrics and parameters, feature names."""
        spark = self.predictions.sparkSession
        params = parameters(self.fitted[self.best_model_name])
        best = self.leaderboard.where(F.col("rank") == 1).drop("rank").first().asDict()
        payload = {"problem_type": self.problem_type, "selected_model": self.best_model_name,
                   "best_model": best, "parameters": params,
                   "input_feature_names": self.prep.input_features,
                   "selected_feature_names": self.prep.selected}
        return spark.createDataFrame([(self.problem_type, self.best_model_name, json.dumps(payload, default=str))],
                                     "problem_type string, selected_model string, payload string")

    def scoring_model(self, name: str | None = None) -> PipelineModel:
        """One PipelineModel with every stage needed on raw rows:
        renames, fills, encodings and scaling (one SQL statement), the
        assembler and the fitted model."""
        name = name or self.best_model_name
        m = self.fitted[name]
        prep = SQLTransformer(statement=self.prep.statement())
        asm = VectorAssembler(inputCols=self.prep.feature_columns(), outputCol="features", handleInvalid="keep")
        stages = [prep, asm, m]
        if self.problem_type == "classification":
            stages.append(ClassNames(self.prep.class_names(), self.prep.n_classes))
        return PipelineModel(stages=stages)

    def save(self, path: str, name: str | None = None) -> None:
        """Pipeline, evaluation report CSV, comparison CSV, best-parameter JSON."""
        self.scoring_model(name).write().overwrite().save(f"{path}/model")
        self.evaluation_long().coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/evaluation_report")
        self.leaderboard.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/model_comparison")
        self.best_parameters().coalesce(1).write.mode("overwrite").json(f"{path}/best_parameters")
        # the class list is in the model's own table, and here for reading while it is short
        short = 0 < self.prep.n_classes <= META_CLASSES
        meta = {"classes": [r["name"] for r in self.prep.class_names().orderBy("label").collect()] if short else [],
                "n_classes": self.prep.n_classes, "problem_type": self.problem_type, "keys": self.prep.keys,
                "raw_columns": self.prep.raw_columns, "selected": self.prep.selected}
        self.predictions.sparkSession.createDataFrame([(json.dumps(meta),)], "meta string") \
            .coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def assemble(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep").transform(df)


@dataclass
class Prepared:
    prep: PrepModel
    train: DataFrame
    test: DataFrame
    n_train: int


def prepare_data(df: DataFrame, target: str, keys: list[str] | None = None, fit_on: str = "train",
                 problem_type: str | None = None, checkpoint: bool | None = None) -> Prepared:
    """Everything before training: cleaning, split, plan, compiled features."""
    cfg = PrepConfig(target=target, keys=list(keys or []), fit_on=fit_on, problem_type=problem_type,
                     checkpoint=checkpoint)
    model, prepared, cl = prepare(df, cfg)
    key = model.keys[0]
    body = assemble(prepared.withColumnRenamed(key, "row_key"), model.feature_columns()) \
        .select("row_key", "__part", "label", "features")
    rows = cl.frame.count()          # cached: no scan
    body = right_size(body, rows, len(model.selected) + 2, "row_key", trees=True).persist(StorageLevel.MEMORY_AND_DISK)
    train = body.where(F.col("__part") == "train").drop("__part")
    test = body.where(F.col("__part") == "test").drop("__part")
    n_train = train.count()
    cl.frame.unpersist()        # the compiled features are cached now
    return Prepared(model, train, test, n_train)


def train_and_rank(p: Prepared, profile: str = "reference", only: list[str] | None = None) -> RunResult:
    """Fit the registry, evaluate all models in one aggregate, rank, explain."""
    model = p.prep
    d = len(model.selected)
    if model.problem_type == "classification":
        specs = K.classifiers(p.n_train, model.n_classes, d, profile)
    else:
        specs = K.regressors(p.n_train, d, profile)
    fitted, preds = K.train_all(specs, p.train, p.test, only)
    if model.problem_type == "classification":
        board = L.leaderboard_classification(preds)
    else:
        board = L.leaderboard_regression(preds)
    board = board.persist(StorageLevel.MEMORY_AND_DISK)
    best = board.where(F.col("rank") == 1).select("model").first()[0]
    raw_imp = L.model_importances(p.train.sparkSession, fitted, model.selected)
    importance = L.feature_importance(raw_imp)
    return RunResult(model, model.problem_type, p.train, p.test, fitted, specs, preds, board, best, importance)


def fit(df: DataFrame, target: str, keys: list[str] | None = None, profile: str = "reference",
        only: list[str] | None = None, fit_on: str = "train", problem_type: str | None = None,
        checkpoint: bool | None = None) -> RunResult:
    """Q5: the whole dataflow. ``only`` restricts the model registry."""
    return train_and_rank(prepare_data(df, target, keys, fit_on, problem_type, checkpoint), profile, only)


def load_scoring_model(path: str) -> PipelineModel:
    """Load a saved bundle; missing parts raise."""
    return PipelineModel.load(f"{path}/model")


def load_meta(spark, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/meta").first()[0])
