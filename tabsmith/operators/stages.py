"""Pipeline stages that Spark ML lacks, each with persistence, so that any
model of the registries is saved, loaded and applied like Spark's own:

* ``FourierMap`` - random Fourier features of the Gaussian kernel;
* ``PlattCurve`` - probabilities from margins by a logistic curve;
* ``ClassShares`` - probabilities from one-vs-rest scores;
* ``ClassNames`` - class values for predicted indexes, from a table;
* ``KernelMachine`` - the estimator of the SVM and SVR slots, made of these;
* ``NearestNeighbours`` - the KNN estimator; its model carries the indexed
  training table and writes it beside its parameters.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import StorageLevel, keyword_only
from pyspark.ml import Estimator, Model, PipelineModel, Transformer
from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest
from pyspark.ml.feature import SQLTransformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasInputCol, HasLabelCol, HasOutputCol, HasPredictionCol, HasProbabilityCol, HasRawPredictionCol
from pyspark.ml.regression import LinearRegression
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsmith.functions.expr import hash_unit, right_size
from tabsmith.operators import knn as KNN
from tabsmith.operators.classes import sized
from tabsmith.plans.sqltext import literal

SEED = 42
RFF_COMPONENTS = 256
PLATT_FOLDS = 5
# cells (rows x mapped columns) that fits running at once may hold: about 1 GB of doubles
FIT_CELLS = 128_000_000
# the tolerance at which margin models stop, that of the library whose models they stand for
MARGIN_TOL = 1e-3


def _param(name: str, doc: str, convert) -> Param:
    return Param(Params._dummy(), name, doc, typeConverter=convert)


_float, _int, _text, _bool = TypeConverters.toFloat, TypeConverters.toInt, TypeConverters.toString, TypeConverters.toBoolean


def vector_text(column: str):
    """A vector as text that differs between different vectors."""
    return F.array_join(F.transform(vector_to_array(column), lambda x: x.cast("string")), ",")


# ------------------------------------------------------------ transformers ---

class FourierMap(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """z(x) = sqrt(2 / D) cos(W x + b), W ~ N(0, 2 gamma), b ~ U(0, 2 pi): one
    matrix product an Arrow batch. W and b follow from the parameters."""
    width = _param("width", "features of a row", _int)
    gamma = _param("gamma", "kernel coefficient", _float)
    components = _param("components", "length of the mapped vector", _int)
    seed = _param("seed", "seed of the map", _int)

    @keyword_only
    def __init__(self, *, inputCol="features", outputCol="mapped", width=1, gamma=1.0, components=RFF_COMPONENTS, seed=SEED):
        super().__init__()
        self._setDefault(inputCol="features", outputCol="mapped", width=1, gamma=1.0, components=RFF_COMPONENTS, seed=SEED)
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        get, size = self.getOrDefault, self.getOrDefault("components")
        rng = np.random.default_rng(get("seed"))
        w = rng.normal(0.0, np.sqrt(2.0 * get("gamma")), size=(size, get("width")))
        b = rng.uniform(0.0, 2 * np.pi, size=size)
        scale = np.sqrt(2.0 / size)

        @F.pandas_udf("array<double>")
        def mapped(x: pd.Series) -> pd.Series:
            if x.empty:
                return pd.Series([], dtype=object)
            return pd.Series(list(scale * np.cos(np.stack(x.to_numpy()).astype(np.float64) @ w.T + b)))
        return df.withColumn(self.getOutputCol(), array_to_vector(mapped(vector_to_array(self.getInputCol()))))


class PlattCurve(Transformer, HasRawPredictionCol, HasProbabilityCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """probability = 1 / (1 + exp(-(slope margin + intercept))); prediction from one half on."""
    slope = _param("slope", "slope of the curve", _float)
    intercept = _param("intercept", "intercept of the curve", _float)

    @keyword_only
    def __init__(self, *, slope=1.0, intercept=0.0):
        super().__init__()
        self._setDefault(slope=1.0, intercept=0.0)
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        p = 1 / (1 + F.exp(-(vector_to_array(self.getRawPredictionCol())[1] * self.getOrDefault("slope") + self.getOrDefault("intercept"))))
        out = df.withColumn(self.getProbabilityCol(), array_to_vector(F.array(1 - p, p)))
        return out.withColumn(self.getPredictionCol(), (vector_to_array(self.getProbabilityCol())[1] >= 0.5).cast("double"))


class ClassShares(Transformer, HasRawPredictionCol, HasProbabilityCol, DefaultParamsReadable, DefaultParamsWritable):
    """Probabilities of one-vs-rest models: the logistic of each class's score
    times ``scale``, divided by their sum. The class of the highest score keeps the highest share."""
    scale = _param("scale", "factor on the scores: 2 for boosted trees, whose score is half the log odds", _float)

    @keyword_only
    def __init__(self, *, scale=1.0):
        super().__init__()
        self._setDefault(scale=1.0)
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        scale = self.getOrDefault("scale")
        # bounded, so that not every share underflows to nothing
        each = F.transform(vector_to_array(self.getRawPredictionCol()), lambda x: 1 / (1 + F.exp(F.least(F.lit(700.0), -x * scale))))
        whole = F.aggregate(each, F.lit(0.0), lambda a, x: a + x)
        return df.withColumn(self.getProbabilityCol(), array_to_vector(F.transform(each, lambda x: x / whole)))


# ---------------------------------------------------------- kernel machines ---

class KernelMachine(Estimator, HasFeaturesCol, HasLabelCol, DefaultParamsReadable, DefaultParamsWritable):
    """Margin model under a linear or Gaussian kernel. Classification:
    ``LinearSVC`` with Platt scaling on out-of-fold margins (two classes) or
    one-vs-rest; regression: Huber ``LinearRegression``. ``C`` weighs the
    errors of single rows as in the library that the slots stand for."""
    C = _param("C", "weight of the errors", _float)
    kernel = _param("kernel", "rbf or linear", _text)
    gamma = _param("gamma", "scale or auto", _text)
    maxIter = _param("maxIter", "most iterations", _int)
    regression = _param("regression", "whether the label is a number to fit", _bool)
    seed = _param("seed", "seed of the map and the folds", _int)

    @keyword_only
    def __init__(self, *, C=1.0, kernel="rbf", gamma="scale", maxIter=1000, regression=False, seed=SEED):
        super().__init__()
        self._setDefault(C=1.0, kernel="rbf", gamma="scale", maxIter=1000, regression=False, seed=SEED)
        self._set(**self._input_kwargs)

    def _map(self, train: DataFrame) -> FourierMap:
        arr = vector_to_array(self.getFeaturesCol())
        row = train.agg(F.max(F.size(arr)).alias("d")).first()
        width = int(row["d"] or 1)
        gamma = 1.0 / width                                    # auto
        if self.getOrDefault("gamma") == "scale":              # 1 / (d x variance of all feature values)
            v = train.select(F.explode(arr).alias("v")).agg(F.var_pop("v")).first()[0] or 1.0
            gamma = 1.0 / (width * v)
        return FourierMap(inputCol=self.getFeaturesCol(), outputCol="mapped", width=width, gamma=gamma, seed=self.getOrDefault("seed"))

    def _fit(self, train: DataFrame) -> PipelineModel:
        kernel = self.getOrDefault("kernel")
        if kernel not in ("rbf", "linear"):
            raise ValueError("kernel must be rbf or linear")
        label, stages, column = self.getLabelCol(), [], self.getFeaturesCol()
        if kernel == "rbf":
            stages.append(self._map(train))
            column = "mapped"
        rows, n, distinct, held, high = self._weighted(train)
        width = RFF_COMPONENTS if stages else int(rows.agg(F.max(F.size("f"))).first()[0] or 1)
        # only the narrow rows are cached; a fit maps them and keeps its own blocks of what is wide
        cached = right_size(rows, distinct, width + 2, "label", "__fold", "f").persist(StorageLevel.MEMORY_AND_DISK)
        z = cached.select("label", "__fold", "weight", array_to_vector("f").alias(self.getFeaturesCol()))
        z = stages[0].transform(z).drop(self.getFeaturesCol()) if stages else z
        try:
            reg = 1.0 / (self.getOrDefault("C") * max(1, n))
            if self.getOrDefault("regression"):
                # on standard labels, else the solver's first steps are lost on their size;
                # the weights shrink with the labels, so the penalty grows by their deviation
                row = train.agg(F.avg(label).alias("mean"), F.stddev_pop(label).alias("std")).first()
                mean, std = row["mean"] or 0.0, row["std"] or 1.0
                est = LinearRegression(loss="huber", maxIter=self.getOrDefault("maxIter"), tol=1e-6, regParam=_penalty(reg * std, held),
                                       featuresCol=column, labelCol="standard", predictionCol="margin", weightCol="weight")
                back = SQLTransformer(statement=f"SELECT *, margin * {literal(float(std))} + {literal(float(mean))} AS prediction FROM __THIS__")
                return PipelineModel([*stages, est.fit(z.withColumn("standard", (F.col("label") - mean) / std)), back])
            svc = LinearSVC(maxIter=self.getOrDefault("maxIter"), tol=MARGIN_TOL, regParam=_penalty(reg, held), featuresCol=column, weightCol="weight")
            if high > 1:
                rest = OneVsRest(classifier=svc, featuresCol=column, rawPredictionCol="rawPrediction", weightCol="weight").fit(z)
                return PipelineModel([*stages, rest, ClassShares()])
            return PipelineModel([*stages, *self._calibrated(svc, z, reg, held, max(1, FIT_CELLS // max(1, distinct * width)))])
        finally:
            cached.unpersist()
            rows.unpersist()

    def _weighted(self, train: DataFrame) -> tuple[DataFrame, int, int, dict, int]:
        """(rows of label, fold, feature array and weight, rows of ``train``, rows
        of these, sums of weights and of their squares by fold, highest label).
        Where most rows have equals, equal ones are one row of their number's weight."""
        key = F.col("row_key") if "row_key" in train.columns else vector_text(self.getFeaturesCol())
        folds = hash_unit(key, seed=self.getOrDefault("seed") + 1)
        single = train.select(F.col(self.getLabelCol()).alias("label"), F.floor(folds * PLATT_FOLDS).alias("__fold"),
                              vector_to_array(self.getFeaturesCol()).alias("f"))
        rows = single.groupBy("label", "__fold", "f").agg(F.count("*").cast("double").alias("weight")).persist(StorageLevel.MEMORY_AND_DISK)
        found = rows.groupBy("__fold").agg(F.sum("weight").alias("n"), F.sum(F.col("weight") ** 2).alias("squares"), F.count("*").alias("distinct"),
                                           F.max("label").alias("high")).collect()
        n, distinct = int(sum(r["n"] for r in found)), sum(r["distinct"] for r in found)
        held = {r["__fold"]: (r["n"], r["squares"]) for r in found}
        if 2 * distinct > n:
            rows.unpersist()
            rows, distinct, held = single.withColumn("weight", F.lit(1.0)), n, {k: (m, m) for k, (m, _) in held.items()}
        return rows, n, distinct, held, int(max((r["high"] or 0 for r in found), default=0))

    @staticmethod
    def _calibrated(svc, z: DataFrame, reg: float, held: dict, at_once: int) -> list:
        """The final model and the curve fitted on out-of-fold margins; the fits
        are independent and run together, as many as ``at_once``."""
        from concurrent.futures import ThreadPoolExecutor

        def margins(k):
            rest = z.where(F.col("__fold") != k)
            if rest.select("label").distinct().count() < 2:
                return None
            part = svc.copy({svc.regParam: _penalty(reg, {f: x for f, x in held.items() if f != k})})
            return part.fit(rest).transform(z.where(F.col("__fold") == k)).select("label", "weight", vector_to_array("rawPrediction")[1].alias("m"))
        with ThreadPoolExecutor(max_workers=min(at_once, PLATT_FOLDS + 1)) as pool:
            final = pool.submit(lambda: svc.copy().fit(z))
            parts = [p for p in pool.map(margins, range(PLATT_FOLDS)) if p is not None]
            final = final.result()
        if not parts:
            return [final, PlattCurve()]
        held_out = parts[0]
        for p in parts[1:]:
            held_out = held_out.unionByName(p)
        # one feature without a penalty: the weights are all that counts
        curve = LogisticRegression(maxIter=100, regParam=0.0, weightCol="weight").fit(
            held_out.select("label", "weight", array_to_vector(F.array("m")).alias("features")))
        return [final, PlattCurve(slope=float(curve.coefficients[0]), intercept=float(curve.intercept))]


def _penalty(reg: float, held: dict) -> float:
    """``reg`` for weighted rows: solvers scale features by a deviation that
    divides by n - sum(w^2) / n, where single rows give n - 1."""
    n, squares = (sum(x[i] for x in held.values()) for i in (0, 1))
    return reg * (n - squares / n) / (n - 1) if n > 1 else reg


# ------------------------------------------------------------- class names ---

class ClassNames(Transformer, HasPredictionCol, HasOutputCol, MLWritable, MLReadable):
    """The class values as text beside their predicted indexes. The classes
    are a table, saved as one; it is broadcast only where it is small."""

    def __init__(self, names: DataFrame | None = None, rows: int = 0):
        super().__init__()
        self._setDefault(outputCol="predicted_label")
        self.names, self.rows = names, rows

    def _transform(self, df: DataFrame) -> DataFrame:
        names = self.names.select(F.col("label").alias("__index"), F.col("name").alias("__name"))
        out = df.join(sized(names, self.rows), F.col(self.getPredictionCol()) == F.col("__index"), "left")
        return out.withColumn(self.getOutputCol(), F.col("__name")).drop("__index", "__name")

    def write(self) -> MLWriter:
        return _TableWriter(self, {"rows": self.rows}, {"names": self.names})

    @classmethod
    def read(cls) -> MLReader:
        return _TableReader(lambda meta, table: ClassNames(table("names"), int(meta["rows"])))


class _TableWriter(MLWriter):
    """Parameters and ``extra`` as Spark ML metadata, tables as Parquet beside them."""

    def __init__(self, stage, extra: dict, tables: dict[str, DataFrame]):
        super().__init__()
        self.stage, self.extra, self.tables = stage, extra, tables

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.stage, path, self.sparkSession, extraMetadata=self.extra)
        for name, table in self.tables.items():
            table.write.parquet(f"{path}/{name}")


class _TableReader(MLReader):
    def __init__(self, build):
        super().__init__()
        self.build = build

    def load(self, path: str):
        meta = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        stage = self.build(meta, lambda name: self.sparkSession.read.parquet(f"{path}/{name}"))
        stage._resetUid(meta["uid"])
        DefaultParamsReader.getAndSetParams(stage, meta)
        return stage


# -------------------------------------------------------- nearest neighbours ---

class _NeighbourParams(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol):
    k = _param("k", "neighbours", _int)
    weights = _param("weights", "uniform or distance", _text)
    metric = _param("metric", "euclidean or manhattan", _text)
    regression = _param("regression", "whether the label is a number to average", _bool)
    keyCol = _param("keyCol", "key of a training row, which settles ties", _text)

    def _defaults(self):
        self._setDefault(k=KNN.K_NEIGHBOURS, weights="uniform", metric="euclidean", regression=False, keyCol="row_key")


class NearestNeighbours(Estimator, _NeighbourParams, DefaultParamsReadable, DefaultParamsWritable):
    """Exact k-nearest neighbours; the fit builds the metric index."""

    @keyword_only
    def __init__(self, *, k=KNN.K_NEIGHBOURS, weights="uniform", metric="euclidean", regression=False, keyCol="row_key"):
        super().__init__()
        self._defaults()
        self._set(**self._input_kwargs)

    def _fit(self, train: DataFrame) -> "NearestNeighboursModel":
        if self.getOrDefault("weights") not in ("uniform", "distance"):
            raise ValueError("weights must be uniform or distance")
        index = KNN.build_index(train, self.getOrDefault("keyCol"), self.getFeaturesCol(), self.getLabelCol(), self.getOrDefault("metric"))
        classes = 0 if self.getOrDefault("regression") else int(train.agg(F.max(self.getLabelCol())).first()[0] or 0) + 1
        model = self._copyValues(NearestNeighboursModel(index, classes))
        return model


class NearestNeighboursModel(Model, _NeighbourParams, MLWritable, MLReadable):
    """Adds the prediction, and for classes the probability, to any frame with
    the features. Rows of equal features are one query, told apart by the digest
    of the vector's text, so a frame needs no key and copies cost nothing."""

    def __init__(self, index: KNN.CellIndex | None = None, classes: int = 0):
        super().__init__()
        self._defaults()
        self.index, self.classes = index, classes

    def _transform(self, df: DataFrame) -> DataFrame:
        return self.answered(*self.found(df, self.getOrDefault("k")))

    def found(self, df: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
        """(the rows with the name of their query, the k nearest training rows of each query)."""
        rows = df.withColumn("__query", F.md5(vector_text(self.getFeaturesCol())))
        queries = rows.groupBy("__query").agg(F.first(vector_to_array(self.getFeaturesCol())).alias("f"))
        return rows, KNN.search(self.index, queries, "__query", "f", k)

    def answered(self, rows: DataFrame, nn: DataFrame) -> DataFrame:
        """The prediction from the neighbours of each query."""
        get = self.getOrDefault
        if get("regression"):
            out = KNN.knn_regress(nn, get("weights"), get("metric")).select(F.col("qid").alias("__query"), F.col("prediction").alias("__p"))
            return rows.join(self._counted(out), "__query", "left").withColumn(self.getPredictionCol(), F.col("__p")).drop("__query", "__p")
        # ties go to the smallest class: the first of the highest shares
        shares = KNN.class_shares(nn, get("weights"), get("metric")).groupBy("qid").agg(
            F.map_from_entries(F.collect_list(F.struct(F.col("tlabel").cast("int"), "share"))).alias("m"))
        each = F.transform(F.sequence(F.lit(0), F.lit(max(0, self.classes - 1))), lambda c: F.coalesce(F.try_element_at("m", c), F.lit(0.0)))
        out = shares.select(F.col("qid").alias("__query"), each.alias("__p"))
        rows = rows.join(self._counted(out), "__query", "left")
        best = (F.array_position("__p", F.array_max("__p")) - 1).cast("double")
        return rows.withColumn(self.getPredictionCol(), best).withColumn(self.getProbabilityCol(), array_to_vector("__p")).drop("__query", "__p")

    def _counted(self, out: DataFrame) -> DataFrame:
        """The answers, sent to the rows where they are few: then no row is shuffled for its answer."""
        out = out.persist(StorageLevel.MEMORY_AND_DISK)
        self.index.held.append(out)
        return sized(out, out.count())

    def release(self) -> None:
        self.index.release()

    def write(self) -> MLWriter:
        index = self.index
        pivots = index.table.sparkSession.createDataFrame([(k, [float(v) for v in p]) for k, p in enumerate(index.pivots)], "cell int, at array<double>")
        return _TableWriter(self, {"classes": self.classes, "metric": index.metric, "keys": index.key_type}, {"table": index.table, "pivots": pivots})

    @classmethod
    def read(cls) -> MLReader:
        return _TableReader(_loaded_neighbours)


def _loaded_neighbours(meta: dict, table) -> NearestNeighboursModel:
    at = table("pivots").orderBy("cell").collect()
    pivots = np.array([r["at"] for r in at], np.float64) if at else np.zeros((0, 0))
    return NearestNeighboursModel(KNN.with_cells(table("table"), pivots, meta["metric"], meta["keys"]), int(meta["classes"]))


def parameters(stage) -> dict[str, str]:
    """Parameters of a fitted model; of several stages, each under its class's name."""
    if isinstance(stage, PipelineModel):
        return {f"{type(s).__name__}.{k}": v for s in stage.stages for k, v in parameters(s).items()}
    return {p.name: str(v) for p, v in stage.extractParamMap().items()} if hasattr(stage, "extractParamMap") else {}
