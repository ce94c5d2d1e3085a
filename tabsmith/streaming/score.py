"""Scoring on streams (P2, P5): every micro-batch is validated in one scan,
its good rows are scored by the saved ``PipelineModel`` and its bad values go
to a table of rejects.

Micro-batches are ordinary frames here (``foreachBatch``), so any saved model
serves, those that join or aggregate too (nearest neighbours). Each batch
writes folders named by its number, replacing what an earlier attempt left:
after a restart a batch that was cut short is done again, and every
row is in the sinks once.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsmith.operators.predict import validated


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What a sink holds; an empty frame where no batch came."""
    from pyspark.errors import AnalysisException
    try:
        return spark.read.parquet(path).drop("batch")
    except AnalysisException:
        return spark.createDataFrame([], schema)


def score_batch(batch: DataFrame, number: int, model: PipelineModel, key: str, numeric: list[str], sink: str, rejects: str | None) -> None:
    """Scores of the accepted rows and the rejected values of one micro-batch, each written once by number."""
    batch = batch.persist()
    try:
        good, bad = validated(batch, numeric, [key]) if numeric else (batch, None)
        model.transform(good).select(key, F.round("prediction", 6).alias("prediction")) \
            .write.mode("overwrite").parquet(f"{sink}/batch={number}")
        if bad is not None:
            bad.write.mode("overwrite").parquet(f"{rejects}/batch={number}")
    finally:
        batch.unpersist()


def score_stream(spark: SparkSession, bundle_path: str, source_dir: str, sink_dir: str, schema, checkpoint: str, key: str,
                 numeric: list[str] = (), reject_dir: str | None = None) -> DataFrame:
    """Score every file in ``source_dir`` with an ``availableNow`` trigger and
    return what the sink holds. With ``numeric``, rows in which one of these
    columns does not hold a number are left out and their values go to
    ``reject_dir`` (key, col_name, value)."""
    if numeric and not reject_dir:
        raise ValueError("reject_dir is needed where columns are checked")
    model = PipelineModel.load(f"{bundle_path}/model")
    stream = spark.readStream.schema(schema).parquet(source_dir)
    query = (stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
             .foreachBatch(lambda batch, n: score_batch(batch, n, model, key, list(numeric), sink_dir, reject_dir)).start())
    query.awaitTermination()
    return _read(spark, sink_dir, f"{key} {stream.schema[key].dataType.simpleString()}, prediction double")


def rejected(spark: SparkSession, reject_dir: str, key: str, key_type: str = "bigint") -> DataFrame:
    """(key, col_name, value) of all batches."""
    return _read(spark, reject_dir, f"{key} {key_type}, col_name string, value string")
