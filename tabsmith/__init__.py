"""tabsmith: a Spark-native tabular AutoML engine.

Every operator is a DataFrame -> DataFrame function or a ``pyspark.ml``
stage. Decisions that depend on the data (which columns to drop, how to
fill, how to encode) are taken from small collected profiles; the rows
themselves never leave the executors.
"""

from tabsmith.session import checkpoint_dir, get_spark

__all__ = ["get_spark", "checkpoint_dir"]
