"""Table loading.

The reference reads one CSV into memory and samples it down to 100,000
rows. Here a file is a Spark scan; sampling is optional and repeatable
(hash of a key, never ``rand``, so the chosen rows do not depend on the
partitioning).
"""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsmith.functions.expr import DEFAULT_SEED, hash_hex, hash_unit, nan_to_null

# Fixed values of the reference: the row cap and its seed.
REFERENCE_ROW_CAP = 100_000
REFERENCE_SAMPLE_SEED = 42

SUPPORTED_FORMATS = {".csv": "csv", ".parquet": "parquet", ".json": "json", ".jsonl": "json"}


class UnsupportedFormatError(ValueError):
    pass


def file_format(path: str) -> str:
    """Format from the extension, lower-cased (S2). A directory of parquet
    parts without an extension is read as parquet."""
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    if ext in SUPPORTED_FORMATS:
        return SUPPORTED_FORMATS[ext]
    if ext == "":
        return "parquet"
    raise UnsupportedFormatError("Unsupported file format")


def load_table(spark: SparkSession, path: str, null_values: str = "",
               schema=None) -> DataFrame:
    """CSV with header and inferred types, JSON lines, or Parquet.

    NaN becomes null on float columns, as the reference's null test merges both.
    For very large CSV inputs pass ``schema`` to skip the inference pass.
    """
    fmt = file_format(path)
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        df = reader.option("header", True).option("inferSchema", schema is None) \
            .option("nullValue", null_values).option("mode", "PERMISSIVE").csv(path)
    elif fmt == "json":
        df = reader.json(path)
    else:
        df = reader.parquet(path)
    return nan_to_null(df)


def sample_exact_n(df: DataFrame, key_cols: list[str], n: int = REFERENCE_ROW_CAP,
                   seed: int = REFERENCE_SAMPLE_SEED) -> DataFrame:
    """S4, exact size: the n rows with the smallest ``md5(seed|key)``.

    Tables with at most n rows are returned whole. Otherwise the n-th
    smallest hash is found by the split's radix search (a filter and a small
    grouped count per level, never a global sort or a top-n merge in one
    task), and the sample is a narrow filter ``hash <= threshold``. Keys
    must be unique. ``df`` should be cached or cheap to rescan (two or three
    scans)."""
    from tabsmith.operators.split import kth_smallest
    total = df.count()
    if total <= n:
        return df
    work = df.withColumn("__h", hash_hex(*key_cols, seed=seed))
    wanted = df.sparkSession.createDataFrame([(0, total, n)], "g int, n bigint, k bigint")
    thr = kth_smallest(work.select(F.lit(0).alias("g"), F.col("__h").alias("h")), wanted).first()["thr"]
    return work.where(F.col("__h") <= F.lit(thr)).drop("__h")


def sample_fraction(df: DataFrame, key_cols: list[str], percent: int,
                    seed: int = DEFAULT_SEED) -> DataFrame:
    """S4, fraction: keep a row when its key hash falls in the first ``percent``
    of 100 buckets. A narrow filter: no shuffle, same rows on any cluster."""
    bucket = F.conv(F.substring(hash_hex(*key_cols, seed=seed), 1, 8), 16, 10).cast("bigint") % 100
    return df.where(bucket < F.lit(percent))


def json_records(df: DataFrame, column: str) -> DataFrame:
    """Parse a column of JSON text into typed columns (S3 on data already in a
    table). One aggregate over all rows merges their schemas (``variant``
    type); the parse runs as ``from_json`` on every row. Text that is no JSON
    parses to nulls."""
    found = df.select(F.expr(f"schema_of_variant_agg(try_parse_json({_quoted(column)}))")).first()[0]
    if not found or not found.startswith("OBJECT<"):
        return df.select(F.lit(None).alias(column))
    schema = re.sub(r"DECIMAL\(\d+, ?\d+\)", "DOUBLE", found.replace("OBJECT<", "STRUCT<"))
    schema = re.sub(r"\b(VOID|VARIANT)\b", "STRING", schema)
    return df.select("*", F.from_json(F.col(column), schema).alias("__json")).select("*", "__json.*").drop("__json")


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


__all__ = ["load_table", "sample_exact_n", "sample_fraction", "json_records", "file_format",
           "UnsupportedFormatError", "REFERENCE_ROW_CAP", "hash_unit"]
