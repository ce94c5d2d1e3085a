"""Dataset profiling operators (A1-A9) as DataFrames.

Each function returns a lazy DataFrame; nothing is collected. The statistics
of many columns come from one aggregate, reshaped with ``inline`` of an
array of structs so the result schema does not depend on the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (BooleanType, ByteType, DateType, DecimalType, DoubleType,
                               FloatType, IntegerType, LongType, ShortType, StringType,
                               TimestampNTZType, TimestampType)

from tabsmith.plans.profile import (APPROX_ACCURACY, categorical_columns, is_complex_type,
                                    numeric_columns, q)


def profile_shape(df: DataFrame) -> DataFrame:
    """A1: (rows, columns)."""
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows", F.lit(len(df.columns)).cast("bigint").alias("columns"))


def profile_types(df: DataFrame) -> DataFrame:
    """A2 + A9: type and kind of every column, derived from the schema."""
    rows = []
    for f in df.schema.fields:
        kind = "numeric" if f.name in numeric_columns(df) else (
            "other" if is_complex_type(f.dataType) else "categorical")
        rows.append((f.name, f.dataType.simpleString(), kind))
    return df.sparkSession.createDataFrame(rows, "column string, dtype string, kind string")


def _long(df: DataFrame, structs) -> DataFrame:
    return df.agg(F.array(*structs).alias("s")).select(F.inline("s"))


def profile_missing(df: DataFrame) -> DataFrame:
    """A3: null count per column, one scan for all columns."""
    return _long(df, [F.struct(F.lit(c).alias("column"),
                               F.count_if(q(c).isNull()).cast("bigint").alias("missing"))
                      for c in df.columns])


def profile_missing_total(df: DataFrame) -> DataFrame:
    """A4: all missing cells."""
    return profile_missing(df).agg(F.sum("missing").cast("bigint").alias("missing_total"))


def profile_duplicates(df: DataFrame) -> DataFrame:
    """A5: rows equal to an earlier row (nulls equal). One shuffle on the
    whole row, partially aggregated map-side."""
    g = df.groupBy(*[q(c) for c in df.columns]).count()
    return g.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("bigint").alias("duplicate_rows"))


_WIDTH = {ByteType: 1, ShortType: 2, IntegerType: 4, LongType: 8, FloatType: 4, DoubleType: 8,
          BooleanType: 1, DateType: 4, TimestampType: 8, TimestampNTZType: 8}


def profile_bytes(df: DataFrame) -> DataFrame:
    """A6, re-aimed: data bytes per column. Strings: UTF-8 bytes; fixed-width
    types: width x non-null values. Python object overhead is not modelled."""
    structs = []
    for f in df.schema.fields:
        c = q(f.name)
        if isinstance(f.dataType, StringType):
            b = F.coalesce(F.sum(F.octet_length(c)), F.lit(0))
        elif isinstance(f.dataType, DecimalType):
            b = F.count(c) * F.lit(16)
        else:
            b = F.count(c) * F.lit(_WIDTH.get(type(f.dataType), 8))
        structs.append(F.struct(F.lit(f.name).alias("column"), b.cast("bigint").alias("bytes")))
    return _long(df, structs)


QUARTILES = [0.25, 0.5, 0.75]


def profile_preview(df: DataFrame, order_by: list[str] | None = None, n: int = 5) -> DataFrame:
    """First n rows; ordered by the given key so the answer is stable."""
    return (df.orderBy(*order_by) if order_by else df).limit(n)


def describe_numeric(df: DataFrame, exact: bool = True) -> DataFrame:
    """A8, numeric part: count, mean, sample std, min, quartiles, max.

    The moments are one aggregate. Quartiles are exact at any size
    (``operators.quantile``); ``exact=False`` takes ``percentile_approx``."""
    from tabsmith.operators.quantile import exact_quantiles
    nums = numeric_columns(df)
    structs = []
    for c in nums:
        d = q(c).cast("double")
        structs.append(F.struct(
            F.lit(c).alias("column"), F.count(d).cast("bigint").alias("count"),
            F.avg(d).alias("mean"), F.stddev_samp(d).alias("std"), F.min(d).alias("min"),
            (F.lit(None).cast("array<double>") if exact else F.percentile_approx(d, F.array(*[F.lit(p) for p in QUARTILES]), APPROX_ACCURACY)).alias("qs"),
            F.max(d).alias("max")))
    out = _long(df, structs)
    if exact:
        found = exact_quantiles(df, nums, QUARTILES)
        quartiles = df.sparkSession.createDataFrame([(c, v) for c, v in found.items()], "column string, qs array<double>")
        out = out.drop("qs").join(F.broadcast(quartiles), "column")
    return out.select("column", "count", "mean", "std", "min",
                      F.col("qs")[0].alias("q25"), F.col("qs")[1].alias("q50"),
                      F.col("qs")[2].alias("q75"), "max")


def describe_categorical(df: DataFrame) -> DataFrame:
    """A8, categorical part: count, unique, top (smallest on ties), freq.

    Value counts of all categorical columns in one shuffle, then one
    aggregate per column; the top value is ``min_by(value, (-count, value))``,
    so no column's levels are ever gathered in one place."""
    cats = categorical_columns(df)
    spark = df.sparkSession
    if not cats:
        return spark.createDataFrame([], "column string, count bigint, unique bigint, top string, freq bigint")
    text = df.select(*[q(c).cast("string").alias(f"c{i}") for i, c in enumerate(cats)])
    names = F.array(*[F.lit(c) for c in cats])
    vc = (text.unpivot([], [f"c{i}" for i in range(len(cats))], "col", "value")
          .groupBy("col", "value").count()
          .select(F.element_at(names, F.substring("col", 2, 10).cast("int") + 1).alias("column"),
                  "value", "count"))
    nn = vc.where(F.col("value").isNotNull())
    # top = most frequent value, smallest on ties: the minimum of (-count, value)
    per_col = nn.groupBy("column").agg(
        F.sum("count").cast("bigint").alias("count"), F.count(F.lit(1)).cast("bigint").alias("unique"),
        F.max("count").cast("bigint").alias("freq"),
        F.min_by("value", F.struct((-F.col("count")).alias("c"), F.col("value").alias("v"))).alias("top"))
    all_cols = spark.createDataFrame([(c,) for c in cats], "column string")
    return (all_cols.join(F.broadcast(per_col), "column", "left")
            .select("column", F.coalesce("count", F.lit(0)).cast("bigint").alias("count"),
                    F.coalesce("unique", F.lit(0)).cast("bigint").alias("unique"), "top", "freq"))
