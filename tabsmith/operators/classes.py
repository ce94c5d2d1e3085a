"""Classes of a target as a table: value, index in sorted order, rows.

The index of a class is found without a global sort in one task: the distinct
values (counted map-side) are cut into ranges, numbered in their range, and
moved on by the sizes of the ranges before, of which there is one row a
partition. Nothing about a class reaches the driver or a literal, so a target
may have any number of classes; joins are hinted as broadcasts only where the
table of classes has at most ``BROADCAST_ROWS`` rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsmith.functions.expr import quoted
from tabsmith.session import checkpoint_dir

#: Rows up to which a table of classes or thresholds is broadcast.
BROADCAST_ROWS = 100_000


def kept(df: DataFrame) -> DataFrame:
    """Written to the shared checkpoint folder: its rows stay as they are, whatever is run again."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def sized(table: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint where the counted rows allow it."""
    return F.broadcast(table) if rows <= BROADCAST_ROWS else table


def class_dictionary(df: DataFrame, target: str) -> DataFrame:
    """(value, label, n): every non-null value of ``target`` (numbers by size, text by
    code points), its index 0, 1, ... as a double and its rows."""
    value = quoted(target)
    counts = df.where(value.isNotNull()).groupBy(value.alias("value")).agg(F.count("*").alias("n"))
    parts = kept(counts.repartitionByRange("value").withColumn("part", F.spark_partition_id()))
    sizes = parts.groupBy("part").agg(F.count("*").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("part").orderBy("value"))
    out = parts.withColumn("place", place).join(F.broadcast(sizes.select("part", before.alias("before"))), "part")
    return kept(out.select("value", (F.col("before") + F.col("place") - 1).cast("double").alias("label"), "n"))


def labelled(df: DataFrame, target: str, classes: DataFrame, name: str = "label", rows: int | None = None) -> DataFrame:
    """``df`` with the index of its class; null where there is none."""
    table = classes.select(F.col("value").alias("__value"), F.col("label").alias("__label"))
    joined = df.join(sized(table, classes.count() if rows is None else rows), quoted(target) == F.col("__value"), "left")
    return joined.withColumn(name, F.col("__label")).drop("__value", "__label")


def summary(classes: DataFrame) -> Column:
    """Aggregates of a table of classes: (k, rows, smallest)."""
    return F.struct(F.count("*").alias("k"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.min("n"), F.lit(0)).alias("smallest"))
