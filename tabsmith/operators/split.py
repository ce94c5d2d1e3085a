"""Repeatable train / test split.

Every row gets ``h = md5(seed|key)``. The test part of a class is its
``n_test`` rows with the smallest ``h``, so the split is exact in size,
independent of partitioning, and reproducible in SQL.

Finding the k-th smallest hash of each class never sorts a large class in one
task: hex prefixes of ``h`` form a radix tree. The state of the search is a
table (class, prefix, rows under it, rank wanted); a level joins it to the rows,
counts the next prefixes (at most 4,096 a class) and picks the one that holds
the rank. A class whose prefix holds at most ``FINAL_BUCKET_ROWS`` rows is
ranked by a window. So a class holding most of the rows costs the same as any
other, and the number of classes is free: no class reaches the driver, and
a table is broadcast only when its counted rows are few.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tabsmith.functions.expr import DEFAULT_SEED, hash_hex
from tabsmith.operators.classes import kept, sized, summary

TEST_SIZE = 0.2
PREFIX_STEP = 3          # hex characters per level: 4,096 buckets
FINAL_BUCKET_ROWS = 50_000


def n_test_stratified(n: int, test_size: float = TEST_SIZE) -> int:
    """Per-class test rows: round half up of test_size x n (exact rational)."""
    return math.floor(Fraction(str(test_size)) * n + Fraction(1, 2))


def n_test_random(n: int, test_size: float = TEST_SIZE) -> int:
    """Test rows of a plain split: ceil(test_size x n)."""
    return math.ceil(Fraction(str(test_size)) * n)


def stratify_problem(classes: int, rows: int, smallest: int, test_size: float = TEST_SIZE) -> str | None:
    """D3: why a stratified split cannot be made, or None."""
    if not classes:
        return "no rows"
    if smallest < 2:
        return "a class has one row, and two are needed to stand on both sides"
    n_test = n_test_random(rows, test_size)
    for side, n in (("test", n_test), ("training", rows - n_test)):
        if n < classes:
            return f"the {side} part would have {n} rows for {classes} classes"
    return None


def kth_smallest(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(g, thr): the k-th smallest ``h`` of every group. ``rows`` has columns g
    and h (32 hex characters), ``wanted`` g, n (rows of the group) and k."""
    state = wanted.where("k > 0").select("g", F.lit("").alias("prefix"), F.col("n").cast("bigint").alias("n"), F.col("k").cast("bigint").alias("k"))
    found, length = None, 0
    while True:
        state = kept(state)
        few = (F.col("n") <= FINAL_BUCKET_ROWS) if length < 32 else F.lit(True)
        sizes = {r["few"]: r["count"] for r in state.groupBy(few.alias("few")).count().collect()}
        hits = _under(rows, state.where(few), sizes.get(True, 0), length) \
            .withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy("h"))).where("r = k").select("g", F.col("h").alias("thr"))
        found = hits if found is None else found.unionByName(hits)
        if not sizes.get(False):
            return kept(found)
        counts = _under(rows, state.where(~few), sizes[False], length).groupBy("g", "k", F.substring("h", 1, length + PREFIX_STEP).alias("prefix")).count()
        upto = F.sum("count").over(Window.partitionBy("g").orderBy("prefix"))
        state = counts.withColumn("upto", upto).where("upto >= k AND upto - count < k") \
            .select("g", "prefix", F.col("count").alias("n"), (F.col("k") - F.col("upto") + F.col("count")).alias("k"))
        length += PREFIX_STEP


def _under(rows: DataFrame, state: DataFrame, groups: int, length: int) -> DataFrame:
    """(g, h, k) of the rows under the groups' prefixes, all of one length."""
    table = sized(state.select(F.col("g").alias("sg"), "prefix", "k"), groups)
    return rows.join(table, F.col("g").eqNullSafe(F.col("sg")) & (F.substring("h", 1, length) == F.col("prefix"))).select("g", "h", "k")


def assign_split(df: DataFrame, keys: list[str], label: str | None = None,
                 stratify: bool = True, test_size: float = TEST_SIZE,
                 seed: int = DEFAULT_SEED, classes: DataFrame | None = None):
    """Add ``__part`` ('train' | 'test'). Returns (frame, warnings).

    ``classes`` (value, n) spares a count where it is known. ``df`` should be
    cached: it is scanned once per radix level (two or three scans at any size)."""
    warnings = []
    work = df.withColumn("__h", hash_hex(*keys, seed=seed))
    groups = 1
    if stratify and label is not None:
        if classes is None:
            classes = kept(work.groupBy(F.col(label).alias("value")).agg(F.count("*").alias("n")))
        found = classes.agg(summary(classes).alias("s")).first()["s"]
        problem = stratify_problem(found["k"], found["rows"], found["smallest"], test_size)
        if problem:
            warnings.append(f"Stratified split failed, using a random split instead: {problem}")
            stratify = False
        groups = found["k"]
    if stratify and label is not None:
        share = Fraction(str(test_size))
        # round half up of test_size x n, in whole numbers
        k = F.call_function("div", F.col("n") * (2 * share.numerator) + share.denominator, F.lit(2 * share.denominator))
        wanted = classes.select(F.col("value").alias("g"), "n", k.alias("k"))
        work = work.withColumn("__grp", F.col(label))
    else:
        groups = 1
        n = work.count()
        wanted = df.sparkSession.createDataFrame([(0, n, n_test_random(n, test_size))], "g int, n bigint, k bigint")
        work = work.withColumn("__grp", F.lit(0))
    thresholds = kth_smallest(work.select(F.col("__grp").alias("g"), F.col("__h").alias("h")), wanted)
    table = sized(thresholds.select(F.col("g").alias("__tg"), F.col("thr").alias("__thr")), groups)
    out = (work.join(table, F.col("__grp").eqNullSafe(F.col("__tg")), "left")
           .withColumn("__part", F.when(F.col("__h") <= F.coalesce("__thr", F.lit("")), "test")
                       .otherwise("train"))
           .drop("__h", "__grp", "__tg", "__thr"))
    return out, warnings


def split_report(df: DataFrame) -> DataFrame:
    """Sample and label counts of both parts, one aggregate."""
    c = df.agg(F.count_if(F.col("__part") == "train").cast("bigint").alias("train"),
               F.count_if(F.col("__part") == "test").cast("bigint").alias("test"))
    # Fixed report names of the reference.
    return c.select(F.inline(F.array(
        F.struct(F.lit("Training Samples").alias("item"), F.col("train").alias("rows")),
        F.struct(F.lit("Testing Samples").alias("item"), F.col("test").alias("rows")),
        F.struct(F.lit("Training Labels").alias("item"), F.col("train").alias("rows")),
        F.struct(F.lit("Testing Labels").alias("item"), F.col("test").alias("rows")))))
