"""Column expressions shared by the operators. All are built-in JVM
functions, so they stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

DEFAULT_SEED = 42


def quoted(name: str) -> Column:
    """A column by its exact name."""
    return F.col("`" + name.replace("`", "``") + "`")


def nan_to_null(df: DataFrame) -> DataFrame:
    """pandas treats NaN and None alike; Spark does not. Turn NaN into null
    on float columns so counts, averages and fills agree with that view."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            cols.append(F.nanvl(F.col(f"`{f.name}`"), F.lit(None).cast(f.dataType)).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


def hash_hex(*keys: Column | str, seed: int = DEFAULT_SEED) -> Column:
    """md5 of ``seed|k1|k2...`` as 32 hex characters.

    The same text is produced by DuckDB's ``md5(CAST(seed AS VARCHAR) || '|' ...)``,
    which makes every hash-based decision checkable in SQL. The order of the
    hex strings equals the order of the 128-bit numbers.
    """
    parts = [F.lit(str(seed))] + [F.col(k).cast("string") if isinstance(k, str) else k.cast("string")
                                  for k in keys]
    return F.md5(F.concat_ws("|", *parts))


def hash_unit(*keys: Column | str, seed: int = DEFAULT_SEED) -> Column:
    """A repeatable uniform number in [0, 1) from the first 32 bits of ``hash_hex``."""
    h = hash_hex(*keys, seed=seed)
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def row_hash(df: DataFrame, seed: int = DEFAULT_SEED) -> Column:
    """Row identity for tables without a key: hash of the JSON of the whole row."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)),
                             F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def safe_div(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


# cells (rows x columns) per partition of a training frame: about 32 MB of doubles
CELLS_PER_PARTITION = 4_000_000
# the same where trees grow, whose work a cell is many times that of a linear fit, up to so many partitions
TREE_CELLS, TREE_PARTITIONS = 50_000, 64


def right_size(df: DataFrame, rows: int, width: int, *keys: str, trees: bool = False) -> DataFrame:
    """Partitions of a bounded number of cells. Small training frames get fewer
    (iterative fits pay a task per partition per step) by ``coalesce``, which is
    narrow; where a partition would hold more than twice the number, rows are dealt by ``keys``."""
    import math
    cells = rows * max(1, width)
    want = max(1, math.ceil(cells / CELLS_PER_PARTITION))
    if trees:
        want = max(want, min(TREE_PARTITIONS, math.ceil(cells / TREE_CELLS)))
    have = df.rdd.getNumPartitions()
    if want < have:
        return df.coalesce(want)
    return df.repartition(want, *keys) if keys and want > 2 * have else df
