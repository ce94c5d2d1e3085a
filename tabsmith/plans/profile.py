"""The fused column profile: every data-dependent decision of cleaning,
imputing and encoding is taken from it.

Scans replace the reference's one-pass-per-column-per-question loops:

(a) one ``agg`` over all columns: row count, non-null count per column,
    min / max / mean / std / var_pop per numeric column; exact quartiles follow
    from ``operators.quantile``, whatever the size;
(b) one ``unpivot`` of the categorical columns followed by
    ``groupBy(column, key).count()``, reduced inside Spark to levels, mode and
    the first levels of each column. Partial aggregation happens map-side,
    so a value that holds a third of all rows costs one row per task. The key
    of a long value is its digest, so wide text is not shuffled.

The level counts are exact for any number of levels. Only the profile reaches
the driver: a row a column and at most ``KEPT_LEVELS`` levels of each.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, BinaryType, DataType, MapType,
                               NumericType, StructType)

#: Levels of a column that the profile keeps; encodings take at most ten.
KEPT_LEVELS = 50
#: Bytes up to which a value stands for itself when levels are counted.
SHORT_BYTES = 64
APPROX_ACCURACY = 100_000


def is_numeric_type(dt: DataType) -> bool:
    return isinstance(dt, NumericType)


def is_complex_type(dt: DataType) -> bool:
    return isinstance(dt, (ArrayType, MapType, StructType, BinaryType)) or dt.typeName() == "vector"


def numeric_columns(df: DataFrame) -> list[str]:
    """Columns the reference calls numeric (``np.number``)."""
    return [f.name for f in df.schema.fields if is_numeric_type(f.dataType)]


def categorical_columns(df: DataFrame) -> list[str]:
    """Everything else that is a scalar: strings, booleans, dates, timestamps."""
    return [f.name for f in df.schema.fields
            if not is_numeric_type(f.dataType) and not is_complex_type(f.dataType)]


def q(name: str):
    return F.col(f"`{name}`")


@dataclass
class ColumnStats:
    name: str
    kind: str                      # "numeric" | "categorical" | "other"
    dtype: str
    non_null: int = 0
    nulls: int = 0
    # numeric
    mean: float | None = None
    std: float | None = None       # sample
    var_pop: float | None = None
    min: float | None = None
    max: float | None = None
    q1: float | None = None
    median: float | None = None
    q3: float | None = None
    # categorical
    distinct: int | None = None    # exact non-null distinct
    levels: list[str] | None = None  # sorted, up to KEPT_LEVELS of them
    mode: str | None = None          # None also where the most frequent value is long: see column_mode
    mode_count: int | None = None


@dataclass
class TableProfile:
    rows: int
    columns: dict[str, ColumnStats] = field(default_factory=dict)
    order: list[str] = field(default_factory=list)

    def numeric(self) -> list[str]:
        return [c for c in self.order if self.columns[c].kind == "numeric"]

    def categorical(self) -> list[str]:
        return [c for c in self.order if self.columns[c].kind == "categorical"]


def _kind(dt: DataType) -> str:
    if is_numeric_type(dt):
        return "numeric"
    if is_complex_type(dt):
        return "other"
    return "categorical"


def profile_table(df: DataFrame, rows: int | None = None, quantiles: bool | str = True, value_counts: bool = True) -> TableProfile:
    """Scans (a) and (b) described in the module docstring. ``quantiles="missing"``:
    only of columns that have nulls, which is all that filling asks for."""
    fields = df.schema.fields
    prof = TableProfile(rows=0, order=[f.name for f in fields])
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, f in enumerate(fields):
        kind = _kind(f.dataType)
        prof.columns[f.name] = ColumnStats(f.name, kind, f.dataType.simpleString())
        c = q(f.name)
        aggs.append(F.count(c).alias(f"nn{i}"))
        if kind == "numeric":
            d = c.cast("double")
            aggs += [F.min(d).alias(f"mn{i}"), F.max(d).alias(f"mx{i}"), F.avg(d).alias(f"av{i}"),
                     F.stddev_samp(d).alias(f"sd{i}"), F.var_pop(d).alias(f"vp{i}")]
    row = df.agg(*aggs).first()
    prof.rows = int(row["rows"]) if rows is None else rows
    for i, f in enumerate(fields):
        st = prof.columns[f.name]
        st.non_null = int(row[f"nn{i}"])
        st.nulls = prof.rows - st.non_null
        if st.kind == "numeric":
            st.min, st.max, st.mean = row[f"mn{i}"], row[f"mx{i}"], row[f"av{i}"]
            st.std, st.var_pop = row[f"sd{i}"], row[f"vp{i}"]
        elif st.kind == "categorical" and not st.non_null:
            st.distinct, st.levels = 0, []

    if quantiles:
        from tabsmith.operators.quantile import exact_quantiles
        wanted = [c for c in prof.numeric() if quantiles != "missing" or prof.columns[c].nulls]
        for c, (q1, median, q3) in exact_quantiles(df, wanted, [0.25, 0.5, 0.75]).items():
            prof.columns[c].q1, prof.columns[c].median, prof.columns[c].q3 = q1, median, q3

    filled = [c for c in prof.categorical() if prof.columns[c].non_null]
    if value_counts and filled:
        levels_of(df, filled, prof)
    return prof


def level_key(value: Column) -> Column:
    """A short value marked ``=``, or the digest of a long one marked ``#``."""
    return F.when(F.octet_length(value) <= SHORT_BYTES, F.concat(F.lit("="), value)).otherwise(F.concat(F.lit("#"), F.md5(value)))


def level_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pass (b): (col, key, n) of the non-null values of several columns, ``col`` being
    the place in ``columns``; one shuffle."""
    keys = df.select(*[level_key(q(c).cast("string")).alias(f"c{i}") for i, c in enumerate(columns)])
    long = keys.unpivot([], [f"c{i}" for i in range(len(columns))], "col", "key").where(F.col("key").isNotNull())
    return long.groupBy(F.substring("col", 2, 10).cast("int").alias("col"), "key").agg(F.count("*").alias("n"))


def levels_of(df: DataFrame, columns: list[str], prof: TableProfile) -> None:
    """Exact level counts, modes (smallest on ties) and first levels of the columns, reduced in Spark."""
    counts = level_counts(df, columns).persist()
    try:
        for r in counts.groupBy("col").agg(F.count("*").alias("levels"), F.max("n").alias("n"),
                                           F.min_by("key", F.struct((-F.col("n")).alias("n"), "key")).alias("key")).collect():
            st = prof.columns[columns[r["col"]]]
            st.distinct, st.mode_count = int(r["levels"]), int(r["n"])
            st.mode = r["key"][1:] if r["key"].startswith("=") else None
        few = [i for i, c in enumerate(columns) if (prof.columns[c].distinct or 0) <= KEPT_LEVELS]
        found: dict[int, list[str]] = {i: [] for i in few}
        for r in counts.where(F.col("col").isin(few)).select("col", "key").collect() if few else []:
            found[r["col"]].append(r["key"])
    finally:
        counts.unpersist()
    for i, keys in found.items():
        c = columns[i]
        if any(k.startswith("#") for k in keys):    # few, but long: read from the rows
            prof.columns[c].levels = sorted(r["v"] for r in df.where(q(c).isNotNull()).select(q(c).cast("string").alias("v")).distinct().collect())
        else:
            prof.columns[c].levels = sorted(k[1:] for k in keys)


def column_mode(df: DataFrame, column: str):
    """Most frequent non-null value, smallest on ties, without collecting levels."""
    r = (df.where(q(column).isNotNull()).groupBy(q(column).alias("v")).count()
         .orderBy(F.desc("count"), F.asc("v")).limit(1).collect())
    return (r[0]["v"], int(r[0]["count"])) if r else (None, 0)
