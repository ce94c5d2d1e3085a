"""Missing values (M1-M5).

The IQR outlier test of the reference ("any value strictly outside
Q1 - 1.5 IQR, Q3 + 1.5 IQR") reduces to ``min < lo or max > hi``, so the
quartiles and extremes of the profile decide it without a second scan.
Fills are ``coalesce`` expressions; medians are exact at any size
(``ml.feature.Imputer`` is approximate).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsmith.plans.profile import TableProfile, q

# Fixed report texts of the reference.
MEDIAN_TEXT = "Median (Outliers Detected)"
MEAN_TEXT = "Mean (No Outliers)"
MODE_TEXT = "Mode"


def numerical_missing_columns(profile: TableProfile, columns: list[str] | None = None) -> list[str]:
    """M1, numeric part."""
    cols = columns if columns is not None else profile.numeric()
    return [c for c in cols if profile.columns[c].kind == "numeric" and profile.columns[c].nulls > 0]


def categorical_missing_columns(profile: TableProfile, columns: list[str] | None = None) -> list[str]:
    """M1, categorical part."""
    cols = columns if columns is not None else profile.categorical()
    return [c for c in cols if profile.columns[c].kind == "categorical" and profile.columns[c].nulls > 0]


@dataclass
class OutlierCheck:
    column: str
    q1: float
    q3: float
    lower: float
    upper: float
    has_outliers: bool


def detect_outliers(profile: TableProfile, column: str) -> OutlierCheck:
    """M2 from the profile: quartiles (linear interpolation) and extremes."""
    st = profile.columns[column]
    if st.q1 is None:
        return OutlierCheck(column, None, None, None, None, False)
    iqr = st.q3 - st.q1
    lo, hi = st.q1 - 1.5 * iqr, st.q3 + 1.5 * iqr
    return OutlierCheck(column, st.q1, st.q3, lo, hi, bool(st.min < lo or st.max > hi))


def outlier_row_counts(df: DataFrame, checks: list[OutlierCheck]) -> DataFrame:
    """M2, row form: how many rows fall outside the fences, all columns in one scan."""
    structs = [F.struct(F.lit(c.column).alias("column"),
                        F.count_if((q(c.column) < F.lit(c.lower)) | (q(c.column) > F.lit(c.upper)))
                        .cast("bigint").alias("outlier_rows"))
               for c in checks if c.lower is not None]
    if not structs:
        return df.sparkSession.createDataFrame([], "column string, outlier_rows bigint")
    return df.agg(F.array(*structs).alias("s")).select(F.inline("s"))


def numeric_fill_plan(profile: TableProfile, columns: list[str] | None = None) -> dict[str, tuple[float, str]]:
    """M3 decision: column -> (fill value, report text)."""
    plan = {}
    for c in numerical_missing_columns(profile, columns):
        st = profile.columns[c]
        if st.non_null == 0:
            continue
        if detect_outliers(profile, c).has_outliers:
            plan[c] = (st.median, MEDIAN_TEXT)
        else:
            plan[c] = (st.mean, MEAN_TEXT)
    return plan


def categorical_fill_plan(profile: TableProfile, columns: list[str] | None = None,
                          df: DataFrame | None = None) -> dict[str, tuple[str, str]]:
    """M4 decision: column -> (mode, report text). Ties: smallest value.
    A column whose most frequent value is long gets its mode from a
    grouped top-1 over ``df``."""
    from tabsmith.plans.profile import column_mode
    plan = {}
    for c in categorical_missing_columns(profile, columns):
        st = profile.columns[c]
        if st.non_null == 0:
            continue
        mode = st.mode
        if mode is None and df is not None:
            mode, _ = column_mode(df, c)
            mode = None if mode is None else str(mode)
        if mode is not None:
            plan[c] = (mode, MODE_TEXT)
    return plan


def fill_expression(column: str, value, dtype: str) -> str:
    """SQL text of a fill. Numeric fills produce double (pandas turns an int
    column with gaps into float); categorical fills keep the column type."""
    from tabsmith.plans.sqltext import ident, literal
    if dtype == "numeric":
        return f"coalesce(CAST({ident(column)} AS DOUBLE), {literal(float(value))})"
    return f"coalesce({ident(column)}, CAST({literal(str(value))} AS {dtype}))"


def apply_fills(df: DataFrame, fills: dict[str, tuple], profile: TableProfile) -> DataFrame:
    """M3 / M4 applied as one projection."""
    exprs = []
    for c in df.columns:
        if c in fills:
            st = profile.columns[c]
            kind = "numeric" if st.kind == "numeric" else st.dtype
            exprs.append(F.expr(fill_expression(c, fills[c][0], kind)).alias(c))
        else:
            exprs.append(q(c))
    return df.select(*exprs)


def missing_value_report(numeric: dict, categorical: dict) -> list[tuple[str, str]]:
    """M5: merged (column, method)."""
    return [(c, v[1]) for c, v in numeric.items()] + [(c, v[1]) for c, v in categorical.items()]
