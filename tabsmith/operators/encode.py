"""Categorical encoding (E1-E5) and target handling.

Level lists come from the profile's value counts. Mode filling adds no
level, so the decisions taken before imputation still hold after it.
Encodings are SQL expressions (saved inside the scoring pipeline); an
unseen level at scoring time gives null for a label code and all-zero
indicators for one-hot columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsmith.plans.profile import TableProfile, q
from tabsmith.plans.sqltext import ident, literal

# Fixed values of the reference.
LABEL_TEXT = "Label Encoding"
ONE_HOT_TEXT = "One Hot Encoding"
MAX_ONE_HOT_LEVELS = 10
REGRESSION_MIN_DISTINCT = 20


def encoding_plan(profile: TableProfile, columns: list[str]) -> list[tuple[str, int, str]]:
    """(column, levels, method) with method label (2 levels),
    one_hot (3-10 levels) or leftover (1 level or more than 10)."""
    out = []
    for c in columns:
        st = profile.columns[c]
        if st.kind != "categorical":
            continue
        n = st.distinct
        if n == 2:
            out.append((c, n, "label"))
        elif 2 < n <= MAX_ONE_HOT_LEVELS:
            out.append((c, n, "one_hot"))
        else:
            out.append((c, n, "leftover"))
    return out


def _as_text(column: str, dtype: str) -> str:
    return ident(column) if dtype == "string" else f"CAST({ident(column)} AS STRING)"


def label_expression(column: str, levels: list[str], dtype: str = "string") -> str:
    """Sorted levels -> 0 / 1 (the order of a sorted label encoder)."""
    v = _as_text(column, dtype)
    return (f"CAST(CASE WHEN {v} = {literal(levels[0])} THEN 0 "
            f"WHEN {v} = {literal(levels[1])} THEN 1 END AS INT)")


def one_hot_expressions(column: str, levels: list[str], dtype: str = "string") -> list[tuple[str, str]]:
    """One int indicator per level except the first sorted level, named
    ``{column}_{level}``."""
    v = _as_text(column, dtype)
    return [(f"{column}_{lv}", f"CAST(coalesce({v} = {literal(lv)}, false) AS INT)") for lv in levels[1:]]


def apply_encoding(df: DataFrame, profile: TableProfile, plan: list[tuple[str, int, str]]) -> DataFrame:
    """E2 then E3 as one projection: label columns in place, indicators appended."""
    methods = {c: m for c, _, m in plan}
    head, tail = [], []
    for c in df.columns:
        m = methods.get(c)
        st = profile.columns.get(c)
        if m == "label":
            head.append(F.expr(label_expression(c, st.levels, st.dtype)).alias(c))
        elif m == "one_hot":
            for name, e in one_hot_expressions(c, st.levels, st.dtype):
                tail.append(F.expr(e).alias(name))
        else:
            head.append(q(c))
    return df.select(*head, *tail)


def encoding_report(plan: list[tuple[str, int, str]]) -> list[tuple[str, str]]:
    """Label report then one-hot report, as (column, method)."""
    return ([(c, LABEL_TEXT) for c, _, m in plan if m == "label"]
            + [(c, ONE_HOT_TEXT) for c, _, m in plan if m == "one_hot"])


# ---------------------------------------------------------------- target ---

class TargetMissing(KeyError):
    pass


def split_xy(df: DataFrame, target: str, keys: list[str] = ()) -> tuple[list[str], str]:
    """The target must exist; features are every other non-key column."""
    if target not in df.columns:
        raise TargetMissing(f"Target column '{target}' was not found after preprocessing.")
    return [c for c in df.columns if c != target and c not in keys], target


def target_distinct(df: DataFrame, target: str) -> int:
    """Exact non-null distinct count of one column, approximate first: an
    approximate count far above the threshold settles the question."""
    approx = df.agg(F.approx_count_distinct(q(target), 0.05).alias("a")).collect()[0]["a"]
    if approx > 2 * REGRESSION_MIN_DISTINCT:
        return int(approx)
    return int(df.agg(F.count_distinct(q(target)).alias("d")).collect()[0]["d"])


def infer_problem_type(df: DataFrame, target: str) -> str:
    """Numeric with more than 20 distinct values -> regression."""
    from tabsmith.plans.profile import is_numeric_type
    dt = df.schema[target].dataType
    if is_numeric_type(dt) and target_distinct(df, target) > REGRESSION_MIN_DISTINCT:
        return "regression"
    return "classification"
