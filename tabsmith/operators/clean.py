"""Cleaning (C1-C6): projections, filters and distinct.

Decisions (which columns go) are read from a ``TableProfile``; the frame
is changed by one ``select`` / ``drop`` per step, so the plan stays a
single projection over the scan.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsmith.plans.profile import TableProfile, q

# Fixed values of the reference: column names always treated as identifiers.
ID_COLUMN_NAMES = ["id", "passengerid", "loan_id", "customer_id", "employee_id", "student_id"]
CARDINALITY_THRESHOLD = 0.15


class ColumnNameCollision(ValueError):
    pass


def clean_name(name: str) -> str:
    return re.sub(r"\s+", "_", name.strip().lower())


def clean_column_names(df: DataFrame) -> DataFrame:
    """Strip, lower-case, whitespace runs to ``_``. Spark resolves names
    case-insensitively, so two columns that clean to the same name raise."""
    new = [clean_name(c) for c in df.columns]
    seen: dict[str, str] = {}
    for old, n in zip(df.columns, new):
        if n in seen:
            raise ColumnNameCollision(f"columns {seen[n]!r} and {old!r} both become {n!r}")
        seen[n] = old
    return df.select(*[q(o).alias(n) for o, n in zip(df.columns, new)])


def remove_duplicate_rows(df: DataFrame) -> DataFrame:
    """Drop full-row duplicates (one shuffle on the row, map-side combined).
    The removed count is ``rows before - rows after``, taken by the caller in
    the same pass as its other counts."""
    return df.dropDuplicates()


def remove_empty_rows(df: DataFrame) -> DataFrame:
    """Drop rows whose every cell is null (narrow filter)."""
    return df.na.drop(how="all")


def all_null_condition(columns: list[str]):
    cond = F.lit(True)
    for c in columns:
        cond = cond & q(c).isNull()
    return cond


def empty_columns(profile: TableProfile) -> list[str]:
    """C4 decision: columns with no non-null value."""
    return [c for c in profile.order if profile.columns[c].non_null == 0]


def id_columns(columns: list[str], names: list[str] = ID_COLUMN_NAMES) -> list[str]:
    """C5 decision: identifier names present in the frame."""
    return [c for c in names if c in columns]


def high_cardinality_columns(profile: TableProfile, skip: list[str],
                             threshold: float = CARDINALITY_THRESHOLD) -> list[str]:
    """C6 decision: categorical columns whose distinct non-null count over all
    rows is strictly above the threshold. Zero rows -> nothing dropped."""
    out = []
    if profile.rows == 0:
        return out
    for c in profile.categorical():
        st = profile.columns[c]
        if c in skip or st.non_null == 0:
            continue
        if st.distinct / profile.rows > threshold:
            out.append(c)
    return out


def drop_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    keep = [c for c in df.columns if c not in set(columns)]
    return df.select(*[q(c) for c in keep])


def cleaning_decisions(profile: TableProfile, protect: list[str],
                       id_names: list[str] = ID_COLUMN_NAMES,
                       threshold: float = CARDINALITY_THRESHOLD) -> list[tuple[str, str]]:
    """C4, C5, C6 in the reference's order, as ``(column, reason)``.
    Protected columns (target, row keys) are never dropped as features by
    C4/C6; a C5 identifier that is a row key is reported and carried aside."""
    out: list[tuple[str, str]] = []
    gone: set[str] = set()
    for c in empty_columns(profile):
        if c not in protect:
            out.append((c, "Removed (Empty column)"))
            gone.add(c)
    remaining = [c for c in profile.order if c not in gone]
    for c in id_columns(remaining, id_names):
        out.append((c, "Removed (Identifier column)"))
        gone.add(c)
    for c in high_cardinality_columns(profile, skip=list(gone) + list(protect), threshold=threshold):
        out.append((c, f"Removed (Unique ratio > {threshold})"))
        gone.add(c)
    return out
