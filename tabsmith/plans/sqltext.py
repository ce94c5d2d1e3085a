"""Quoting helpers for the SQL text of a fitted transform.

A fitted preparation is saved as one ``SQLTransformer`` statement, so every
expression is written once as Spark SQL text and used both for training
(``F.expr``) and for scoring (the saved statement).
"""

from __future__ import annotations

import math


def ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, int):
        return f"CAST({v} AS BIGINT)"
    if isinstance(v, float):
        if math.isnan(v):
            return "CAST('NaN' AS DOUBLE)"
        if math.isinf(v):
            return "CAST('Infinity' AS DOUBLE)" if v > 0 else "CAST('-Infinity' AS DOUBLE)"
        return f"CAST({repr(v)} AS DOUBLE)"
    s = str(v).replace("\\", "\\\\").replace("'", "\\'")
    return f"'{s}'"
