"""Exact quantiles at any size: a mergeable sketch picks bounds, counts confirm them.

Every wanted pair of ranks is held by a range of values that is known to
contain it. A round is two scans, each one aggregate for all columns and ranges:

1. ``percentile_approx`` over the range's values proposes bounds a little below
   and above the ranks (its summaries are merged map-side, its rank error is bounded);
2. exact counts: below the lower bound, equal to it, between, equal to the
   upper bound, and the least and largest value between.

The counts tell on which of these parts a rank lies. On a bound, the value is
found; between, the range shrinks to [least, largest] of what lies there, some
thousandth of it; outside (the sketch was wrong) it shrinks to that side. A
range of at most ``FINAL_VALUES`` values is fetched and ordered. Every round
removes at least a bound's value from the range, so ties, however many, end the search
rather than lengthen it. There is one path whatever the number of rows.

Infinities need no care, as values are only compared; NaN (the largest value, as
Spark orders it) is counted apart. Quantiles are interpolated linearly between
the two neighbouring ranks, like ``percentile`` and pandas.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsmith.functions.expr import quoted

#: Values of a range up to which it is fetched.
FINAL_VALUES = 10_000
#: Accuracy of the sketch: ranks are off by at most 1 / ACCURACY of the values.
ACCURACY = 10_000


@dataclass
class _Range:
    column: str
    ranks: tuple[int, ...]      # wanted, from 0 over the column's values but NaN
    low: float | None           # None: unbounded
    high: float | None
    below: int                  # values under the range
    size: int                   # values in it

    def holds(self, x: Column) -> Column:
        cond = x.isNotNull() & ~F.isnan(x)
        if self.low is not None:
            cond = cond & (x >= F.lit(self.low))
        if self.high is not None:
            cond = cond & (x <= F.lit(self.high))
        return cond


def _value(column: str) -> Column:
    return quoted(column).cast("double")


def _proposed(df: DataFrame, ranges: list[_Range]) -> list[tuple[float, float]]:
    """Scan 1: bounds around the ranks of every range. Ranges of the same values, as all of a
    column are at first, share a sketch: the sketches of all tasks are merged in one place."""
    shared: dict[tuple, list[float]] = {}
    places = []
    for r in ranges:
        at = [(k - r.below) / r.size for k in (r.ranks[0], r.ranks[-1])]
        slack = 2.0 / ACCURACY + 1.0 / r.size
        key = (r.column, r.low, r.high)
        probs = shared.setdefault(key, [])
        places.append((key, len(probs)))
        probs += [max(0.0, at[0] - slack), min(1.0, at[1] + slack)]
    values = {(r.column, r.low, r.high): F.when(r.holds(_value(r.column)), _value(r.column)) for r in ranges}
    row = df.agg(*[F.percentile_approx(values[key], F.array(*[F.lit(p) for p in probs]), ACCURACY).alias(f"p{i}")
                   for i, (key, probs) in enumerate(shared.items())]).first()
    found = {key: row[f"p{i}"] for i, key in enumerate(shared)}
    return [tuple(found[key][i:i + 2]) for key, i in places]


def _counted(df: DataFrame, ranges: list[_Range], bounds) -> list[dict]:
    """Scan 2: exact counts of every range's parts."""
    aggs = []
    for i, (r, (a, b)) in enumerate(zip(ranges, bounds)):
        x, a, b = _value(r.column), F.lit(a), F.lit(b)
        inside = r.holds(x)
        between = F.when(inside & (x > a) & (x < b), x)
        under, over = F.when(inside & (x < a), x), F.when(inside & (x > b), x)
        aggs += [F.struct(F.count(under).alias("under"), F.max(under).alias("under_max"), F.count_if(inside & (x == a)).alias("at_low"),
                          F.count(between).alias("between"), F.min(between).alias("least"), F.max(between).alias("largest"),
                          F.count_if(inside & (x == b)).alias("at_high"), F.min(over).alias("over_min"), F.count(over).alias("over")).alias(f"c{i}")]
    row = df.agg(*aggs).first()
    return [row[f"c{i}"].asDict() for i in range(len(ranges))]


def _parts(r: _Range, a: float, b: float, c: dict) -> list[tuple[int, float | None, float | None]]:
    """(size, lowest, highest) of the parts of a range in order."""
    parts = [(c["under"], r.low, c["under_max"]), (c["at_low"], a, a)]
    if a < b:
        parts += [(c["between"], c["least"], c["largest"]), (c["at_high"], b, b)]
    return [*parts, (c["over"], c["over_min"], r.high)]


def _narrowed(r: _Range, a: float, b: float, c: dict, found: dict) -> list[_Range]:
    """The ranges left for the ranks of ``r``; ranks on a single value go to ``found``."""
    out, below = [], r.below
    for size, low, high in _parts(r, a, b, c):
        ranks = tuple(k for k in r.ranks if below <= k < below + size)
        if ranks and low is not None and low == high:
            found.update({(r.column, k): low for k in ranks})
        elif ranks:
            out.append(_Range(r.column, ranks, low, high, below, size))
        below += size
    return out


def _fetched(df: DataFrame, ranges: list[_Range], found: dict) -> None:
    """The values of small ranges, ordered here: at most FINAL_VALUES a range."""
    entries = [F.when(r.holds(_value(r.column)), F.struct(F.lit(i).alias("r"), _value(r.column).alias("x"))) for i, r in enumerate(ranges)]
    rows = df.select(F.explode(F.filter(F.array(*entries), lambda e: e.isNotNull())).alias("e")).groupBy("e.r", "e.x").count().collect()
    values: dict[int, list] = {}
    for row in rows:
        values.setdefault(row["r"], []).append((row["x"], row["count"]))
    for i, r in enumerate(ranges):
        at, ranks = r.below, list(r.ranks)
        for x, n in sorted(values.get(i, [])):
            while ranks and ranks[0] < at + n:
                found[(r.column, ranks.pop(0))] = x
            at += n


def exact_quantiles(df: DataFrame, columns: list[str], probs: list[float]) -> dict[str, list[float | None]]:
    """{column: [quantile for each prob]} with linear interpolation; None for a column without values."""
    if not columns:
        return {}
    sizes = df.agg(*[F.struct(F.count(_value(c)).alias("n"), F.count_if(F.isnan(_value(c))).alias("nan")).alias(f"s{i}")
                     for i, c in enumerate(columns)]).first()
    total = {c: sizes[f"s{i}"]["n"] for i, c in enumerate(columns)}
    found: dict[tuple[str, int], float] = {}
    state = []
    for i, c in enumerate(columns):
        solid = total[c] - sizes[f"s{i}"]["nan"]
        for p in probs:
            h = (total[c] - 1) * p
            wanted = sorted({math.floor(h), math.ceil(h)}) if total[c] else []
            found.update({(c, k): math.nan for k in wanted if k >= solid})
            ranks = tuple(k for k in wanted if k < solid)
            if ranks:
                state.append(_Range(c, ranks, None, None, 0, solid))
    small = []
    while state:
        small += [r for r in state if r.size <= FINAL_VALUES]
        state = [r for r in state if r.size > FINAL_VALUES]
        if state:
            bounds = _proposed(df, state)
            counts = _counted(df, state, bounds)
            state = [x for r, (a, b), c in zip(state, bounds, counts) for x in _narrowed(r, a, b, c, found)]
    if small:
        # ranges of one column may be the same one: fetched once
        merged: dict[tuple, _Range] = {}
        for r in small:
            key = (r.column, r.low, r.high)
            merged[key] = _Range(r.column, tuple(sorted({*r.ranks, *(merged[key].ranks if key in merged else ())})), r.low, r.high, r.below, r.size)
        _fetched(df, list(merged.values()), found)

    def quantile(c: str, p: float) -> float | None:
        if not total[c]:
            return None
        h = (total[c] - 1) * p
        v, w = found[(c, math.floor(h))], found[(c, math.ceil(h))]
        part = h - math.floor(h)
        if v == w or not part:
            return float(v)
        return float(v + part * (w - v) if math.isfinite(w - v) else (1 - part) * v + part * w)
    return {c: [quantile(c, p) for p in probs] for c in columns}
