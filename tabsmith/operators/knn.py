"""Exact k-nearest neighbours (K4, R4) through a metric index.

``build_index`` draws pivots from the training rows (smallest key hashes) and
puts every row into the cell of its nearest pivot, with its distance to it; a
cell knows its row count and its smallest and largest distance. ``search``
asks twice. Round one looks into the nearest cells that hold k rows together:
the k-th distance found there bounds the true one. Round two looks into every
other cell that the bound cannot exclude: by the triangle inequality (the
cell's ring of distances, the query's distance to the pivot) or because the
pivot is too much farther than the nearest one. Within a cell only rows
whose distance to the pivot fits the bound are compared. Nothing is left out,
so the result is that of comparing every pair, for Euclidean and
Manhattan distance alike. Where rows repeat the features of others many times,
a search for k takes of equal rows the k of the smallest keys: they are equally
far, so no other can be among the k nearest.

A task is one block of a cell's rows against one block of the queries that ask
for that cell (``cogroup``); both are bounded by ``block_rows``, so a cell that
holds a third of all rows is many tasks. It emits at most k rows a query; a
window keeps k of them. Training rows travel only to cells that are asked for.
The pivots (at most ``MAX_CELLS`` rows) and the table of cells are all that the
driver holds and tasks are sent.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K_NEIGHBOURS = 5
BLOCK_ROWS = 20_000
#: Rows of a cell on average, and the most cells of an index.
CELL_ROWS, MAX_CELLS = 256, 2048
#: Distances of one NumPy step.
STEP_CELLS = 1 << 21
#: Distances that Manhattan sums are added up for at a time.
CACHE_CELLS = 1 << 14
#: Pairs that a task compares at least, and the most tasks of a round.
TASK_PAIRS, MAX_TASKS = 1 << 24, 4096
METRICS = ("euclidean", "manhattan")


def _as_array(df: DataFrame, col: str) -> DataFrame:
    from pyspark.ml.functions import vector_to_array
    dt = df.schema[col].dataType
    if dt.typeName() == "vector" or dt.simpleString().startswith("vector"):
        return df.withColumn(col, vector_to_array(col, "float64"))
    return df.withColumn(col, F.col(col).cast("array<double>"))


def _key_type(df: DataFrame, key: str) -> str:
    return "bigint" if df.schema[key].dataType.typeName() in ("long", "integer", "short", "byte") else "string"


# -------------------------------------------------------------- distances ---

def _far(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distances of all rows of ``a`` to all rows of ``b``, good to the
    rounding of one matrix product; both must lie near the origin."""
    if metric == "manhattan":
        out, columns = np.zeros((len(a), len(b))), np.ascontiguousarray(b.T)
        step = max(1, CACHE_CELLS // max(1, len(b)))
        held = np.empty((min(step, len(a)), len(b)))
        for i in range(0, len(a), step):       # few enough that sums and gaps stay in a core's cache
            part = out[i:i + step]
            gap = held[:len(part)]
            for j in range(a.shape[1]):
                np.subtract(a[i:i + step, j, None], columns[j], out=gap)
                np.abs(gap, out=gap)
                part += gap
        return out
    d = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2.0 * a @ b.T
    return np.sqrt(np.maximum(d, 0.0, out=d))


def _near(rows: np.ndarray, one: np.ndarray, metric: str) -> np.ndarray:
    """Comparable distances on direct differences: squared when Euclidean."""
    return np.abs(rows - one).sum(axis=1) if metric == "manhattan" else ((rows - one) ** 2).sum(axis=1)


def _slack(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """How far ``_far`` may be off, for each row of ``a``."""
    size = lambda x: np.abs(x).sum(axis=1)
    most = size(b).max() if len(b) else 0.0
    return (1e-6 if metric == "euclidean" else 1e-11) * (size(a) + most) + 1e-300


# ------------------------------------------------------------------ index ---

@dataclass
class CellIndex:
    table: DataFrame                       # tid, tlabel, f, cell, reach (distance to the pivot)
    pivots: np.ndarray
    sizes: np.ndarray                      # rows of each cell
    low: np.ndarray                        # smallest and largest reach of each cell
    high: np.ndarray
    metric: str
    key_type: str
    rows: int
    distinct: int = 0                      # different features, about
    held: list[DataFrame] = field(default_factory=list)   # frames cached for this index and its searches

    def release(self) -> None:
        for frame in self.held:
            frame.unpersist()
        self.held.clear()

    def nearest(self, k: int) -> CellIndex:
        """The index for searches of ``k`` neighbours: itself, or without the copies that none of them can need."""
        if 2 * k * self.distinct > self.rows:
            return self
        order = Window.partitionBy("f").orderBy(F.col("tid").asc_nulls_last())
        table = self.table.withColumn("copy", F.row_number().over(order)).where(F.col("copy") <= k).drop("copy").persist(StorageLevel.MEMORY_AND_DISK)
        self.held.append(table)
        return with_cells(table, self.pivots, self.metric, self.key_type)


def _placed(df: DataFrame, pivots: np.ndarray, metric: str) -> DataFrame:
    """``df`` with cell and reach: the nearest pivot (lowest number on ties) and the distance to it."""
    middle = pivots.mean(axis=0)
    near = pivots - middle

    @F.pandas_udf("cell int, reach double")
    def place(x: pd.Series) -> pd.DataFrame:
        if x.empty:
            return pd.DataFrame({"cell": pd.Series([], dtype="int32"), "reach": pd.Series([], dtype="float64")})
        X = np.stack(x.to_numpy()).astype(np.float64) - middle
        step = max(1, STEP_CELLS // len(near))
        cell = np.concatenate([_far(X[i:i + step], near, metric).argmin(axis=1) for i in range(0, len(X), step)])
        gap = X - near[cell]
        reach = np.abs(gap).sum(axis=1) if metric == "manhattan" else np.sqrt((gap * gap).sum(axis=1))
        return pd.DataFrame({"cell": cell.astype(np.int32), "reach": reach})

    return df.withColumn("__at", place("f")).select(*df.columns, F.col("__at.cell").alias("cell"), F.col("__at.reach").alias("reach"))


def build_index(train: DataFrame, key: str, features: str, label: str, metric: str = "euclidean",
                cells: int | None = None) -> CellIndex:
    """Index of ``train``. The indexed table is cached until ``release``."""
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {', '.join(METRICS)}")
    kt = _key_type(train, key)
    rows = _as_array(train.select(F.col(key).cast(kt).alias("tid"), F.col(label).cast("double").alias("tlabel"),
                                  F.col(features).alias("f")), "f")
    if cells is None:
        cells = train.count() // CELL_ROWS
    # a bounded number of rows by key hash: the same under any partitioning
    drawn = rows.orderBy(F.xxhash64("tid"), "tid").limit(max(1, min(MAX_CELLS, cells))).select("f").collect()
    pivots = np.unique(np.array([r["f"] for r in drawn], np.float64), axis=0) if drawn else np.zeros((0, 0))
    if not len(pivots):
        table = rows.withColumn("cell", F.lit(0)).withColumn("reach", F.lit(0.0))
        none = np.zeros(0)
        return CellIndex(table, pivots, none, none, none, metric, kt, 0)
    table = _placed(rows, pivots, metric).persist(StorageLevel.MEMORY_AND_DISK)
    index = with_cells(table, pivots, metric, kt)
    index.held.append(table)
    return index


def with_cells(table: DataFrame, pivots: np.ndarray, metric: str, key_type: str) -> CellIndex:
    """An index over a table that knows its cells: one aggregate, a row a cell."""
    sizes, low, high = (np.zeros(len(pivots)) for _ in range(3))
    distinct = 0                           # equal rows share a cell
    for r in table.groupBy("cell").agg(F.count("*").alias("n"), F.min("reach").alias("a"), F.max("reach").alias("b"),
                                       F.approx_count_distinct("f").alias("d")).collect():
        sizes[r["cell"]], low[r["cell"]], high[r["cell"]] = r["n"], r["a"], r["b"]
        distinct += r["d"]
    return CellIndex(table, pivots, sizes, low, high, metric, key_type, int(sizes.sum()), distinct)


# ----------------------------------------------------------------- search ---

def _home(index: CellIndex, k: int):
    """UDF: the nearest cells of a query until they hold k rows."""
    middle = index.pivots.mean(axis=0)
    near, sizes, metric = index.pivots - middle, index.sizes, index.metric

    @F.pandas_udf("array<int>")
    def home(x: pd.Series) -> pd.Series:
        out, step = [], max(1, STEP_CELLS // len(near))
        for i in range(0, len(x), step):
            d = _far(np.stack(x.iloc[i:i + step].to_numpy()).astype(np.float64) - middle, near, metric)
            order = np.argsort(d, axis=1, kind="stable")
            before = np.cumsum(sizes[order], axis=1) - sizes[order]
            mask = np.zeros(d.shape, bool)
            np.put_along_axis(mask, order, before < k, axis=1)
            out += [np.flatnonzero(m & (sizes > 0)).astype(np.int32) for m in mask]
        return pd.Series(out)
    return home


def _others(index: CellIndex):
    """UDF: the cells beyond ``home`` that a bound on the k-th distance does not exclude."""
    middle = index.pivots.mean(axis=0)
    near, there, low, high, metric = index.pivots - middle, index.sizes > 0, index.low, index.high, index.metric

    @F.pandas_udf("array<int>")
    def others(x: pd.Series, bound: pd.Series, home: pd.Series) -> pd.Series:
        out, step = [], max(1, STEP_CELLS // len(near))
        for i in range(0, len(x), step):
            X = np.stack(x.iloc[i:i + step].to_numpy()).astype(np.float64) - middle
            d = _far(X, near, metric)
            r = (bound.iloc[i:i + step].to_numpy(dtype=np.float64) + _slack(X, near, metric))[:, None]
            mask = there & (d - high <= r) & (low - d <= r)
            # a row is nearer to its own pivot than to the query's: at least half the difference away
            mask &= (d - np.where(there, d, np.inf).min(axis=1)[:, None]) / 2 <= r
            for m, had in zip(mask, home.iloc[i:i + step]):
                m[had] = False
                out.append(np.flatnonzero(m).astype(np.int32))
        return pd.Series(out)
    return others


def _task(k: int, types: tuple[str, str], metric: str, pivots: np.ndarray, counted):
    """One block of queries against one block of a cell's rows."""
    qdt, tdt = ("int64" if t == "bigint" else "object" for t in types)

    def nearest(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        out_q, out_t, out_l, out_d = [], [], [], []
        if not q.empty and not t.empty:
            pivot = pivots[int(t["cell"].iloc[0])]
            t = t.sort_values("reach", kind="stable")
            tid, label, reach = t["tid"].to_numpy(), t["tlabel"].to_numpy(dtype=np.float64), t["reach"].to_numpy()
            # around the pivot: large offsets cost no digits
            T, Q = (np.stack(x["f"].to_numpy()).astype(np.float64) - pivot for x in (t, q))
            own = np.abs(Q).sum(axis=1) if metric == "manhattan" else np.sqrt((Q * Q).sum(axis=1))
            bound = q["bound"].to_numpy(dtype=np.float64)
            order = np.argsort(own, kind="stable")
            qid, done = q["qid"].to_numpy(), 0
            step = max(1, STEP_CELLS // len(T))
            for i in range(0, len(order), step):
                some = order[i:i + step]
                wide = bound[some] + _slack(Q[some], T[-1:], metric) + 1e-9 * reach[-1]
                a = np.searchsorted(reach, (own[some] - wide).min(), "left")
                b = np.searchsorted(reach, (own[some] + wide).max(), "right")
                if a >= b:
                    continue
                d = _far(Q[some], T[a:b], metric)
                done += d.size
                kk = min(k, b - a)
                kth = np.minimum(np.partition(d, kk - 1, axis=1)[:, kk - 1], bound[some]) + 2 * _slack(Q[some], T[a:b], metric)
                for j, row in enumerate(some):
                    at = a + np.flatnonzero(d[j] <= kth[j])
                    if not len(at):
                        continue
                    exact = _near(T[at], Q[row], metric)   # close calls are settled on direct differences
                    best = np.lexsort((tid[at], exact))[:k]
                    out_q.append(np.array([qid[row]] * len(best), dtype=object))
                    out_t.append(tid[at[best]])
                    out_l.append(label[at[best]])
                    out_d.append(exact[best])
            if counted is not None:
                counted.add(done)
        if not out_q:
            return pd.DataFrame({"qid": pd.Series([], dtype=qdt), "tid": pd.Series([], dtype=tdt),
                                 "tlabel": pd.Series([], dtype="float64"), "dist": pd.Series([], dtype="float64")})
        return pd.DataFrame({"qid": np.concatenate(out_q).astype(qdt), "tid": np.concatenate(out_t).astype(tdt),
                             "tlabel": np.concatenate(out_l), "dist": np.concatenate(out_d)})
    return nearest


def _round(index: CellIndex, asked: DataFrame, k: int, block_rows: int, counted) -> DataFrame:
    """Candidates (qid, tid, tlabel, dist) of queries (qid, f, bound, cell)."""
    parts = np.maximum(1, -(-index.sizes // block_rows)).astype(int)      # blocks of a cell's rows
    wanted = np.zeros(len(parts), int)                                    # blocks of the queries for it
    pairs = 0
    for r in asked.groupBy("cell").count().collect():
        wanted[r["cell"]] = -(-r["count"] // block_rows)
        pairs += int(r["count"]) * int(index.sizes[r["cell"]])
    number = lambda values: F.get(F.array(*[F.lit(int(v)) for v in values]), F.col("cell"))
    block = lambda key, n: F.pmod(F.xxhash64(key), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = asked.withColumn("qb", block("qid", number(wanted))).withColumn("tb", every(number(parts)))
    right = index.table.where(number(wanted) > 0).withColumn("tb", block("tid", number(parts))).withColumn("qb", every(number(wanted)))
    types = asked.schema["qid"].dataType.simpleString(), index.key_type
    # tasks by the pairs to compare: a block's bytes say little of its work, and by bytes many land in one task
    tasks = min(int((parts * wanted).sum()), MAX_TASKS, pairs // TASK_PAIRS)
    if tasks > 1:
        left, right = (x.repartition(tasks, "cell", "tb", "qb") for x in (left, right))
    return left.groupBy("cell", "tb", "qb").cogroup(right.groupBy("cell", "tb", "qb")).applyInPandas(
        _task(k, types, index.metric, index.pivots, counted), f"qid {types[0]}, tid {types[1]}, tlabel double, dist double")


def search(index: CellIndex, queries: DataFrame, key: str, features: str, k: int = K_NEIGHBOURS,
           block_rows: int | None = None, counted=None) -> DataFrame:
    """(qid, tid, tlabel, dist, rank) of the k nearest rows of every query; ``dist`` is
    squared when Euclidean; ties go to the smaller training key. ``counted``
    is an accumulator that adds up the distances computed."""
    block_rows = block_rows or BLOCK_ROWS
    te = _as_array(queries.select(F.col(key).cast(_key_type(queries, key)).alias("qid"), F.col(features).alias("f")), "f")
    if not index.rows:
        return te.select("qid", F.lit(None).cast(index.key_type).alias("tid"), F.lit(None).cast("double").alias("tlabel"),
                         F.lit(None).cast("double").alias("dist"), F.lit(None).cast("int").alias("rank")).where("false")
    held, index = index.held, index.nearest(k)
    order = Window.partitionBy("qid").orderBy("dist", "tid")
    first = lambda df: df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    te = te.withColumn("home", _home(index, k)("f")).persist(StorageLevel.MEMORY_AND_DISK)
    held.append(te)
    one = te.withColumn("bound", F.lit(float("inf"))).withColumn("cell", F.explode("home")).drop("home")
    one = first(_round(index, one, k, block_rows, counted))
    if len(index.pivots) == 1:
        return one
    one = one.persist(StorageLevel.MEMORY_AND_DISK)
    held.append(one)
    kth = F.max("dist") if index.metric == "manhattan" else F.sqrt(F.max("dist"))
    bounds = one.groupBy("qid").agg(F.when(F.count("*") >= k, kth).otherwise(F.lit(float("inf"))).alias("bound"))
    two = te.join(bounds, "qid").withColumn("cell", F.explode(_others(index)("f", "bound", "home"))).select("qid", "f", "bound", "cell")
    return first(one.drop("rank").unionByName(_round(index, two, k, block_rows, counted)))


def neighbours(train: DataFrame, test: DataFrame, key: str, features: str, label: str, k: int = K_NEIGHBOURS,
               block_rows: int | None = None, metric: str = "euclidean", cells: int | None = None, counted=None) -> DataFrame:
    """Index ``train`` and search it for every row of ``test``. Integer keys
    stay integers; any other key is compared as text."""
    return search(build_index(train, key, features, label, metric, cells), test, key, features, k, block_rows, counted)


# ---------------------------------------------------------------- answers ---

def _weight(weights: str, metric: str) -> Column:
    """1, or the inverse distance; beside a neighbour at no distance the others count nothing."""
    if weights == "uniform":
        return F.lit(1.0)
    if weights != "distance":
        raise ValueError("weights must be uniform or distance")
    d = F.col("dist") if metric == "manhattan" else F.sqrt("dist")
    same = F.min("dist").over(Window.partitionBy("qid")) == 0
    return F.when(same, (F.col("dist") == 0).cast("double")).otherwise(1.0 / d)


def class_shares(nn: DataFrame, weights: str = "uniform", metric: str = "euclidean") -> DataFrame:
    """(qid, tlabel, share): each class's part of the neighbours' weight."""
    votes = nn.withColumn("w", _weight(weights, metric)).groupBy("qid", "tlabel").agg(F.sum("w").alias("w"))
    return votes.select("qid", "tlabel", (F.col("w") / F.sum("w").over(Window.partitionBy("qid"))).alias("share"))


def knn_classify(nn: DataFrame, weights: str = "uniform", metric: str = "euclidean") -> DataFrame:
    """(qid, prediction, score): the class of most weight, ties to the
    smallest, and the share of class 1."""
    best = F.max(F.struct("share", (-F.col("tlabel")).alias("low")))
    one = F.max(F.when(F.col("tlabel") == 1, F.col("share")))
    return class_shares(nn, weights, metric).groupBy("qid").agg(
        (-best["low"]).alias("prediction"), F.coalesce(one, F.lit(0.0)).alias("score"))


def knn_regress(nn: DataFrame, weights: str = "uniform", metric: str = "euclidean") -> DataFrame:
    """Mean target of the neighbours, by weight."""
    if weights == "uniform":
        return nn.groupBy("qid").agg(F.avg("tlabel").alias("prediction"))
    w = nn.withColumn("w", _weight(weights, metric))
    return w.groupBy("qid").agg((F.sum(F.col("w") * F.col("tlabel")) / F.sum("w")).alias("prediction"))
