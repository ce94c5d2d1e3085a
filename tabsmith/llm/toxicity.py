"""Toxicity by a subsequence string kernel, a Nyström map and a linear SVM.

A sentence is judged by its units: its words, lower-cased, without punctuation
around or inside them, and letters that stand alone in a row, joined. Two units are
compared by all subsequences of three characters within a window of
``SPAN``, weighted by ``DECAY`` to the length they span, so letters left out or
put in between cost a little. The normalised kernel, raised to ``DEGREE``, is
taken between a unit and the landmarks only; the inverse root of the landmarks'
own kernel matrix makes it the coordinates in which a squared-hinge SVM is
trained. A text's value is the highest of its sentences', a sentence's that of
its units, and a logistic curve fitted on labelled texts makes it a score.

Training: labels belong to texts, so first every sentence has its text's label;
then, in ``ROUNDS`` rounds, only the sentence and the word of each text that the
model puts highest: of toxic texts as what to find, of others as what to leave.
The sample is bounded: at most ``TOXIC_ROWS`` and ``OTHER_ROWS`` labelled rows
in the order of a hash of their id; all else covers all rows. The labels of the
sample are a bounded broadcast; texts do not move. The model is ``LANDMARKS``
units and their subsequences: fixed in size.

Cases: null and empty texts have no units and get the curve's value of the
lowest unit value; without toxic or without other labelled texts each score is the
share of toxic ones (0 without labels); labels that are null are not used;
repeated rows stay; an empty table gives an empty table; other columns are kept
where named and never read.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.llm.common import Hashed, small_batches, stored

DECAY, SPAN, DEGREE = 0.8, 6, 3
LANDMARKS, CLEAN_LANDMARKS = 320, 128
TOXIC_ROWS, OTHER_ROWS = 4_000, 8_000
#: Units that the SVM is trained on, at most.
TRAIN_UNITS = 12_000
RIDGE = 3e-4
ROUNDS = 3
#: Weight of all other words of texts that are not toxic, against 1 for either side's highest.
REST = 0.3
#: Words in at least this share of the toxic texts are also learnt in altered forms, of this weight.
COMMON, ALTERED = 0.05, 1.0
#: Units whose values a Python worker keeps; the table is emptied when full.
UNITS_KEPT = 500_000
STEP_CHARS = 1 << 19

SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
_MARKS = re.compile(r"[\W_]+")
GAPS = [(a, b) for a in range(1, SPAN) for b in range(1, SPAN - a)]
WEIGHTS = [DECAY ** (a + b + 1) for a, b in GAPS]


def unit(word: str) -> str:
    """A word as the kernel sees it; empty without a letter or digit."""
    return _MARKS.sub("", word.lower())


def triples(units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(unit index, packed subsequence, summed weight) of every subsequence of
    at most 65,536 units, and the norm of each unit."""
    marked = [f"\x02{u}\x03" for u in units]
    codes = np.frombuffer("".join(marked).encode("utf-16-le", "surrogatepass"), np.uint16).astype(np.uint64)
    sizes = np.array([len(u.encode("utf-16-le", "surrogatepass")) // 2 for u in marked], np.int64)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(units)), sizes)
    left = ends[owner] - np.arange(len(codes)) if len(codes) else np.zeros(0, np.int64)
    keys, weight = [], []
    for (a, b), w in zip(GAPS, WEIGHTS):
        at = np.flatnonzero(left > a + b)
        packed = codes[at] << np.uint64(32) | codes[at + a] << np.uint64(16) | codes[at + a + b]
        keys.append(owner[at].astype(np.uint64) << np.uint64(48) | packed)
        weight.append(np.full(len(at), w, np.float32))
    keys, weight = np.concatenate(keys), np.concatenate(weight)
    order = np.argsort(keys)
    keys, weight = keys[order], weight[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    weight = np.add.reduceat(weight, first) if len(first) else weight
    own = (keys[first] >> np.uint64(48)).astype(np.int64)
    norm = np.sqrt(np.maximum(np.bincount(own, weight * weight, len(units)), 1e-12))
    return own, keys[first] & np.uint64((1 << 48) - 1), weight, norm


class Landmarks:
    """Kernel values between any units and the landmarks."""

    def __init__(self, units: list[str]):
        self.units = units
        own, packed, weight, norm = triples(units)
        keys, row = np.unique(packed, return_inverse=True)
        order = np.argsort(row, kind="stable")
        # landmark and weight of each occurrence, by subsequence
        self.owner, self.weight = own[order], (weight / norm[own])[order]
        self.at = np.searchsorted(row[order], np.arange(len(keys) + 1))
        self.index = Hashed(keys, np.arange(len(keys)), 16)

    def kernel(self, units: list[str]) -> np.ndarray:
        n = len(self.units)
        out = np.zeros((len(units), n), np.float32)
        for i in range(0, len(units) if n else 0, 4096):
            part = units[i:i + 4096]
            own, packed, weight, norm = triples(part)
            found = self.index.find(packed)
            hit = found >= 0
            own, key, weight = own[hit], self.index.rows[found[hit]], weight[hit]
            size = self.at[key + 1] - self.at[key]
            ends = np.cumsum(size)
            spot = np.repeat(self.at[key] - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)
            sums = np.bincount(np.repeat(own, size) * n + self.owner[spot], np.repeat(weight, size) * self.weight[spot], len(part) * n)
            out[i:i + 4096] = (sums.reshape(-1, n) / norm[:, None]) ** DEGREE
        return out


class Values(dict):
    """Word -> number of its value; new words wait in ``new``."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class Model:
    def __init__(self, landmarks: Landmarks, beta: np.ndarray, bias: float, slope: float = 1.0, shift: float = 0.0):
        self.landmarks, self.beta, self.bias, self.slope, self.shift = landmarks, beta.astype(np.float32), float(bias), slope, shift
        self.clear()

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k in ("landmarks", "beta", "bias", "slope", "shift")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.clear()

    def clear(self) -> None:
        self.known, self.units = Values(), Values()  # words as they stand, and as the kernel sees them
        self.values, self.single = np.zeros(0, np.float32), np.zeros(0, bool)
        self.unit_values, self.unit_single = self.values, self.single

    def of_units(self, units: list[str]) -> np.ndarray:
        return self.landmarks.kernel(units) @ self.beta + self.bias

    def words(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
        """(value of every word, offsets by text, words); letters alone in a
        row of three or more take the value of the word they spell, if higher."""
        if len(self.known) > UNITS_KEPT:
            self.clear()
        split = [(t or "").split() for t in texts]
        counts = [len(x) for x in split]
        at = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
        k = np.fromiter(map(self.known.__getitem__, chain.from_iterable(split)), np.int64, int(at[-1]))
        if self.known.new:
            own = np.array([self.units[unit(w)] for w in self.known.new], np.int64)
            if self.units.new:
                self.unit_values = np.concatenate((self.unit_values, self.of_units(self.units.new)))
                self.unit_single = np.concatenate((self.unit_single, np.array([len(u) == 1 for u in self.units.new])))
                self.units.new = []
            self.values = np.concatenate((self.values, self.unit_values[own]))
            self.single = np.concatenate((self.single, self.unit_single[own]))
            self.known.new = []
        values, single = self.values[k], self.single[k]
        # runs of single letters within a text
        edge = np.zeros(len(k) + 1, bool)
        edge[at] = True
        start = np.flatnonzero(single & (edge[:-1] | ~np.concatenate(([False], single[:-1]))))
        stop = np.flatnonzero(single & (edge[1:] | ~np.concatenate((single[1:], [False])))) + 1
        long = stop - start >= 3
        if long.any():
            words = list(chain.from_iterable(split))
            spelled = ["".join(unit(w) for w in words[a:b]) for a, b in zip(start[long], stop[long])]
            for a, b, v in zip(start[long], stop[long], self.of_units(spelled)):
                values[a:b] = np.maximum(values[a:b], v)
        return values, at, split

    def of_texts(self, texts: list[str | None]) -> tuple[np.ndarray, list[str]]:
        """(highest value, the unit that has it) of each text."""
        values, at, split = self.words(texts)
        out, best = np.full(len(texts), self.bias, np.float64), [""] * len(texts)
        some = np.flatnonzero(at[1:] > at[:-1])
        if len(some):
            out[some] = np.maximum.reduceat(values, at[some])
            for i in some:
                best[i] = split[i][int(values[at[i]:at[i + 1]].argmax())]
        return out, best

    def probability(self, value: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * value + self.shift, -30, 30)))


def train_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 15) -> np.ndarray:
    """Weights (the last one the bias) of a squared-hinge SVM, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], RIDGE)
    ridge[-1] = 1e-8
    weight = weight / weight.sum()
    loss = lambda v: (weight * np.maximum(1 - y * (x @ v), 0) ** 2).sum() + (ridge * v * v).sum()
    for _ in range(steps):
        gap = 1 - y * (x @ w)
        on = gap > 0
        grad = -2 * x[on].T @ (weight[on] * y[on] * gap[on]) + 2 * ridge * w
        hess = 2 * (x[on] * weight[on, None]).T @ x[on] + 2 * np.diag(ridge)
        step = np.linalg.solve(hess, grad)
        size, now = 1.0, loss(w)
        while loss(w - size * step) > now and size > 1e-4:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-4:
            break
    return w


def variants(u: str) -> list[str]:
    """A unit with one strange character put in or one doubled."""
    return sorted({u[:i] + "\x04" + u[i:] for i in range(1, len(u))} | {u[:i] + u[i] + u[i:] for i in range(len(u))})


def logistic(value: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the likeliest logistic curve (Newton, slightly held)."""
    x = np.stack([value, np.ones(len(value))], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + np.array([1e-3, 0]) * w
        hess = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag([1e-3, 1e-9])
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def _slices(texts: list[str | None]):
    i = 0
    while i < len(texts):
        j, chars = i, 0
        while j < len(texts) and (j == i or chars + len(texts[j] or "") <= STEP_CHARS):
            chars += len(texts[j] or "")
            j += 1
        yield i, j
        i = j


def labelled_units(sample: DataFrame) -> DataFrame:
    """(unit, toxic, others): how many sentences of toxic and of other texts hold a unit."""
    def run(batches):
        for batch in batches:
            count: dict[tuple[str, int], int] = {}
            for text, y in zip(*(c.to_pylist() for c in batch.columns)):
                for sentence in SENTENCE.split(text or ""):
                    for u in {unit(w) for w in sentence.split()}:
                        if u:
                            count[u, y] = count.get((u, y), 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in count], pa.string()), pa.array([n if y else 0 for (_, y), n in count.items()], pa.int64()),
                                              pa.array([0 if y else n for (_, y), n in count.items()], pa.int64())], names=["unit", "toxic", "others"])

    return sample.select("text", "toxic").mapInArrow(run, "unit string, toxic long, others long").groupBy("unit") \
        .agg(F.sum("toxic").alias("toxic"), F.sum("others").alias("others"))


def _compared(units: DataFrame, landmarks: Landmarks, vectors: bool) -> DataFrame:
    """units with their kernel values (``k``) or the highest of them (``near``)."""
    def run(batches):
        for batch in batches:
            k = landmarks.kernel(batch.column(0).to_pylist())
            near = k.max(axis=1) if k.shape[1] else np.zeros(len(k), np.float32)
            columns = [*batch.columns, pa.array(near.astype(np.float64))]
            if vectors:
                flat = pa.array(k.reshape(-1), pa.float32())
                columns.append(pa.ListArray.from_arrays(np.arange(len(k) + 1, dtype=np.int32) * k.shape[1], flat))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["unit", "toxic", "others", "near"] + ["k"] * vectors
    return units.select("unit", "toxic", "others").mapInArrow(
        run, "unit string, toxic long, others long, near double" + ", k array<float>" * vectors)


def fit(docs: DataFrame, labels: DataFrame, train, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """``train``: function of the id column that tells the rows to learn from."""
    small_batches(docs.sparkSession)
    own = F.col(f"`{doc_id}`")
    known = labels.where(train(own) & F.col(label).isNotNull() & own.isNotNull()) \
        .select(own.alias("id"), (F.col(label) != 0).cast("int").alias("toxic"))
    # one row an id; the bound of the sample is that of the broadcast
    known = known.groupBy("id").agg(F.max("toxic").alias("toxic"))
    totals = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    picked = None
    for y, bound in ((1, TOXIC_ROWS), (0, OTHER_ROWS)):
        part = known.where(F.col("toxic") == y).orderBy(F.xxhash64("id"), "id").limit(bound)
        picked = part if picked is None else picked.union(part)
    sample = stored(docs.select(own.alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
                    .join(F.broadcast(picked), "id").select("text", "toxic"), "toxic-sample")
    seen = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not seen.get(1) or not seen.get(0):
        share = totals.get(1, 0) / max(sum(totals.values()), 1)
        shift = float(np.log(share / (1 - share))) if 0 < share < 1 else -30.0 if share == 0 else 30.0
        return Model(Landmarks([]), np.zeros(0), 0.0, 0.0, shift)

    units = stored(labelled_units(sample), "toxic-units")
    n1, n0 = (int(x or 0) for x in units.agg(F.sum("toxic"), F.sum("others")).first())
    gain = F.col("toxic") * F.log((F.col("toxic") + 0.5) / (n1 + 1) / ((F.col("others") + 0.5) / (n0 + 1)))
    top = [r[0] for r in units.where("toxic > 0").orderBy(gain.desc(), "unit").limit(LANDMARKS - CLEAN_LANDMARKS).collect()]
    near = _compared(units.where("others > 0"), Landmarks(top), False)
    top += [r[0] for r in near.where(~F.col("unit").isin(top)).orderBy(F.desc("near"), "unit").limit(CLEAN_LANDMARKS).collect()]
    # altered forms of the words that many toxic texts have are to be found, too
    common = [r[0] for r in units.where((F.col("toxic") >= COMMON * seen[1]) & (F.col("others") * 20 < F.col("toxic")))
              .orderBy(F.desc("toxic"), "unit").limit(100).collect()]
    altered = sorted({v for u in common for v in variants(u)})
    landmarks = Landmarks(top)
    value, vector = np.linalg.eigh(landmarks.kernel(top).astype(np.float64))
    root = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-3))) @ vector.T

    # units near a landmark first, the others by hash
    table = _compared(units, landmarks, True).orderBy((F.col("near") < 0.02), F.xxhash64("unit"), "unit").limit(TRAIN_UNITS).toArrow()
    k = np.array(table.column("k").combine_chunks().flatten(), np.float32).reshape(-1, len(top)) @ root
    toxic, others = (table.column(c).to_numpy().astype(float) for c in ("toxic", "others"))

    rest = k[others > 0]

    extra = landmarks.kernel(altered) @ root

    def trained(positive, up, negative, down) -> Model:
        x = np.vstack([positive, extra, negative, rest])
        y = np.concatenate([np.ones(len(positive) + len(extra)), -np.ones(len(negative) + len(rest))])
        w = train_svm(x, y, np.concatenate([up / up.sum(), np.full(len(extra), ALTERED / max(len(extra), 1)),
                                            down / max(down.sum(), 1), REST * others[others > 0] / others.sum()]))
        return Model(landmarks, root @ w[:-1], w[-1])

    def counted(words):
        many = Counter(words)
        return landmarks.kernel(list(many)) @ root, np.array(list(many.values()), float)

    model = trained(k[toxic > 0], toxic[toxic > 0], rest, others[others > 0])
    left: list[str] = []
    for _ in range(ROUNDS):
        highest = _valued(sample, model).collect()
        found = [unit(r["unit"]) for r in highest if r["toxic"]]
        left += [unit(r["unit"]) for r in highest if not r["toxic"]]
        model = trained(*counted(found), *counted(left))
    got = _valued(sample, model).toArrow()
    y, v = got.column("toxic").to_numpy().astype(float), got.column("value").to_numpy()
    share = np.where(y > 0, totals.get(1, 0) / max(y.sum(), 1), totals.get(0, 0) / max((1 - y).sum(), 1))
    model.slope, model.shift = logistic(v, y, share / share.sum() * len(y))
    return model


def _valued(sample: DataFrame, model: Model) -> DataFrame:
    """(toxic, value, unit) of the sampled texts: bounded by the sample."""
    def run(batches):
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for i, j in _slices(texts):
                value, best = model.of_texts(texts[i:j])
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(i, j - i), pa.array(value), pa.array(best, pa.string())],
                                                 names=["toxic", "value", "unit"])

    return sample.select("text", "toxic").mapInArrow(run, "toxic int, value double, unit string")


def scored(spark: SparkSession, docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns, score, predicted, worst (the word with the highest value). No shuffle."""
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model)
    names = [f"c{k}" for k in range(len(keep))]
    fields = [T.StructField(n, docs.schema[c].dataType) for n, c in zip(names, keep)]
    fields += [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("worst", T.StringType())]

    def run(batches):
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            for i, j in _slices(texts):
                value, best = sent.value.of_texts(texts[i:j])
                score = sent.value.probability(value)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in range(len(keep))), pa.array(score),
                                                  pa.array((score >= 0.5).astype(np.int32)), pa.array(best, pa.string())],
                                                 names=[f.name for f in fields])

    source = docs.select(*[F.col(f"`{c}`").alias(n) for n, c in zip(names, keep)], F.col(f"`{text}`").cast("string").alias("text"))
    return source.mapInArrow(run, T.StructType(fields)).toDF(*keep, "score", "predicted", "worst")


def sentences(spark: SparkSession, docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """One row a sentence: ``keep`` columns, sentence, score."""
    parts = docs.select(*[F.col(f"`{c}`") for c in keep], F.explode(F.split(F.col(f"`{text}`"), SENTENCE.pattern)).alias("__sentence"))
    parts = parts.where(F.trim("__sentence") != "")
    return scored(spark, parts, model, [*keep, "__sentence"], "__sentence").drop("predicted", "worst").withColumnRenamed("__sentence", "sentence")
