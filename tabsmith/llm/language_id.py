"""Language identification by interpolated Kneser-Ney character models.

Text is lower-cased, every run of other characters than letters becomes one
blank, and UTF-16 units are the symbols. For each language the counts of all
4-grams of all training texts are gathered by Spark (each task counts its own
rows first). Lower orders use continuation counts; each order interpolates with
the next lower by its absolute discount. The tables of all languages share
sorted arrays of hashes with a jump table on their top bits, and one row of log
probabilities a gram, so a text costs one lookup a character for a gram that
any language knows.

The language with the lowest cross-entropy a character is chosen. Rejection is
calibrated on all training texts, by one aggregate: beyond ``Z`` standard
deviations of their cross-entropy under the chosen language, with a spread for
short texts from the variance of single characters, a text is rejected; so are
texts without a letter.

Every 4-gram counts. Up to ``WHOLE_CELLS`` (counts x languages) the tables are
collected and broadcast. Beyond, ``Blocks`` keeps all orders, discounts and
context sums as tables in the shared folder: the grams of the texts at hand get
their probabilities by joins, order after order, and meet the texts in buckets
of rows. More than ``MAX_LANGUAGES`` labels fail.

Cases: a null text or one without a letter is ``und`` with score 0; equal
cross-entropies give the first label in order; repeated rows count as often as
they occur; without any training text everything is ``und``; other columns are
kept where named and never read.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.llm.common import Hashed, input_bytes, small_batches, stored

ORDER = 4
#: Counts of 4-grams times languages up to which every task holds the models.
WHOLE_CELLS = 1 << 22
#: 4-grams that a counting task holds before it hands them on.
HELD = 1 << 21
#: Texts of one task where the models are joined, for up to four languages.
BUCKET_BYTES = 8 << 20
MAX_LANGUAGES = 256
Z = 8.0
#: Least deviation of a language's cross-entropies, in nats: texts that mix languages are no noise.
MIN_SPREAD = 0.2
#: Scales of scores that calibration tries.
SCALES = [2.0 ** (k / 2) for k in range(-2, 15)]
STEP_CHARS = 1 << 19
UNKNOWN = "und"

_NOT_LETTERS = re.compile(r"[\W\d_]+")


def plain(text: str | None) -> str:
    """Letters in lower case, one blank between words; empty without a letter."""
    out = _NOT_LETTERS.sub(" ", (text or "").lower()).strip()
    return out if any(map(str.isalpha, out)) else ""


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """4-grams of plain texts, packed with the last symbol lowest, and the
    offsets of each text's grams. Blanks stand before and after a text."""
    data = np.frombuffer("".join(f"   {t} " if t else "" for t in texts).encode("utf-16-le", "surrogatepass"), np.uint16)
    sizes = np.array([len(t.encode("utf-16-le", "surrogatepass")) // 2 + 4 if t else 0 for t in texts], np.int64)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    wide = data.astype(np.uint64)
    packed = wide[3:] | wide[2:-1] << np.uint64(16) | wide[1:-2] << np.uint64(32) | wide[:-3] << np.uint64(48)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    inside = np.ones(len(packed) + 3, bool)
    first = starts[:-1][sizes > 0]
    for k in range(3):  # what ends in a text's leading blanks is no gram of it
        inside[first + k] = False
    return packed[inside[3:]], np.concatenate(([0], np.cumsum(np.maximum(sizes - 3, 0))))


def _steps(texts: list[str | None]):
    i = 0
    while i < len(texts):
        j, chars = i, 0
        while j < len(texts) and (j == i or chars + len(texts[j] or "") <= STEP_CHARS):
            chars += len(texts[j] or "")
            j += 1
        yield i, j
        i = j


def count_grams(docs: DataFrame, lang: str, text: str) -> DataFrame:
    """(lang, gram, n) over all rows with a language, summed."""
    def run(batches):
        total: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, j in _steps(texts):
                by: dict[str, list[str]] = {}
                for name, t in zip(langs[i:j], texts[i:j]):
                    by.setdefault(name, []).append(plain(t))
                for name, own in by.items():
                    g, n = np.unique(grams(own)[0], return_counts=True)
                    if name in total:
                        old, many = total[name]
                        both, back = np.unique(np.concatenate((old, g)), return_inverse=True)
                        g, n = both, np.bincount(back, np.concatenate((many, n)), len(both)).astype(np.int64)
                    total[name] = g, n
            if sum(len(g) for g, _ in total.values()) > HELD:
                yield from _counted(total)
                total = {}
        yield from _counted(total)

    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).where("lang IS NOT NULL")
    return rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _counted(total):
    for name, (g, n) in total.items():
        if len(g):
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(g)), pa.array(g.view(np.int64)), pa.array(n.astype(np.int64))],
                                             names=["lang", "gram", "n"])


class Limits:
    """What calibration tells of each language: mean and spread of its
    cross-entropies, variance of its characters; and the scale of scores."""

    def __init__(self, langs: list[str]):
        self.langs = langs
        self.mean = np.zeros(len(langs))
        self.spread = np.full(len(langs), np.inf)
        self.noise = np.zeros(len(langs))
        self.scale = 10.0


def discount(ones: int, twos: int) -> float:
    return ones / (ones + 2 * twos) if ones and twos else 0.5


def entropies(texts: list[str | None], k: int, logs_of) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cross-entropy by language, variance of it by language, symbols) of each
    text; ``logs_of`` gives the log probabilities of packed 4-grams."""
    packed, at = grams([plain(t) for t in texts])
    size = at[1:] - at[:-1]
    total, square = np.zeros((len(texts), max(k, 1))), np.zeros((len(texts), max(k, 1)))
    some = size > 0
    if some.any() and k:
        logs = logs_of(packed)
        total[some] = np.add.reduceat(logs, at[:-1][some], axis=0, dtype=np.float64)
        square[some] = np.add.reduceat(logs * logs, at[:-1][some], axis=0, dtype=np.float64)
    n = np.maximum(size, 1)[:, None]
    entropy = -total / n
    return entropy, np.maximum(square / n - entropy ** 2, 0), size


class Model:
    """Kneser-Ney models of several languages in shared tables."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = sorted(counts)
        k = len(self.langs)
        per = [self._orders(*counts[name]) for name in self.langs]
        self.tables, self.back = {}, {}
        for n in range(1, ORDER + 1):
            keys = np.unique(np.concatenate([o[n][0] for o in per] or [np.zeros(0, np.uint64)]))
            contexts = np.unique(keys >> np.uint64(16))
            share = np.full((len(keys), k), 0.0)
            gamma = np.ones((len(contexts), k))
            for j, orders in enumerate(per):
                g, c = orders[n]
                if not len(g):
                    continue
                ctx, where = np.unique(g >> np.uint64(16), return_inverse=True)
                total = np.bincount(where, c)
                types = np.bincount(where)
                cut = discount(int((c == 1).sum()), int((c == 2).sum()))
                share[np.searchsorted(keys, g), j] = np.maximum(c - cut, 0) / total[where]
                gamma[np.searchsorted(contexts, ctx), j] = cut * types / total
            spot = np.searchsorted(contexts, keys >> np.uint64(16))
            if n == 1:
                below = np.full((len(keys), k), 2.0 ** -16)
            else:
                below = np.exp(self._logs(keys & np.uint64((1 << 16 * (n - 1)) - 1), n - 1))
            self.tables[n] = Hashed(keys, np.log(share + gamma[spot] * below).astype(np.float32))
            self.back[n] = Hashed(contexts, np.log(gamma).astype(np.float32))
        self.limits = Limits(self.langs)

    @staticmethod
    def _orders(g: np.ndarray, n: np.ndarray):
        out = {ORDER: (g, n.astype(np.float64))}
        for order in range(ORDER - 1, 0, -1):
            shorter = np.unique(out[order + 1][0]) & np.uint64((1 << 16 * order) - 1)
            keys, many = np.unique(shorter, return_counts=True)
            out[order] = keys, many.astype(np.float64)
        return out

    def _logs(self, keys: np.ndarray, n: int) -> np.ndarray:
        """Log probability of the last symbol after the others, by language."""
        at = self.tables[n].find(keys)
        if len(self.tables[n].rows):
            out = self.tables[n].rows[np.maximum(at, 0)].astype(np.float32)
        else:
            out = np.zeros((len(keys), len(self.langs)), np.float32)
        miss = np.flatnonzero(at < 0)
        if len(miss):
            if n == 1:
                lower = np.full((len(miss), len(self.langs)), -16 * np.log(2.0), np.float32)
                context = np.zeros(len(miss), np.uint64)
            else:
                lower = self._logs(keys[miss] & np.uint64((1 << 16 * (n - 1)) - 1), n - 1)
                context = keys[miss] >> np.uint64(16)
            spot = self.back[n].find(context)
            known = spot >= 0
            if known.any():
                lower[known] += self.back[n].rows[spot[known]]
            out[miss] = lower
        return out

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cross-entropy by language, variance of it by language, symbols) of each text."""
        return entropies(texts, len(self.langs), lambda packed: self._logs(packed, ORDER))

    def through(self, source: DataFrame, made, schema: T.StructType) -> DataFrame:
        """What ``made(score, batch)`` yields for the batches of ``source``. No shuffle."""
        sent = source.sparkSession.sparkContext.broadcast(self)

        def run(batches):
            for batch in batches:
                yield from made(sent.value.score, batch)

        return source.mapInArrow(run, schema)


class Blocks:
    """The models of ``Model`` as tables in the shared folder, for any number of
    grams: counts of each order, and totals and kinds of each context."""

    def __init__(self, counts: DataFrame, langs: list[str]):
        self.langs, self.limits = langs, Limits(langs)
        self.cuts, self.grams, self.contexts = {}, {}, {}
        place = F.from_json(F.lit(json.dumps({name: j for j, name in enumerate(langs)})), "map<string,int>")
        own = counts.select(F.try_element_at(place, F.col("lang")).alias("j"), "gram", "n")
        by_lang = lambda *values: F.map_from_entries(F.collect_list(F.struct("j", *values)))
        for n in range(ORDER, 0, -1):
            if n < ORDER:
                own = own.groupBy("j", _suffix(n).alias("gram")).agg(F.count("*").alias("n"))
            own = stored(own, f"order{n}")
            self.cuts[n] = [0.5] * len(langs)
            for r in own.groupBy("j").agg(F.count_if(F.col("n") == 1).alias("ones"), F.count_if(F.col("n") == 2).alias("twos")).collect():
                self.cuts[n][r["j"]] = discount(r["ones"], r["twos"])
            self.grams[n] = stored(own.groupBy("gram").agg(by_lang("n").alias("counts")), f"grams{n}")
            sums = own.groupBy("j", _context().alias("context")).agg(F.sum("n").alias("total"), F.count("*").alias("types"))
            self.contexts[n] = stored(sums.groupBy("context").agg(by_lang(F.struct("total", "types")).alias("sums")), f"contexts{n}")

    def probabilities(self, wanted: DataFrame) -> DataFrame:
        """(gram, logs): log probabilities by language of distinct 4-grams."""
        levels = {ORDER: wanted}
        for n in range(ORDER - 1, 0, -1):
            levels[n] = levels[n + 1].select(_suffix(n).alias("gram")).distinct()
        out = None
        for n in range(1, ORDER + 1):
            rows = levels[n].join(self.grams[n], "gram", "left").withColumn("context", _context()) \
                .join(self.contexts[n], "context", "left")
            if n == 1:
                rows = rows.withColumn("p", F.array_repeat(F.lit(2.0 ** -16), len(self.langs)))
            else:
                rows = rows.withColumn("below", _suffix(n - 1)).join(out.withColumnRenamed("gram", "below"), "below")
            out = stored(rows.select("gram", F.transform("p", _interpolated(self.cuts[n])).alias("p")), f"probabilities{n}")
        return out.select("gram", F.transform("p", lambda p: F.log(p).cast("float")).alias("logs"))

    def through(self, source: DataFrame, made, schema: T.StructType) -> DataFrame:
        """As of ``Model``. Rows are dealt into buckets by their place, so neither
        an id nor a text that is frequent makes one large; each bucket's grams
        are joined to the models."""
        k, last = len(self.langs), source.columns[-1]
        buckets = max(1, input_bytes(source) * max(k, 4) // (4 * BUCKET_BYTES))
        # written first: a repeated task must deal its rows alike
        rows = stored(source.select(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(buckets)).alias("bucket"), "*"), "texts")

        def needs(batches):
            for batch in batches:
                bucket, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
                for i, j in _steps(texts):
                    packed, at = grams([plain(t) for t in texts[i:j]])
                    b = np.repeat(bucket[i:j], at[1:] - at[:-1])
                    order = np.lexsort((packed, b))
                    packed, b = packed[order], b[order]
                    first = np.ones(len(b), bool)
                    first[1:] = (packed[1:] != packed[:-1]) | (b[1:] != b[:-1])
                    yield pa.RecordBatch.from_arrays([pa.array(b[first]), pa.array(packed[first].view(np.int64))], names=["bucket", "gram"])

        wanted = stored(rows.select("bucket", last).mapInArrow(needs, "bucket long, gram long").distinct(), "wanted")
        found = wanted.join(self.probabilities(wanted.select("gram").distinct()), "gram").select("bucket", "gram", "logs")
        names = schema.names

        def run(texts: pa.Table, found: pa.Table) -> pa.Table:
            own = found.column("gram").to_numpy().view(np.uint64)
            order = np.argsort(own)
            own = own[order]
            logs = found.column("logs").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(own), k)[order]
            score = lambda t: entropies(t, k, lambda packed: logs[np.searchsorted(own, packed)])
            out = [b for batch in texts.drop_columns(["bucket"]).to_batches() for b in made(score, batch)]
            return pa.Table.from_batches(out).select(names)

        return rows.groupBy("bucket").cogroup(found.groupBy("bucket")).applyInArrow(run, schema)


def _interpolated(cuts: list[float]):
    """The probability of a language, from that of the order below."""
    def step(p, j):
        at, cut = F.try_element_at("sums", j), F.get(F.array(*map(F.lit, cuts)), j)
        many = F.coalesce(F.try_element_at("counts", j), F.lit(0))
        return F.when(at.isNull(), p).otherwise((F.greatest(many - cut, F.lit(0.0)) + cut * at["types"] * p) / at["total"])

    return step


def _suffix(n: int) -> Column:
    return F.col("gram").bitwiseAND(F.lit((1 << 16 * n) - 1))


def _context() -> Column:
    return F.shiftrightunsigned("gram", 16)


def fit(docs: DataFrame, train: Column, lang: str = "lang", text: str = "text") -> Model | Blocks:
    """Models from the rows for which ``train`` holds, calibrated on all of them."""
    small_batches(docs.sparkSession)
    rows = docs.where(train & F.col(lang).isNotNull() & F.col(text).isNotNull())
    many = rows.select(lang).distinct().limit(MAX_LANGUAGES + 1).count()
    if many > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    kept = stored(count_grams(rows, lang, text), "grams")
    langs = sorted(r[0] for r in kept.select("lang").distinct().collect())
    if kept.count() * len(langs) > WHOLE_CELLS:
        model = Blocks(kept, langs)
    else:
        table = kept.toArrow()
        names = np.array(table.column("lang").to_pylist(), object)
        g, n = table.column("gram").to_numpy().view(np.uint64), table.column("n").to_numpy()
        counts = {}
        for name in langs:
            mine = names == name
            order = np.argsort(g[mine])
            counts[name] = g[mine][order], n[mine][order]
        model = Model(counts)
    if langs:
        _calibrate(model, rows, lang, text)
    return model


def _calibrate(model: Model | Blocks, rows: DataFrame, lang: str, text: str) -> None:
    """Mean and spread of cross-entropies by language, and the scale at which
    scores are likeliest, from all training rows: sums of each batch, summed."""
    langs, sums = model.langs, ["n", "low", "square", "noise", *[f"loss{k}" for k in range(len(SCALES))]]

    def made(score, batch):
        labels, texts = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_pylist()
        for i, j in _steps(texts):
            entropy, noise, size = score(texts[i:j])
            some = size > 0
            entropy, noise = entropy[some], noise[some]
            label = np.searchsorted(langs, labels[i:j][some].astype(str))
            best, low = entropy.argmin(axis=1), entropy.min(axis=1)
            values = [np.ones(len(best)), low, low ** 2, noise[np.arange(len(best)), best]]
            for scale in SCALES:
                z = -scale * (entropy - low[:, None])
                values.append(np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), label])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(langs))), *(pa.array(np.bincount(best, v, len(langs))) for v in values)],
                                             names=["best", *sums])

    schema = T.StructType([T.StructField("best", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in sums]])
    source = rows.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    got = model.through(source, made, schema).groupBy("best").agg(*[F.sum(c).alias(c) for c in sums]).toArrow()
    table = np.zeros((len(langs), len(sums)))
    table[got.column("best").to_numpy()] = np.stack([got.column(c).to_numpy() for c in sums], axis=1)
    whole, limits = table.sum(axis=0), model.limits
    if not whole[0]:
        return
    for k in range(len(langs)):
        n, low, square, noise = (table[k] if table[k, 0] >= 10 else whole)[:4]  # too few to tell: as all languages together
        limits.mean[k] = low / n
        limits.spread[k] = max(max(square / n - (low / n) ** 2, 0.0) ** 0.5, MIN_SPREAD)
        limits.noise[k] = noise / n
    limits.scale = SCALES[int(whole[4:].argmin())]


def identified(spark: SparkSession, docs: DataFrame, model: Model | Blocks, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns, lang_pred, score, rejected, cross_entropy. No shuffle unless the models are ``Blocks``."""
    return _identified(spark, docs, model, keep, text).toDF(*keep, "lang_pred", "score", "rejected", "cross_entropy")


def accepted(spark: SparkSession, docs: DataFrame, model: Model | Blocks, text: str = "text") -> DataFrame:
    """The rows that are not rejected, with all their columns. Without any
    language to learn from only texts without a letter are rejected."""
    found = _identified(spark, docs, model, docs.columns, text).where("NOT rejected")
    return found.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)])


def _identified(spark, docs, model, keep, text) -> DataFrame:
    """As ``identified``; the ``keep`` columns are called c0, c1, ..."""
    small_batches(spark)
    limits = model.limits
    names = [f"c{k}" for k in range(len(keep))]
    fields = [T.StructField(n, docs.schema[c].dataType) for n, c in zip(names, keep)]
    fields += [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
               T.StructField("rejected", T.BooleanType()), T.StructField("cross_entropy", T.DoubleType())]
    columns = [f.name for f in fields]

    def made(score, batch):
        m = limits
        labels = np.array([*m.langs, UNKNOWN], object)
        texts = batch.column(len(keep)).to_pylist()
        for i, j in _steps(texts):
            entropy, _, size = score(texts[i:j])
            best = entropy.argmin(axis=1)
            low = entropy[np.arange(j - i), best]
            share = 1 / np.exp(-m.scale * (entropy - low[:, None])).sum(axis=1)
            empty = size == 0
            none = empty | (len(m.langs) == 0)
            best[none] = len(m.langs)
            if m.langs:
                k = np.minimum(best, len(m.langs) - 1)
                limit = m.mean[k] + Z * np.sqrt(m.spread[k] ** 2 + m.noise[k] / np.maximum(size, 1))
                rejected = empty | (low > limit)
            else:
                rejected = empty
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).slice(i, j - i) for c in range(len(keep))), pa.array(labels[best], pa.string()),
                 pa.array(np.where(none, 0.0, share)), pa.array(rejected), pa.array(np.where(none, None, low), pa.float64())],
                names=columns)

    source = docs.select(*[F.col(f"`{c}`").alias(n) for n, c in zip(names, keep)], F.col(f"`{text}`").cast("string").alias("text"))
    return model.through(source, made, T.StructType(fields))
