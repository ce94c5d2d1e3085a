"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

Both tables are lower-cased (A-Z) and cut into words. Every run of ``n`` words
of a benchmark item is a window; an item of fewer words, but not none, is one
window. Each task holds the window hashes of the benchmark, sorted, and hashes
the windows of its own texts with a few array operations over the Arrow text
buffer; a hash that is found is verified on the words themselves. A word of a
document inside any occurrence of a window is hit.

Broadcast bound: the benchmark is sent in blocks of at most about
``BLOCK_BYTES`` of text. A larger one takes several passes, whose hits are
united through spans that travel with the rows; nothing grows with it but the
number of passes.

Cases: null and empty texts have no words; items without words have no
windows; a null item_id is reported as the empty string; items with the same
id count once; repeated documents stay; an empty table gives an empty table;
other columns of the documents are kept by ``filtered`` and ``cleaned`` and
never read.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.llm.common import LOWER, byte_set, small_batches, steps, stored, text_bytes, window_hashes, word_hashes, words_of

N = 13
BLOCK_BYTES = 8 << 20

# Bytes of a word after lower-casing: digits, letters and all
# bytes of characters beyond ASCII.
WORD = byte_set(b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(0x80, 0x100)))

HITS = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())]))


class Windows:
    """The distinct windows of one benchmark block, by length, sorted by hash:
    equal windows, of one item or several, are one entry with all their items."""

    def __init__(self, items: list[tuple[str, bytes]], n: int):
        self.words: list[list[bytes]] = []
        found: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for k, (_, text) in enumerate(items):
            data = LOWER[np.frombuffer(text, np.uint8)]
            start, end, _ = words_of(data, WORD, np.array([0, len(data)]))
            raw = data.tobytes()
            self.words.append([raw[a:b] for a, b in zip(start, end)])
            if len(start):
                size = min(n, len(start))
                h = window_hashes(word_hashes(data, start, end), size)
                found.setdefault(size, []).append((h, np.full(len(h), k), np.arange(len(h))))
        self.by_size = {}
        for size, parts in found.items():
            h, item, at = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(h, kind="stable")
            keys, first, names = [], [], []
            for k in order:
                words, run = self.words[item[k]][at[k]:at[k] + size], len(keys) - 1
                while run >= 0 and keys[run] == h[k] and self._at(first[run], size) != words:
                    run -= 1                        # another window of the same hash
                if run < 0 or keys[run] != h[k]:
                    keys.append(h[k])
                    first.append((int(item[k]), int(at[k])))
                    names.append(set())
                    run = len(keys) - 1
                names[run].add(items[item[k]][0])
            self.by_size[size] = np.array(keys, np.uint64), first, names

    def _at(self, spot: tuple[int, int], size: int) -> list[bytes]:
        return self.words[spot[0]][spot[1]:spot[1] + size]

    def occurrences(self, data: np.ndarray, offsets: np.ndarray):
        """(document, first word, size, items) of every occurrence in the
        texts, and the number of words of each text."""
        start, end, doc = words_of(data, WORD, offsets)
        counts = np.bincount(doc, minlength=len(offsets) - 1)
        first = np.concatenate(([0], np.cumsum(counts)))
        out = []
        if len(start):
            h = word_hashes(data, start, end)
            for size, (keys, spots, names) in self.by_size.items():
                windows = window_hashes(h, size)
                if not len(windows):
                    continue
                left = np.searchsorted(keys, windows)
                known = keys[np.minimum(left, len(keys) - 1)] == windows
                known &= doc[:len(windows)] == doc[size - 1:]
                for w in np.flatnonzero(known):
                    words = [data[a:b].tobytes() for a, b in zip(start[w:w + size], end[w:w + size])]
                    k = int(left[w])
                    while k < len(keys) and keys[k] == windows[w]:
                        if self._at(spots[k], size) == words:
                            out.append((int(doc[w]), int(w - first[doc[w]]), size, names[k]))
                            break
                        k += 1
        return out, counts


def _blocks(benchmark: DataFrame, item_id: str, text: str) -> list[list[tuple[str, bytes]]]:
    """The benchmark in blocks of about BLOCK_BYTES, each read by itself."""
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("name"),
                             F.coalesce(F.col(text), F.lit("")).alias("text")).distinct()
    size = items.agg(F.sum(F.octet_length("text") + F.octet_length("name"))).first()[0] or 0
    n = -(-size // BLOCK_BYTES)
    block = F.pmod(F.xxhash64("name", "text"), F.lit(max(n, 1)))
    for k in range(n):
        yield [(r[0], r[1].encode()) for r in items.where(block == k).collect()]


def _united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def hits(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, keep: list[str], n: int = N,
         text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``keep`` columns, n_words, hit (word spans, exclusive ends, disjoint,
    sorted), items (sorted ids of the items that occur). One pass over the
    documents for each block, without a shuffle."""
    return _scanned(spark, docs, benchmark, keep, n, text, item_id, item_text, False).drop("__text") \
        .toDF(*keep, "n_words", "hit", "items")


def _scanned(spark, docs, benchmark, keep, n=N, text="text", item_id="item_id", item_text="text", with_text=False) -> DataFrame:
    """As ``hits``; the ``keep`` columns are called c0, c1, ... here, so no name of theirs can clash."""
    small_batches(spark)
    inner = [f"c{k}" for k in range(len(keep))]
    fields = [T.StructField(c, docs.schema[k].dataType) for c, k in zip(inner, keep)]
    fields += [T.StructField("__text", T.StringType()), T.StructField("n_words", T.LongType()),
               T.StructField("hit", HITS), T.StructField("items", T.ArrayType(T.StringType()))]
    rows = docs.select(*[F.col(f"`{k}`").alias(c) for c, k in zip(inner, keep)],
                       F.col(f"`{text}`").cast("string").alias("__text"), F.lit(0).cast("long").alias("n_words"),
                       F.array().cast(HITS).alias("hit"), F.array().cast("array<string>").alias("items"))

    def scan(sent, carried: bool, give_text: bool):
        def run(batches):
            windows = Windows(sent.value, n)
            for batch in batches:
                data, offsets = text_bytes(batch.column(len(keep)))
                for i, j in steps(offsets):
                    at = offsets[i:j + 1]
                    found, counts = windows.occurrences(LOWER[data[at[0]:at[-1]]], at - at[0])
                    part = batch.slice(i, j - i)
                    spans = [[] for _ in range(j - i)]
                    items = [set() for _ in range(j - i)]
                    if carried:
                        spans = [[(x["first"], x["last"]) for x in s] for s in part.column(len(keep) + 2).to_pylist()]
                        items = [set(x) for x in part.column(len(keep) + 3).to_pylist()]
                    last: dict[int, set] = {}
                    for doc, first, size, names in found:
                        if spans[doc] and spans[doc][-1][0] <= first <= spans[doc][-1][1]:    # runs of hits are one span
                            spans[doc][-1] = spans[doc][-1][0], max(spans[doc][-1][1], first + size)
                        else:
                            spans[doc].append((first, first + size))
                        if last.get(doc) is not names:
                            items[doc] |= names
                            last[doc] = names
                    columns = [part.column(c) for c in range(len(keep))]
                    columns.append(part.column(len(keep)) if give_text else pa.nulls(j - i, pa.string()))
                    columns.append(pa.array(counts, pa.int64()))
                    columns.append(pa.array([[{"first": a, "last": b} for a, b in _united(s)] for s in spans],
                                            pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))))
                    columns.append(pa.array([sorted(x) for x in items], pa.list_(pa.string())))
                    yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])
        return run

    blocks = _blocks(benchmark, item_id, item_text)
    block = next(blocks, [])  # without items the scan still counts words
    carried = False
    while True:
        following = next(blocks, None)
        last = following is None
        rows = rows.mapInArrow(scan(spark.sparkContext.broadcast(block), carried, with_text or not last), T.StructType(fields))
        if last:
            break
        rows, block, carried = stored(rows, "hits"), following, True
    return rows


N_HIT = "aggregate(hit, 0L, (s, x) -> s + x.last - x.first)"
CONTAMINATED = f"({N_HIT} > 0 AND 20 * {N_HIT} >= n_words)"


def report(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated (n_hit > 0
    and n_hit at least a twentieth of n_words)."""
    found = hits(spark, docs, benchmark, [doc_id])
    return found.select(doc_id, "n_words", F.expr(N_HIT).alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        F.expr(CONTAMINATED).alias("contaminated"))


def filtered(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents that are not contaminated, with all their columns, unchanged."""
    found = _scanned(spark, docs, benchmark, docs.columns, text=text).where(f"NOT {CONTAMINATED}")
    return found.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)])


def cleaned(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """All documents; the words that are hit are cut out of ``text``, together
    with what stands between them."""
    @F.pandas_udf("string")
    def cut(texts, spans):
        return texts.combine(spans, lambda t, s: t if t is None or s is None or not len(s) else _cut(t, s))

    found = _scanned(spark, docs, benchmark, docs.columns, text=text, with_text=True)
    return found.select(*[(cut("__text", "hit") if c == text else F.col(f"c{k}")).alias(c) for k, c in enumerate(docs.columns)])


def _cut(text: str, spans) -> str:
    raw = text.encode()
    data = LOWER[np.frombuffer(raw, np.uint8)]
    start, end, _ = words_of(data, WORD, np.array([0, len(data)]))
    out, at = [], 0
    for s in spans:
        out.append(raw[at:start[s["first"]]])
        at = end[s["last"] - 1]
    return b"".join([*out, raw[at:]]).decode()


