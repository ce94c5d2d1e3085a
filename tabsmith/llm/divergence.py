"""Source divergence audit: how far the term shares of one source are from another's, and which terms stand out.

Terms are runs of ASCII letters and characters beyond ASCII, lower-cased in
A-Z. A language keeps the terms of at least ``MIN_DOCS`` of its documents.
Every group (language, source), and the language as a whole, gives a kept term
the integer share p = 1 + floor(10^9 (count + 1) / (N + V)); the divergence of
a term is floor((p - q)^2 / q). All arithmetic is on integers: the share is a
long division in three steps of a thousand, exact below 9 * 10^15 tokens a
language.

Spread: tasks count the terms of their own Arrow batches (dictionary codes,
exact), Spark adds the counts up, so a hot source or term costs one row a task.
Kept terms get numbers in blocks of about ``BLOCK`` terms of a language. A
group's counts in a block are two sorted arrays (term numbers and counts),
sent as variable-length bytes. For every unordered pair of groups and block,
the two arrays are co-grouped: a galloping search finds the common terms, and
common, one-sided and absent terms are priced both ways. A task thus holds two
arrays of at most ``BLOCK`` terms, whatever the size of a source; sums of
blocks are added by Spark. The result has one row for each ordered pair of
sources of a language by nature.

Cases: null texts, languages and sources read as empty text; a group without
kept terms has the shares of absent terms; a language without kept terms gives
0 for every pair; a language of one source has no pairs; repeated rows count as
documents of their own; an empty table gives an empty table; other columns,
also of clashing names, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabsmith.llm.common import LOWER, byte_set, small_batches, steps, stored, text_bytes, words_of

# Fixed values of the audit.
MIN_DOCS, SCALE, TOP = 3, 10**9, 200
#: Terms of a language that one block of a pair holds, about.
BLOCK = 1 << 16
#: Short-side terms that one galloping step looks up at once.
STRIDE = 256

TERM = byte_set(b"abcdefghijklmnopqrstuvwxyz" + bytes(range(0x80, 0x100)))


# ------------------------------------------------------------- counting ---

def batch_counts(groups: pa.Array, texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """(group, term, tokens, documents) of one step of texts; ``groups`` are small numbers, one a text."""
    data, offsets = text_bytes(texts)
    data, offsets = LOWER[data[offsets[0]:offsets[-1]]], offsets - offsets[0]
    start, end, doc = words_of(data, TERM, offsets)
    if not len(start):
        return np.zeros(0, np.int64), pa.array([], pa.binary()), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = np.zeros(len(data) + 1, np.int32)
    inside[start] += 1
    inside[end] -= 1      # a word may start where another text's ends
    packed = data[np.cumsum(inside[:-1]).astype(bool)]
    ends = np.concatenate(([0], np.cumsum(end - start))).astype(np.int32)
    terms = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(packed)]).dictionary_encode()
    codes, n = terms.indices.to_numpy(), len(terms.dictionary)
    cells, tokens = np.unique(doc * n + codes, return_counts=True)          # a document's tokens of a term
    keys, at = np.unique(groups[cells // n] * n + cells % n, return_inverse=True)
    return (keys // n, terms.dictionary.take(pa.array(keys % n)), np.bincount(at, tokens, len(keys)).astype(np.int64),
            np.bincount(at, minlength=len(keys)))


def counted(spark: SparkSession, docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, term, tokens, docs); a row with a null term for every group."""
    small_batches(spark)
    plain = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = docs.select(plain(lang).alias("lang"), plain(source).alias("source"), plain(text).alias("text"))

    def run(batches):
        for batch in batches:
            langs, sources = (batch.column(k).dictionary_encode() for k in (0, 1))
            width = max(1, len(sources.dictionary))
            both = langs.indices.to_numpy().astype(np.int64) * width + sources.indices.to_numpy()
            known, groups = np.unique(both, return_inverse=True)
            name = lambda at: (langs.dictionary.take(pa.array(known[at] // width)), sources.dictionary.take(pa.array(known[at] % width)))  # noqa: E731, B023
            every = np.arange(len(known))
            none = pa.array(np.zeros(len(known), np.int64))
            yield pa.RecordBatch.from_arrays([*name(every), pa.nulls(len(known), pa.string()), none, none], names=NAMES)
            sizes = pc.binary_length(batch.column(2)).to_numpy().astype(np.int64)
            for i, j in steps(np.concatenate(([0], np.cumsum(sizes))), 8 << 20):
                group, term, tokens, in_docs = batch_counts(groups[i:j], batch.column(2).slice(i, j - i))
                yield pa.RecordBatch.from_arrays([*name(group), term.cast(pa.string()), pa.array(tokens), pa.array(in_docs)], names=NAMES)

    return rows.mapInArrow(run, "lang string, source string, term string, tokens long, docs long") \
        .groupBy("lang", "source", "term").agg(F.sum("tokens").alias("tokens"), F.sum("docs").alias("docs"))


NAMES = ["lang", "source", "term", "tokens", "docs"]


# --------------------------------------------------------------- shares ---

def share(count: Column, whole: Column) -> Column:
    """1 + floor(10^9 (count + 1) / whole), exactly: the division is taken in steps of a thousand."""
    out, rest = F.lit(0).cast("long"), count + 1
    for _ in range(3):
        out, rest = out * 1000 + _div(rest * 1000, whole), (rest * 1000) % whole
    return out + 1


def _div(a: Column, b: Column) -> Column:
    """Integer quotient of two longs that are not negative."""
    return F.call_function("div", a, b)


def shares(counts: np.ndarray, whole: int) -> np.ndarray:
    """The same of an array of counts."""
    out, rest = np.zeros(len(counts), np.int64), counts + 1
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // whole, rest % whole
    return out + 1


def strayed(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), q)


def _strayed(p, q):
    return (p - q) * (p - q) // q


# ------------------------------------------------------------ pair tasks ---

def coded(values: np.ndarray) -> bytes:
    """Numbers that are not negative, seven bits a byte, the last byte of each marked."""
    rest, parts, left = values.astype(np.uint64), [], np.ones(len(values), bool)
    sizes = np.ones(len(values), np.int64)
    for _ in range(9):
        more = rest >> np.uint64(7) > 0
        parts.append((rest & np.uint64(127)).astype(np.uint8))
        rest = rest >> np.uint64(7)
        left = left & more
        if not left.any():
            break
        sizes += left
    at = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint8)
    for k, part in enumerate(parts):
        there = sizes > k
        out[at[there] + k] = part[there] | np.where(sizes[there] == k + 1, 128, 0).astype(np.uint8)
    return out.tobytes()


def decoded(raw: bytes) -> np.ndarray:
    data = np.frombuffer(raw, np.uint8)
    ends = np.flatnonzero(data & 128)
    if not len(ends):
        return np.zeros(0, np.int64)
    begin = np.concatenate(([0], ends[:-1] + 1))
    place = np.arange(len(data)) - np.repeat(begin, ends - begin + 1)
    return np.add.reduceat((data & 127).astype(np.int64) << (7 * place), begin)


def common(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the common values of two sorted arrays without repeats. The
    longer one is galloped through: from the last place, in doubled steps, up
    to the end of the next stride of the shorter one, which is then looked up
    between those places."""
    if len(a) > len(b):
        at_b, at_a = common(b, a)
        return at_a, at_b
    found, low = [np.zeros(0, np.int64)], 0
    for i in range(0, len(a), STRIDE):
        stride, step, high = a[i:i + STRIDE], STRIDE, low
        while high < len(b) and b[high] <= stride[-1]:
            high, step = high + step, 2 * step
        found.append(low + np.searchsorted(b[low:high], stride))
        low = int(found[-1][-1])
    at = np.concatenate(found)
    same = np.flatnonzero((at < len(b)) & (b[np.minimum(at, len(b) - 1)] == a)) if len(b) else np.zeros(0, np.int64)
    return same, at[same]


def priced(a: tuple[np.ndarray, np.ndarray, int], b: tuple[np.ndarray, np.ndarray, int]) -> tuple[int, int, int]:
    """(value of a against b, value of b against a, terms that either holds)
    over the terms of two sorted sparse arrays (numbers, counts, N + V)."""
    p, q = shares(a[1], a[2]), shares(b[1], b[2])
    p0, q0 = (int(shares(np.zeros(1, np.int64), whole)[0]) for whole in (a[2], b[2]))
    in_a, in_b = common(a[0], b[0])
    only_a, only_b = np.delete(p, in_a), np.delete(q, in_b)
    both = p[in_a], q[in_b]
    ab = int(_strayed(*both).sum()) + int(_strayed(only_a, q0).sum()) + int(_strayed(p0, only_b).sum())
    ba = int(_strayed(both[1], both[0]).sum()) + int(_strayed(q0, only_a).sum()) + int(_strayed(only_b, p0).sum())
    return ab, ba, len(p) + len(q) - len(in_a)


PAIR = "lang string, a string, b string, ab long, ba long, held long"


def _pair_task(left: pa.Table, right: pa.Table) -> pa.Table:
    one = lambda t: (np.cumsum(decoded(t["ids"][0].as_py())), decoded(t["counts"][0].as_py()), t["whole"][0].as_py())
    ab, ba, held = priced(one(left), one(right))
    return pa.table({"lang": left["lang"], "a": left["a"], "b": left["b"], "ab": pa.array([ab]), "ba": pa.array([ba]),
                     "held": pa.array([held])})


def _pack(batches):
    """The last column, sorted lists of (number, count), as two coded columns: steps between numbers, and counts."""
    for batch in batches:
        *keep, cells = batch.columns
        lists = [(x.values.field(0).to_numpy(zero_copy_only=False), x.values.field(1).to_numpy(zero_copy_only=False)) for x in cells]
        ids = pa.array([coded(np.diff(number, prepend=0)) for number, _ in lists], pa.binary())
        counts = pa.array([coded(count) for _, count in lists], pa.binary())
        yield pa.RecordBatch.from_arrays([*keep, ids, counts], names=ARRAYS)


ARRAYS = ["lang", "source", "block", "whole", "ids", "counts"]


def audit(spark: SparkSession, docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, block: int = BLOCK,
          lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank): ``pair`` rows hold the
    divergence from each other source of the language, ``term`` rows the
    ``top`` terms that the source uses more than its language does."""
    counts = stored(counted(spark, docs, lang, source, text), "terms")
    terms = counts.where("term IS NOT NULL")
    kept = stored(terms.groupBy("lang", "term").agg(F.sum("tokens").alias("total"), F.sum("docs").alias("docs"))
                  .where(F.col("docs") >= min_docs).drop("docs"), "kept")
    blocks = -(-kept.count() // block) or 1   # of any language; a language of fewer terms leaves some empty
    kept = kept.withColumn("block", F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int"))
    kept = kept.withColumn("id", F.row_number().over(Window.partitionBy("lang", "block").orderBy("term")).cast("long"))
    rows = stored(terms.select("lang", "source", "term", "tokens").join(kept, ["lang", "term"]), "kept-counts")

    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n"))
    own = rows.groupBy("lang", "source").agg(F.sum("tokens").alias("n"))
    groups = counts.where("term IS NULL").select("lang", "source").join(langs, "lang", "left").join(own, ["lang", "source"], "left") \
        .select("lang", "source", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("v", "lang_n", "n")])
    groups = stored(groups, "groups")

    # sorted sparse arrays of each group and block, empty ones too
    empty = groups.where("v > 0").select("lang", "source", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
                                         F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("tokens"))
    cells = rows.select("lang", "source", "block", "id", "tokens").unionByName(empty)
    # the empty cells only make their group exist: nulls are not collected
    cell = F.when(F.col("id").isNotNull(), F.struct("id", "tokens"))
    cells = cells.groupBy("lang", "source", "block").agg(F.sort_array(F.collect_list(cell)).alias("cells"))
    cells = cells.join(groups.select("lang", "source", (F.col("n") + F.col("v")).alias("whole")), ["lang", "source"])
    arrays = stored(cells.select("lang", "source", "block", "whole", "cells")
                    .mapInArrow(_pack, "lang string, source string, block int, whole long, ids binary, counts binary"), "sparse")

    names = groups.select("lang", F.col("source").alias("other"))
    left = arrays.join(names, "lang").where("source < other").withColumnsRenamed({"source": "a", "other": "b"})
    right = arrays.join(names, "lang").where("other < source").withColumnsRenamed({"other": "a", "source": "b"})
    right = right.toDF(*right.columns)       # both sides come from one frame: columns of their own
    sums = left.groupBy("lang", "a", "b", "block").cogroup(right.groupBy("lang", "a", "b", "block")).applyInArrow(_pair_task, PAIR) \
        .groupBy("lang", "a", "b").agg(*[F.sum(c).alias(c) for c in ("ab", "ba", "held")])
    sums = sums.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item"), F.col("ab").alias("value"), "held"),
                                                 F.struct(F.col("b").alias("source"), F.col("a").alias("item"), F.col("ba").alias("value"), "held"))).alias("x")) \
        .select("lang", "x.*")
    whole = F.greatest(F.col("n") + F.col("v"), F.lit(1))
    base = groups.select("lang", "source", "v", "lang_n", "n", share(F.lit(0).cast("long"), whole).alias("p0"))
    pairs = base.join(base.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0")), "lang").where("source <> item") \
        .join(sums, ["lang", "source", "item"], "left")
    absent = (F.col("v") - F.col("held")) * strayed(F.col("p0"), F.col("q0"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item",
                         F.when(F.col("v") == 0, F.lit(0).cast("long")).otherwise(F.col("value") + absent).alias("value"))
    own_share = share(F.col("tokens"), F.col("n") + F.col("v"))
    all_share = share(F.col("total"), F.col("lang_n") + F.col("v"))
    high = rows.join(groups, ["lang", "source"]).withColumn("p", own_share).withColumn("q", all_share).where("p > q") \
        .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), strayed(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = lambda x: x.withColumn("rank", F.row_number().over(order))
    return ranked(pairs).unionByName(ranked(high).where(F.col("rank") <= top))
