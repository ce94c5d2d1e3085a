"""Fill-in-the-middle transformation: a ``pyarrow.compute`` pipeline over Arrow batches.

A text is cut into units (a run of ASCII letters, or one other code point). Two
cuts drawn from the id's digest part it into prefix, middle and suffix, and the
parts are joined again around three markers: ``psm`` puts the suffix before the
middle, ``spm`` puts it first; a ``plain`` text stays as it is. Per batch the
units become list arrays, are flattened with the index of their text, get their
ordinal in the text, are filtered by role, rebuilt into lists and joined.

The separator between units is the byte 0xFF, which no UTF-8 text holds, so the
pipeline works on binary arrays. Every row is transformed where it is read:
there is no shuffle, and a task holds one step of about a megabyte of text (a
longer text is a step of its own).

Cases: a null text counts as empty; an empty text, or one that holds a marker,
is plain; a null id counts as empty text in the digest; repeated rows stay and
are cut alike; an empty table gives an empty table; other columns are kept where ``keep``
names them (one of the result's names is replaced) and are not read otherwise.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.llm.common import small_batches, steps

# The markers and the shares of a hundred.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM, SPM_BELOW = 90, 20

#: A unit of UTF-8 bytes: ASCII letters, another ASCII character, or one longer character.
UNIT = r"([A-Za-z]+|[\x00-\x40\x5b-\x60\x7b-\x7f]|[\xc0-\xff][\x80-\xbf]*)"
SEPARATOR = b"\xff"

FIELDS = [T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()),
          T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())]


class Units:
    """The units of some texts: flat, with the text and the ordinal of each."""

    def __init__(self, texts: pa.Array):
        cut = pc.split_pattern(pc.replace_substring_regex(texts, UNIT, b"\\1" + SEPARATOR), SEPARATOR)
        sizes = pc.list_value_length(cut)
        self.flat, self.parent = pc.list_flatten(cut), pc.list_parent_indices(cut)
        first = pc.subtract(pc.cumulative_sum(sizes), sizes)
        self.ordinal = pc.subtract(pa.array(np.arange(len(self.flat)), pa.int64()), pc.cast(first.take(self.parent), pa.int64()))
        self.n = pc.cast(pc.subtract(sizes, 1), pa.int64())  # behind the last separator stands an empty unit

    def joined(self, start: pa.Array, end: pa.Array) -> pa.Array:
        """Of each text, its units from ``start`` to ``end`` (exclusive) as one string."""
        role = pc.and_(pc.greater_equal(self.ordinal, start.take(self.parent)), pc.less(self.ordinal, end.take(self.parent)))
        ends = pc.cumulative_sum(pc.subtract(end, start))
        offsets = pa.concat_arrays([pa.array([0], pa.int64()), ends])
        lists = pa.LargeListArray.from_arrays(offsets, self.flat.filter(role))
        return pc.binary_join(lists, pa.scalar(b"", self.flat.type)).cast(pa.large_string())


def transform(texts: pa.Array, h: list[pa.Array]) -> list[pa.Array]:
    """The columns FIELDS of some texts, ``h`` being the four digest numbers of each."""
    texts = texts.cast(pa.large_string()).fill_null("")
    units = Units(texts.cast(pa.large_binary()))
    size = pc.add(units.n, 1)
    a, b = (pc.subtract(x, pc.multiply(pc.divide(x, size), size)) for x in h[:2])
    start, end = pc.min_element_wise(a, b), pc.max_element_wise(a, b)
    zero = pa.array(np.zeros(len(texts), np.int64))
    prefix, middle, suffix = units.joined(zero, start), units.joined(start, end), units.joined(end, units.n)

    below = lambda x, k: pc.less(pc.subtract(x, pc.multiply(pc.divide(x, 100), 100)), k)
    plain = pc.or_(pc.equal(units.n, 0), pc.invert(below(h[2], PLAIN_FROM)))
    for mark in (PREFIX, SUFFIX, MIDDLE):
        plain = pc.or_(plain, pc.match_substring(texts, mark))
    spm = below(h[3], SPM_BELOW)
    form = pc.if_else(plain, "plain", pc.if_else(spm, "spm", "psm"))
    text = lambda s: pa.scalar(s, pa.large_string())
    p, s, m, none = text(PREFIX), text(SUFFIX), text(MIDDLE), text("")
    output = pc.if_else(plain, texts, pc.if_else(
        spm, pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, none),
        pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, none)))
    chars = lambda x: pc.if_else(plain, pa.scalar(None, pa.int64()), pc.cast(pc.utf8_length(x), pa.int64()))
    return [units.n, form.cast(pa.string()), chars(prefix), chars(middle), output]


def digest_numbers(doc_id: Column) -> list[Column]:
    """The first four numbers of eight hexadecimal digits of the digest of ``1:`` and the id."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def transformed(spark: SparkSession, docs: DataFrame, keep: list[str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``keep`` columns, n (units), form, prefix_chars, middle_chars and output, the transformed text."""
    small_batches(spark)
    names = [f.name for f in FIELDS]
    keep = [c for c in keep if c not in names]
    inner = [f"c{k}" for k in range(len(keep))]
    source = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keep, inner)], F.col(f"`{text}`").cast("string").alias("text"),
                         *[x.alias(f"h{k}") for k, x in enumerate(digest_numbers(F.col(f"`{doc_id}`")))])
    at = len(keep)

    def run(batches):
        for batch in batches:
            column = batch.column(at)
            sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            for i, j in steps(np.concatenate(([0], np.cumsum(sizes)))):
                part = batch.slice(i, j - i)
                columns = transform(part.column(at), [part.column(at + 1 + k) for k in range(4)])
                columns[-1] = columns[-1].cast(pa.string())
                yield pa.RecordBatch.from_arrays([part.column(c) for c in range(at)] + columns, names=inner + names)

    schema = T.StructType([T.StructField(k, docs.schema[c].dataType) for c, k in zip(keep, inner)] + FIELDS)
    return source.mapInArrow(run, schema).toDF(*keep, *names)


def restored(output: Column, form: Column) -> Column:
    """The exact text, rebuilt from an output and its form. A marker is found
    at its first place: no part of a transformed text holds one, and none can
    arise where a part meets a marker."""
    body = F.substring(output, 4, 2**31 - 1)
    first = F.split(body, F.when(form == "spm", F.lit(PREFIX)).otherwise(F.lit(SUFFIX)), 2)
    last = F.split(F.get(first, F.lit(1)), MIDDLE, 2)
    a, b, middle = F.get(first, F.lit(0)), F.get(last, F.lit(0)), F.get(last, F.lit(1))
    return F.when(form == "plain", output).when(form == "spm", F.concat(b, middle, a)).otherwise(F.concat(a, middle, b))


def report(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the digests of the output and of the text restored from it."""
    rows = transformed(spark, docs, ["doc_id"])
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
