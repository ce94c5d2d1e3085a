"""Document fingerprints: bottom-k sketches of shingle hashes, with DataFrame functions only.

A sketch holds the ``K`` smallest of the hashes of a text's five-word shingles
(words: runs without ASCII white space, lower-cased; a shorter text is one
shingle). The sketch of a union is the ``K`` smallest of both sketches, so
parts are merged in any order. Of two sketches, the share of the union's
``K`` smallest that both hold estimates resemblance; the size follows from the
``K``-th smallest hash, and both give containment.

Cases: null and empty texts have an empty sketch, which resembles an empty one
by 1 and any other by 0; equal texts have equal sketches; repeated rows stay;
an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsmith.llm.common import input_bytes

K, SHINGLE = 128, 5
#: Bytes of the input that one bucket of neighbours holds, about.
BUCKET_BYTES = 4 << 20
#: Hashes are the 63 low bits of XXH64, so their order is that of longs.
MASK = (1 << 63) - 1


def sketched(df: DataFrame, text: str, out: str, k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """``df`` with the sketch of ``text`` as a sorted array of longs."""
    words, n = f"__{out}_words", f"__{out}_n"
    df = df.withColumn(words, F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[ \t\n\x0B\f\r]+", -1), lambda w: w != ""))
    df = df.withColumn(n, F.size(words))
    spot = lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(shingle)]).bitwiseAND(F.lit(MASK))
    hashes = F.transform(F.sequence(F.lit(0), F.greatest(F.col(n) - shingle, F.lit(0))), spot)
    return df.withColumn(out, F.when(F.col(n) == 0, F.array().cast("array<bigint>"))
                         .otherwise(F.slice(F.sort_array(F.array_distinct(hashes)), 1, k))).drop(words, n)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merged(df: DataFrame, by: list[str], sketch: str = "sketch", k: int = K) -> DataFrame:
    """``by`` and the sketch of all rows of a group. Hashes are made distinct
    and cut to ``k`` a task before the last shuffle, so a hot group costs no
    more than another."""
    # outer: else Spark infers a filter on the array and pushes the whole sketch
    # into it, below the columns that keep its words from being split again
    values = df.select(*by, F.explode_outer(sketch).alias("__h")).where("__h IS NOT NULL").distinct()
    first = Window.partitionBy(*by).orderBy("__h")
    return values.withColumn("__r", F.row_number().over(first)).where(F.col("__r") <= k) \
        .groupBy(*by).agg(F.sort_array(F.collect_list("__h")).alias(sketch))


def resemblance(a: str, b: str, k: int = K) -> Column:
    """Estimated share of common shingles among all of both."""
    union = merge(F.col(a), F.col(b), k)
    both = F.array_intersect(F.array_intersect(union, F.col(a)), F.col(b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(F.size(both) / F.size(union))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated count of distinct shingles; exact below ``k``."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) * float(MASK) / F.element_at(a, -1))


def containment(a: str, b: str, k: int = K) -> Column:
    """Estimated share of the shingles of ``a`` that ``b`` holds."""
    r = resemblance(a, b, k)
    both = r * distinct_shingles(merge(F.col(a), F.col(b), k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both / distinct_shingles(F.col(a), k)))


def digits(a: str) -> Column:
    """A sketch as text: 16 hexadecimal digits a hash."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def bucketed(docs: DataFrame, doc_id: str) -> DataFrame:
    """Rows dealt out in ranges of ``doc_id``: columns ``__bucket`` and
    ``__kind``. 0 is a row itself; 1 is the first row of the next bucket, sent
    to this one, too; 2 is the first row of all, sent to the last bucket. Sorted by
    (__kind, doc_id), every row's successor is in its own bucket.

    Bounds are ids that occur, one for each BUCKET_BYTES of the input."""
    n = max(1, min(100_000, input_bytes(docs) // BUCKET_BYTES))
    parts = [i / n for i in range(1, n)]
    found = docs.agg(F.percentile_approx(doc_id, parts or [0.5], max(10_000, 20 * n)).alias("b"), F.min(doc_id).alias("low"),
                     F.max(F.col(doc_id).isNull()).alias("no")).first()
    bounds = sorted(set(found["b"] or [])) if parts else []
    # two short lists instead of one long: the block, then the place in it
    side = max(1, int(len(bounds) ** 0.5))
    blocks = [bounds[i:i + side] for i in range(0, len(bounds), side)]
    id_ = F.col(doc_id)
    if blocks:
        heads = F.from_json(F.lit(json.dumps([b[0] for b in blocks])), "array<bigint>")
        lists = F.from_json(F.lit(json.dumps(blocks)), "array<array<bigint>>")
        block = F.coalesce(F.size(F.filter(heads, lambda x: x <= id_)), F.lit(0))
        place = F.when(block == 0, F.lit(0)).otherwise(
            (block - 1) * side + F.size(F.filter(F.get(lists, block - 1), lambda x: x <= id_)))
        docs = docs.withColumn("__bucket", F.when(id_.isNull(), F.lit(0)).otherwise(place))
        bound = F.array_contains(F.flatten(lists), id_)
    else:
        docs, bound = docs.withColumn("__bucket", F.lit(0)), F.lit(False)
    first = id_.isNull() if found["no"] else id_ == F.lit(found["low"])
    spot = lambda b, kind: F.struct(b.cast("int").alias("bucket"), F.lit(kind).alias("kind"))
    here = F.col("__bucket")
    copies = F.array_compact(F.array(spot(here, 0), F.when(bound & (here > 0), spot(here - 1, 1)),
                                     F.when(first, spot(F.lit(len(bounds)), 2))))
    return docs.withColumn("__to", F.explode(copies)).withColumn("__bucket", F.col("__to.bucket")) \
        .withColumn("__kind", F.col("__to.kind")).drop("__to")


def edited_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text against an edited one: its last half (code points, rounded
    down) replaced by as much of the start of the next text by ascending id
    (after the last: the first). One shuffle, by ranges of ids."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    rows = bucketed(rows, "doc_id")
    order = Window.partitionBy("__bucket").orderBy("__kind", F.col("doc_id").asc_nulls_first(), "text")
    rows = rows.withColumn("__next", F.lead("text").over(order))
    rows = sketched(rows, "text", "sketch")
    rows = rows.withColumn("next_sketch", F.lead("sketch").over(order)).where("__kind = 0")
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long"))
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")),
                                              F.substring("__next", F.lit(1), half)))
    rows = sketched(rows, "edited", "edited_sketch")
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), digits("sketch").alias("fingerprint"),
                       digits("edited_sketch").alias("edited_fingerprint"),
                       resemblance("sketch", "edited_sketch").alias("near_edited"),
                       resemblance("sketch", "next_sketch").alias("near_next"),
                       containment("sketch", "edited_sketch").alias("contained_in_edited"),
                       distinct_shingles(F.col("sketch")).alias("distinct_shingles"))
