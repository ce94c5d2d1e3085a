"""Packing of tokenised documents into sequences by the sum-of-squares rule.

A document's ids (a word-level BPE of the ``tokenizers`` library, plus one end
id) are cut into pieces of ``capacity`` tokens. A whole piece is a sequence of
its own. The others, longest first, are placed one by one: with N(g) the open
sequences of residual gap g, a piece goes where the sum of all N(g)^2 becomes
smallest, a new sequence being one of the choices (ties: the tighter gap).
Equal gaps are thus kept rare, so a fitting gap of any size stays at hand.

Spread: texts are tokenised where they are read and the pieces written to the
shared folder. Pieces are dealt by a hash of their row into groups of about
``GROUP``, packed independently: a group's state is one count and one
stack a gap. Sequences that a group leaves with a gap of ``capacity / 64`` or
more give their pieces back, and those of all groups are packed again in as few groups as
hold them, round after round as long as a round halves them. So the loss by
dealing is that of the last group, not of every one. Groups sort their rows,
so a task that runs again places them alike.

A word between blanks is tokenised once and kept by its hash, in a table that is
emptied when full: the tokenizer's own rules never join what stands on both sides of a blank.

Cases: null and empty texts are one piece, the end id alone; strings like
special tokens are ordinary text; repeated rows are packed one by one; an empty
table gives an empty table; columns outside ``keep`` are not read, and a kept
one of a result's name is replaced.
"""

from __future__ import annotations

import os
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.llm.byte_bpe import ragged, stand_ins
from tabsmith.llm.common import LOWER, byte_set, small_batches, steps, stored, text_bytes, word_hashes, words_of

CAPACITY, END_ID = 4096, 1
#: Pieces that one task packs, about.
GROUP = 1 << 17
#: Words kept for reuse by a Python worker.
WORDS = 4_000_000
# Bytes of a word (all but ASCII white space), letters and marks that may end
# one; the end of plain letters, and the letter among them that lower-cases to two.
WORD = byte_set(bytes(b for b in range(256) if b != 0x20 and not 0x09 <= b <= 0x0D))
LETTER, MARK = byte_set(b"abcdefghijklmnopqrstuvwxyz"), byte_set(b".,;:!?")
PLAIN, DOTTED = "\u0250", "\u0130"


# ----------------------------------------------------------- tokenising ---

class WordBpe:
    """The tokenizer of one file's content, a table of words in front of it.

    Texts are cut into words with array operations over their bytes, lower-cased
    in A-Z; a mark behind a letter at a word's end is a word of its own. Words are looked up by their
    64-bit hashes, all of a step at once. (Two of ten million different words
    share a hash with a probability of some millionths.) New words go to the tokenizer once.

    A run of letters is one word to the tokenizer's splitter, so for plain words
    (letters below U+0250, where lower-casing is by letter and composition changes
    nothing) its model is asked directly, lower-cased and byte by byte as the
    splitter would hand it over. All else takes the whole tokenizer."""

    def __init__(self, content: bytes):
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_buffer(content)
        self.library.encode_special_tokens = True
        self.model = self.library.model
        self.shown = stand_ins()
        self.clear()

    def clear(self) -> None:
        self.hashes, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)     # sorted; word of each
        self.flat, self.at = np.zeros(0, np.uint32), np.zeros(1, np.int64)          # ids of the words

    def learn(self, words: list[str]) -> None:
        """Append the ids of new words."""
        coded: list = [None] * len(words)
        rest = []
        for i, word in enumerate(words):
            if word.isalpha() and (word.isascii() or max(word) < PLAIN and DOTTED not in word):
                word = word.lower()
                shown = word if word.isascii() else "".join(map(self.shown.__getitem__, word.encode()))
                coded[i] = [x.id for x in self.model.tokenize(shown)]
            else:
                rest.append(i)
        for k in range(0, len(rest), 4096):
            part = rest[k:k + 4096]
            for i, x in zip(part, self.library.encode_batch([words[i] for i in part], add_special_tokens=False)):
                coded[i] = x.ids
        ends = np.cumsum(np.fromiter(map(len, coded), np.int64, len(coded)))
        self.flat = np.concatenate((self.flat, np.fromiter(chain.from_iterable(coded), np.uint32, int(ends[-1]))))
        self.at = np.concatenate((self.at, self.at[-1] + ends))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of each text's ids) of texts as bytes."""
        if len(self.hashes) > WORDS:
            self.clear()
        data = LOWER[data]
        start, end, doc = words_of(data, WORD, offsets)
        marked = np.flatnonzero((end - start > 1) & MARK[data[end - 1]] & LETTER[data[np.maximum(end - 2, 0)]])
        start, doc = np.insert(start, marked + 1, end[marked] - 1), np.insert(doc, marked + 1, doc[marked])
        end = np.insert(end, marked, end[marked] - 1)
        h, first, word = np.unique(word_hashes(data, start, end), return_index=True, return_inverse=True)
        spot = np.searchsorted(self.hashes, h)
        known = len(self.hashes) and self.hashes[np.minimum(spot, len(self.hashes) - 1)] == h
        new = np.flatnonzero(~known) if len(self.hashes) else np.arange(len(h))
        if len(new):
            raw = data.tobytes()
            had = len(self.at) - 1
            self.learn([raw[a:b].decode() for a, b in zip(start[first[new]].tolist(), end[first[new]].tolist())])
            self.hashes = np.insert(self.hashes, spot[new], h[new])
            self.place = np.insert(self.place, spot[new], had + np.arange(len(new)))
            spot = np.searchsorted(self.hashes, h)
        ids, ends = ragged(self.flat, self.at, self.place[spot][word])
        counts = np.bincount(doc, minlength=len(offsets) - 1)
        return ids, np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))]


@lru_cache(maxsize=2)
def tokenizer(content: bytes) -> WordBpe:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")   # a task has one core
    return WordBpe(content)


def pieces(spark: SparkSession, docs: DataFrame, path: str, keep: list[str], text: str = "text", capacity: int = CAPACITY,
           end_id: int = END_ID, ids: bool = True) -> DataFrame:
    """``keep`` columns, piece, start, length, ids_crc32 and, with ``ids``, the ids: one row a piece, in the shared
    folder. The tokenizer's file has a fixed size and is broadcast. ``row`` numbers the rows."""
    small_batches(spark)
    with open(path, "rb") as f:
        content = spark.sparkContext.broadcast(f.read())
    more = [T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
            T.StructField("ids_crc32", T.LongType())] + ([T.StructField("ids", T.ArrayType(T.IntegerType()))] if ids else [])
    keep = [c for c in keep if c not in RESULT]
    names = [f"c{k}" for k in range(len(keep))] + [f.name for f in more]

    def run(batches):
        coder = tokenizer(content.value)
        for batch in batches:
            data, offsets = text_bytes(batch.column(len(keep)))
            for i, j in steps(offsets):
                coded, at = coder.encode(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                rows, found = [], []
                for k in range(j - i):
                    own = np.append(coded[at[k]:at[k + 1]], np.uint32(end_id)).astype("<u4")
                    for n, a in enumerate(range(0, len(own), capacity)):
                        part = own[a:a + capacity]
                        rows.append(i + k)
                        found.append((n, a, len(part), zlib.crc32(part.tobytes()), part))
                columns = [batch.column(c).take(pa.array(rows)) for c in range(len(keep))]
                columns += [pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
                if ids:
                    offsets = np.cumsum([0] + [x[2] for x in found]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(offsets, np.concatenate([x[4] for x in found]).astype(np.int32)))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = T.StructType([T.StructField(n, docs.schema[c].dataType) for n, c in zip(names, keep)] + more)
    source = docs.select(*[F.col(f"`{c}`").alias(n) for n, c in zip(names, keep)], F.col(f"`{text}`").cast("string").alias("text"))
    out = source.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id())
    return stored(out, "pieces").toDF(*keep, *[f.name for f in more], "row")


RESULT = ["piece", "start", "length", "ids_crc32", "ids", "row", "sequence_id", "offset"]


# -------------------------------------------------------------- packing ---

def placed(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places pieces in the order given: (sequence of each, offset of each, gap left in each sequence)."""
    gaps = np.zeros(capacity + 1, np.int64)                 # N(g); no open sequence has gap 0
    waiting: dict[int, list[int]] = {}                      # open sequences by gap
    sequence, offset, left = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    for i, s in enumerate(lengths.tolist()):
        gap, least = capacity, 2 * gaps[capacity - s] + 1 if s < capacity else 0
        if s < capacity:
            # change of the sum for every gap from s on; one that nothing has is no choice
            there = gaps[s:capacity]
            change = 2 * (gaps[:capacity - s] - there + 1)
            change[0] = 1 - 2 * there[0]                    # the gap closes
            change[there == 0] = 1 << 62
            best = int(change.argmin())
            if change[best] <= least:
                gap = s + best
        if gap == capacity:
            k = len(left)
            left.append(capacity)
        else:
            k = waiting[gap].pop()
            gaps[gap] -= 1
        sequence[i], offset[i], left[k] = k, capacity - gap, gap - s
        if gap > s:
            waiting.setdefault(gap - s, []).append(k)
            gaps[gap - s] += 1
    return sequence, offset, np.array(left, np.int64)


def _group_task(capacity: int, first: int):
    def run(rows: pa.Table) -> pa.Table:
        row, length = rows["row"].to_numpy(), rows["length"].to_numpy()
        order = np.lexsort((row, -length))
        sequence, offset, left = placed(length[order], capacity)
        number = ((first + rows["group"][0].as_py() << 32) + sequence) * 2
        return pa.table({"row": row[order], "length": length[order], "sequence_id": number, "offset": offset, "gap": left[sequence]})
    return run


def packed(rows: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """``pieces`` with sequence_id and offset. Whole pieces get odd numbers, the others' sequences even ones."""
    whole = rows.where(F.col("length") == capacity).withColumn("sequence_id", F.col("row") * 2 + 1).withColumn("offset", F.lit(0).cast("long"))
    rest = rows.where(F.col("length") < capacity)
    waiting, n, first, done = rest.select("row", "length"), rest.count(), 0, None
    while True:
        groups = max(1, -(-n // group))
        dealt = waiting.select("row", "length", F.pmod(F.xxhash64("row", F.lit(first)), F.lit(groups)).alias("group"))
        found = stored(dealt.groupBy("group").applyInArrow(
            _group_task(capacity, first), "row long, length long, sequence_id long, offset long, gap long"), "packed")
        loose = F.col("gap") >= max(1, capacity // 64)
        left = found.where(loose).count() if groups > 1 else 0
        again = 0 < left <= n // 2
        kept = (found.where(~loose) if again else found).select("row", "sequence_id", "offset")
        done = kept if done is None else done.unionByName(kept)
        if not again:
            break
        waiting, n, first = found.where(loose).select("row", "length"), left, first + groups
    return whole.unionByName(rest.join(done, "row").select(*whole.columns))


def report(spark: SparkSession, docs: DataFrame, path: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    rows = packed(pieces(spark, docs, path, ["doc_id"], ids=False))
    return rows.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
