"""Byte-level BPE encoding and decoding with the ``tokenizers`` library over Arrow batches.

A rank file gives token bytes and ranks. Every byte has a printable stand-in
character, so the library's BPE model works on characters; its merges are all
pairs of tokens whose union is a token, in the order of ranks, which is the
rule that merges by rank alone. A text is cut by the pattern; pieces seen
before come from a bounded table, the others go through the library some
thousand at a time. Decoding reverses the stand-in table; a token may hold part of a
character, so bytes are joined before they are read as UTF-8.

Cases: null and empty texts have no tokens and decode to the empty string;
repeated rows stay; an empty table gives an empty table; other columns of the
input are kept where ``keep`` names them and are never read otherwise.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.llm.common import small_batches

#: Pieces kept for reuse by a Python worker; the table is emptied when full.
PIECES = 250_000
#: Characters that one step encodes; a longer text is a step of its own.
STEP_CHARS = 1 << 20

# The white space of the pattern (Unicode White_Space). The
# expression library used here counts U+001C to U+001F as white space too.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def stand_ins() -> dict[int, str]:
    """Byte -> printable character: printable bytes stand for themselves, the
    others, in order, for the characters from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return {b: chr(b) if b in shown else chr(next(hidden)) for b in range(256)}


def ragged(flat: np.ndarray, at: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slices ``flat[at[i]:at[i + 1]]`` for each ``i`` of ``k``, joined, and their ends."""
    size = at[k + 1] - at[k]
    ends = np.cumsum(size)
    return flat[np.repeat(at[k] - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)], ends


class Pieces(dict):
    """Piece -> number; a piece asked for first time gets the next number and waits in ``new``."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        self.new.append(piece)
        return n


class ByteBpe:
    """Encoder and decoder for one rank file's content and one split pattern."""

    def __init__(self, ranks: bytes, pattern: str):
        from tokenizers import Tokenizer, models, pre_tokenizers

        token = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        shown = stand_ins()
        text = lambda raw: "".join(shown[b] for b in raw)
        pairs = sorted((rank, cut, raw) for raw, rank in token.items() for cut in range(1, len(raw))
                       if raw[:cut] in token and raw[cut:] in token)
        self.vocab = {text(raw): rank for raw, rank in token.items()}
        model = models.BPE(vocab=self.vocab, merges=[(text(raw[:cut]), text(raw[cut:])) for _, cut, raw in pairs],
                           ignore_merges=True)
        self.library = Tokenizer(model)
        self.library.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        back = {c: b for b, c in shown.items()}
        raw = {rank: bytes(back[c] for c in chars) for chars, rank in self.vocab.items()}
        sizes = [len(raw.get(i, b"")) for i in range(max(raw, default=-1) + 1)]
        self.raw_at = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
        self.raw_bytes = np.frombuffer(b"".join(raw.get(i, b"") for i in range(len(sizes))), np.uint8)
        pattern = pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]")
        self.pieces = regex.compile(pattern).findall
        self.clear()

    def clear(self) -> None:
        self.known = Pieces()
        self.flat, self.at = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def learn(self) -> None:
        """Encode the pieces that wait; the library's results are large, so some at a time."""
        new, coded = self.known.new, []
        for i in range(0, len(new), 4096):
            coded += [x.ids for x in self.library.encode_batch(new[i:i + 4096], add_special_tokens=False)]
        ends = np.cumsum([len(x) for x in coded], dtype=np.int64)
        self.flat = np.concatenate((self.flat, np.fromiter(chain.from_iterable(coded), np.uint32, int(ends[-1]))))
        self.at = np.concatenate((self.at, self.at[-1] + ends))
        self.known.new = []

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts as uint32, offsets of each text's ids)."""
        if len(self.known) > PIECES:
            self.clear()
        split = [self.pieces(t) for t in texts]
        counts = [len(x) for x in split]
        k = np.fromiter(map(self.known.__getitem__, chain.from_iterable(split)), np.int64, sum(counts))
        if self.known.new:
            self.learn()
        ids, ends = ragged(self.flat, self.at, k)
        return ids, np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))]

    def decode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """(bytes of all tokens, end of each token's bytes)."""
        data, ends = ragged(self.raw_bytes, self.raw_at, np.asarray(ids, np.int64))
        return data.tobytes(), ends

    def offsets(self, text: str, ids: np.ndarray) -> tuple[list[int], list[int]]:
        """Code points that each token touches, as starts and exclusive ends.
        Tokens that share a split character overlap there."""
        data = np.frombuffer(text.encode(), np.uint8)
        char = np.cumsum((data & 0xC0) != 0x80) - 1  # character of each byte
        ends = np.cumsum((self.raw_at[1:] - self.raw_at[:-1])[np.asarray(ids, np.int64)])
        starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
        return char[starts].tolist() if len(ends) else [], (char[ends - 1] + 1).tolist() if len(ends) else []


@lru_cache(maxsize=2)
def codec(ranks: bytes, pattern: str) -> ByteBpe:
    return ByteBpe(ranks, pattern)


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    i = 0
    while i < len(texts):
        j, chars = i, 0
        while j < len(texts) and (j == i or chars + len(texts[j]) <= STEP_CHARS):
            chars += len(texts[j])
            j += 1
        yield i, j
        i = j


def rank_file(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(spark: SparkSession, docs: DataFrame, path: str, pattern: str, text: str = "text",
           keep: list[str] | None = None, offsets: bool = False, digests: bool = False) -> DataFrame:
    """``keep`` columns plus n_tokens and either ids (with ``offsets`` also
    starts and ends, in code points) or, with ``digests``, ids_sha256 and
    decoded_sha256. A kept column of one of these names is replaced.

    The rank file has a fixed size and is broadcast; each task reads its own
    rows, so there is no shuffle and memory is one batch plus the piece table.
    """
    small_batches(spark)
    ranks = spark.sparkContext.broadcast(rank_file(path))
    more = [T.StructField("n_tokens", T.LongType())]
    if digests:
        more += [T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    else:
        more += [T.StructField("ids", T.ArrayType(T.IntegerType()))]
        if offsets:
            more += [T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("starts", "ends")]

    keep = [c for c in (docs.columns if keep is None else keep) if c not in {f.name for f in more}]
    kept = [docs.schema[c] for c in keep]

    def run(batches):
        coder = codec(ranks.value, pattern)
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            texts = [t or "" for t in texts]
            for i, j in _slices(texts):
                ids, at = coder.encode(texts[i:j])
                columns = [batch.column(c).slice(i, j - i) for c in range(len(keep))]
                columns.append(pa.array(at[1:] - at[:-1], pa.int64()))
                coded = [ids[a:b] for a, b in zip(at[:-1], at[1:])]
                if digests:
                    data, ends = coder.decode(ids)
                    cut = np.concatenate(([0], ends))[at]
                    columns.append(pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in coded]))
                    columns.append(pa.array([hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(cut[:-1], cut[1:])]))
                else:
                    columns.append(pa.ListArray.from_arrays(at.astype(np.int32), ids.astype(np.int32)))
                    if offsets:
                        spans = [coder.offsets(t, x) for t, x in zip(texts[i:j], coded)]
                        columns += [pa.array([s[k] for s in spans], pa.list_(pa.int32())) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(columns, names=[f"c{k}" for k in range(len(columns))])

    names = [f"c{k}" for k in range(len(keep) + len(more))]
    schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, kept + more)])
    source = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(keep)],
                         F.col(f"`{text}`").cast("string").alias("text"))
    return source.mapInArrow(run, schema).toDF(*keep, *[f.name for f in more])


def decode(spark: SparkSession, rows: DataFrame, path: str, pattern: str, ids: str = "ids",
           keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns plus ``decoded`` (binary) and ``decoded_text``; bytes
    that are no whole character become U+FFFD in the text only. Null ids
    decode to nothing; an id outside the file fails."""
    ranks = spark.sparkContext.broadcast(rank_file(path))
    keep = list(keep or [])

    def run(batches):
        coder = codec(ranks.value, pattern)
        for batch in batches:
            raw = [coder.decode(x or [])[0] for x in batch.column(len(keep)).to_pylist()]
            columns = [batch.column(c) for c in range(len(keep))]
            columns += [pa.array(raw, pa.binary()), pa.array([r.decode(errors="replace") for r in raw], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[f"c{k}" for k in range(len(columns))])

    fields = [rows.schema[c] for c in keep] + [T.StructField("decoded", T.BinaryType()), T.StructField("decoded_text", T.StringType())]
    schema = T.StructType([T.StructField(f"c{k}", f.dataType) for k, f in enumerate(fields)])
    source = rows.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(keep)],
                         F.col(f"`{ids}`").cast("array<int>").alias("ids"))
    return source.mapInArrow(run, schema).toDF(*[f.name for f in fields])
