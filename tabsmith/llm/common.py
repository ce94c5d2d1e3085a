"""Helpers shared by the text operators: tables, shared storage, Arrow text buffers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsmith.session import checkpoint_dir

#: Bytes of text that one NumPy step works on; a longer text is a step of its own.
STEP_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and read it back: a
    lost executor never replays what lies before. ``codec``: the files' compression, if not the session's."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/tabsmith-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Rows here hold long texts: Arrow batches of fewer rows bound the memory
    of both sides of a task. A size that the user has set stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, "1000")


def input_bytes(df: DataFrame) -> int:
    """Size of a frame's files as the optimizer knows it; of a frame that does
    not come from files, the bytes of its texts, counted."""
    known = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if known < 1 << 60:
        return known
    texts = [F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)) for f in df.schema if f.dataType.typeName() == "string"]
    return int(df.agg(F.sum(sum(texts, F.lit(8)))).first()[0] or 0)


def held_out(doc_id: Column, mod: int, rest: int) -> Column:
    """crc32 of the id as text, modulo ``mod``, equals ``rest`` (a null id counts as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % mod == rest


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null has length zero."""
    column = column.cast(pa.large_string()).fill_null("")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and offsets[-1] else np.zeros(0, np.uint8)
    return data, offsets


def steps(offsets: np.ndarray, size: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes each."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def byte_set(spec: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(spec)] = True
    return out


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Powers:
    """Powers of an odd constant modulo 2^64 and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> None:
        if len(self.up) < n:
            n = 1 << int(n).bit_length()
            with np.errstate(over="ignore"):
                self.up = np.concatenate(([np.uint64(1)], np.cumprod(np.full(n - 1, self.base, np.uint64))))
                self.down = np.concatenate(([np.uint64(1)], np.cumprod(np.full(n - 1, self.inverse, np.uint64))))


BYTE_POWERS, WORD_POWERS = Powers(0x9E3779B97F4A7C15), Powers(0xC2B2AE3D27D4EB4F)


def mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(29))


def words_of(data: np.ndarray, is_word: np.ndarray, doc_offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of every maximal run of word bytes in ``data``.

    ``doc_offsets`` are relative to ``data``; a run never crosses a document."""
    inside = is_word[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = doc_offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(doc_offsets, start, "right") - 1


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of every run of bytes."""
    BYTE_POWERS.upto(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * BYTE_POWERS.up[:len(data)], out=total[1:])
        return mixed((total[end] - total[start]) * BYTE_POWERS.down[start] + (end - start).astype(np.uint64))


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every ``n`` consecutive word hashes (also across documents)."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    WORD_POWERS.upto(len(words) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * WORD_POWERS.up[:len(words)], out=total[1:])
        return mixed((total[n:] - total[:-n]) * WORD_POWERS.down[:len(words) - n + 1])


ODD = np.uint64(0x9E3779B97F4A7C15)


class Hashed:
    """Rows of values under packed keys: sorted hashes and a jump table on
    their top bits, so a key is found in a step or two."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray, jump_bits: int = 20):
        self.shift = np.uint64(64 - jump_bits)
        with np.errstate(over="ignore"):
            hashes = keys * ODD
        order = np.argsort(hashes)
        self.hashes, self.rows = np.append(hashes[order], np.uint64(0)), rows[order]
        top = (hashes[order] >> self.shift).astype(np.int64)
        self.jump = np.searchsorted(top, np.arange((1 << jump_bits) + 1)).astype(np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key, or -1."""
        with np.errstate(over="ignore"):
            h = keys * ODD
        top = (h >> self.shift).astype(np.int64)
        at, end = self.jump[top], self.jump[top + 1]
        out = np.where((self.hashes[at] == h) & (at < end), at, -1)
        left = np.flatnonzero((out < 0) & (at + 1 < end))
        step = 1
        while len(left):
            spot = at[left] + step
            same = self.hashes[spot] == h[left]
            out[left[same]] = spot[same]
            left = left[~same]
            step += 1
            left = left[at[left] + step < end[left]]
        return out
