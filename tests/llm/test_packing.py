import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabsmith.llm import packing
from tabsmith.llm.common import text_bytes
from tests.llm.data import clashing, empty, odd

PATH = P.path("word_bpe_49k.json")


def library():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_words_kept_give_the_library_s_ids(monkeypatch):
    pool = ["a", "The", "don't", "'S", "ǅ", "Σ", "ΟΔΟΣ", "é", "é", "́", "中文", "한", "\U0001F600", "\0", "\x1c", "\x85", " ", "　", "\x0b", "\x0c",
            "\r\n", "\n", "\t", " ", "  ", "1", "١", "!", "--", "<|endoftext|>", "<|startoftext|>", "İ", "ß", "﻿", "​", "</w>"]
    rnd, ids_of = random.Random(4), library()
    texts = ["".join(rnd.choice(pool) for _ in range(rnd.randint(0, 30))) for _ in range(3000)] + ["", " ", "\n\n"]
    for words in (packing.WORDS, 20):
        monkeypatch.setattr(packing, "WORDS", words)
        coder = packing.WordBpe(open(PATH, "rb").read())
        for i in range(0, len(texts), 250):
            ids, at = coder.encode(*text_bytes(pa.array(texts[i:i + 250], pa.string())))
            for t, a, b in zip(texts[i:i + 250], at[:-1], at[1:]):
                assert ids[a:b].tolist() == ids_of(t)


def by_rule(lengths, capacity):
    """Every choice tried, the sum of squares counted anew each time."""
    gaps = []
    for s in lengths:
        def total(k):
            after = [g - s * (i == k) for i, g in enumerate(gaps)] + ([capacity - s] if k == len(gaps) else [])
            counts = np.bincount([g for g in after if 0 < g < capacity] or [0], minlength=1)
            return int((counts[1:] ** 2).sum())
        choices = [(total(k), g, k) for k, g in enumerate(gaps) if g >= s] + [(total(len(gaps)), capacity, len(gaps))]
        best = min(choices)
        k = best[2]
        if k == len(gaps):
            gaps.append(capacity)
        gaps[k] -= s
    return sorted(gaps)


@pytest.mark.parametrize("capacity, n, high", [(10, 60, 10), (30, 120, 30), (64, 200, 20), (7, 50, 3), (1, 5, 1)])
def test_the_rule(capacity, n, high):
    rng = np.random.default_rng(capacity)
    lengths = rng.integers(1, high + 1, n)
    sequence, offset, left = packing.placed(lengths, capacity)
    assert sorted(left) == by_rule(lengths.tolist(), capacity)
    for k in range(len(left)):
        spans = sorted((o, o + s) for o, s, q in zip(offset, lengths, sequence) if q == k)
        assert [a for a, _ in spans] == [0] + [b for _, b in spans[:-1]] and spans[-1][1] == capacity - left[k]


def gapless(rows, capacity):
    """Sequences without gaps or overlap; their number."""
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in by.values():
        spans.sort()
        assert [a for a, _ in spans] == [0, *np.cumsum([n for _, n in spans])[:-1]]
        assert sum(n for _, n in spans) <= capacity
    return len(by)


def test_pieces_hold_every_id(spark):
    docs, ids_of = odd(spark), library()
    rows = packing.packed(packing.pieces(spark, clashing(docs).withColumn("offset", F.lit(-1)), PATH, ["doc_id", "text", "score", "offset"])).collect()
    expected = []
    for r in docs.collect():
        ids = ids_of(r["text"] or "") + [1]
        expected += [(str(r["doc_id"]), k, a, ids[a:a + 4096]) for k, a in enumerate(range(0, len(ids), 4096))]
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["ids"]) for r in rows) == sorted(expected)
    assert all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and r["length"] == len(r["ids"]) for r in rows)
    assert gapless(rows, 4096) == -(-sum(r["length"] for r in rows) // 4096)
    assert packing.report(spark, empty(spark), PATH).collect() == []


def test_groups_give_back_what_they_fill_badly(spark):
    rng = np.random.default_rng(5)
    lengths = np.minimum(rng.lognormal(3.3, 1, 3000).astype(int) + 1, 256)
    rows = spark.createDataFrame([(k, int(n)) for k, n in enumerate(lengths)], "row long, length long").withColumn("doc_id", F.col("row"))
    least = -(-int(lengths.sum()) // 256)
    for group in (10_000, 300):
        out = packing.packed(rows, 256, group).collect()
        assert sorted((r["row"], r["length"]) for r in out) == list(enumerate(lengths))
        assert gapless(out, 256) <= 1.01 * least
    # nothing fits beside anything: every piece alone, and no endless rounds
    alone = spark.createDataFrame([(k, 200) for k in range(1000)], "row long, length long")
    assert gapless(packing.packed(alone, 256, 100).collect(), 256) == 1000
