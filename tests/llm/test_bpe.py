import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import tiktoken

from tabsmith.llm import byte_bpe
from tests.llm.data import clashing, empty, odd

PATH = P.path("byte_bpe_multi_50k.tiktoken")


def reference():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


POOL = ["a", "aa", "aaa", " ", "  ", "\n", "\t", "é", "ß", "中", "文", "한", "\U0001F600", "\0", "\x1c", "\x85", "​", "　",
        "0", "١", "!", "--", "'s", "'S", "\r\n", "ñ", "the ", " the", "́", "﻿", "е", "\x0b", "<|endoftext|>"]


def test_ids_equal_the_reference_and_decode_to_the_text():
    coder, enc, rnd = byte_bpe.codec(byte_bpe.rank_file(PATH), P.PATTERN), reference(), random.Random(3)
    texts = ["".join(rnd.choice(POOL) for _ in range(rnd.randint(0, 40))) for _ in range(3000)] + [""]
    ids, at = coder.encode(texts)
    for t, a, b in zip(texts, at[:-1], at[1:]):
        assert ids[a:b].tolist() == enc.encode_ordinary(t)
        assert coder.decode(ids[a:b])[0] == t.encode()


def test_table_of_pieces_is_emptied(monkeypatch):
    monkeypatch.setattr(byte_bpe, "PIECES", 3)
    coder, enc = byte_bpe.ByteBpe(byte_bpe.rank_file(PATH), P.PATTERN), reference()
    for t in ("one two three four five", "six seven one", "two two"):
        ids, _ = coder.encode([t, t])
        assert ids.tolist() == enc.encode_ordinary(t) * 2


def test_offsets_cover_split_characters():
    coder = byte_bpe.codec(byte_bpe.rank_file(PATH), P.PATTERN)
    text = "a\U0001F600é中 end"
    ids, _ = coder.encode([text])
    starts, ends = coder.offsets(text, ids)
    raw = text.encode()
    at = 0
    for i, a, b in zip(ids, starts, ends):
        piece = coder.decode(np.array([i]))[0]
        assert raw[at:at + len(piece)] == piece and piece in text[a:b].encode()
        at += len(piece)
    assert ends[-1] == len(text) and coder.offsets("", np.zeros(0, np.uint32)) == ([], [])


def test_digests_and_roundtrip_on_odd_rows(spark):
    docs, enc = odd(spark), reference()
    got = byte_bpe.encode(spark, docs, PATH, P.PATTERN, keep=["doc_id", "n_chars"], digests=True).collect()
    expected = []
    for r in docs.collect():
        ids = enc.encode_ordinary(r["text"] or "")
        expected.append((r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                         hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    assert sorted((str(r["doc_id"]), *r[2:]) for r in got) == sorted((str(e[0]), *e[1:]) for e in expected)
    coded = byte_bpe.encode(spark, clashing(docs), PATH, P.PATTERN, offsets=True)
    assert coded.columns.count("ids") == 1
    back = byte_bpe.decode(spark, coded, PATH, P.PATTERN, keep=["doc_id", "text"]).collect()
    assert len(back) == docs.count() and all(r["decoded_text"] == (r["text"] or "") for r in back)
    assert byte_bpe.encode(spark, empty(spark), PATH, P.PATTERN).count() == 0
