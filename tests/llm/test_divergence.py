import random
import re

import numpy as np
from pyspark.sql import functions as F

from tabsmith.llm import divergence
from tests.llm.data import clashing, empty, odd

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_hand(docs):
    """The contract read literally, with Python's integers."""
    rows = [(r["lang"] or "", r["source"] or "", TERM.findall((r["text"] or "").translate(LOWER))) for r in docs]
    out = set()
    for lang in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == lang]
        terms = {t for r in own for t in r[2]}
        kept = {t for t in terms if sum(t in r[2] for r in own) >= 3}
        count = {s: {t: sum(r[2].count(t) for r in own if r[1] == s) for t in kept} for s in {r[1] for r in own}}
        all_ = {t: sum(c[t] for c in count.values()) for t in kept}
        v = len(kept)
        p = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + v) for t in kept}
        q = p(all_)
        for s in count:
            ps = p(count[s])
            pair = [(-sum((ps[t] - x) ** 2 // x for t, x in p(count[o]).items()), o.encode(), o) for o in count if o != s]
            term = [(-((ps[t] - q[t]) ** 2 // q[t]), t.encode(), t) for t in kept if count[s][t] and ps[t] > q[t]]
            for part, found, most in (("pair", pair, None), ("term", term, 200)):
                out |= {(lang, s, part, x[2], -x[0], k) for k, x in enumerate(sorted(found)[:most], 1)}
    return out


def texts(n, seed):
    rnd = random.Random(seed)
    words = [w + c for w in ("the", "Ab", "été", "x", "日本", "zz", "Z", "\U0001F600", "ﬀ") for c in ("", "a", "bé", "Q")]
    weights = [1 / (k + 1) for k in range(len(words))]
    return [(k, rnd.choice([" ", ". ", "\n", "1", "_"]).join(rnd.choices(words, weights, k=rnd.randint(0, 60))), rnd.choice(["en", "fr", None, ""]),
             rnd.choice(["a", "a", "a", "b", "c", "é", "z", "\U0001F600", "ﬀ", None]), 1) for k in range(1000, 1000 + n)]


def test_rows_equal_the_rule(spark):
    for docs in (odd(spark), odd(spark, texts(150, 1)), odd(spark, texts(150, 1) * 2)):
        got = divergence.audit(spark, docs).collect()
        assert len(got) == len(set(got)) and {tuple(r) for r in got} == by_hand(docs.collect())


def test_small_blocks_clashing_names_and_an_empty_table(spark):
    docs = odd(spark, texts(60, 2))
    expected = by_hand(docs.collect())
    named = clashing(docs).select("*", *[F.lit(1).alias(c) for c in ("term", "tokens", "docs", "id", "block", "v", "whole")])
    assert {tuple(r) for r in divergence.audit(spark, named, block=5).collect()} == expected
    assert divergence.audit(spark, empty(spark)).collect() == []


def test_only_the_top_terms_are_reported(spark):
    docs = odd(spark, [(k, " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)), "en", "a" if k % 2 else "b", 1) for k in range(20, 26)]
               + [(k, "other words only", "en", "c", 1) for k in range(30, 34)])
    got = divergence.audit(spark, docs).collect()
    assert {tuple(r) for r in got} == by_hand(docs.collect())
    assert max(r["rank"] for r in got if r["part"] == "term") == 200


def test_sorted_arrays():
    rng = np.random.default_rng(1)
    for n, m in ((0, 0), (0, 5), (1, 1000), (700, 3), (1000, 900), (5000, 20)):
        a, b = (np.sort(rng.choice(20_000, k, replace=False)) for k in (n, m))
        i, j = divergence.common(a, b)
        assert (a[i] == b[j]).all() and set(a[i]) == set(a) & set(b)
    values = np.concatenate((rng.integers(0, 300, 500), [0, 127, 128, 16383, 16384, 2**62, 2**40]))
    assert (divergence.decoded(divergence.coded(values)) == values).all()
    assert len(divergence.decoded(divergence.coded(np.zeros(0, np.int64)))) == 0


def test_shares_are_exact_for_large_counts(spark):
    counts, whole = [0, 1, 999, 10**12, 8 * 10**15 - 1], 8 * 10**15
    expected = [1 + 10**9 * (c + 1) // whole for c in counts]
    assert divergence.shares(np.array(counts), whole).tolist() == expected
    rows = spark.createDataFrame([(c, whole) for c in counts], "c long, w long").select(divergence.share(F.col("c"), F.col("w")).alias("p"))
    assert [r["p"] for r in rows.collect()] == expected
