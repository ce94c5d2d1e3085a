import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsmith.llm import brown_lm, toxicity
from tabsmith.llm.catalog import op1_toxicity, op3_brown_lm
from tabsmith.llm.common import held_out, table
from tests.conftest import SF
from tests.llm.data import clashing, empty, odd


def kernel(u, v):
    """Subsequences of three characters within the window, by definition."""
    def features(s):
        s, out = f"\x02{s}\x03", {}
        for i in range(len(s)):
            for j in range(i + 1, len(s)):
                for k in range(j + 1, len(s)):
                    if k - i < toxicity.SPAN:
                        out[s[i] + s[j] + s[k]] = out.get(s[i] + s[j] + s[k], 0) + toxicity.DECAY ** (k - i + 1)
        return out
    a, b = features(u), features(v)
    size = lambda x: math.sqrt(sum(w * w for w in x.values()))
    return (sum(w * b.get(f, 0) for f, w in a.items()) / (size(a) * size(b))) ** toxicity.DEGREE if a and b else 0.0


def test_kernel_equals_its_definition():
    marks = toxicity.Landmarks(["idiot", "aaaa", "thrash", "é"])
    units = ["idiot", "id.iot", "aaaaaaa", "trash", "", "é", "ñandú", "x"]
    got = marks.kernel(units)
    for i, u in enumerate(units):
        for j, v in enumerate(marks.units):
            assert abs(got[i, j] - kernel(u, v)) < 1e-5


INSULTS = ["idiot", "moron", "scoundrel"]


def labelled(spark):
    """Invented texts; every toxic one has one insult somewhere."""
    rng = np.random.default_rng(5)
    syllables = ["ta", "lo", "mer", "vin", "ko", "sal", "dre", "un", "pi", "gan"]
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 4)))
    rows, labels = [], []
    for k in range(600):
        words = [word() for _ in range(rng.integers(5, 30))]
        if k % 4 == 0:
            words[rng.integers(len(words))] = INSULTS[k % 3] + rng.choice(["", ".", ",", "!"])
        rows.append((1000 + k, " ".join(words).capitalize() + ".", "en", "a", 1))
        labels.append((1000 + k, 1, int(k % 4 == 0)))
    labels += [(None, 1, 1), (1, 1, None), (999_999, 1, 1)]
    return odd(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def model(spark):
    docs, labels = labelled(spark)
    return toxicity.fit(docs, labels, lambda i: ~held_out(i, 5, 0))


def test_insults_are_found_also_with_gaps_and_insertions(spark, model):
    docs, labels = labelled(spark)
    got = toxicity.scored(spark, clashing(docs), model, ["doc_id"]).join(labels, "doc_id").where("doc_id >= 1000").collect()
    assert sum(r["predicted"] == r["toxic"] for r in got) / len(got) > 0.97
    probe = ["Talo mer i.d.i.o.t vin.", "Talo m o r o n vin.", "You mo-ron!", "idioot ta", "scounndrel!", "talo mervin kosal.", "a b c d"]
    frame = spark.createDataFrame(list(enumerate(probe)), "doc_id long, text string")
    out = {r["doc_id"]: r["predicted"] for r in toxicity.scored(spark, frame, model, ["doc_id"]).collect()}
    assert [out[k] for k in range(len(probe))] == [1, 1, 1, 1, 1, 0, 0]
    by = toxicity.sentences(spark, frame.where("doc_id = 2").withColumn("text", F.lit("Talo mer. You moron! Vin ko.")), model, ["doc_id"]).collect()
    assert [r["score"] >= 0.5 for r in sorted(by, key=lambda r: r["sentence"])] == [False, False, True]


def test_odd_rows_and_missing_labels(spark, model):
    docs, labels = labelled(spark)
    docs = odd(spark)
    got = toxicity.scored(spark, clashing(docs), model, ["doc_id", "text"]).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert toxicity.scored(spark, empty(spark), model, ["doc_id"]).count() == 0
    for some in (labels.limit(0), labels.where("toxic = 0")):
        flat = toxicity.fit(labelled(spark)[0], some, lambda i: F.lit(True))
        assert {r["predicted"] for r in toxicity.scored(spark, docs, flat, ["doc_id"]).collect()} == {0}


def test_toxicity_on_tables(spark):
    sf = "/root/testdata/sf0.01"
    rows = op1_toxicity(spark, sf).join(table(spark, sf, "labels"), "doc_id").where("held_out").collect()
    y, s = np.array([r["toxic"] for r in rows]), np.array([r["score"] for r in rows])
    better = (s[y == 1][:, None] > s[y == 0]).mean() + (s[y == 1][:, None] == s[y == 0]).mean() / 2
    assert better > 0.75


# --- class language model -------------------------------------------------

def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))


def check_base(rows, got):
    train = Counter()
    for i, t in rows:
        if zlib.crc32(str("" if i is None else i).encode()) % 5 != 1:
            train.update([*words(t), None])
    n, v = sum(train.values()), len(train)
    expected = []
    for i, t in rows:
        w = [*words(t), None]
        expected.append((str(i), len(w), sum(train[x] > 0 for x in w), n, round(sum(math.log10((train[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 4)))
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == sorted(expected)


def test_counts_and_base_score_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(brown_lm, "TOP", 40)
    monkeypatch.setattr(brown_lm, "WORDS", 20)
    monkeypatch.setattr(brown_lm, "ENDINGS", 10)
    monkeypatch.setattr(brown_lm, "BUCKET_BYTES", 4000)
    docs = clashing(odd(spark, [(300 + k, f"Some words {k} and Others {k % 7} end\tthere", "en", "a", 1) for k in range(50)])).withColumn("ho", held_out(F.col("doc_id"), 5, 1))
    fitted, rest = brown_lm.fit(docs, ~F.col("ho"))
    check_base([(r["doc_id"], r["text"]) for r in docs.collect()], brown_lm.scored(spark, docs, fitted, rest, ["doc_id"]).collect())
    assert brown_lm.scored(spark, empty(spark), fitted, rest, ["doc_id"]).count() == 0
    none, rest = brown_lm.fit(docs.where("false"), F.lit(True))
    got = brown_lm.scored(spark, docs, none, rest, ["doc_id"]).collect()
    assert len(got) == docs.count() and all(r["score"] == r["base_score"] and r["train_tokens"] == 0 for r in got)


def test_held_out_likelihood_beats_the_base(spark):
    sf = "/root/testdata/sf0.01"
    got = op3_brown_lm(spark, sf).collect()
    check_base([tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text").collect()], got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def information(pairs, own):
    k = own.max() + 1
    one = np.eye(k)[own]
    t = one.T @ pairs @ one
    f = lambda x: (x[x > 0] * np.log(x[x > 0])).sum()
    return f(t) - f(t.sum(axis=0)) - f(t.sum(axis=1))


def test_one_id_is_many_buckets(spark, monkeypatch):
    """Rows of one id, or of one text without an id, are no task of their own."""
    monkeypatch.setattr(brown_lm, "BUCKET_BYTES", 1000)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        same = [(7 if k % 2 else None, "one text of many rows", "en", "a", 1) for k in range(400)]
        docs = odd(spark, same).where("text LIKE 'one text%'").repartition(4)
        model, rest = brown_lm.fit(docs, F.lit(True))
        got = brown_lm.scored(spark, docs, model, rest, ["doc_id"]).groupBy("doc_id", F.spark_partition_id().alias("p")).count().collect()
        assert sum(r["count"] for r in got) == 400
        for own in (7, None):
            assert max(r["count"] for r in got if r["doc_id"] == own) < 150
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_exchange_finds_hidden_classes_and_never_loses():
    rng = np.random.default_rng(4)
    hidden = np.concatenate(([0], rng.integers(1, 4, 60)))
    step = np.array([[0, 5, 1, 1], [1, 0, 9, 1], [1, 1, 0, 9], [6, 9, 1, 0]], float)
    pairs = rng.poisson(step[hidden][:, hidden] * 3).astype(float)
    own = brown_lm.exchange(pairs, 4, 10)
    start = np.concatenate(([0], 1 + np.arange(60) % 3))
    assert own[0] == 0 and information(pairs, own) >= information(pairs, hidden) - 1e-6 > information(pairs, start)
    agree = sum((own[a] == own[b]) == (hidden[a] == hidden[b]) for a in range(1, 61) for b in range(1, a))
    assert agree == 60 * 59 / 2


def rare(w):
    """Most words of a kind share their ending, a fifth have that of the other kind."""
    return f"k{w}{'word' if (w % 2 == 1) != (w % 10 < 2) else 'bird'}"


def two_kinds(spark):
    """Rare words: one kind stands between ``ma`` and ``na``, the other between ``po`` and ``ro``."""
    rng = np.random.default_rng(5)
    rows = [(k, " ".join(x for w in rng.integers(0, 200, 30) for x in (("ma", rare(w), "na") if w % 2 else ("po", rare(w), "ro")))) for k in range(120)]
    return spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string")


def test_rare_words_are_clustered_by_their_own_neighbours(spark, monkeypatch):
    """Not only the frequent ones, and not by their ending."""
    monkeypatch.setattr(brown_lm, "TOP", 30)
    monkeypatch.setattr(brown_lm, "WORDS", 4)
    monkeypatch.setattr(brown_lm, "ENDINGS", 3)
    fitted, rest = brown_lm.fit(two_kinds(spark), F.lit(True))
    probe = spark.createDataFrame([(w, side, f"{side} {rare(w)}") for w in range(200) for side in ("ma", "po")], "w long, side string, text string")
    got = {(r["w"], r["side"]): r["score"] for r in brown_lm.scored(spark, probe, fitted, rest, ["w", "side"]).collect()}
    assert all(got[w, "ma" if w % 2 else "po"] > got[w, "po" if w % 2 else "ma"] for w in range(200))


def test_class_tables_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(brown_lm, "HELD", 500)
    docs = two_kinds(spark).repartition(3)
    texts = [words(r["text"]) for r in docs.collect()]
    count = Counter(w for t in texts for w in t)
    top = [w for w, _ in sorted(count.items(), key=lambda x: (-x[1], x[0]))[:30]]
    code = lambda names: brown_lm.tokens(np.frombuffer(" ".join(names).encode(), np.uint8), np.array([0, len(" ".join(names))]))
    h, ending, _ = code(top)
    items = brown_lm.Items(h[:4], np.unique(ending[4:]))
    codes = brown_lm.Codes(items, h, 4)
    rows = docs.select("text")
    own = brown_lm.exchange(brown_lm.pair_counts(rows, items), 6)
    classes, seen, table = brown_lm.clustered(brown_lm.neighbours(rows, codes), codes, own, brown_lm.pair_counts(rows, items))
    by_hash = {r["h"]: (r["n"], r["class"]) for r in classes.collect()}
    every = list(count)
    h, ending, _ = code(every)
    of, known = {None: 0}, {None: 0}
    for w, x, e in zip(every, h, ending):
        item = int(items.of(np.array([x]), np.array([e]))[0])
        known[w] = int(seen[codes.own(np.array([x]), np.array([item]))[0]])
        n, of[w] = by_hash.pop(int(np.int64(x.view(np.int64))), (count[w], int(own[item])))
        assert n == count[w] and (w not in top or known[w] == of[w])
    assert not by_hash
    expected = np.zeros_like(table)
    for t in texts:
        for a, b in zip([None, *t], [*t, None]):
            expected[known[a], of[b]] += 1
    assert (table == expected).all() and len(set(of.values())) > 2


def test_class_probabilities_sum_to_one():
    """Over all known words and the unseen ones of every class, after any class."""
    own = np.array([0, 1, 1, 2])
    pairs = np.array([[0, 3, 1, 0], [2, 1, 0, 4], [1, 0, 2, 1], [1, 2, 2, 0.0]])
    counts = {1: [4, 1, 2], 2: [3, 1]}
    sizes = np.zeros((4, 3))
    for c, n in {**counts, 0: [4]}.items():
        sizes[:, c] = sum(n), len(n), n.count(1), n.count(2)
    m = brown_lm.Model(None, own, pairs, sizes, 1, 1, 4, None)
    inside = [1 - m.cut[0] / 4 + 10 ** m.unseen[0]] + [sum((x - m.cut[c]) / m.many[c] for x in counts[c]) + 10 ** m.unseen[c] for c in (1, 2)]
    assert np.allclose(inside, 1) and np.allclose((10 ** m.step).sum(axis=1), 1)
