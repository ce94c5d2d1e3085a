import hashlib
import re

import pytest

from tabsmith.llm import decontaminate
from tabsmith.llm.common import table
from tests.conftest import SF
from tests.llm.data import clashing, empty, odd

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi"


def words(text):
    return WORDS.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))


def brute(docs, items, n=13):
    windows = {}
    for item, text in items:
        w = words(text)
        for k in range(len(w) - min(n, len(w)) + 1):
            if w:
                windows.setdefault(tuple(w[k:k + n]), set()).add("" if item is None else str(item))
    sizes = {len(k) for k in windows}
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                if tuple(w[k:k + size]) in windows:
                    found |= windows[tuple(w[k:k + size])]
                    hit |= set(range(k, k + size))
        yield (str(doc_id), len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(),
               len(hit) > 0 and 20 * len(hit) >= len(w))


def cases(spark):
    more = [(20, f"intro words {LONG.upper()} outro", "en", "a", 1), (21, LONG.replace(" ", "--"), "en", "a", 1),
            (22, "Short-Item here", "en", "a", 1), (23, " ".join(LONG.split()[:12]), "en", "a", 1),
            (24, "pad " * 400 + "short item", "en", "a", 1), (25, "alpha\x00beta", None, None, None)]
    items = spark.createDataFrame([(1, LONG), (2, "short item"), (3, None), (4, "!!"), (None, "quick brown fox"), (2, "short item"),
                                   (10, LONG + " rho"), (5, "日本語 and")], "item_id long, text string")
    return odd(spark, more), items


@pytest.mark.parametrize("block", [8 << 20, 40])
def test_report_equals_brute_force(spark, monkeypatch, block):
    """Also in several passes over small blocks of the benchmark."""
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    docs, items = cases(spark)
    got = decontaminate.report(spark, clashing(docs), items).collect()
    expected = brute([(r["doc_id"], r["text"]) for r in docs.collect()], [tuple(r) for r in items.collect()])
    assert sorted((str(r[0]), *r[1:]) for r in got) == sorted(expected)


def test_filter_and_cut(spark):
    docs, items = cases(spark)
    bad = {r[0] for r in decontaminate.report(spark, docs, items).where("contaminated").collect()}
    kept = decontaminate.filtered(spark, clashing(docs), items)
    assert kept.columns == clashing(docs).columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in docs.collect() if r["doc_id"] not in bad)
    cut = {r["doc_id"]: r["text"] for r in decontaminate.cleaned(spark, clashing(docs), items).collect()}
    assert cut[20] == "intro words  outro" and cut[3] is None and cut[9] == "x" and cut[24] == "pad " * 400


def test_empty_tables(spark):
    docs, items = cases(spark)
    assert decontaminate.report(spark, empty(spark), items).count() == 0
    got = decontaminate.report(spark, docs, items.limit(0)).collect()
    assert len(got) == docs.count() and not any(r["n_hit"] or r["contaminated"] for r in got)


def test_tables(spark):
    docs, items = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    expected = brute([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()])
    assert sorted((str(r[0]), *r[1:]) for r in decontaminate.report(spark, docs, items).collect()) == sorted(expected)


def test_repeated_words_take_a_moment(spark):
    """Equal windows are one entry, so a text and an item of one word over and over are linear."""
    import time
    text = "word " * 20_000
    items = [("a", text.encode()), ("b", text.encode()), ("c", b"word " * 13 + b"end")]
    windows = decontaminate.Windows(items, decontaminate.N)
    keys, spots, names = windows.by_size[13]
    assert len(keys) == 2 and sorted(map(sorted, names)) == [["a", "b", "c"], ["c"]]
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    bench = spark.createDataFrame([(n, t.decode()) for n, t in items], "item_id string, text string")
    at = time.time()
    row = decontaminate.report(spark, docs, bench).first()
    assert (row["n_words"], row["n_hit"], row["n_items"]) == (20_000, 20_000, 3) and time.time() - at < 60
