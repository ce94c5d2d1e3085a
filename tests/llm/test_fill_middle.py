import hashlib
import re

from pyspark.sql import functions as F

from tabsmith.llm import fill_middle
from tests.llm.data import clashing, empty, odd

MORE = [(k, t, "en", "a", 1) for k, t in enumerate(
    ["a<P>b", "x <S", "<S>", "tail <", "<M", "P>S>M> <", "é1é2é3 日本語\nnew\r\nline\0", "<<P <<S <<M>", "\U0001F600" * 7, "abc", " ", "a b",
     "¿Qué? 'quoted' <p> <s>", "tab\tand ½"] * 8, 100)]


def by_hand(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    x = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[8 * k:8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(units[i:j]) for i, j in ((0, a), (a, b), (b, n)))
    if not text or any(k in text for k in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_rows_equal_the_rule_and_texts_come_back(spark):
    docs = odd(spark, MORE)
    got = fill_middle.transformed(spark, docs, ["doc_id", "text"]).withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == by_hand(r["doc_id"], r["text"])
        assert r["back"] == (r["text"] or "")
    assert {r["form"] for r in got} == {"plain", "spm", "psm"}


def test_digests(spark):
    docs = odd(spark, MORE)
    expected = sorted((str(r["doc_id"]), *map(str, by_hand(r["doc_id"], r["text"])[:4]),
                       hashlib.sha256(by_hand(r["doc_id"], r["text"])[4].encode()).hexdigest(),
                       hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in docs.collect())
    assert sorted(tuple(map(str, r)) for r in fill_middle.report(spark, docs).collect()) == expected


def test_steps_and_clashing_names(spark, monkeypatch):
    docs = clashing(odd(spark, MORE)).withColumn("output", F.lit(1)).withColumn("h1", F.lit(2))
    rows = fill_middle.transformed(spark, docs, docs.columns)
    assert rows.columns == [c for c in docs.columns if c not in ("n", "output")] + ["n", "form", "prefix_chars", "middle_chars", "output"]
    assert sorted(str(r["output"]) for r in rows.collect()) == sorted(by_hand(r["doc_id"], r["text"])[4] for r in docs.collect())
    assert {r["h1"] for r in rows.collect()} == {2}
    assert fill_middle.report(spark, empty(spark)).collect() == []
