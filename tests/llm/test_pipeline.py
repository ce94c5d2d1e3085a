import hashlib
import sys
from collections import Counter

import pyspark.sql.functions as F

import __spark_entry__
import corpus_pipeline
from tabsmith.llm import line_dedup
from tabsmith.llm.common import table
from tests.conftest import SF
from tests.llm.data import clashing, empty, odd
from tests.llm.test_bpe import reference
from tests.llm.test_decontaminate import brute as contamination
from tests.llm.test_simhash import fingerprint, groups


def without_boilerplate(rows):
    """(id, source, text) with the lines of a source gone that too many of its families of texts hold."""
    solid = lambda t: {x for x in t.split("\n") if x.strip(" \t\x0b\x0c\r")}
    family = lambda lines: tuple(sorted(hashlib.md5(x.encode()).hexdigest() for x in lines)[:line_dedup.FAMILY])
    pages = {}
    for _, source, t in rows:
        if t is not None:
            pages.setdefault(source, {}).setdefault(family(solid(t)), set()).update(solid(t))
    gone = {}
    for source, own in pages.items():
        count = Counter(line for lines in own.values() for line in lines)
        gone[source] = {x for x, n in count.items() if n >= line_dedup.MIN_PAGES and n > line_dedup.RATIO * len(own)}
    for i, source, t in rows:
        yield i, source, t if t is None else "\n".join(x for x in t.split("\n") if x not in gone[source])


def test_run_equals_brute_force(spark):
    docs = table(spark, SF, "documents")
    rows = [(r["doc_id"], r["source"], r["text"]) for r in docs.collect() if any(map(str.isalpha, r["text"] or ""))]
    rows = list(without_boilerplate(rows))
    prints = {i: fingerprint(t) for i, _, t in rows}
    root = groups(set(prints.values()))
    first = {}
    for i, _, _ in rows:
        first[root[prints[i]]] = min(first.get(root[prints[i]], i), i)
    rows = [r for r in rows if first[root[prints[r[0]]]] == r[0]]
    items = [tuple(r) for r in table(spark, SF, "benchmark").select("item_id", "text").collect()]
    bad = {c[0] for c in contamination([(i, t) for i, _, t in rows], items) if c[-1]}
    enc = reference()
    expected = {i: (t, enc.encode_ordinary(t)) for i, _, t in rows if str(i) not in bad}
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == [*docs.columns, "n_tokens", "ids"]
    got = {r["doc_id"]: r for r in got.collect()}
    assert set(got) == set(expected)
    assert all((r["text"], r["ids"]) == expected[i] and r["n_tokens"] == len(r["ids"]) and r["n_chars"] == len(r["text"]) for i, r in got.items())


def test_stages_take_odd_rows_and_keep_all_columns(spark):
    docs = clashing(odd(spark, [(500 + k, f"the cat number {k} and the dog went to town\nCookie note", "en", "z", 5) for k in range(8)]))
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "simhash", "decontaminate", "byte_bpe"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "byte_bpe":
            assert out.columns == columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        else:
            assert set(columns) <= set(out.columns) and len(set(out.columns)) == len(out.columns)
        docs = out.cache()
        assert docs.count() > 0
    assert docs.where(F.col("text").contains("Cookie")).count() == 0


def test_stages_take_an_empty_table(spark):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty(spark), SF).count() == 0


def test_entry_registers_them_only_when_they_are_there(monkeypatch):
    names = set(__spark_entry__.queries())
    assert {f"op{k}" for k in range(1, 14)} == {n.split("_")[0] for n in names if n.startswith("op")} and "pipeline" in names
    assert "op6_decontaminate" in __spark_entry__.oracle_sql()
    for missing in ("corpus_pipeline", "tabsmith.llm.catalog", "tabsmith.llm.oracle"):
        with monkeypatch.context() as m:
            m.setitem(sys.modules, missing, None)      # importing it raises ImportError
            left = set(__spark_entry__.queries())
            assert left and not any(n.startswith("op") or n == "pipeline" for n in left)
            assert not any(n.startswith("op") for n in __spark_entry__.oracle_sql())
