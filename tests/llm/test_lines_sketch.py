import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tabsmith.llm import line_dedup, sketch
from tabsmith.llm.common import table
from tests.conftest import SF
from tests.llm.data import clashing, empty, odd


def test_boilerplate_lines_go_by_site(spark):
    rows = [(k, f"Menu\nstory {k} of the site\n\nFooter", "en", "big", 1) for k in range(40)]
    rows += [(100 + k, f"Menu\nother {k}", "en", "small", 1) for k in range(2)]
    rows += [(200, "Menu\nFooter", "en", "big", 1), (201, "Footer\nlast\nMenu\nMenu", "en", "big", 1), (202, None, "en", "big", 1)]
    rows += [(300 + k, f"Top\nwithout host {k}", None, None, 1) for k in range(4)]
    rows += [(400 + k, "copy one\ncopy two", "en", "big", 1) for k in range(30)]  # one page, however many copies
    docs = clashing(odd(spark, rows))
    out = line_dedup.deduplicated(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    text = {r["doc_id"]: r["text"] for r in out.where("doc_id >= 0").collect() if r["source"] in ("big", "small", None)}
    assert text[7 + 100 - 107 + 5] is not None
    assert text[39] == "story 39 of the site\n" and text[201] == "last"
    assert text[200] == "" and text[202] is None  # nothing else is left
    assert text[100] == "Menu\nother 0" and text[300] == "without host 0" and text[410] == "copy one\ncopy two"
    told = {r["c0"]: (r["n_lines"], r["n_dropped"]) for r in line_dedup.counted(docs).where("c0 >= 200").collect()}
    assert told[201] == (4, 3) and told[200] == (2, 2) and told[202] == (0, 0)
    assert line_dedup.deduplicated(empty(spark)).count() == 0


def test_near_copies_are_one_page(spark):
    """Copies that differ in a line make no boilerplate; what stands on many families of pages is some."""
    body = [f"passage {k} of the copied story" for k in range(60)]
    rows = [(k, "\n".join([*body[:20], f"changed {k}", *body[21:]]), "en", "s", 1) for k in range(12)]
    rows += [(100 + k, f"quoted once in a while\nown text {k}\nmore {k}" if k < 6 else f"own text {k}\nmore {k}", "en", "s", 1) for k in range(80)]
    docs = spark.createDataFrame(rows, odd(spark).schema)
    found = line_dedup.boilerplate(docs).select("pages", "host_pages").collect()
    assert found == []                                  # 6 of some 85 pages, and one to three families of the copies
    out = {r["doc_id"]: r["text"] for r in line_dedup.deduplicated(docs).collect()}
    assert all(out[r[0]] == r[1] for r in rows)


def shingles(text):
    w = [x for x in re.split(r"[ \t\n\x0B\f\r]+", (text or "").lower()) if x]
    return {tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def check_report(docs, rows, close):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    expected, far = [], 0
    for k, (i, t) in enumerate(order):
        t, n = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[:len(t) - half] + n[:half]
        expected.append((str(i), len(t), hashlib.sha256(edited.encode()).hexdigest(),
                         likeness(shingles(t), shingles(edited)), likeness(shingles(t), shingles(n)), t))
    got = sorted(docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["edited_sha256"]))
    expected.sort(key=lambda e: (e[0] != "None", int(e[0]) if e[0] != "None" else 0, e[2]))
    assert [(str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in got] == [e[:3] for e in expected]
    for r, e in zip(got, expected):
        assert abs(r["near_edited"] - e[3]) < close and abs(r["near_next"] - e[4]) < close
    prints = {}
    for r, e in zip(got, expected):
        assert prints.setdefault(e[5], r["fingerprint"]) == r["fingerprint"]


@pytest.mark.parametrize("bucket", [4 << 20, 300])
def test_report_equals_brute_force(spark, monkeypatch, bucket):
    """Also with many buckets of neighbours, empty ones and null ids among them."""
    monkeypatch.setattr(sketch, "BUCKET_BYTES", bucket)
    docs = odd(spark, [(100 + k % 30, f"text number {k} with some more words and then {k * k} again", "en", "a", 1) for k in range(60)])
    check_report(sketch.edited_report(clashing(docs)), [(r["doc_id"], r["text"]) for r in docs.collect()], 0.2)
    assert sketch.edited_report(empty(spark)).count() == 0
    one = odd(spark).where("doc_id = 1")
    assert sketch.edited_report(one).first()["near_next"] == 1.0


def test_report_on_tables(spark, monkeypatch):
    monkeypatch.setattr(sketch, "BUCKET_BYTES", 20_000)
    docs = table(spark, SF, "documents")
    check_report(sketch.edited_report(docs), [tuple(r) for r in docs.select("doc_id", "text").collect()], 0.2)


def test_merging_and_estimates(spark):
    docs = table(spark, SF, "documents").select("doc_id", "source", "text")
    rows = sketch.sketched(docs, "text", "sketch")
    whole = sketch.merged(rows.withColumn("g", F.lit(1)), ["g"]).first()["sketch"]
    parts = [r["sketch"] for r in sketch.merged(rows, ["source"]).collect()]
    assert len(parts) == 20 and sorted(set(sum(parts, [])))[:sketch.K] == whole
    every = set().union(*(shingles(r["text"]) for r in docs.collect()))
    frame = spark.createDataFrame([(whole, parts[0])], "a array<long>, b array<long>")
    n, inside, self_ = frame.select(sketch.distinct_shingles(F.col("a")), sketch.containment("b", "a"), sketch.resemblance("a", "a")).first()
    assert abs(n / len(every) - 1) < 0.3 and self_ == 1.0 and inside > 0.6


def test_plan_is_native(spark, capsys):
    sketch.edited_report(table(spark, SF, "documents")).explain("formatted")
    line_dedup.deduplicated(table(spark, SF, "documents")).explain("formatted")
    plan = capsys.readouterr().out
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)
    assert Counter(re.findall(r"\(\d+\) Window\n", plan))  # the neighbour is found by a window
