import html
import re

import pytest

from tabsmith.llm import html_extract as X
from tabsmith.llm.common import table
from tests.conftest import SF


def texts(source):
    lines = X.lines_of(source)
    return [x.text for x, m in zip(lines, X.marks(lines)) if m != X.OUTSIDE]


def test_markup():
    assert texts("<html><body><header class='site'><h1>Site</h1></header><div class=\"cookie-notice\">We use</div><main><article>"
                 "<header><h1>T &amp; x</h1></header><p>One<br>two <b>b</b>c&nbsp;d</p><div class=share>Share</div><p class=ad>Buy</p>"
                 "<p>Three &lt;p&gt; <script>var x='<p>no</p>'</script>end</p><section id='reader-comments'><p>nice</p></section></article>"
                 "<aside>side</aside></main><form><p>q</p></form><footer>f</footer>") == ["T & x", "One two bc d", "Three <p> end"]
    assert texts("<article><p>cut <b>off") == ["cut off"] and texts("<article><p>cut<a href='x") == ["cut"]
    assert texts("plain &eacute; text<!-- no <p>x</p> --> goes") == ["plain é text goes"]
    assert texts("<div class='main-content no-sidebar'><p>a</p></div><div class='sidebar-content'><p>b</p></div>") == ["a"]
    assert texts("") == [] and texts("<script>x") == [] and texts("<style>p</style><p hidden>h</p><p>v</p>") == ["v"]


def test_longest_common_subsequence():
    import random
    rnd = random.Random(1)
    for _ in range(200):
        a, b = ([rnd.choice("abcd") for _ in range(rnd.randint(0, 12))] for _ in range(2))
        table_ = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table_[i + 1][j + 1] = table_[i][j] + 1 if x == y else max(table_[i][j + 1], table_[i + 1][j])
        got = X.common_lines(a, b)
        at, left = -1, [a[i] for i in sorted(got)]
        for x in left:  # it is a subsequence of b, too
            at = b.index(x, at + 1)
        assert len(got) == table_[-1][-1]


def page(k, body, path=None, host="site.example"):
    return k, f"http://{host}{path or f'/news/{k}'}?ref=x#top", f"<html><body>{body}</body></html>"


@pytest.mark.parametrize("bucket", [4 << 20, 400])
def test_shared_lines_of_the_nearest_page_go(spark, monkeypatch, bucket):
    """Pages whose markup names no article; also over many ranges of URLs."""
    monkeypatch.setattr(X, "BUCKET_BYTES", bucket)
    menu, foot = "<div>Home</div><div>News</div><div>About us</div>", "<div>Imprint 2020</div>"
    rows = [page(k, f"{menu}<div>Story number {k} tells at length of what is new in town {k}.</div><div>It goes on {k}.</div>{foot}") for k in range(30)]
    rows += [page(100 + k, f"{menu}<div>A single copy that two addresses hold, with much text.</div>{foot}", f"/copy/{k}") for k in range(2)]
    rows += [page(200, f"{menu}<div>Alone.</div>{foot}", host="other.example"), (300, None, None), (301, "http://site.example/x", ""),
             (302, None, "<p>no address</p>"), (None, "http://n.example/", "<p>no id</p>")]
    rows += [page(400 + k, f"<nav>Home</nav><article><p>Quoted by both.</p><p>Own words {k} of this page here.</p><div>Read more</div></article>", f"/a/{k}", "art.example") for k in range(3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumnRenamed("x", "y").selectExpr("*", "1 AS bucket", "2 AS text", "3 AS key")
    got = {r["page_id"]: r for r in X.extracted(pages.repartition(5)).collect()}
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got.values())
    for k in range(30):
        assert got[k]["text"] == f"Story number {k} tells at length of what is new in town {k}.\nIt goes on {k}." and got[k]["n_template"] == 4
    assert got[200]["text"] == "Home\nNews\nAbout us\nAlone.\nImprint 2020" and got[300]["text"] == "" and got[302]["text"] == "no address"
    assert "A single copy" in got[100]["text"] and "A single copy" in got[101]["text"]
    assert got[401]["text"] == "Quoted by both.\nOwn words 1 of this page here." and got[401]["n_template"] == 2
    assert X.extracted(pages.limit(0)).count() == 0


def test_tables(spark, monkeypatch):
    monkeypatch.setattr(X, "BUCKET_BYTES", 30_000)
    pages = table(spark, SF, "pages")
    got = {r["page_id"]: r["text"] for r in X.extracted(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S)[1]
        parts = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", article))
        assert got[r["page_id"]] == "\n".join(x for x in parts if x)


def test_tasks_hand_on_what_they_hold(spark, monkeypatch):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    pages = table(spark, SF, "pages").limit(60).cache()
    monkeypatch.setattr(X, "HELD_CHARS", 500)
    monkeypatch.setattr(X, "HELD_PAGES", 3)
    before = spark.conf.get(key)
    spark.conf.set(key, "10000")
    try:
        few = sorted(map(tuple, X.extracted(pages).collect()))
        assert spark.conf.get(key) == "1000"        # long texts: Arrow batches of fewer rows
    finally:
        spark.conf.set(key, before)
    monkeypatch.undo()
    assert few == sorted(map(tuple, X.extracted(pages).collect()))
