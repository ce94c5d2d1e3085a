"""HTML extraction by differencing a page against its nearest page by URL.

A page is cut into lines (all its blocks of text, menus and footers as well)
with what the markup says of them: whether a line stands in the article, in
prose markup, or in a part that is no content by its element or class name.
Pages are put in order of host and URL path; a page's partner is the neighbour
of the same host whose path begins alike for longest. Both pages' lines are
aligned by a longest common subsequence, and the lines they share are deleted
as template. Prose inside an article is spared, since an article may quote what
another one has. If the shared lines are most of a page's content, the partner
is a copy, not a page of the same template, and the other neighbour is tried.
A check by markup follows: lines that no partner shares but that stand in a
menu, an advert or another part that is no content go, too.

Pages are dealt out by ranges of (host, path), so a hot host is many tasks; the
first and last page of a range also go to the neighbouring ranges. A task
reads its pages in order and holds three of them.

Cases: null and empty html give an empty text; a null URL counts as an empty
host; a page without a partner is judged by its markup alone; truncated and
unclosed markup is read as far as it goes; equal URLs are neighbours, in the
order of page_id; an empty table gives an empty table; other columns are not
read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tabsmith.llm.common import input_bytes, small_batches

BUCKET_BYTES = 4 << 20
SAMPLED_KEYS = 64  # for each bucket
#: Characters and pages that a task holds before it hands them on.
HELD_CHARS, HELD_PAGES = 1 << 20, 512

MARKUP = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>", re.S)
ATTRIBUTE = re.compile(r"(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
URL = re.compile(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)([^?#]*)|^([^?#]*)")

# Elements of HTML.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "object"}
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
            "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody "
            "td tfoot th thead tr ul".split())
PROSE = set("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption li dd dt td th".split())
NO_CONTENT = set("nav footer aside form button select menu dialog head fieldset label input".split())
VOID = set("area base br col embed hr img input link meta source track wbr".split())
WRAPPERS = {"div", "section", "ul", "ol", "table", "tr"}
OFTEN_OPEN = {"p", "li", "dt", "dd", "tr", "td", "th", "option", "tbody", "thead"}
# Words of class names, ids and roles of parts that are no content.
NO_CONTENT_NAMES = set("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies "
                       "consent gdpr notice notices alert sidebar sidebars aside widget widgets menu menus nav navbar navigation "
                       "breadcrumb breadcrumbs footer header masthead comment comments commentlist respond disqus share sharing "
                       "social related recommended newsletter subscribe signup popup modal overlay toolbar pagination pager "
                       "search login skip contentinfo complementary".split())
ARTICLE_NAMES = set("article post entry story content main".split())


SPARED, OPEN, OUTSIDE = 0, 1, 2


class Line:
    __slots__ = ("text", "place", "prose")

    def __init__(self, text: str, place: int, prose: bool):
        self.text, self.place, self.prose = text, place, prose


def _no_content(tag: str, attributes: str, inside: int) -> tuple[bool, bool]:
    """(the element is no content, it is named as the article)."""
    if tag in NO_CONTENT or (tag == "header" and not inside):
        return True, False
    named = False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            return True, False
        if name in ("class", "id", "role"):
            for word in value.split():
                parts = [p for p in re.split(r"[^a-z0-9]+", word) if p]
                if not parts:
                    continue
                ends = {parts[0], parts[-1]}
                if inside:  # an article has a header of its own
                    ends -= {"header", "banner"}
                if parts[0] not in ("no", "has", "with", "without", "is") and ends & NO_CONTENT_NAMES and tag not in ("body", "html", "main"):
                    return True, False
                named |= parts[-1] in ARTICLE_NAMES
    return False, named


def lines_of(html: str) -> list[Line]:
    """All lines of a page. ``place``: 3 in an article element, 2 in a main
    element, 1 in a part named like one, -1 in a part that is no content, else 0."""
    out: list[Line] = []
    text: list[str] = []
    stack: list[tuple[str, bool, int]] = []  # element, no content, place
    drop, soft, place, prose, at = False, False, 0, False, 0
    skip: str | None = None

    def flush():
        nonlocal text
        joined = " ".join("".join(text).split())
        if joined:
            out.append(Line(joined, -1 if drop else place, prose))
        text = []

    for m in MARKUP.finditer(html):
        if m.start() < at:
            continue
        if m.start() > at:
            text.append(unescape(html[at:m.start()]))
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        closing, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag == "br":
            text.append(" ")
        elif tag in RAW and not closing:
            end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(html, at)
            at = end.end() if end else len(html)
        elif tag in BLOCK or tag in NO_CONTENT or tag == "span":
            if tag != "span":
                flush()
            if tag in PROSE:
                prose = not closing
            elif tag in BLOCK and not (closing and tag in WRAPPERS):
                prose = False
            if tag in VOID:
                continue
            bad, named = _no_content(tag, attributes, place) if not closing and (attributes or tag in NO_CONTENT or tag == "header") else (False, False)
            if tag in OFTEN_OPEN:  # without an end tag it ends at the next one
                soft = bad and not closing
            elif closing:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        soft = False
                        break
            else:
                main = tag == "main" or re.search(r"""role\s*=\s*["']?main\b""", attributes)
                here = 3 if tag == "article" else 2 if main else 1 if named else 0
                stack.append((tag, bad or drop, max(place, here)))
            hard, place = stack[-1][1:] if stack else (False, 0)
            drop = hard or soft
    if at < len(html):
        rest = html[at:]
        cut = re.search(r"<[a-zA-Z/!][^>]*$", rest)  # markup that the end of the page cuts off
        text.append(unescape(rest[:cut.start()] if cut else rest))
    flush()
    return out


def marks(lines: list[Line]) -> list[int]:
    """SPARED for prose of the article, OPEN for other content, OUTSIDE for
    what the markup places elsewhere."""
    best = max((x.place for x in lines), default=0)
    return [OUTSIDE if x.place < max(best, 0) else SPARED if x.place and x.prose else OPEN for x in lines]


def url_key(url: str | None) -> tuple[str, str]:
    """(host, path) of a URL; query and fragment do not count."""
    m = URL.match(url or "")
    return (m[1].lower(), m[2].rstrip("/")) if m and m[1] is not None else ("", (m[3] if m else "") or "")


def common_lines(a: list[str], b: list[str]) -> set[int]:
    """Indexes of ``a`` in a longest common subsequence with ``b`` (bit-parallel)."""
    shared = set(a) & set(b)
    own = [i for i, x in enumerate(a) if x in shared]
    other = [x for x in b if x in shared]
    spots: dict[str, int] = {}
    for k, i in enumerate(own):
        spots[a[i]] = spots.get(a[i], 0) | 1 << k
    full = (1 << len(own)) - 1
    v, rows = full, []
    for x in other:
        u = v & spots[x]
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    out, k, j = set(), len(own) - 1, len(other) - 1
    while k >= 0 and j >= 0:
        if rows[j] >> k & 1:
            k -= 1
        elif j and not rows[j - 1] >> k & 1:
            j -= 1
        else:
            out.add(own[k])
            k, j = k - 1, j - 1
    return out


def alike(a: str, b: str) -> tuple[int, int]:
    """How long two paths begin alike: in segments, then in characters."""
    x, y = a.split("/"), b.split("/")
    n = next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
    m = next((i for i, (p, q) in enumerate(zip(a, b)) if p != q), min(len(a), len(b)))
    return n, m


class Page:
    __slots__ = ("bucket", "host", "path", "own", "page_id", "url", "lines", "marks")

    def __init__(self, row):
        self.bucket, key, self.own, self.page_id, self.url, texts, marked = row
        self.host, self.path = key.split("\0")[:2]
        self.lines, self.marks = texts or [], marked or []


def content(page: Page, before: Page | None, after: Page | None) -> tuple[str, int]:
    """(text, shared lines deleted) of a page between its neighbours."""
    near = [p for p in (before, after) if p is not None and p.host == page.host]
    near.sort(key=lambda p: alike(page.path, p.path), reverse=True)
    inside = [i for i, m in enumerate(page.marks) if m != OUTSIDE]
    size = sum(len(page.lines[i]) for i in inside)
    gone: set[int] = set()
    for partner in near:
        shared = common_lines(page.lines, partner.lines)
        if size and 2 * sum(len(page.lines[i]) for i in inside if i in shared) > size:
            continue  # a copy
        gone = {i for i in shared if page.marks[i] != SPARED}
        break
    return "\n".join(page.lines[i] for i in inside if i not in gone), len(gone)


def extracted(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars, n_template (shared lines deleted). One
    shuffle, of the lines; the ranges come from two reads of the URLs."""
    small_batches(pages.sparkSession)
    rows = pages.select(F.col(f"`{page_id}`").alias("c0"), F.col(f"`{url}`").cast("string").alias("c1"),
                        F.col(f"`{html}`").cast("string").alias("c2"))
    id_type = pages.schema[page_id].dataType

    def key_of(page, link, digest):
        host, path = url_key(link)
        return f"{host}\0{path}\0{'' if page is None else str(page).zfill(20)}\0{digest}"

    keyed = rows.select("c0", "c1", F.md5(F.coalesce("c2", F.lit(""))).alias("m"))

    def keys(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([key_of(*r) for r in zip(*(c.to_pylist() for c in batch.columns))], pa.string())], names=["key"])

    n = max(1, min(100_000, input_bytes(pages) // BUCKET_BYTES))
    total = pages.count()
    all_keys = keyed.mapInArrow(keys, "key string")
    bounds: list[str] = []
    if n > 1 and total:
        some = sorted(r[0] for r in all_keys.where(F.rand(7) < SAMPLED_KEYS * n / total).collect())
        bounds = sorted({some[len(some) * i // n] for i in range(1, n)}) if some else []

    def ends(batches):
        found: dict[int, list[str]] = {}
        for batch in batches:
            for k in batch.column(0).to_pylist():
                at = found.setdefault(bisect_right(bounds, k), [k, k])
                at[0], at[1] = min(at[0], k), max(at[1], k)
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([x[0] for x in found.values()], pa.string()),
                                          pa.array([x[1] for x in found.values()], pa.string())], names=["bucket", "low", "high"])

    edges = all_keys.mapInArrow(ends, "bucket int, low string, high string").groupBy("bucket") \
        .agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("bucket").collect()
    also: dict[str, list[int]] = {}  # page at the edge of a range -> the range beyond it
    for left, right in zip(edges, edges[1:]):
        also.setdefault(left["high"], []).append(right["bucket"])
        also.setdefault(right["low"], []).append(left["bucket"])

    def packed(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=[f.name for f in dealt.fields])

    def cut(batches):
        for batch in batches:
            out, held = [], 0
            for page, link, source in rows_of(batch):
                lines = lines_of(source or "")
                key = key_of(page, link, hashlib.md5((source or "").encode()).hexdigest())
                texts, marked = [x.text for x in lines], marks(lines)
                home = bisect_right(bounds, key)
                out += [(b, key, b == home, page, link, texts, marked) for b in [home, *also.get(key, ())]]
                held += len(source or "")
                if held > HELD_CHARS or len(out) >= HELD_PAGES:
                    yield packed(out)
                    out, held = [], 0
            if out:
                yield packed(out)

    dealt = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("key", T.StringType()), T.StructField("own", T.BooleanType()),
                          T.StructField("c0", id_type), T.StructField("c1", T.StringType()),
                          T.StructField("texts", T.ArrayType(T.StringType())), T.StructField("marks", T.ArrayType(T.ByteType()))])
    types = [to_arrow_type(f.dataType) for f in dealt.fields]
    sorted_ = rows.mapInArrow(cut, dealt).repartition(n, "bucket").sortWithinPartitions("bucket", "key")

    def compare(batches):
        before = page = None
        out: list[tuple] = []
        held = 0

        def told(after):
            nonlocal held
            if page is not None and page.own:
                text, gone = content(page, before if before is not None and before.bucket == page.bucket else None,
                                     after if after is not None and after.bucket == page.bucket else None)
                out.append((page.page_id, page.url, text, len(text), gone))
                held += len(text)

        for batch in batches:
            for row in rows_of(batch):
                after = Page(row)
                told(after)
                before, page = page, after
                if held > HELD_CHARS or len(out) >= HELD_PAGES:
                    yield _given(out, types[3])
                    out, held = [], 0
        told(None)
        if out:
            yield _given(out, types[3])

    result = T.StructType([T.StructField("c0", id_type), T.StructField("c1", T.StringType()), T.StructField("text", T.StringType()),
                           T.StructField("n_chars", T.LongType()), T.StructField("n_template", T.LongType())])
    return sorted_.mapInArrow(compare, result).toDF(page_id, url, "text", "n_chars", "n_template")


def rows_of(batch: pa.RecordBatch):
    """The rows of a batch as Python values, one at a time."""
    for i in range(batch.num_rows):
        yield [c[i].as_py() for c in batch.columns]


def _given(rows, id_type):
    types = [id_type, pa.string(), pa.string(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["c0", "c1", "text", "n_chars", "n_template"])
