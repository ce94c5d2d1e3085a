"""SimHash near-duplicates: a binary trie self-join over fingerprints.

Fingerprint: words (runs without ASCII white space, A-Z lower-cased), three-word
shingles with repeats, XXH64 of each (seed 42); a bit is 1 if it is set in over
half of them.

Links (at most two differing bits): of four blocks of 16 bits two at least are
equal in a linked pair, so each of the six pairs of blocks, moved to the front,
heads a trie whose first 32 levels must agree and whose other 32 may differ in
two. Fingerprints are dealt out by those 32 bits and each task walks its tries
on sorted arrays: pairs of nodes go down together, add the bits that differ,
and are given up beyond two. A head that holds very many fingerprints is dealt
out again by pairs of its next eight levels, so no task holds a hot subtree.
A task reports a forest of its links (member, smallest member), never all
pairs; groups are joined by alternating star contraction with every round
written to the shared folder.

Cases: null and empty texts have the fingerprint zero and are linked like any
other; copies share a fingerprint and cost one trie leaf; rows without an id
never name a group that has an id; repeated rows stay; an empty table gives an
empty table; other columns are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.llm.common import small_batches, stored

SHINGLE, BITS = 3, 2
SEED = 42
#: Fingerprints under one head beyond which its next levels are dealt out, too.
HOT_HEAD = 4096
#: Node pairs that go down together.
FRONTIER = 1 << 18
#: Shingles hashed at a time.
STEP = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    at = np.concatenate(([0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)))
    k = min(shingle, len(words))
    first, last = at[:len(words) - k + 1].tolist(), (at[k:] - 1).tolist()
    ones = np.zeros(64, np.int64)
    hashed = xxhash.xxh64_intdigest
    for i in range(0, len(first), STEP):
        h = np.array([hashed(joined[a:b], SEED) for a, b in zip(first[i:i + STEP], last[i:i + STEP])], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(first), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``keep`` columns as c0, c1, ... and ``fp`` (long). No shuffle."""
    small_batches(docs.sparkSession)
    fields = [T.StructField(f"c{k}", docs.schema[c].dataType) for k, c in enumerate(keep)] + [T.StructField("fp", T.LongType())]

    def run(batches):
        for batch in batches:
            fp = np.array([fingerprint(t, shingle) for t in batch.column(len(keep)).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), pa.array(fp)],
                                             names=[f.name for f in fields])

    return docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(keep)],
                       F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(run, T.StructType(fields))


# --- trie self-join -------------------------------------------------------

#: Orders of the four blocks: the pair that must agree first.
ORDERS = [(*pair, *(b for b in range(4) if b not in pair)) for pair in combinations(range(4), 2)]


def _reordered(values: np.ndarray, order: tuple[int, ...]) -> np.ndarray:
    """The 16-bit blocks of each value (0 is the lowest) with ``order[0]`` on top."""
    out = np.zeros_like(values)
    for place, block in enumerate(order):
        out |= ((values >> np.uint64(16 * block)) & np.uint64(0xFFFF)) << np.uint64(48 - 16 * place)
    return out


def _restored(values: np.ndarray, order: tuple[int, ...]) -> np.ndarray:
    out = np.zeros_like(values)
    for place, block in enumerate(order):
        out |= ((values >> np.uint64(48 - 16 * place)) & np.uint64(0xFFFF)) << np.uint64(16 * block)
    return out


def trie_pairs(values: np.ndarray, lo_a, hi_a, lo_b, hi_b, level, spent, budget: int):
    """Index pairs whose values differ in at most ``budget`` bits.

    ``values`` are sorted within each node. A node pair is two index ranges
    with equal depth ``level`` (bits read from the top) and ``spent``
    differing bits so far; a pair of a node with itself has equal ranges.
    Yields (i, j) arrays with i < j for self pairs."""
    stack = [tuple(np.asarray(x, np.int64) for x in (lo_a, hi_a, lo_b, hi_b, level, spent))]
    while stack:
        la, ha, lb, hb, lv, sp = stack.pop()
        if len(la) > FRONTIER:
            half = len(la) // 2
            stack += [tuple(x[:half] for x in (la, ha, lb, hb, lv, sp)), tuple(x[half:] for x in (la, ha, lb, hb, lv, sp))]
            continue
        done = lv == 64
        if done.any():
            yield la[done], lb[done]
            la, ha, lb, hb, lv, sp = (x[~done] for x in (la, ha, lb, hb, lv, sp))
        if not len(la):
            continue
        # one value on either side: the rest of both paths at once
        leaf = (ha - la == 1) & (hb - lb == 1)
        if leaf.any():
            i, j = la[leaf], lb[leaf]
            rest = values[i] ^ values[j]
            keep = lv[leaf].astype(np.uint64)
            rest &= np.where(keep == 0, ~np.uint64(0), (np.uint64(1) << (np.uint64(64) - np.maximum(keep, np.uint64(1)))) - np.uint64(1))
            near = (np.bitwise_count(rest) + sp[leaf] <= budget) & (i != j)
            yield i[near], j[near]
            la, ha, lb, hb, lv, sp = (x[~leaf] for x in (la, ha, lb, hb, lv, sp))
            if not len(la):
                continue
        same = la == lb
        mid_a = _split(values, la, ha, lv)
        mid_b = np.where(same, mid_a, _split(values, lb, hb, lv))
        parts = [(la, mid_a, lb, mid_b, sp), (mid_a, ha, mid_b, hb, sp), (la, mid_a, mid_b, hb, sp + 1), (mid_a, ha, lb, mid_b, sp + 1)]
        down = []
        for k, (a, b, c, d, s) in enumerate(parts):
            ok = (a < b) & (c < d) & (s <= budget)
            if k == 3:
                ok &= ~same
            if k < 2:
                ok &= ~(same & (b - a == 1))
            down.append(tuple(x[ok] for x in (a, b, c, d, lv + 1, s)))
        stack.append(tuple(np.concatenate(x) for x in zip(*down)))


def _split(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, level: np.ndarray) -> np.ndarray:
    """First index in each sorted range whose bit at ``level`` (from the top) is 1."""
    bit = np.uint64(1) << (np.uint64(63) - np.minimum(level, 63).astype(np.uint64))
    lo, hi = lo.copy(), hi.copy()
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi) >> 1
        one = (values[np.minimum(mid, len(values) - 1)] & bit) != 0
        hi = np.where(open_ & one, mid, hi)
        lo = np.where(open_ & ~one, mid + 1, lo)


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Smallest index linked to each of ``n`` indexes."""
    root = np.arange(n)
    while True:
        a, b = root[i], root[j]
        if (a == b).all():
            return root
        low = np.minimum(a, b)
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


#: The differences of eight bits that the budget allows.
MASKS = [m for m in range(256) if m.bit_count() <= BITS]


def _cells(distinct: DataFrame) -> DataFrame:
    """(order, head, sub, value): every fingerprint under each of its six heads.

    ``sub`` is -1, or for a hot head a pair of next-eight-bit prefixes: a value
    goes to each pair that holds its prefix and could hold a partner's."""
    block = lambda b: F.shiftrightunsigned("fp", 16 * b).bitwiseAND(0xFFFF)
    moved = [F.struct(F.lit(k).alias("order"),
                      F.shiftleft(block(o[0]), 48).bitwiseOR(F.shiftleft(block(o[1]), 32))
                      .bitwiseOR(F.shiftleft(block(o[2]), 16)).bitwiseOR(block(o[3])).alias("value"))
             for k, o in enumerate(ORDERS)]
    rows = distinct.select(F.explode(F.array(*moved)).alias("m")).select(
        "m.order", "m.value", F.shiftrightunsigned("m.value", 32).alias("head"))
    sizes = rows.groupBy("order", "head").count().where("count > 1")
    rows = rows.join(sizes, ["order", "head"])  # a head of one value has no pair
    own = F.shiftrightunsigned("value", 24).bitwiseAND(0xFF).cast("int")
    pairs = [F.least(own, own.bitwiseXOR(m)) * 256 + F.greatest(own, own.bitwiseXOR(m)) for m in MASKS]
    return rows.select("order", "head", "value", F.explode(
        F.when(F.col("count") > HOT_HEAD, F.array(*pairs)).otherwise(F.array(F.lit(-1)))).alias("sub"))


def links(distinct: DataFrame, budget: int = BITS) -> DataFrame:
    """(a, b) with a forest of the links among the ``fp`` of ``distinct``:
    for every head or cell, each linked member and the group's smallest."""
    if budget != BITS:
        raise ValueError("four blocks serve a budget of two bits")
    dealt = _cells(distinct).repartition("order", "head", "sub").sortWithinPartitions("order", "head", "sub", "value")

    def walk(order, head, sub, value):
        edge = np.flatnonzero((order[1:] != order[:-1]) | (head[1:] != head[:-1]) | (sub[1:] != sub[:-1])) + 1
        lo, hi = np.concatenate(([0], edge)), np.concatenate((edge, [len(value)]))
        v = value.view(np.uint64)
        s = sub[lo]
        whole = s < 0
        # the two prefixes of a cell: its rows are sorted, so each prefix is a range
        p, q = np.where(whole, 0, s >> 8), np.where(whole, 0, s & 255)
        prefix = (v >> np.uint64(24)).astype(np.int64) & 255
        in_p = np.add.reduceat(prefix == p.repeat(hi - lo), lo)
        cut = np.where(whole | (p == q), hi, lo + in_p)
        level = np.where(whole, 32, 40)
        la, ha = lo, cut
        lb, hb = np.where(whole | (p == q), lo, cut), hi
        spent = np.bitwise_count((p ^ q).astype(np.uint64)).astype(np.int64)
        ok = (la < ha) & (lb < hb)
        root = np.arange(len(v))
        for i, j in trie_pairs(v, la[ok], ha[ok], lb[ok], hb[ok], level[ok], spent[ok], budget):
            if len(i):
                root = _merged(root, i, j)
        k = np.flatnonzero(root != np.arange(len(v)))
        out_a, out_b = np.zeros(len(k), np.uint64), np.zeros(len(k), np.uint64)
        for o in range(len(ORDERS)):
            mine = order[k] == o
            out_a[mine], out_b[mine] = _restored(v[k[mine]], ORDERS[o]), _restored(v[root[k[mine]]], ORDERS[o])
        return pa.RecordBatch.from_arrays([pa.array(out_a.view(np.int64)), pa.array(out_b.view(np.int64))], names=["a", "b"])

    def run(batches):
        kept = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("order", "head", "sub", "value")]
            if kept is not None:
                columns = [np.concatenate(x) for x in zip(kept, columns)]
            o, h, s, _ = columns
            # the last group may go on in the next batch
            last = (o == o[-1]) & (h == h[-1]) & (s == s[-1])
            cut = int(np.argmax(last))
            if cut:
                yield walk(*(x[:cut] for x in columns))
            kept = [x[cut:] for x in columns]
        if kept is not None:
            yield walk(*kept)

    return dealt.select("order", "head", "sub", "value").mapInArrow(run, "a long, b long")


def _merged(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Groups ``root`` with the links (i, j) added."""
    a, b = root[i], root[j]
    return forest(a, b, len(root))[root]


# --- components -----------------------------------------------------------

def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest
    node that it reaches. Large-star and small-star steps in turn, each
    written to the shared folder, until the edges stay the same."""
    edges = stored(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = mark(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u != v").distinct()
        edges = stored(small, "edges")
        after = mark(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def classes(rows: DataFrame, budget: int = BITS) -> DataFrame:
    """(fp, root) for every distinct fingerprint ``fp`` of ``rows``."""
    distinct = stored(rows.select("fp").distinct(), "fingerprints")
    found = components(links(distinct, budget))
    return distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                    shingle: int = SHINGLE, budget: int = BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest id of the group; null if none has one)."""
    rows = stored(fingerprints(docs, [doc_id], text, shingle), "simhash")
    found = classes(rows, budget)
    first = rows.groupBy("fp").agg(F.min("c0").alias("first"))
    named = found.join(first, "fp")
    ids = named.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = named.join(ids, "root").select("fp", "component_id")
    return rows.join(by_fp, "fp").select(F.col("c0").alias(doc_id), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                                         "component_id")


def deduplicated(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 shingle: int = SHINGLE, budget: int = BITS) -> DataFrame:
    """One row of each group, with all its columns: that with the smallest id
    (no id counts last), then the smallest text hash. Texts move once, to the
    rows that stay; of equal rows one stays."""
    hashed = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"), F.xxhash64(F.col(f"`{text}`")).alias("h"))
    rows = stored(fingerprints(hashed, ["id", "h"], "text", shingle), "simhash")
    found = classes(rows, budget)
    best = rows.groupBy("fp").agg(F.min(F.struct(F.col("c0").isNull().alias("no"), "c0", "c1")).alias("k"))
    # a row's name without nulls: join and removal of equal rows share one shuffle by it
    name = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))
    best = best.join(found, "fp").groupBy("root").agg(F.min("k").alias("k")).select(
        name(F.col("k.c0")).alias("__id"), F.col("k.c1").alias("__hash"))
    names = [f"c{k}" for k in range(len(docs.columns))]
    plain = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)],
                        name(F.col(f"`{doc_id}`")).alias("__id"), F.xxhash64(F.col(f"`{text}`")).alias("__hash"))
    kept = plain.join(best, ["__id", "__hash"], "left_semi").dropDuplicates(["__id", "__hash"])
    return kept.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])
