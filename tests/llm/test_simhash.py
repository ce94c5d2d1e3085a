import random
import re

import numpy as np
import xxhash

from tabsmith.llm import simhash
from tabsmith.llm.common import table
from tests.conftest import SF
from tests.llm.data import clashing, empty, odd


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + 3]).encode(), 42) for i in range(max(len(w) - 2, 1))]
    return sum(1 << b for b in range(64) if 2 * sum(y >> b & 1 for y in h) > len(h))


def groups(values):
    """Smallest value reachable by steps of at most two bits."""
    up = {v: v for v in values}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    some = sorted(up)
    for i, a in enumerate(some):
        for b in some[:i]:
            if (a ^ b).bit_count() <= 2:
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {v: find(v) for v in up}


def expected(rows):
    fp = [(i, fingerprint(t)) for i, t in rows]
    root = groups({f for _, f in fp})
    first = {}
    for i, f in fp:
        if i is not None:
            first[root[f]] = min(first.get(root[f], i), i)
    return sorted((str(i), format(f, "016x"), str(first.get(root[f]))) for i, f in fp)


def test_trie_pairs_are_all_pairs():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    values = [base]
    for k in range(5):
        mask = np.zeros(200, np.uint64)
        for _ in range(k % 3 + 1):
            mask |= np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64)
        values.append(base ^ mask)
    v = np.unique(np.concatenate(values))
    got = set()
    for i, j in simhash.trie_pairs(v, [0], [len(v)], [0], [len(v)], [0], [0], 2):
        got |= {(min(p), max(p)) for p in zip(i.tolist(), j.tolist())}
    assert got == {(i, j) for j in range(len(v)) for i in range(j) if int(v[i] ^ v[j]).bit_count() <= 2}


def test_components_of_many_near_fingerprints(spark, monkeypatch):
    """A hot head, a long chain and a tight cluster; also with heads dealt out again."""
    rnd = random.Random(2)
    values = {rnd.getrandbits(64) for _ in range(300)}
    chain = rnd.getrandbits(64)
    for k in range(40):  # each step two bits from the last
        values.add(chain)
        chain ^= 3 << (k % 31) * 2
    centre = rnd.getrandbits(64)
    values |= {centre ^ (1 << a) ^ (1 << b) for a in range(32) for b in range(8)}
    values |= {centre ^ (rnd.getrandbits(32) & rnd.getrandbits(32) & rnd.getrandbits(32)) for _ in range(200)}
    root = groups(values)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    rows = spark.createDataFrame([(signed(v),) for v in values], "fp long").repartition(4)
    for hot in (simhash.HOT_HEAD, 4):
        monkeypatch.setattr(simhash, "HOT_HEAD", hot)
        found = {r["fp"] & (1 << 64) - 1: r["root"] & (1 << 64) - 1 for r in simhash.classes(rows).collect()}
        assert len(found) == len(values)
        by_root, by_found = {}, {}
        for v in values:
            by_root.setdefault(root[v], set()).add(v)
            by_found.setdefault(found[v], set()).add(v)
        assert sorted(map(sorted, by_root.values())) == sorted(map(sorted, by_found.values()))


def test_odd_rows_and_tables(spark):
    docs = odd(spark, [(50, "THE quick\tbrown fox jumps  over the lazy dog near the river bank today.", None, None, None)])
    got = simhash.near_duplicates(spark, clashing(docs)).collect()
    assert sorted(tuple(map(str, r)) for r in got) == expected([(r["doc_id"], r["text"]) for r in docs.collect()])
    docs = table(spark, SF, "documents")
    got = simhash.near_duplicates(spark, docs).collect()
    assert sorted(tuple(map(str, r)) for r in got) == expected([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert simhash.near_duplicates(spark, empty(spark)).count() == 0


def test_one_of_each_group_stays(spark):
    docs = odd(spark)
    kept = simhash.deduplicated(spark, clashing(docs))
    assert kept.columns == clashing(docs).columns
    rows = kept.collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(["1", "3", "6", "7", "8", "9", "None"])
    assert next(r["text"] for r in rows if r["doc_id"] is None).startswith("Ohne")
    assert simhash.deduplicated(spark, empty(spark)).count() == 0
