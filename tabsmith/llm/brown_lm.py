"""Class-based n-gram scoring: exchange clustering of words into Brown classes.

The probability of a word after another is that of its class after the
other's class, times that of the word within its class. Classes come from exchange
clustering: every word moves to the class that raises the mutual information of
neighbouring classes most, in sweeps. First items are clustered in the driver: the
``WORDS`` most frequent words and, for all others, the ``ENDINGS`` most frequent
word endings (four bytes); what is left is one item. Then every other word that was
counted is clustered by its own neighbours, all words at once, in rounds of
Spark jobs (``clustered``); it starts from the class of its ending, which only words never
seen keep. Beside its neighbours a word is known by its own class if it is one of the
TOP, else by that of its ending. Transitions are interpolated with class frequencies; within a
class, counts are discounted and what is taken off is the share of unseen words.

Spark counts all words, all pairs of items and all neighbours of all training texts, each task
its own rows first. Only bounded tables are collected or broadcast: TOP words,
the item pairs (at most items squared) and the class tables. Counts and classes of all other
words meet the texts by a join: rows are dealt into buckets, each bucket's
words are looked up in the vocabulary by a shuffle on the word, and a task
scores one bucket of texts with that bucket's own part of the vocabulary.

Cases: null and empty texts are one end token; without training texts both
scores follow the empty counts (class score as the base); repeated rows stay
and count as often as they occur; rows are dealt out by their place, whatever
their ids; an empty table gives an empty table; other columns are kept where named
and never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tabsmith.llm.common import LOWER, Hashed, byte_set, input_bytes, steps, stored, text_bytes, word_hashes, words_of

#: Most frequent words whose counts every task holds, and those that are items.
TOP, WORDS, ENDINGS = 50_000, 1_500, 500
CLASSES, SWEEPS = 96, 6
#: Rounds over the whole vocabulary, and what is added to every count that their gains compare.
ROUNDS, SEEN = 2, 0.5
#: Weight of class frequencies in the transitions.
PRIOR = 50.0
BUCKET_BYTES = 8 << 20
#: Words that a counting task holds before it hands them on.
HELD = 2_000_000

# Bytes of a word: all but ASCII white space.
WORD = byte_set(bytes(b for b in range(256) if b != 0x20 and not 0x09 <= b <= 0x0D))


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hash, ending, words a text) of lower-cased text bytes."""
    start, end, doc = words_of(data, WORD, offsets)
    ending = np.zeros(len(start), np.int64)
    for k in range(1, 5):
        inside = end - k >= start
        ending |= np.where(inside, data[np.maximum(end - k, 0)].astype(np.int64), 0) << (8 * (k - 1))
    return word_hashes(data, start, end), ending, np.bincount(doc, minlength=len(offsets) - 1)


def _texts(batch_column):
    data, offsets = text_bytes(batch_column)
    for i, j in steps(offsets):
        at = offsets[i:j + 1]
        yield i, j, LOWER[data[at[0]:at[-1]]], at - at[0]


def vocabulary(texts: DataFrame) -> DataFrame:
    """(h, ending, n): every word of ``text`` with its count."""
    def run(batches):
        parts, held = [], 0
        for batch in batches:
            for _, _, data, offsets in _texts(batch.column(0)):
                h, ending, _ = tokens(data, offsets)
                parts.append(_grouped(h, ending, np.ones(len(h), np.int64)))
                held += len(parts[-1][0])
                if held > HELD:
                    parts = [_grouped(*(np.concatenate(x) for x in zip(*parts)))]
                    held = len(parts[0][0])
                    if held > HELD // 2:
                        yield _counted(parts[0])
                        parts, held = [], 0
        if parts:
            yield _counted(_grouped(*(np.concatenate(x) for x in zip(*parts))))

    return texts.mapInArrow(run, "h long, ending long, n long").groupBy("h").agg(F.min("ending").alias("ending"), F.sum("n").alias("n"))


def _grouped(h, ending, n):
    order = np.argsort(h, kind="stable")
    h, ending, n = h[order], ending[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
    return h[first], ending[first], np.add.reduceat(n, first) if len(h) else n


def _counted(part):
    h, ending, n = part
    return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(ending), pa.array(n)], names=["h", "ending", "n"])


class Items:
    """Word -> item: 0 is the end of a text, 1 what no list names."""

    def __init__(self, words: np.ndarray, endings: np.ndarray):
        self.words = Hashed(words, np.arange(len(words), dtype=np.int64) + 2, 16)
        self.endings = Hashed(endings.astype(np.uint64), np.arange(len(endings), dtype=np.int64) + 2 + len(words), 12)
        self.n = 2 + len(words) + len(endings)

    def of(self, h: np.ndarray, ending: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), np.int64)
        at = self.words.find(h)
        known = at >= 0
        out[known] = self.words.rows[at[known]]
        rest = np.flatnonzero(~known)
        at = self.endings.find(ending[rest].astype(np.uint64))
        out[rest[at >= 0]] = self.endings.rows[at[at >= 0]]
        return out


def _sequence(values: np.ndarray, counts: np.ndarray, end: int) -> np.ndarray:
    """The values of all texts, each followed by ``end``."""
    at = np.cumsum(counts + 1)
    out = np.full(int(at[-1]) if len(at) else 0, end, values.dtype)
    inside = np.ones(len(out), bool)
    inside[at - 1] = False
    out[inside] = values
    return out


def pair_counts(texts: DataFrame, items: Items) -> np.ndarray:
    """Matrix of neighbouring items over all texts; a text begins after an end."""
    sent = texts.sparkSession.sparkContext.broadcast(items)

    def run(batches):
        n = sent.value.n
        total = np.zeros(n * n, np.int32)
        for batch in batches:
            for _, _, data, offsets in _texts(batch.column(0)):
                h, ending, counts = tokens(data, offsets)
                row = _sequence(sent.value.of(h, ending), counts, 0)
                if len(row):
                    before = np.concatenate(([0], row[:-1]))
                    pair, many = np.unique(before * n + row, return_counts=True)
                    total[pair] += many.astype(np.int32)
        pair = np.flatnonzero(total)
        for i in range(0, len(pair), 1 << 18):
            part = pair[i:i + (1 << 18)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part].astype(np.int64))], names=["pair", "n"])

    got = texts.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(items.n * items.n)
    out[got.column("pair").to_numpy()] = got.column("n").to_numpy()
    return out.reshape(items.n, items.n)


def exchange(pairs: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each item. Class 0 is the end's alone; the others begin by
    frequency, and each item in turn moves to where the mutual information of
    neighbouring classes is highest."""
    n = len(pairs)
    c = min(classes, max(n, 2))
    weight = pairs.sum(axis=0)
    order = np.concatenate(([0], 1 + np.argsort(-weight[1:], kind="stable")))
    own = np.zeros(n, np.int64)
    own[order[1:]] = 1 + np.arange(n - 1) % (c - 1)
    one = np.zeros((n, c))
    one[np.arange(n), own] = 1
    after, before = pairs @ one, pairs.T @ one  # item -> classes that follow, that precede
    table = one.T @ after
    f = lambda x: x * np.log(np.maximum(x, 1e-300))
    for _ in range(sweeps):
        moved = 0
        for w in order[1:]:
            g, out, into, self_ = own[w], after[w].copy(), before[w].copy(), pairs[w, w]
            if not weight[w]:
                continue
            table[g, :] -= out
            table[:, g] -= into
            table[g, g] += self_
            # the item's own pairs with its class, seen from outside
            out[g] -= self_
            into[g] -= self_
            rows, cols, diagonal = table.sum(axis=1), table.sum(axis=0), np.diag(table)
            gain = (f(table + out) - f(table)).sum(axis=1) + (f(table + into[:, None]) - f(table)).sum(axis=0)
            gain += f(diagonal + out + into + self_) - f(diagonal + out) - f(diagonal + into) + f(diagonal)
            gain -= f(rows + out.sum() + self_) - f(rows) + f(cols + into.sum() + self_) - f(cols)
            gain[0] = -np.inf
            best = int(gain.argmax())
            if gain[best] <= gain[g] + 1e-9:
                best = g
            out[g] += self_
            into[g] += self_
            if best != g:
                moved += 1
                own[w] = best
                after[:, g] -= pairs[:, w]
                after[:, best] += pairs[:, w]
                before[:, g] -= pairs[w, :]
                before[:, best] += pairs[w, :]
                out, into = after[w], before[w]
            table[best, :] += out
            table[:, best] += into
            table[best, best] -= self_
        if not moved:
            break
    return own


# ------------------------------------------------------- the whole vocabulary ---

class Codes:
    """Neighbours in two bytes: the items, then the TOP words that are no items."""

    def __init__(self, items: Items, h: np.ndarray, words: int):
        self.items, self.words = items, words       # codes 2 to 2 + words are words of their own
        self.more = Hashed(h[words:], np.arange(max(0, len(h) - words), dtype=np.int64) + items.n, 16)
        self.n = items.n + max(0, len(h) - words)

    def own(self, h: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Code of a word: its own if it has one, else its item's."""
        at = self.more.find(h)
        return np.where(at >= 0, self.more.rows[at] if len(self.more.rows) else item, item)

    def single(self, code: np.ndarray) -> np.ndarray:
        """Whether a code is the end or a word among the items."""
        return (code == 0) | ((code >= 2) & (code < 2 + self.words))


def neighbours(texts: DataFrame, codes: Codes) -> DataFrame:
    """(h, item, near): every word that is no item with its ending's item and, for
    each time it occurs, the codes before and after it, two bytes each."""
    sent = texts.sparkSession.sparkContext.broadcast(codes)

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            for _, _, data, offsets in _texts(batch.column(0)):
                h, ending, counts = tokens(data, offsets)
                item = sent.value.items.of(h, ending)
                row = _sequence(sent.value.own(h, item), counts, 0)
                word = np.ones(len(row), bool)
                word[np.cumsum(counts + 1) - 1] = False
                at = np.flatnonzero(word)[~sent.value.single(item)]
                near = np.stack([np.where(at > 0, row[at - 1], 0), row[at + 1]], axis=1).astype("<u2")
                rare = ~sent.value.single(item)
                parts.append((h[rare], item[rare].astype(np.int32), near))
                held += len(at)
                if held > HELD:
                    yield _near(parts)
                    parts, held = [], 0
        if held:
            yield _near(parts)

    def joined(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            h = table.column("h").to_numpy()
            last = int(np.searchsorted(h, h[-1], "left")) if len(h) else 0     # the last word may go on in the next batch
            if last:
                yield _merged(table.slice(0, last))
            held = table.slice(last)
        if held is not None and held.num_rows:
            yield _merged(held)

    schema = "h long, item int, near binary"
    return texts.mapInArrow(run, schema).repartition("h").sortWithinPartitions("h").mapInArrow(joined, schema)


def _near(parts) -> pa.RecordBatch:
    h, item, near = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(h, kind="stable")
    h, item, near = h[order], item[order], near[order]
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    return _rows(h[first].view(np.int64), item[first], 4 * np.append(first, len(h)), near)


def _rows(h, item, offsets, near) -> pa.RecordBatch:
    held = pa.Array.from_buffers(pa.binary(), len(h), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(near))])
    return pa.RecordBatch.from_arrays([pa.array(h), pa.array(item), held], names=["h", "item", "near"])


def _unpacked(column) -> tuple[np.ndarray, np.ndarray]:
    """(neighbours of all rows, where each row's begin and the last one's end)."""
    column = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).cast(pa.binary())
    if not len(column):
        return np.zeros((0, 2), "<u2"), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    near = np.frombuffer(column.buffers()[2], "<u2", int(offsets[-1] - offsets[0]) // 2, int(offsets[0])) if offsets[-1] > offsets[0] else np.zeros(0, "<u2")
    return near.reshape(-1, 2), (offsets - offsets[0]) // 4


def _merged(table: pa.Table) -> pa.RecordBatch:
    h, item = table.column("h").to_numpy(), table.column("item").to_numpy()
    near, at = _unpacked(table.column("near"))
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    return _rows(h[first], item[first], 4 * np.append(at[first], at[-1]), near)


def _f(x):
    return x * np.log(np.maximum(x, 1e-300))


def information(table: np.ndarray) -> float:
    """Mutual information of the two sides, times the count, but for a constant."""
    return float(_f(table).sum() - _f(table.sum(axis=0)).sum() - _f(table.sum(axis=1)).sum())


class Round:
    """What a round holds fixed: the class of each code, and how often a class stands
    before (``before[k, c]``) and after (``after[k, c]``) the words of a class."""

    def __init__(self, seen: np.ndarray, before: np.ndarray, after: np.ndarray):
        self.seen, self.sides, self.size = seen, (before, after), before.sum(axis=0)
        self.shares = [np.log(side + SEEN) - np.log(self.size + SEEN * len(side)) for side in self.sides]

    @property
    def value(self) -> float:
        return sum(map(information, self.sides))

    def moved(self, own: np.ndarray, near: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The class of highest gain of each word, taken out of its own first. All words
        move at once, so a class gains by what it is, not by what a newcomer makes of it
        (the gain of first order); none moves to an empty one."""
        out = own.copy()
        for i in range(0, len(own), 4096):
            j = min(i + 4096, len(own))
            out[i:j] = self._moved(own[i:j], near[at[i]:at[j]], np.diff(at[i:j + 1]))
        return out

    def _moved(self, own, near, n):
        rows, k = len(own), len(self.size)
        word, alone, gain, mine = np.repeat(np.arange(rows), n), np.arange(rows), 0.0, 0.0
        for s, (side, share) in enumerate(zip(self.sides, self.shares)):
            many = np.bincount(word * k + self.seen[near[:, s]], minlength=rows * k).reshape(rows, k)
            gain = gain + many @ share
            r, c = np.nonzero(many)
            x = many[r, c]
            rest = np.bincount(r, x * np.log(np.maximum(side[c, own[r]] - x, 0) + SEEN), rows)
            mine = mine + rest - n * np.log(np.maximum(self.size[own] - n, 0) + SEEN * k)
        gain[alone, own] = mine
        gain[:, (self.size == 0) | (np.arange(k) == 0)] = -np.inf
        best = gain.argmax(axis=1)
        return np.where(gain[alone, best] > mine + 1e-9, best, own)


def clustered(near: DataFrame, codes: Codes, own: np.ndarray, pairs: np.ndarray, rounds: int | None = None) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """((h, n, class) of every word of ``near``, class of each code, transitions).

    In a round every word chooses its class by the class tables as they were before; a
    word's class follows from the tables of all rounds, so no round writes the vocabulary.
    A round that does not raise the information is not taken."""
    sc = near.sparkSession.sparkContext
    k = int(own.max()) + 1
    seen = np.concatenate((own, own[1] * np.ones(codes.n - codes.items.n, np.int64)))

    def classes(batch, done):
        h, item = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
        got, at = _unpacked(batch.column(2))
        out = own[item]
        for r in done:
            out = r.moved(out, got, at)
        return h, item, got, at, out

    def known(done):
        """Classes of the words that have codes of their own."""
        sent = sc.broadcast((codes, done))

        def run(batches):
            codes, done = sent.value
            for batch in batches:
                some = pa.array(codes.more.find(batch.column(0).to_numpy().view(np.uint64)) >= 0)
                batch = batch.filter(some)
                if batch.num_rows:
                    h, item, _, _, c = classes(batch, done)
                    yield pa.RecordBatch.from_arrays([pa.array(codes.own(h, item)), pa.array(c)], names=["code", "class"])
        got = near.mapInArrow(run, "code long, class long").toArrow()
        out = seen.copy()
        out[got.column("code").to_numpy()] = got.column("class").to_numpy()
        return out

    def tables(seen, done):
        sent = sc.broadcast((codes, done, seen))

        def run(batches):
            codes, done, seen = sent.value
            total = np.zeros(2 * k * k, np.int64)
            count = lambda side, a, b: np.add(total, np.bincount((side * k + a) * k + b, minlength=len(total)), out=total)
            for batch in batches:
                h, item, got, at, c = classes(batch, done)
                n = np.diff(at)
                c, mine = np.repeat(c, n), np.repeat(seen[codes.own(h, item)], n)
                first, last = codes.single(got[:, 0]), codes.single(got[:, 1])
                # a pair of neighbours counts with the word's class on one side, the class it is known by on the other
                count(0, seen[got[:, 0]], c)
                count(0, mine[last], seen[got[last, 1]])
                count(1, seen[got[:, 1]], c)
                count(1, mine[first], seen[got[first, 0]])
            cell = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total[cell])], names=["cell", "n"])
        got = near.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
        out = np.zeros(2 * k * k)
        out[got.column("cell").to_numpy()] = got.column("n").to_numpy()
        # pairs of the end and the words among the items
        whole = codes.single(np.arange(codes.items.n))
        one = np.eye(k)[own] * whole[:, None]
        among = one.T @ pairs @ one
        before, after = out.reshape(2, k, k)
        return before + among, after + among.T

    done: list[Round] = []
    seen = known(done)
    now = Round(seen, *tables(seen, done))
    for _ in range(ROUNDS if rounds is None else rounds):
        tried = [*done, now]
        s = known(tried)
        then = Round(s, *tables(s, tried))
        if then.value <= now.value:
            break
        done, now = tried, then
    sent = sc.broadcast(done)

    def final(batches):
        for batch in batches:
            _, _, _, at, c = classes(batch, sent.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at)), pa.array(c)], names=["h", "n", "class"])
    return near.mapInArrow(final, "h long, n long, class long"), now.seen, now.sides[0]


class Model:
    """Everything of bounded size: items, classes, transitions, class sizes, frequent
    words. ``table`` counts the pairs of classes (default: those of the items),
    ``top_own`` has the classes of the frequent words (default: those of their items)."""

    def __init__(self, items, own, pairs, sizes, total, distinct, ends, top, table=None, top_own=None):
        self.items, self.own, self.total, self.distinct, self.ends, self.top = items, own, total, distinct, ends, top
        self.top_own = top_own
        k = int(own.max()) + 1
        if table is None:
            one = np.zeros((len(own), k))
            one[np.arange(len(own)), own] = 1
            table = one.T @ pairs @ one
        share = (table.sum(axis=0) + 1) / (table.sum() + k)
        self.step = np.log10((table + PRIOR * share) / (table.sum(axis=1, keepdims=True) + PRIOR))
        many, types, once, twice = sizes
        cut = np.where((once > 0) & (twice > 0), once / np.maximum(once + 2 * twice, 1), 0.5)
        self.cut, self.many = cut, np.maximum(many, 1)
        # a class none of whose words was seen leaves all to unseen ones
        self.unseen = np.log10(np.where(types > 0, cut * types / self.many, 1.0))

    def scores(self, data, offsets, h_known, n_known, own_known):
        """(tokens, known tokens, base score, score) of each text; the given
        words, counts and classes are those beyond the frequent ones."""
        h, ending, counts = tokens(data, offsets)
        n = np.zeros(len(h), np.int64)
        at = self.top.find(h)
        frequent = at >= 0
        n[frequent] = self.top.rows[at[frequent]]
        rest = np.flatnonzero(~frequent)
        seen = self.own[self.items.of(h, ending)]       # what the word after it knows
        if self.top_own is not None:
            seen[frequent] = self.top_own[at[frequent]]
        own = seen.copy()
        if len(h_known) and len(rest):
            spot = np.minimum(np.searchsorted(h_known, h[rest]), len(h_known) - 1)
            there = h_known[spot] == h[rest]
            n[rest] = np.where(there, n_known[spot], 0)
            own[rest[there]] = own_known[spot[there]]
        word = np.where(n > 0, np.log10(np.maximum(n - self.cut[own], 1e-9) / self.many[own]), self.unseen[own])
        own, n, word, seen = _sequence(own, counts, 0), _sequence(n, counts, self.ends), _sequence(word, counts, 0), _sequence(seen, counts, 0)
        ends = np.cumsum(counts + 1)
        starts = ends - counts - 1
        base = np.log10((n + 0.5) / (self.total + 0.5 * (self.distinct + 1)))
        if self.total:
            model = self.step[np.concatenate(([0], seen[:-1])), own] + word
        else:
            model = base
        if not len(starts):
            return (np.zeros(0, np.int64),) * 2 + (np.zeros(0),) * 2
        add = lambda x: np.add.reduceat(x, starts)
        return counts + 1, add((n > 0).astype(np.int64)), add(base), add(model)


def fit(docs: DataFrame, train: Column, text: str = "text") -> tuple[Model, DataFrame]:
    """(model, vocabulary beyond the frequent words: h, n, class) from the rows for which ``train`` holds."""
    rows = docs.where(train).select(F.col(f"`{text}`").cast("string").alias("text"))
    vocab = stored(vocabulary(rows), "vocabulary")
    total, distinct = vocab.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    ends = rows.count()
    top = vocab.orderBy(F.desc("n"), "h").limit(TOP).toArrow()
    h, n = top.column("h").to_numpy().view(np.uint64), top.column("n").to_numpy()
    least = F.lit(int(n[-1]) if len(n) else 0)
    last = F.lit(int(h[-1].view(np.int64)) if len(h) else 0)
    common = int(n[WORDS - 1]) if len(n) >= WORDS else 0
    # endings count the words that are no items themselves; of equal counts at the border some may be both
    endings = vocab.where(F.col("n") <= common).groupBy("ending").agg(F.sum("n").alias("n")) \
        .orderBy(F.desc("n"), "ending").limit(ENDINGS).toArrow()
    items = Items(h[:WORDS], endings.column("ending").to_numpy())
    pairs = pair_counts(rows, items)
    own = exchange(pairs)
    codes = Codes(items, h, len(h[:WORDS]))
    # every other word is clustered by its own neighbours
    classes, seen, table = clustered(stored(neighbours(rows, codes), "neighbours", "zstd"), codes, own, pairs)
    classes = stored(classes, "classes")
    sizes = classes.groupBy("class").agg(
        F.sum("n").alias("many"), F.count("*").alias("types"), F.sum((F.col("n") == 1).cast("long")).alias("once"),
        F.sum((F.col("n") == 2).cast("long")).alias("twice")).collect()
    by_class = np.zeros((4, int(own.max()) + 1))
    for r in sizes:
        by_class[:, r["class"]] = r["many"], r["types"], r["once"], r["twice"]
    among = own[2:2 + len(h[:WORDS])]
    for row, x in zip(by_class, (n[:WORDS], 1, n[:WORDS] == 1, n[:WORDS] == 2)):
        np.add.at(row, among, x)
    top_own = np.concatenate((among, seen[items.n:]))
    model = Model(items, own, pairs, by_class, total + ends, distinct + (ends > 0), ends, Hashed(h, n, 16), table, Hashed(h, top_own, 16).rows)
    rest = classes.where((F.col("n") < least) | ((F.col("n") == least) & (F.col("h") > last)))
    return model, rest


def scored(spark: SparkSession, docs: DataFrame, model: Model, rest: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns, n_tokens, n_known, train_tokens, base_score, score,
    perplexity (10 to the mean negative log10 probability a token)."""
    names = [f"c{k}" for k in range(len(keep))]
    buckets = max(1, input_bytes(docs) // BUCKET_BYTES)
    bucket = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(buckets)).cast("int")
    # by the row's place, so no id or text is hot; written first, since both sides of the join must deal alike
    rows = stored(docs.select(bucket.alias("bucket"), *[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)],
                              F.col(f"`{text}`").cast("string").alias("text")), "texts", "zstd")
    sent = spark.sparkContext.broadcast(model)

    def needs(batches):
        for batch in batches:
            dealt = batch.column(0).to_numpy()
            for i, j, data, offsets in _texts(batch.column(1)):
                h, _, counts = tokens(data, offsets)
                b = np.repeat(dealt[i:j], counts)
                rare = sent.value.top.find(h) < 0
                h, b = h[rare], b[rare]
                order = np.lexsort((h, b))
                h, b = h[order], b[order]
                first = np.concatenate(([True], (h[1:] != h[:-1]) | (b[1:] != b[:-1]))) if len(h) else np.zeros(0, bool)
                yield pa.RecordBatch.from_arrays([pa.array(b[first].astype(np.int32)), pa.array(h[first].view(np.int64))], names=["bucket", "h"])

    wanted = rows.select("bucket", "text").mapInArrow(needs, "bucket int, h long").join(rest, "h").select("bucket", "h", "n", F.col("class").cast("short").alias("class"))
    fields = [T.StructField(n, docs.schema[c].dataType) for n, c in zip(names, keep)]
    fields += [T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")]
    fields += [T.StructField(c, T.DoubleType()) for c in ("base_score", "score", "perplexity")]
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in fields])

    def score(texts: pa.Table, words: pa.Table) -> pa.Table:
        m = sent.value
        h, first = np.unique(words.column("h").to_numpy().view(np.uint64), return_index=True)
        n, own = (words.column(c).to_numpy()[first] for c in ("n", "class"))
        out = []
        for batch in texts.to_batches():
            for i, j, data, offsets in _texts(batch.column(len(keep) + 1)):
                many, known, base, value = m.scores(data, offsets, h, n, own)
                out.append(pa.RecordBatch.from_arrays(
                    [*(batch.column(k + 1).slice(i, j - i) for k in range(len(keep))), pa.array(many.astype(np.int64)), pa.array(known),
                     pa.array(np.full(j - i, m.total, np.int64)), pa.array(base), pa.array(value),
                     pa.array(10 ** np.minimum(-value / many, 300))], schema=arrow))
        return pa.Table.from_batches(out, arrow)

    return rows.groupBy("bucket").cogroup(wanted.groupBy("bucket")).applyInArrow(score, T.StructType(fields)) \
        .toDF(*keep, "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
