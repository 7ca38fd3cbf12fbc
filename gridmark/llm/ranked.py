"""Ranked lexical search over bit-sliced Bloom signatures, with exact rescoring of all that is not provably excluded.

The index holds documents in blocks.  A block is a bit matrix, a row per signature slot and a column
per document: a term sets the slots of its keys, one key for every frequency level it reaches.  ANDing
the slots of a key therefore gives a bitmap of documents that holds every document with that term at
that level, and a few more.  A block also lists its vocabulary with document counts, which gives exact
weights and passes over terms that no document of the block has.  Level bitmaps are the slices of an upper bound of each document's score:
a document in a term's slice of level a but not in the next, b, is taken to hold the term b - 1 times.
Blocks hold documents of like size and have slots to match, so long documents fill theirs no more than
short ones.

A search makes two passes over the index.  The first takes the documents of highest bounds; their
exact scores give, for every item, a score that its results reach.  The second keeps every document
whose bound reaches it.  Those are scored from their texts, and ranked.  Items are taken in groups of
bounded size, each group against all blocks.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridmark.llm.frames import narrow
from gridmark.llm.words import LOWER, steps, windows
from gridmark.session import discard, store

#: Slots of a key, and slots a block has for every key of its largest document's size class.
HASHES, SLOTS_PER_KEY = 6, 16
#: Documents of a block, and bytes of its bit matrix unless eight documents need more.
BLOCK_DOCS, BLOCK_BYTES = 4096, 4 << 20
#: Frequency levels: exact up to 8, then four a doubling.
LEVELS = np.array([*range(1, 9)] + [x << i for i in range(1, 38) for x in (5, 6, 7, 8)], np.int64)
#: Rows of highest bound, for every wanted result, whose exact scores set what an item's results reach at least.
SEEDS = 3
#: Different (item, term) pairs that one group of items has on average; terms whose slices are read together.
GROUP_TERMS, TERM_STEP = 1 << 16, 1024

_TERM = np.zeros(256, bool)
_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_TERMS = rb"[0-9a-z\x80-\xff]+"
_BASE, _MASK = 0x9E3779B97F4A7C15 | 1, (1 << 64) - 1
_BLOCK = "documents int, terms long, slots long, rows binary, lengths binary, bits binary, vocabulary binary, frequencies binary"


# --- terms -----------------------------------------------------------------------------------

def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _Hasher:
    """64-bit hashes of many slices of a buffer at once: a polynomial in an odd base, by differences of running sums."""

    def __init__(self):
        self.powers = self.inverse = np.ones(1, np.uint64)

    def __call__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        n = len(data)
        if n + 1 > len(self.powers):
            size = max(n + 1, 1 << 16)
            self.powers, self.inverse = (np.cumprod(np.append(np.uint64(1), np.full(size - 1, b, np.uint64)), dtype=np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.powers[:n], out=total[1:])
        return _mixed((total[end] - total[start]) * self.inverse[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of all terms of the documents between ``offsets``."""
    n = len(data)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    inside = _TERM[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(inside & (edge[:-1] | np.append(True, ~inside[:-1])))
    end = np.flatnonzero(inside & (edge[1:] | np.append(~inside[1:], True))) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def term_counts(texts: pa.Array, hasher: _Hasher) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, cuts, hashes, counts) of runs of rows: row r's different terms are ``cuts[r]:cuts[r + 1]``; a long text goes window by window."""
    for lo, hi, data, offsets in steps(texts):
        data = LOWER[data]
        if hi - lo == 1:
            found: dict = {}
            marks = windows(data, _TERM)
            for a, b in zip(marks, marks[1:]):
                start, end, _ = _bounds(data[a:b], np.array([0, b - a]))
                part = np.unique(hasher(data[a:b], start, end), return_counts=True)
                found = {0: part} if not found else {0: _added(found[0], part)}
            h, n = found[0]
            yield lo, np.array([0, len(h)]), h, n
            continue
        start, end, doc = _bounds(data, offsets)
        h = hasher(data, start, end)
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        head = np.flatnonzero((np.diff(h, prepend=h[:1]) != 0) | (np.diff(doc, prepend=-1) != 0)) if len(h) else np.zeros(0, np.int64)
        yield lo, np.searchsorted(doc[head], np.arange(hi - lo + 1)), h[head], np.diff(np.append(head, len(h)))


def _added(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    h, at = np.unique(np.concatenate([one[0], two[0]]), return_inverse=True)
    return h, np.bincount(at, np.concatenate([one[1], two[1]]), minlength=len(h)).astype(np.int64)


def _slots(h: np.ndarray, level: int, slots: int) -> np.ndarray:
    """Slots (keys, HASHES) of terms at a level."""
    h = _mixed(h + np.uint64((level * 0xA24BAED4963EE407) & _MASK))
    low, step = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return ((low[:, None] + np.arange(HASHES, dtype=np.uint64) * step[:, None]) % np.uint64(slots)).astype(np.int64)


# --- index -----------------------------------------------------------------------------------

class _Block:
    """A bit matrix in the making."""

    def __init__(self, slots: int):
        self.slots = slots
        self.room = int(min(BLOCK_DOCS, max(8, 8 * BLOCK_BYTES // slots // 8 * 8)))
        self.bits = np.zeros((slots, self.room // 8), np.uint8)
        self.rows, self.lengths, self.seen = [], [], []

    def add(self, row: int, h: np.ndarray, n: np.ndarray) -> None:
        at, level = len(self.rows), 0
        self.seen.append(h)
        while len(h):
            self.bits[_slots(h, level, self.slots).ravel(), at >> 3] |= np.uint8(1 << (at & 7))
            level += 1
            more = n >= LEVELS[level]
            h, n = h[more], n[more]
        self.rows.append(row)

    def made(self) -> pa.RecordBatch:
        words, many = np.unique(np.concatenate(self.seen), return_counts=True)
        used = np.ascontiguousarray(self.bits[:, :(len(self.rows) + 7) // 8])
        raw = (np.array(self.rows, "<i8"), np.array(self.lengths, "<i8"), used, words.astype("<u8"), many.astype("<u4"))
        rows, lengths, bits, vocabulary, frequencies = (pa.array([x.tobytes()], pa.binary()) for x in raw)
        return pa.RecordBatch.from_arrays([pa.array([len(self.rows)], pa.int32()), pa.array([sum(self.lengths)], pa.int64()), pa.array([self.slots], pa.int64()),
                                           rows, lengths, bits, vocabulary, frequencies], _names(_BLOCK))


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _row(key: str, text: str):
    """A hash of a row's key and text; rows that share it are all scored."""
    return F.xxhash64(F.col(key), F.col(text))


def build_index(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The index as a written table, a row a block; documents without a term are not in it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, blocks = _Hasher(), {}
        for batch in batches:
            names = batch.column(0).to_numpy()
            for lo, cuts, h, n in term_counts(batch.column(1), hasher):
                # keys of a term: the levels it reaches
                keys = np.concatenate([[0], np.cumsum(np.searchsorted(LEVELS, n, "right"))])
                for r in range(len(cuts) - 1):
                    a, b = int(cuts[r]), int(cuts[r + 1])
                    if a == b:
                        continue
                    size = max(4, int(keys[b] - keys[a] - 1).bit_length())
                    if size not in blocks:
                        blocks[size] = _Block(SLOTS_PER_KEY << size)
                    block = blocks[size]
                    block.add(int(names[lo + r]), h[a:b], n[a:b])
                    block.lengths.append(int(n[a:b].sum()))
                    if len(block.rows) == block.room:
                        yield blocks.pop(size).made()
        for block in blocks.values():
            yield block.made()

    return store(docs.select(_row(key, text), F.col(text)).mapInArrow(run, _BLOCK), "signatures")


# --- items -----------------------------------------------------------------------------------

class _Asked:
    """A group of items: their terms, how often each item holds each, and, once counted, the terms' weights."""

    def __init__(self, rows: list):
        self.items = sorted({r.row for r in rows})
        number = {x: i for i, x in enumerate(self.items)}
        self.words = sorted({bytes(r.word) for r in rows})
        at = {w: i for i, w in enumerate(self.words)}
        pairs = sorted((number[r.row], at[bytes(r.word)], r.n) for r in rows)
        self.item, self.term, self.times = (np.array(c, np.int64) for c in zip(*pairs))
        hasher = _Hasher()
        self.hashes = np.concatenate([hasher(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)])) for w in self.words])

    def count(self, index: DataFrame, documents: int, terms: int) -> None:
        order = np.argsort(self.hashes)
        hashes = self.hashes[order]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(hashes), np.int64)
            for batch in batches:
                for words, many in zip(batch.column(0), batch.column(1)):
                    hit, at = _met(np.frombuffer(words.as_buffer(), "<u8"), hashes)
                    total[hit] += np.frombuffer(many.as_buffer(), "<u4")[at]
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(order[some].astype(np.int32)), pa.array(total[some])], ["t", "n"])

        found = index.select("vocabulary", "frequencies").mapInArrow(run, "t int, n long").groupBy("t").agg(F.sum("n").alias("n")).collect()
        many = dict((r.t, r.n) for r in found)  # at most the group's terms
        self.documents, self.all_terms = documents, terms
        self.weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * many.get(t, 0) + 1))) if t in many else 0 for t in range(len(self.words))], np.int64)

    def lengthening(self, n: np.ndarray) -> np.ndarray:
        return 25 + 75 * n * self.documents // self.all_terms


def _met(vocabulary: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which ``hashes`` a sorted vocabulary holds, and where."""
    at = np.searchsorted(vocabulary, hashes)
    hit = np.flatnonzero(at < len(vocabulary))
    hit = hit[vocabulary[at[hit]] == hashes[hit]]
    return hit, at[hit]


def _gain(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def bounds(asked: _Asked, slots: int, bits: np.ndarray, lengths: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """Upper bounds (items, documents) of the scores of a block's documents."""
    docs, known = len(lengths), _met(vocabulary, asked.hashes)[0]
    known = known[asked.weights[known] > 0]
    m = asked.lengthening(lengths)
    terms, columns, gains = [], [], []
    for s in range(0, len(known), TERM_STEP):
        t = known[s:s + TERM_STEP]
        slices, level, reach = None, 0, None
        rows = np.arange(len(t))
        while len(rows):
            at = _slots(asked.hashes[t[rows]], level, slots)
            new = np.bitwise_and.reduce(bits[at], axis=1)
            if slices is not None:
                new &= slices
            some = new.any(axis=1)
            rows, slices = rows[some], new[some]
            if level == 0:
                reach = np.zeros((len(t), docs), np.uint8)
            reach[rows] += np.unpackbits(slices, axis=1, bitorder="little")[:, :docs]
            level += 1
        row, col = np.nonzero(reach)
        tf = np.minimum(LEVELS[reach[row, col].astype(np.int64)] - 1, lengths[col])  # below the first level not reached
        terms.append(t[row])
        columns.append(col)
        gains.append(asked.weights[t[row]] * _gain(tf, m[col]))
    out = np.zeros((len(asked.items), docs), np.int64)
    if not terms:
        return out
    terms, columns, gains = map(np.concatenate, (terms, columns, gains))  # ascending in terms
    first = np.searchsorted(terms, np.arange(len(asked.words) + 1))
    for i, t, times in zip(asked.item.tolist(), asked.term.tolist(), asked.times.tolist()):
        a, b = first[t], first[t + 1]
        out[i, columns[a:b]] += gains[a:b] * times
    return out


def _search(index: DataFrame, asked: _Asked, k: int, least: np.ndarray | None) -> DataFrame:
    """``(row, item)``: of every item the ``k`` rows of highest bound in each task, or, given ``least``, all rows whose bound reaches it; with the bound."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3

        def made(item: np.ndarray, row: np.ndarray, bound: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(row), pa.array(item.astype(np.int32)), pa.array(bound)], ["row", "item", "bound"])

        for batch in batches:
            for r in range(batch.num_rows):
                slots = batch.column(0)[r].as_py()
                rows, lengths, words, bits = (np.frombuffer(c[r].as_buffer(), kind) for c, kind in zip(batch.columns[1:], ("<i8", "<i8", "<u8", np.uint8)))
                bound = bounds(asked, slots, bits.reshape(slots, -1), lengths, words)
                if least is not None:
                    item, col = np.nonzero(bound >= least[:, None])
                    yield made(item, rows[col], bound[item, col])
                    continue
                if bound.shape[1] > k:
                    edge = np.partition(bound, bound.shape[1] - k, axis=1)[:, -k]
                    item, col = np.nonzero((bound >= edge[:, None]) & (bound > 0))
                else:
                    item, col = np.nonzero(bound)
                held = [np.concatenate(x) for x in zip(held, (item, rows[col], bound[item, col]))]
                order = np.lexsort((held[1], -held[2], held[0]))
                held = [x[order] for x in held]
                top = np.arange(len(order)) - np.searchsorted(held[0], held[0]) < k
                held = [x[top] for x in held]
        if least is None:
            yield made(*held)

    return index.select("slots", "rows", "lengths", "vocabulary", "bits").mapInArrow(run, "row long, item int, bound long")


def _scored(docs: DataFrame, asked: _Asked, pairs: DataFrame, n_pairs: int, text: str, key: str) -> DataFrame:
    """``(item, key, score)``: exact scores of the pairs' rows of ``docs``, from their texts."""
    wanted = pairs.groupBy("row").agg(F.collect_set("item").alias("items"))
    wanted = narrow(wanted, n_pairs)
    chosen = docs.select(_row(key, text).alias("row"), F.col(key).alias("id"), F.col(text).alias("body")).join(wanted, "row").select("id", "items", "body")
    schema = docs.select(F.col(key).alias("id")).schema.add("item", "integer").add("score", "long")
    first = np.searchsorted(asked.item, np.arange(len(asked.items) + 1)).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, find = {w: i for i, w in enumerate(asked.words)}, re.compile(_TERMS).findall
        weights, term, times = asked.weights.tolist(), asked.term.tolist(), asked.times.tolist()
        for batch in batches:
            at, items, scores = [], [], []
            for r in range(batch.num_rows):
                data = LOWER[np.frombuffer(batch.column(2)[r].as_py().encode(), np.uint8)]
                n, held, marks = 0, Counter(), windows(data, _TERM)
                for a, b in zip(marks, marks[1:]):
                    words = find(data[a:b].tobytes())
                    n += len(words)
                    held.update(filter(number.__contains__, words))
                m = 25 + 75 * n * asked.documents // asked.all_terms
                gain = {number[w]: weights[number[w]] * (1_000_000_000 * tf // (1000 * tf + 8 * m)) for w, tf in held.items()}
                for i in batch.column(1)[r].as_py():
                    at.append(r)
                    items.append(i)
                    scores.append(sum(gain[term[x]] * times[x] for x in range(first[i], first[i + 1]) if term[x] in gain))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(items, pa.int32()), pa.array(scores, pa.int64())], ["id", "item", "score"])

    return chosen.mapInArrow(run, schema)


def _asked_terms(items: DataFrame, key: str, text: str) -> DataFrame:
    """``(row, word, n)``: terms of every item; ``row`` numbers items by hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(_TERMS).findall
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = Counter(find(LOWER[np.frombuffer((body or "").encode(), np.uint8)].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(words), pa.int64()), pa.array(list(words), pa.binary()), pa.array(list(words.values()), pa.int64())],
                                                 ["row", "word", "n"])

    return items.select("row", F.col(text)).mapInArrow(run, "row long, word binary, n long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
           index: DataFrame | None = None) -> DataFrame:
    """``(item, rank, key, score)``: of every item the ``k`` rows of ``docs`` of highest score above 0, all if there are fewer.

    Equal scores are ranked by key, null keys last.  A repeated document row is ranked each time; of
    rows that share an item id the one of smallest text is asked.  Null and empty texts have no terms:
    such documents score nothing, such items have no results.  A very long document is read window by
    window; of one item all different terms are held at once.  Terms' document counts are kept by 64-bit
    hashes: two of V different terms share one with a chance of V^2 / 2^65.
    """
    own = index is None
    index = build_index(docs, text, key) if own else index
    sizes = index.agg(F.sum("documents").alias("d"), F.sum("terms").alias("t")).first()
    once = store(items.groupBy(F.col(item).alias("item")).agg(F.min(item_text).alias(item_text)).withColumn("row", F.xxhash64(F.col("item"))), "asked-items")
    words = store(_asked_terms(once, "row", item_text), "asked-terms")
    shape = docs.select(F.lit(0).alias("row"), F.lit(0).alias("rank"), F.col(key).alias("id"), F.lit(0).cast("long").alias("score")).limit(0)
    groups, results = -(-words.count() // GROUP_TERMS), []
    for g in range(groups if sizes.d else 0):
        rows = words.filter(F.pmod("row", F.lit(groups)) == g).collect()
        if not rows:
            continue
        asked = _Asked(rows)
        asked.count(index, sizes.d, sizes.t)
        best = Window.partitionBy("item").orderBy(F.desc("bound"), "row")
        seeds = store(_search(index, asked, SEEDS * k, None).withColumn("r", F.row_number().over(best)).filter(F.col("r") <= SEEDS * k).select("row", "item"), "seeds")
        first = _scored(docs, asked, seeds, SEEDS * k * len(asked.items), text, key).filter("score > 0")
        ranked = first.withColumn("r", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score")))).filter(F.col("r") == k)
        least = np.ones(len(asked.items), np.int64)
        for r in ranked.select("item", "score").collect():  # one row an item of the group
            least[r.item] = r.score
        pairs = store(_search(index, asked, k, least).select("row", "item").distinct(), "not-excluded")
        exact = _scored(docs, asked, pairs, pairs.count(), text, key).filter("score > 0")
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
        top = exact.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        names = docs.sparkSession.createDataFrame(list(enumerate(asked.items)), "item int, row long")
        results.append(store(top.join(F.broadcast(names), "item").select("row", "rank", "id", "score"), "ranked"))
        discard(seeds)
        discard(pairs)
    found = results[0] if results else shape
    for more in results[1:]:
        found = found.unionByName(more)
    if own:
        discard(index)
    return found.join(once.select("row", F.col("item").alias(item)), "row").select(item, "rank", F.col("id").alias(key), "score")
