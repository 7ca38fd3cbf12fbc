"""Removal of long repeated spans by De Bruijn compaction.

Every window of ``length`` words is an edge of the token De Bruijn graph (its nodes are the windows
one word shorter).  Which edges repeat decides what goes, but a row per edge would be several times
the corpus, so the graph is never written out edge by edge:

1. Edges are dealt out by their anchor, the smallest hash of an ``anchor``-word gram inside the
   window.  Equal windows have equal anchors, wherever they stand.  Neighbouring edges of a document
   under one anchor form a nonbranching path; a path is one row (start, edges, anchor, hash of its text).
2. A count by anchor leaves the anchors met more than once.  Where all paths under such an anchor are
   equal, the path is compact as it stands and all its edges repeat.
3. Where paths under one anchor differ, the graph branches: equal paths are first counted together,
   and only one copy of each different path is opened into its edges, read again at its source
   coordinates; edges met twice repeat.
4. The repeated paths and edges of a document, and edges that repeat inside it, mark its words.

Each step is a grouping with partial sums or a join on (anchor, path) or on the document, so a
passage shared by a third of all documents is a counter and never a list.  Before a join that keeps few
rows of a large side, a sieve of bounded size lets most others stay where they are: texts of documents
without repeats are not shuffled.  Paths are compared by
128 bits (anchor hash and text hash), edges by a 128-bit hash of their text at the source.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridmark.llm.frames import narrow, sieve
from gridmark.llm.words import Words, steps
from gridmark.session import scratch, store

LENGTH = 35
ANCHOR = 8
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def _powers(n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """m ** i and m ** -i modulo 2 ** 64 for i < n."""
    out = []
    for x in (m, pow(m, -1, 1 << 64)):
        p = np.full(n, x, np.uint64)
        if n:
            p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _spans(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, m: int, powers: dict) -> np.ndarray:
    """Hash of values[lo:hi] for many spans at once, from one running sum."""
    n = len(values) + 1
    if len(powers.get(m, ((),))[0]) < n:
        powers[m] = _powers(max(n, 1 << 16), m)
    up, down = powers[m]
    sums = np.zeros(n, np.uint64)
    np.cumsum(values * up[:n - 1], out=sums[1:])
    return _mix((sums[hi] - sums[lo]) * down[lo])


def _sliding(pick: np.ufunc, h: np.ndarray, width: int) -> np.ndarray:
    """Minimum or maximum of every ``width`` neighbours."""
    done, step = h, 1
    while step * 2 <= width:
        done, step = pick(done[:-step], done[step:]), step * 2
    return pick(done[:len(h) - width + 1], done[width - step:]) if step < width else done


def _paths(w: Words, length: int, anchor: int, powers: dict):
    """Runs of windows under one anchor: (document, first word, windows, anchor), in order; and documents with inner repeats."""
    none = np.zeros(0, np.int64)
    n = len(w.start)
    if n < length:
        return none, none, none, none.view(np.uint64), none
    word = _spans(w.bytes.astype(np.uint64) + np.uint64(1), w.at, w.to, _MULTIPLIERS[0], powers)
    at = np.arange(n - anchor + 1)
    grams = _spans(word, at, at + anchor, _MULTIPLIERS[1], powers)
    width = length - anchor + 1
    low = _sliding(np.minimum, grams, width)
    inside = np.arange(len(low)) + length <= w.first[1:][w.doc[:len(low)]]
    window = np.flatnonzero(inside)
    if not len(window):
        return none, none, none, none.view(np.uint64), none
    # a gram is an anchor if some window over it has it as its minimum; equal windows of one document have equal anchors at two places
    edge = np.zeros(width - 1, np.uint64)
    place = np.flatnonzero(grams == _sliding(np.maximum, np.concatenate([edge, np.where(inside, low, 0), edge]), width))
    order = np.lexsort((grams[place], w.doc[place]))
    value, owner = grams[place][order], w.doc[place][order]
    inner = np.unique(owner[1:][(value[1:] == value[:-1]) & (owner[1:] == owner[:-1])])
    low, doc = low[window], w.doc[window]
    new = np.ones(len(window), bool)
    new[1:] = (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, len(window)))
    return doc[head], window[head], size, low[head], inner


def _paths_of(length: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        powers: dict = {}
        for batch in batches:
            for lo, hi, data, offsets in steps(batch.column(2)):
                w = Words(data, offsets)
                doc, start, size, low, inner = _paths(w, length, anchor, powers)
                text, digest = w.joined, xxhash.xxh3_64_intdigest
                seg = np.fromiter((digest(text[s:e]) for s, e in zip(w.at[start].tolist(), w.to[start + size + length - 2].tolist())),
                                  np.uint64, len(start))
                own = start - w.first[doc]
                bounds = np.searchsorted(doc, np.arange(hi - lo + 1)).astype(np.int32)
                items = pa.StructArray.from_arrays([pa.array(own.astype(np.int32)), pa.array(size.astype(np.int32)),
                                                    pa.array(low.view(np.int64)), pa.array(seg.view(np.int64))], ["start", "run", "anchor", "seg"])
                selfish = np.zeros(hi - lo, bool)
                selfish[inner] = True
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo),
                                                  pa.array(selfish), pa.ListArray.from_arrays(pa.array(bounds), items)], ["d", "k", "inner", "paths"])
    return run


def _open(length: int):
    """Edges of chosen paths: a 128-bit hash of the window's text, read at its place in the document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            chosen = batch.column(3)
            for lo, hi, data, offsets in steps(batch.column(2)):
                w = Words(data, offsets)
                rows, place, high, lower, n = [], [], [], [], []
                for i in range(lo, hi):
                    base = int(w.first[i - lo])
                    for c in chosen[i].as_py():
                        for s in range(c["start"], c["start"] + c["run"]):
                            h = xxhash.xxh3_128_intdigest(w.text(base + s, base + s + length - 1))
                            rows.append(i)
                            place.append(s)
                            high.append(h >> 64)
                            lower.append(h & 0xFFFFFFFFFFFFFFFF)
                            n.append(c["n"])
                take = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), pa.array(place, pa.int32()),
                     pa.array(np.array(high, np.uint64).view(np.int64)), pa.array(np.array(lower, np.uint64).view(np.int64)), pa.array(n, pa.int64())],
                    ["d", "k", "place", "w1", "w2", "n"])
    return run


def _named(docs: DataFrame, text: str, key: str, *more: Column) -> DataFrame:
    """``(d, k, body)`` and ``more``: a document is named by its key and 64 bits of key and text."""
    number = F.xxhash64(key) if dict(docs.dtypes)[key] != "bigint" else F.coalesce(F.col(key), F.lit(-1))
    name = F.xxhash64(F.coalesce(text, F.lit("")), F.col(key), F.col(key).isNull())
    return docs.select(number.alias("d"), name.alias("k"), F.col(text).alias("body"), *more)


def _sifted(df: DataFrame, small: DataFrame, key: str, *more: str) -> DataFrame:
    """Inner join on ``key``, a hash, and ``more``; rows that the sieve knows to meet none are not shuffled."""
    return sieve(df, small, key).filter("maybe").drop("maybe").join(small, [key, *more])


def repeated_paths(docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """``(d, k, inner, spots)``: per document with repeats the paths (start, run) whose windows repeat, all whole.

    ``inner`` marks documents in which some window may repeat inside the document; those are settled
    where the document is read.  The result is written; nothing else made here stays.
    """
    with scratch(docs.sparkSession) as keep:
        return keep(store(_repeated(_named(docs, text, key), length, anchor), "repeats"))


def _repeated(named: DataFrame, length: int, anchor: int) -> DataFrame:
    found = store(named.mapInArrow(_paths_of(length, anchor), "d long, k long, inner boolean, "
                                   "paths array<struct<start:int,run:int,anchor:long,seg:long>>"), "paths")
    flat = found.select("d", "k", F.explode("paths").alias("p")).select("d", "k", "p.start", "p.run", "p.anchor", "p.seg")
    met = (flat.groupBy("anchor").agg(F.count("*").alias("n"), F.min("seg").alias("s"), F.max("seg").alias("t"))
           .filter("n > 1").select("anchor", (F.col("s") != F.col("t")).alias("branches")))
    hits = store(_sifted(flat, store(met, "anchors"), "anchor"), "hits")
    settled = hits.filter("not branches").select("d", "k", "start", "run")
    forks = hits.filter("branches").drop("branches")
    copies = store(forks.groupBy("anchor", "seg").agg(F.count("*").alias("n"), F.min(F.struct("d", "k", "start", "run")).alias("p")), "forks")
    whole = forks.join(narrow(store(copies.filter("n > 1").select("anchor", "seg"), "whole")), ["anchor", "seg"]).select("d", "k", "start", "run")
    opened = store(copies.groupBy("p.d", "p.k").agg(F.collect_list(F.struct("p.start", "p.run", "n")).alias("chosen")), "opened")
    edges = store(_sifted(named, opened, "k", "d").select("d", "k", "body", "chosen")
                  .mapInArrow(_open(length), "d long, k long, place int, w1 long, w2 long, n long"), "edges")
    # a path of n = 1 stands in one row of one document; repeated rows make n > 1, so reading those twice adds nothing new
    twice = edges.groupBy("w1", "w2").agg(F.sum("n").alias("total"), F.min("n").alias("least")).filter("total > 1 and least = 1").select("w1", "w2")
    twice = store(twice, "twice")  # written, so that a join on an edge of very many paths can be split
    single = _sifted(edges.filter("n = 1"), twice, "w1", "w2").select("d", "k", F.col("place").alias("start"), F.lit(1).alias("run"))
    marks = settled.unionByName(whole).unionByName(single).groupBy("d", "k").agg(F.collect_set(F.struct("start", "run")).alias("spots"))
    own = found.filter("inner").select("d", "k", "inner").distinct()
    return marks.join(own, ["d", "k"], "full").select("d", "k", F.coalesce("inner", F.lit(False)).alias("inner"),
                                                     F.coalesce("spots", F.array().cast("array<struct<start:int,run:int>>")).alias("spots"))


def _removed(w: Words, doc: int, spots: list, inner: bool, length: int) -> np.ndarray:
    """Marks the words of one document that a repeated window covers."""
    n, base = int(w.count[doc]), int(w.first[doc])
    cover = np.zeros(n + 1, np.int64)
    for s in spots:
        cover[s["start"]] += 1
        cover[s["start"] + s["run"] + length - 1] -= 1
    if inner and n >= length:
        seen: dict[bytes, int] = {}
        for i in range(n - length + 1):
            h = hashlib.blake2b(w.text(base + i, base + i + length - 1), digest_size=16).digest()
            for j in {i, seen[h]} if h in seen else ():
                cover[j] += 1
                cover[j + length] -= 1
            seen.setdefault(h, i)
    return np.cumsum(cover[:n]) > 0


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH, anchor: int = ANCHOR,
                   marks: str = "repeats") -> DataFrame:
    """``docs`` with repeated words cut from ``text``, and a column ``marks``: struct (n_words, n_removed, kept_sha256, spans).

    A word goes if a window of ``length`` words that covers it starts anywhere else too, in the same
    document or another, judged on the input.  ``spans`` are the removed word ranges (from, to).  White
    space around kept words stays; a text without repeats stays byte for byte, null stays null and has
    no words.  Repeated rows repeat each other.  Other columns, also of clashing names, pass through.
    """
    rest = [c for c in docs.columns if c != text]
    inside = F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row")
    repeats = repeated_paths(docs, text, key, length, anchor)
    named = sieve(_named(docs, text, key, inside), repeats, "k")
    joined = named.filter("maybe").join(repeats, ["d", "k"], "left").select("row", "body", "inner", "spots")
    free = named.filter("not maybe").select("row", "body", *[F.lit(None).cast(joined.schema[c].dataType).alias(c) for c in ("inner", "spots")])
    joined = free.union(joined)
    schema = T.StructType([joined.schema["row"], T.StructField("body", T.StringType()), T.StructField("n_words", T.LongType()),
                           T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType()),
                           T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, inner, spots = batch.column(1), batch.column(2), batch.column(3)
            for lo, hi, data, offsets in steps(body):
                w = Words(data, offsets)
                texts, gone, digests, spans = [], [], [], []
                for i in range(lo, hi):
                    doc = i - lo
                    a, b = int(w.first[doc]), int(w.first[doc + 1])
                    marked = spots[i].as_py()
                    cut = _removed(w, doc, marked, inner[i].as_py(), length) if marked is not None else np.zeros(0, bool)
                    if not cut.any():
                        kept = w.text(a, b - 1) if b > a else b""
                        texts.append(body[i].as_py())
                        spans.append([])
                        gone.append(0)
                    else:
                        turn = np.flatnonzero(np.diff(np.concatenate([[0], cut.astype(np.int8), [0]])))
                        ranges = turn.reshape(-1, 2).tolist()
                        pieces, raw, at = [], [], int(offsets[doc])
                        done = 0
                        for s, e in [*ranges, [b - a, b - a]]:
                            if s > done:
                                pieces.append(w.text(a + done, a + s - 1))
                            stop = int(w.start[a + s]) if a + s < b else int(offsets[doc + 1])
                            raw.append(data[at:stop].tobytes())
                            at = int(w.start[a + e]) if a + e < b else int(w.end[b - 1])
                            at = stop if s == e else at
                            done = e
                        kept = b" ".join(pieces)
                        texts.append(b"".join(raw).decode("utf-8"))
                        spans.append(ranges)
                        gone.append(int(cut.sum()))
                    digests.append(hashlib.sha256(kept).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(texts, pa.string()), pa.array(w.count.astype(np.int64)), pa.array(gone, pa.int64()),
                     pa.array(digests, pa.string()), pa.array(spans, pa.list_(pa.list_(pa.int64())))],
                    ["row", "body", "n_words", "n_removed", "kept_sha256", "spans"])

    out = joined.mapInArrow(run, schema)
    return out.select(*[F.col("body").alias(text) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns],
                      F.struct("n_words", "n_removed", "kept_sha256", "spans").alias(marks))
