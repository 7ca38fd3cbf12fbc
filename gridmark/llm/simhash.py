"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint has 64 bits.  Cut into ``blocks`` blocks, two fingerprints that differ in at most
``max_bits`` bits agree on all bits of some ``blocks - max_bits`` blocks, so a join on every such
choice of blocks meets every close pair.  Equal fingerprints are one row before that join.  A join
key with many fingerprints is cut into chunks of bounded size and every pair of chunks is one small
group; a group yields a spanning forest of its close pairs, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmark.llm.words import LOWER, STEP_BYTES, Words, overlapping, steps
from gridmark.operators.components import contract
from gridmark.session import store

#: Fingerprints of one key that one group holds at most.
CHUNK = 1024
BITS = 64


def shingle_hashes(w: Words, shingle: int, seed: int, short: bool, digest) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles and the document of each; with ``short`` documents of fewer words are one shingle."""
    last = w.first[1:][w.doc] - 1
    index = np.arange(len(w.doc))
    begins = index + shingle - 1 <= last
    if short:
        begins |= index == w.first[:-1][w.doc]
    first = index[begins]
    final = np.minimum(first + shingle - 1, last[begins])
    whole = w.joined
    return np.fromiter((digest(whole[s:e], seed) for s, e in zip(w.at[first].tolist(), w.to[final].tolist())), np.uint64, len(first)), w.doc[first]


def ones(hashes: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """How many hashes of every run have each bit."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.add.reduceat(bits, heads, axis=0, dtype=np.int64)


def _fingerprints(data: np.ndarray, offsets: np.ndarray, shingle: int, seed: int) -> np.ndarray:
    import xxhash

    data, digest = LOWER[data], xxhash.xxh64_intdigest
    if len(offsets) == 2 and len(data) > STEP_BYTES:  # one long text, counted piece by piece
        total, many = np.zeros((1, BITS), np.int64), 0
        for w in overlapping(data, shingle):
            hashes, _ = shingle_hashes(w, shingle, seed, False, digest)
            if len(hashes):
                total += ones(hashes, np.zeros(1, np.int64))
                many += len(hashes)
        if many:
            return np.packbits(total * 2 > many, axis=1, bitorder="little").reshape(-1).view(np.uint64)
    w = Words(data, offsets)
    out = np.zeros(len(w.count), np.uint64)
    hashes, owner = shingle_hashes(w, shingle, seed, True, digest)
    if not len(hashes):
        return out
    docs, heads, sizes = np.unique(owner, return_index=True, return_counts=True)
    out[docs] = np.packbits(ones(hashes, heads) * 2 > sizes[:, None], axis=1, bitorder="little").reshape(-1).view(np.uint64)
    return out


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 3, seed: int = 42) -> DataFrame:
    """``(key, fp long)`` of every row: majority bit of XXH64 over ``shingle``-word shingles, repeats included.

    Words are ``[^ \\t-\\r]+`` after lower-casing A-Z.  Fewer words than a shingle: the whole
    sequence is one.  No word, an empty or a null text: 0.  A very long text is counted in pieces.
    """
    schema = docs.select(key).schema.add("fp", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [_fingerprints(data, offsets, shingle, seed) for _, _, data, offsets in steps(batch.column(1))]
            fp = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], [key, "fp"])

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, schema)


def _masks(blocks: int, max_bits: int) -> list[int]:
    cuts = [round(i * BITS / blocks) for i in range(blocks + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    full = [sum(c) for c in combinations(block, blocks - max_bits)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in full]


def _forest(fp: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Edges that connect what the close pairs of one bounded group connect."""
    todo = np.ones(len(fp), bool)
    out = []
    for seed in range(len(fp)):
        if not todo[seed]:
            continue
        todo[seed] = False
        queue = [seed]
        while queue:
            at = queue.pop()
            near = np.flatnonzero(todo & (np.bitwise_count(fp ^ fp[at]) <= max_bits))
            todo[near] = False
            out += [(at, x) for x in near.tolist()]
            queue += near.tolist()
    return out


def _group_edges(table: pa.Table, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges within every group (equal c, v, a, b) of rows sorted by group."""
    cols = [table.column(c).to_numpy() for c in ("c", "v", "a", "b")]
    fp = table.column("fp").to_numpy().view(np.uint64)
    new = np.ones(len(fp), bool)
    if len(fp):
        new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in cols])
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, len(fp)))
    two = starts[sizes == 2]
    two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= max_bits]
    left, right = [fp[two]], [fp[two + 1]]
    for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
        part = fp[s:s + n]
        edges = np.array(_forest(part, max_bits), np.int64).reshape(-1, 2)
        left.append(part[edges[:, 0]])
        right.append(part[edges[:, 1]])
    x, y = np.concatenate(left).view(np.int64), np.concatenate(right).view(np.int64)
    return np.maximum(x, y), np.minimum(x, y)


def close_edges(fps: DataFrame, max_bits: int = 3, blocks: int = 5) -> DataFrame:
    """Edges ``(a, b)``, a > b, that connect the distinct ``fp`` values as all pairs within ``max_bits`` do."""
    keys = [F.struct(F.lit(i).cast("tinyint").alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("v"))
            for i, m in enumerate(_masks(blocks, max_bits))]
    rows = fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.c", "k.v")
    crowded = rows.groupBy("c", "v").agg(F.count("*").alias("n")).filter("n > 1")
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    mine = F.pmod(F.xxhash64("fp"), chunks).cast("int")
    spread = (rows.join(crowded, ["c", "v"]).select("c", "v", "fp", mine.alias("mine"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("other"))
              .select("c", "v", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"), "fp"))
    spread = spread.repartition("c", "v", "a", "b").sortWithinPartitions("c", "v", "a", "b", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            if not len(table):
                continue
            tail = np.logical_and.reduce([table.column(c).to_numpy() == table.column(c)[-1].as_py() for c in ("c", "v", "a", "b")])
            keep = int(np.argmax(tail))
            rest = table.slice(keep).combine_chunks()
            a, b = _group_edges(table.slice(0, keep), max_bits)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
        if rest is not None:
            a, b = _group_edges(rest, max_bits)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return spread.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 3, max_bits: int = 3,
                    blocks: int = 5) -> DataFrame:
    """``(key, fp, component_id)`` per row; component_id is the smallest key reachable over close fingerprints.

    A null key has a fingerprint and a component, but names none: a component of null keys only has
    component_id null.  Repeated rows stay repeated.  An empty table gives an empty one.
    """
    marked = store(fingerprints(docs, text, key, shingle), "simhash")
    by_fp = store(marked.groupBy("fp").agg(F.min(key).alias("low")), "simhash-fp")
    nodes = contract(close_edges(by_fp.select("fp"), max_bits, blocks), ())
    placed = by_fp.join(nodes.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lows = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    named = placed.join(lows, "root").select("fp", "component_id")
    return marked.join(named, "fp").select(key, "fp", "component_id")
