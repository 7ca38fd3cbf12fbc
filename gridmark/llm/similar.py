"""Groups of documents whose five-word shingles are alike: SimHash and min-hash candidates, every link checked on the shingles.

A document is the set of its shingle hashes; equal sets are one node.  Sets whose SimHash fingerprints are
connected by three or fewer differing bits, found by the pigeonhole blocks of :mod:`gridmark.llm.simhash`,
are one bucket; as few pairs of similarity 0.8 are that close, sets that agree in some band of minima are
another.  Each bucket first checks its members against its smallest one, which is linear
in the bucket and settles groups of copies.  Buckets that this leaves in several components are then
compared member by member in chunks.  A pair of similarity s is a candidate with probability
1 - (1 - s^5)^20 by the bands, 0.9996 at 0.8, if the minima were independent; what is linked is decided on the
sets alone.  The first pass keeps the bands only; sets are made again for the texts that meet somebody.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from gridmark.llm.frames import narrow
from gridmark.llm.simhash import BITS, close_edges, ones, shingle_hashes
from gridmark.llm.words import LOWER, STEP_BYTES, Words, overlapping, steps
from gridmark.operators.components import contract
from gridmark.session import scratch, store

SHINGLE, LEAST, BANDS, WIDTH, SEED = 5, 0.8, 20, 5, 42
#: Bits in which linked fingerprints differ at most, and hashes whose bits are counted at once.
MAX_BITS, PIECE = 3, 1 << 14
#: Sets of one bucket that one group holds at most, and members of one center that one task checks.
CHUNK = 1024

#: Factors and terms of the hash functions whose minima are taken.
_FACTORS, _TERMS = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * WIDTH), np.uint64) | np.array([[1], [0]], np.uint64)


def _hashes(w: Words, shingle: int, short: bool) -> tuple[np.ndarray, np.ndarray]:
    import xxhash

    return shingle_hashes(w, shingle, SEED, short, xxhash.xxh32_intdigest)


def _sets(data: np.ndarray, offsets: np.ndarray, shingle: int) -> list[np.ndarray]:
    """Sorted different shingle hashes of every text, 32 bits each; words and short texts as in ``simhash``."""
    data = LOWER[data]
    if len(offsets) == 2 and len(data) > STEP_BYTES:  # one long text, piece by piece
        parts = [np.unique(_hashes(w, shingle, False)[0]) for w in overlapping(data, shingle)]
        whole = np.unique(np.concatenate(parts))
        if len(whole):
            return [whole.astype(np.uint32)]
    w = Words(data, offsets)
    hashes, owner = _hashes(w, shingle, True)
    both = np.unique(owner.astype(np.uint64) << np.uint64(32) | hashes)
    cuts = np.searchsorted(both >> np.uint64(32), np.arange(1, len(w.count), dtype=np.uint64))
    return np.split(both.astype(np.uint32), cuts)


def _bands(sets: list[np.ndarray]) -> np.ndarray:
    """Band hashes (sets, BANDS) of non-empty sets."""
    flat, heads = np.concatenate(sets).astype(np.uint64), np.cumsum([0, *(len(s) for s in sets[:-1])])
    flat = (flat ^ np.uint64(0x2545F4914F6CDD1D)) * np.uint64(0x9E3779B97F4A7C15)
    flat ^= flat >> np.uint64(32)
    low = np.stack([np.minimum.reduceat(flat * f + t, heads) >> np.uint64(32) for f, t in zip(_FACTORS, _TERMS)], axis=1).reshape(len(sets), BANDS, WIDTH)
    out = np.full((len(sets), BANDS), SEED, np.uint64)
    for i in range(WIDTH):
        out = (out ^ low[:, :, i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def _fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """SimHash of non-empty sets: a bit is 1 if it is in over half of the hashes, mixed to 64 bits."""
    size = np.array([len(s) for s in sets])
    flat, owner, total = np.concatenate(sets), np.repeat(np.arange(len(sets)), size), np.zeros((len(sets), BITS), np.int64)
    for lo in range(0, len(flat), PIECE):
        mixed = flat[lo:lo + PIECE].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            mixed = (mixed ^ mixed >> np.uint64(shift)) * np.uint64(factor)
        which, heads = np.unique(owner[lo:lo + PIECE], return_index=True)
        total[which] += ones(mixed ^ mixed >> np.uint64(31), heads)
    return np.packbits(total * 2 > size[:, None], axis=1, bitorder="little").reshape(-1).view(np.int64)


def _marks(docs: DataFrame, text: str, key: str, shingle: int) -> DataFrame:
    """``(key, body, node, fp, bands)`` of every row; ``body`` is the text's hash, no word: fp null, no bands."""
    schema = docs.select(key).schema.add("body", "long").add("node", "long").add("fp", "long").add("bands", ArrayType(LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in steps(batch.column(2)):
                sets = _sets(data, offsets, shingle)
                full = [s for s in sets if len(s)]
                bands, fp = (iter(f(full).tolist() if full else []) for f in (_bands, _fingerprints))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), _node(sets),
                                                  pa.array([next(fp) if len(s) else None for s in sets], pa.int64()),
                                                  pa.array([next(bands) if len(s) else [] for s in sets], pa.list_(pa.int64()))], schema.names)

    return docs.select(F.col(key), F.xxhash64(F.col(text)), F.col(text)).mapInArrow(run, schema)


def _node(sets: list[np.ndarray]) -> pa.Array:
    import xxhash

    return pa.array(np.array([xxhash.xxh64_intdigest(s.astype("<u4").tobytes(), SEED) for s in sets], np.uint64).view(np.int64))


def _sets_of(docs: DataFrame, bodies: DataFrame, text: str, shingle: int) -> DataFrame:
    """``(node, ids)``: the shingle set of every text whose hash is in ``bodies (body)``, one row a node."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # nodes of this task; copies of one text are made once a task
        for batch in batches:
            for _, _, data, offsets in steps(batch.column(0)):
                sets = _sets(data, offsets, shingle)
                node = _node(sets)
                new = [i for i, x in enumerate(node.to_pylist()) if x not in seen and not seen.add(x)]
                yield pa.RecordBatch.from_arrays([node.take(pa.array(new, pa.int64())), pa.array([sets[i].astype("<u4").tobytes() for i in new], pa.binary())], ["node", "ids"])

    chosen = docs.select(F.xxhash64(F.col(text)).alias("body"), F.col(text).alias("text")).join(bodies, "body", "left_semi")
    return chosen.select("text").mapInArrow(run, "node long, ids binary").groupBy("node").agg(F.first("ids").alias("ids"))


def _checked(pairs: DataFrame, least: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alike = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), "<u4"), np.frombuffer(y.as_buffer(), "<u4")
                enough = min(len(x), len(y)) >= least * max(len(x), len(y)) - 1e-9
                common = len(np.intersect1d(x, y, assume_unique=True)) if enough else 0
                alike.append(enough and common >= least * (len(x) + len(y) - common) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(alike, pa.bool_()))

    return pairs.mapInArrow(run, "a long, b long")


def _forest(sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Edges that connect what the pairs of similarity ``least`` of one bounded group connect."""
    size = np.array([len(s) for s in sets])
    heads = np.cumsum(size) - size
    seen, word = np.unique(np.concatenate(sets), return_inverse=True)
    todo, out = np.ones(len(sets), bool), []
    for seed in range(len(sets)):
        queue = [seed] if todo[seed] else []
        todo[seed] = False
        while queue and todo.any():
            at = queue.pop()
            mine = np.zeros(len(seen), bool)
            mine[word[heads[at]:heads[at] + size[at]]] = True
            common = np.add.reduceat(mine[word], heads, dtype=np.int64)
            near = np.flatnonzero(todo & (common >= least * (size + size[at] - common) - 1e-9))
            todo[near] = False
            out += [(at, x) for x in near.tolist()]
            queue += near.tolist()
    return out


def _dealt(rows: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Counts per ``by`` as ``chunks`` and, for every row, its chunk ``mine``."""
    counts = rows.groupBy(*by).agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    return counts, rows.join(counts, by).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))


def groups(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """``(key, body, root)`` per row: ``root`` is common to all rows connected by similarity ``least`` or more."""
    with scratch(docs.sparkSession) as keep:
        marked = store(_marks(docs, text, key, shingle), "similar")
        edges = keep(_edges(docs, marked, text, shingle, least))
        named = keep(store(marked.select(key, "body", "node"), "similar-nodes"))
    roots = contract(edges, ())
    return named.join(roots, "node", "left").select(key, "body", F.coalesce("root", "node").alias("root"))


def _buckets(marked: DataFrame) -> DataFrame:
    """``(node, c, v)``: bucket v of band c; after the bands comes that of the fingerprints that close ones connect."""
    near = contract(close_edges(marked.filter("fp is not null").select("fp").distinct(), MAX_BITS), ())
    prints = marked.filter("fp is not null").select("node", "fp").distinct().join(near.withColumnRenamed("node", "fp"), "fp", "left")
    return marked.select("node", F.posexplode("bands").alias("c", "v")).unionByName(
        prints.select("node", F.lit(BANDS).alias("c"), F.coalesce("root", "fp").alias("v")))


def _edges(docs: DataFrame, marked: DataFrame, text: str, shingle: int, least: float) -> DataFrame:
    """Written edges (a, b), a > b, that connect the nodes that all pairs of similarity ``least`` in a common bucket connect."""
    rows = _buckets(marked)
    crowded = rows.groupBy("c", "v").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high").drop("high")
    members = store(rows.join(crowded, ["c", "v"]).distinct(), "similar-members")
    pairs = store(members.filter("node > low").select("node", "low").distinct(), "similar-pairs")
    wanted = pairs.select("node").union(pairs.select("low")).distinct()
    bodies = store(marked.groupBy("node").agg(F.min("body").alias("body")).join(wanted, "node", "left_semi").select("body"), "similar-bodies")
    sets = store(_sets_of(docs, narrow(bodies), text, shingle), "similar-sets")

    counts, mine = _dealt(pairs, ["low"])
    centers = (sets.withColumnRenamed("node", "low").withColumnRenamed("ids", "low_ids").join(counts, "low")
               .withColumn("mine", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks"))
    both = mine.drop("chunks").join(sets, "node").join(centers, ["low", "mine"])
    stars = store(_checked(both.select("node", "low", "ids", "low_ids"), least), "similar-stars")

    roots = contract(stars, ())
    found = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # a bucket of two is settled by its one pair; equal buckets are compared once
    buckets = found.groupBy("c", "v").agg(F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("who"),
                                          F.min("root").alias("r"), F.max("root").alias("s")).filter("n > 2 and r < s")
    left = buckets.groupBy("who", "n").agg(F.min(F.struct("c", "v")).alias("k")).select("k.c", "k.v")
    left = store(members.join(left, ["c", "v"]).select("c", "v", "node"), "similar-left")
    if left.isEmpty():
        return stars
    _, mine = _dealt(left, ["c", "v"])
    spread = (mine.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
              .select("c", "v", "node", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b")).join(sets, "node"))

    def run(table: pa.Table) -> pa.Table:
        node = table.column("node").to_numpy()
        links = np.array(_forest([np.frombuffer(x.as_buffer(), "<u4") for x in table.column("ids")], least), np.int64).reshape(-1, 2)
        x, y = node[links[:, 0]], node[links[:, 1]]
        return pa.table({"a": np.maximum(x, y), "b": np.minimum(x, y)})

    return store(stars.union(spread.groupBy("c", "v", "a", "b").applyInArrow(run, "a long, b long")).distinct(), "similar-edges")


def one_of_each(docs: DataFrame, found: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row of ``docs`` for every ``root`` of ``found`` (key, body, root): of smallest key, null last, then of smallest text hash."""
    free = "_"
    while any(c.lower().startswith(free) for c in docs.columns):
        free += "_"
    one, two = f"{free}key", f"{free}body"
    with scratch(docs.sparkSession) as keep:
        many = store(found.groupBy(key, "body", "root").agg(F.count("*").alias("n")), "similar-rows")
        best = store(many.groupBy("root").agg(F.min(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"), F.col("body").alias("kept"))).alias("best"))
                     .select("root", "best.id", "best.kept"), "similar-kept")
        judged = many.join(best, "root").select(F.col(key).alias(one), F.col("body").alias(two), "n",
                                                (F.col(key).eqNullSafe(F.col("id")) & (F.col("body") == F.col("kept"))).alias("stays"))
        judged = keep(store(judged.filter("not stays or n > 1"), "similar-judged"))
    gone, again = (narrow(judged.filter(c).select(one, two)) for c in ("not stays", "stays"))
    same = F.col(key).eqNullSafe(F.col(one)) & (F.xxhash64(F.col(text)) == F.col(two))
    named = docs.join(gone, same, "left_anti")
    if judged.filter("stays").isEmpty():
        return named
    return named.join(again, same, "left_anti").unionByName(named.join(again, same, "left_semi").dropDuplicates([key, text]))


def without_near_copies(docs: DataFrame, text: str = "text", key: str = "doc_id", **settings) -> DataFrame:
    """:func:`one_of_each` of :func:`groups`; of the files made on the way only the list of what leaves stays."""
    with scratch(docs.sparkSession) as keep:
        found = groups(docs, text, key, **settings)
        out = keep(one_of_each(docs, found, text, key))
    return out
