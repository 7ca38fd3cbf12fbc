"""Exact top-k inner-product search by exhaustive term-at-a-time accumulation.

Query and candidate vectors travel as blocks of integer weights.  Candidate blocks are dealt in turn
over lanes and query blocks over groups of bounded size; a task works on one group in one lane.  It
holds the group's queries and takes the lane's candidate blocks one at a time, so that its memory does
not grow with the table; what is moved is the candidates once a group and the queries once a lane.
A pair of blocks is scored term by term: the non-zero query weights of a term are scattered, times the
term's postings, into a dense score array; the best k of it are selected by partition and merged with
what the lane has found for those queries.  The last step merges the k of each lane.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmark.session import bound_batches, store

QUERY_BLOCK, CANDIDATE_BLOCK = 512, 4096
#: Weights of the queries that a task holds, about: 16 MB.
GROUP_WEIGHTS = 1 << 21
#: Lanes for each core: a query is sent, and its best found, once for each.
LANES_A_CORE = 4
#: Queries whose scores are accumulated together, so that the score array stays in the processor's cache.
SCORE_ROWS = 16
_BLOCK = "block long, n int, width int, ids binary, weights binary"


def integer_weights(vector: Column, scale: float) -> Column:
    """floor(scale * x) of every component as double; null for a vector that is null or holds null, NaN or infinity."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(F.coalesce(ok, F.lit(False)), F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))))


def _blocks(size: int):
    """Packs rows (id, weights) of a task into blocks: ids and a matrix of weights, shorter vectors padded with zeros."""
    def pack(ids: list, rows: list, block: int) -> pa.RecordBatch:
        width = max(map(len, rows))
        matrix = np.zeros((len(rows), width), np.int64)
        for i, r in enumerate(rows):
            matrix[i, :len(r)] = r
        return pa.RecordBatch.from_arrays(
            [pa.array([block], pa.int64()), pa.array([len(rows)], pa.int32()), pa.array([width], pa.int32()),
             pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([matrix.tobytes()], pa.binary())], ["block", "n", "width", "ids", "weights"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, block = [], [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            block = batch.column(2)[0].as_py() << 33 if block is None else block
            bounds = batch.column(1).offsets.to_numpy()
            flat = batch.column(1).values.to_numpy()
            for i, key in enumerate(batch.column(0).to_pylist()):
                ids.append(key)
                rows.append(flat[bounds[i]:bounds[i + 1]])
                if len(ids) == size:
                    yield pack(ids, rows, block)
                    ids, rows, block = [], [], block + 1
        if ids:
            yield pack(ids, rows, block)
    return run


def _best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every row the k best (row, id, score): higher score first, then smaller id; a row's own id takes no part."""
    low = np.iinfo(np.int64).min
    allowed = ids[None, :] != own[:, None]
    masked = np.where(allowed, scores, low)
    keep = allowed
    if masked.shape[1] > k:
        cut = np.partition(masked, masked.shape[1] - k, axis=1)[:, -k]
        keep = allowed & (masked >= cut[:, None])
    row, col = np.nonzero(keep)
    return _ranked(row, ids[col], scores[row, col], k)


def _ranked(row: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -score, row))
    row, ids, score = row[order], ids[order], score[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    top = rank < k
    return row[top], ids[top], score[top]


def _accumulate(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Scores of all query rows against all candidates, one term after the other."""
    scores = np.zeros((len(queries), len(candidates)), np.int64)
    for term in range(min(queries.shape[1], candidates.shape[1])):
        weights = queries[:, term]
        rows = np.flatnonzero(weights)
        postings = candidates[:, term]
        if len(rows) == len(weights):
            scores += weights[:, None] * postings
        elif len(rows):
            scores[rows] += weights[rows, None] * postings
    return scores


def _search(k: int):
    """Of a task's rows, query blocks first, the k best in its candidate blocks of every query."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = []  # of each query block: ids, weights, its best so far as row, id, score
        for batch in batches:
            for r in range(batch.num_rows):
                asks, n, width, ids, weights = [c[r].as_py() for c in batch.columns]
                ids, matrix = np.frombuffer(ids, np.int64), np.frombuffer(weights, np.int64).reshape(n, width)
                if asks:
                    held.append([ids, matrix, (np.zeros(0, np.int64),) * 3])
                    continue
                by_term = np.ascontiguousarray(matrix.T).T
                for block in held:
                    own, q, found = block
                    parts = [found]
                    for s in range(0, len(own), SCORE_ROWS):
                        row, got, score = _best(_accumulate(q[s:s + SCORE_ROWS], by_term), ids, own[s:s + SCORE_ROWS], k)
                        parts.append((row + s, got, score))
                    block[2] = _ranked(*map(np.concatenate, zip(*parts)), k)
        for own, _, (row, got, score) in held:
            yield pa.RecordBatch.from_arrays([pa.array(own[row]), pa.array(got), pa.array(score)], ["query_id", "vec_id", "score"])
    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: float = 256.0,
          lanes: int | None = None) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` best candidates of every query row, all if there are fewer.

    Weights are floor(scale * x); the score is their integer inner product (64-bit), over the shared
    components if lengths differ.  Ties go to the smaller id, then rank by turn.  Candidates are all
    rows but those of the query's own id.  Rows without an id, and vectors that are null, or hold
    null, NaN or infinite components, take no part; an empty vector scores 0 everywhere.  A repeated
    candidate row is ranked each time; of repeated query rows one is answered, by its smallest vector.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    lanes = lanes or min(int(spark.conf.get("spark.sql.shuffle.partitions")), LANES_A_CORE * spark.sparkContext.defaultParallelism)
    rows = (vectors.select(F.col(key).cast("long").alias("id"), integer_weights(F.col(vector), scale).alias("w"), F.coalesce(is_query, F.lit(False)).alias("q"))
            .filter(F.col("id").isNotNull() & F.col("w").isNotNull()))
    part = F.spark_partition_id().cast("long").alias("part")
    candidates = store(rows.select("id", "w", part).mapInArrow(_blocks(CANDIDATE_BLOCK), _BLOCK), "candidates")
    asked = rows.filter("q").groupBy("id").agg(F.min("w").alias("w"))
    queries = store(asked.select("id", "w", part).mapInArrow(_blocks(QUERY_BLOCK), _BLOCK), "questions")
    groups = -(-(queries.agg(F.sum(F.col("n").cast("long") * F.col("width"))).first()[0] or 1) // GROUP_WEIGHTS)

    def sent(blocks: DataFrame, asks: bool, own: int, others: int, cell: Column) -> DataFrame:
        """Every block in its turn, from a place by the task that made it, and once for each of the others."""
        turn = (F.pmod(F.xxhash64(F.shiftright("block", 33)), F.lit(own)) + F.col("block") % own) % own
        return (blocks.select(turn.alias("turn"), F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias("other"), F.lit(asks).alias("asks"), "n", "width", "ids", "weights")
                .withColumn("cell", cell.cast("int")).drop("turn", "other"))

    # shuffled by the task's number: a join would be planned as a broadcast of all copies of the queries
    cells = (sent(candidates, False, lanes, groups, F.col("other") * lanes + F.col("turn"))
             .unionByName(sent(queries, True, groups, lanes, F.col("turn") * lanes + F.col("other")))
             .repartitionById(lanes * groups, "cell").sortWithinPartitions(F.desc("asks")).drop("cell"))
    found = cells.mapInArrow(_search(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
