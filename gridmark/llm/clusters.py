"""Lloyd's clustering with exact integer centroids and an equal-average equal-variance nearest search.

Vectors become integers once and are written; every round is one pass over them.  The centroids of a
round are sorted by component sum.  A vector starts at the centroids next to its own sum and moves
outward: as soon as the sum alone keeps a side of the list further away than the best so far, that
side is done; a centroid whose sum and deviation together are too far is passed over; only what is
left is measured, in integers.  A task returns the sum and count of each centroid's vectors, so a
round shuffles ``k`` rows a task, and what the driver sees is ``k`` rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmark.session import discard, store

#: Scaled components stay below this, so that with up to 64 of them every bound below fits in 64 bits.
COMPONENT_BOUND = 1 << 24
#: Vectors that are searched together.
STEP = 4096
_FAR = np.iinfo(np.int64).max


def scaled(vector: Column, dim: int, scale: float) -> Column:
    """floor(scale * x) of every component; null unless there are ``dim`` finite ones, scaled below :data:`COMPONENT_BOUND`."""
    x = F.transform(vector, lambda x: F.lit(float(scale)) * x.cast("double"))
    ok = (F.size(vector) == dim) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < COMPONENT_BOUND))
    return F.when(F.coalesce(ok, F.lit(False)), F.transform(x, lambda v: F.floor(v).cast("int")))


class Centroids:
    """Centroids in the order of their sums, with sums and deviations."""

    def __init__(self, rows: np.ndarray):
        total = rows.sum(axis=1)
        self.number = np.lexsort((np.arange(len(rows)), total))
        self.rows, self.total = rows[self.number], total[self.number]
        self.deviation = _deviation(self.rows, self.total)

    def nearest(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(number of the nearest centroid, squared distance, distances measured); ties go to the smaller number."""
        n, d = v.shape
        k = len(self.total)
        total = v.sum(axis=1)
        deviation = _deviation(v, total)
        best, who, measured = np.full(n, _FAR), np.full(n, k), 0
        right = np.searchsorted(self.total, total)
        left = right - 1
        active = np.arange(n)
        while len(active):
            lo, hi = left[active], right[active]
            low = np.where(lo >= 0, total[active] - self.total[np.maximum(lo, 0)], _FAR)
            high = np.where(hi < k, self.total[np.minimum(hi, k - 1)] - total[active], _FAR)
            down = low <= high
            gap = np.where(down, low, high)
            # (difference of sums)^2 / d is a lower bound of the distance, and further out it only grows
            near = (gap < _FAR) & ((best[active] == _FAR) | (np.where(gap < _FAR, gap, 0) ** 2 <= np.where(best[active] < _FAR, best[active], 0) * d))
            active, down, gap = active[near], down[near], gap[near]
            at = np.where(down, left[active], right[active])
            left[active[down]] -= 1
            right[active[~down]] += 1
            apart = deviation[active] - self.deviation[at]
            slack = 1e-9 * (deviation[active] ** 2 + self.deviation[at] ** 2 + 1)
            try_ = gap.astype(float) ** 2 / d + apart * apart <= best[active].astype(float) * (1 + 1e-12) + slack
            row, c = active[try_], at[try_]
            measured += len(row)
            diff = v[row] - self.rows[c]
            distance = np.einsum("ij,ij->i", diff, diff)
            number = self.number[c]
            better = (distance < best[row]) | ((distance == best[row]) & (number < who[row]))
            best[row[better]], who[row[better]] = distance[better], number[better]
        return who, best, measured


def _deviation(rows: np.ndarray, total: np.ndarray) -> np.ndarray:
    d = rows.shape[1]
    return np.sqrt((d * np.einsum("ij,ij->i", rows, rows) - total * total) / d)


def _parts(column: pa.Array, dim: int) -> Iterator[tuple[int, np.ndarray]]:
    flat = column.flatten().to_numpy().reshape(-1, dim)
    for s in range(0, len(flat), STEP):
        yield s, flat[s:s + STEP].astype(np.int64)


def _next(kept: DataFrame, now: np.ndarray, spark) -> np.ndarray:
    """The centroids after one round: floor of the mean of each one's vectors; empty ones stay."""
    k, dim = now.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, many, total = Centroids(now), np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for batch in batches:
            for _, v in _parts(batch.column(0), dim):
                who = search.nearest(v)[0]
                many += np.bincount(who, minlength=k)
                for c in range(k):
                    total[c] += v[who == c].sum(axis=0)
        some = np.flatnonzero(many)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(many[some]), pa.array(total[some].tolist(), pa.list_(pa.int64()))], ["c", "n", "total"])

    sums = kept.select("w").mapInArrow(run, "c int, n long, total array<long>").groupBy("c").agg(
        F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[i]) for i in range(dim)]).alias("total"))
    out = now.copy()
    for r in sums.collect():  # one row a centroid
        out[r.c] = [x // r.n for x in r.total]
    return out


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, key: str = "vec_id", vector: str = "embedding", dim: int = 64, scale: float = 1024.0,
            seed: str = "3:") -> DataFrame:
    """``(key, cluster, distance, cluster_inertia, inertia, centroid_sha256)`` of every kept vector.

    Kept are vectors of exactly ``dim`` finite components whose scaled size stays below 2^24, as
    larger ones have no squared distance in 64 bits.  The first centroids are the kept rows of
    smallest sha256 of ``seed`` and key; equal keys go by their vectors, rows without a key are
    assigned but never first centroids.  With fewer keyed rows than ``k`` there are as many centroids
    as rows; without any there are no rows.  Repeated rows are assigned each; columns besides the two are not read.
    """
    spark = vectors.sparkSession
    if not 0 < dim <= 64 or k < 1:
        raise ValueError(f"1 to 64 components and at least one centroid, got {dim} and {k}")
    kept = store(vectors.select(F.col(key).cast("long").alias("id"), scaled(F.col(vector), dim, scale).alias("w")).filter("w is not null"), "vectors")
    order = F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")).cast("binary"), 256)
    first = kept.filter("id is not null").select(order.alias("h"), "w").orderBy("h", "w").limit(k).collect()
    now = np.array([r.w for r in first], np.int64).reshape(len(first), dim)
    if not len(first):
        return kept.limit(0).select(F.col("id").alias(key), *[F.lit(None).cast(t).alias(n) for n, t in _COLUMNS])
    for _ in range(rounds):
        now = _next(kept, now, spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Centroids(now)
        for batch in batches:
            for s, v in _parts(batch.column(1), dim):
                who, distance, _ = search.nearest(v)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s, len(v)), pa.array(who.astype(np.int32)), pa.array(distance)], ["id", "cluster", "distance"])

    found = store(kept.select("id", "w").mapInArrow(run, "id long, cluster int, distance long"), "clusters")
    discard(kept)
    inertia = {r.cluster: r.inertia for r in found.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now.tolist()]
    about = spark.createDataFrame([(c, n, sum(inertia.values()), digest[c]) for c, n in inertia.items()],
                                  "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select(F.col("id").alias(key), *[n for n, _ in _COLUMNS])


_COLUMNS = (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))
