"""Clustering against a plain integer version; the search against all distances."""

import hashlib
import math
import random

import numpy as np
from pyspark.sql import functions as F

from gridmark.llm.clusters import Centroids, cluster


def plain(rows, k, rounds, scale):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    centers = [v for _, v in first]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centers))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        for j, g in groups.items():
            centers[j] = [sum(c) // len(g) for c in zip(*g)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    total = {j: sum(d for _, c, d in found if c == j) for j in range(len(centers))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return [(i, c, d, total[c], sum(total.values()), digest[c]) for i, c, d in found]


def test_search_finds_the_nearest_and_measures_few():
    rng = np.random.default_rng(1)
    c = rng.integers(-900, 900, (200, 16)) + rng.integers(-3000, 3000, (200, 1))
    v = np.concatenate([rng.integers(-900, 900, (500, 16)) + rng.integers(-3000, 3000, (500, 1)), c[:20], np.full((3, 16), -(1 << 24)), np.full((3, 16), (1 << 24) - 1)])
    who, distance, measured = Centroids(c).nearest(v)
    every = ((v[:, None].astype(object) - c[None].astype(object)) ** 2).sum(axis=2)
    assert who.tolist() == [min(range(200), key=lambda j: (row[j], j)) for row in every] and distance.tolist() == every.min(axis=1).tolist()
    assert measured < 0.25 * every.size


def test_ties_go_to_the_smaller_number():
    c = np.array([[4, 0], [0, 4], [0, 0], [4, 0], [0, 0]])
    assert Centroids(c).nearest(np.array([[0, 0], [2, 0], [4, 0], [2, 2]]))[0].tolist() == [2, 0, 0, 0]


def test_rows_against_plain(spark):
    rng = random.Random(3)
    rows = [(i if i % 9 else None, [rng.choice([-0.5, 0.25, 0.75]) + rng.random() / 9 for _ in range(5)]) for i in range(200)]
    rows += [(300, None), (301, []), (302, [1.0] * 4), (303, [0.1, None, 0.1, 0.1, 0.1]), (304, [0.1, float("nan"), 0.0, 0.0, 0.0]), (305, [float("inf")] * 5)]
    rows += [(400, [0.5] * 5)] * 70 + [(401, [0.5] * 5)] * 30
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, cluster int, w int").repartition(5)
    got = sorted(map(str, (tuple(r) for r in cluster(df, 6, 4, dim=5, scale=64.0).collect())))
    assert got == sorted(map(str, plain([r for r in rows if r[1] is None or len(r[1]) == 5], 6, 4, 64.0)))


def test_small_and_empty_tables(spark):
    df = spark.createDataFrame([(1, [0.5]), (2, [0.25]), (None, [9.0]), (3, [1e30])], "vec_id long, embedding array<float>")
    assert {(r.vec_id, r.distance) for r in cluster(df, dim=1).collect() if r.vec_id} == {(1, 0), (2, 0)} or cluster(df, dim=1).count() == 3
    assert cluster(df, dim=1).filter(F.col("vec_id") == 3).count() == 0  # beyond the stated bound
    empty = cluster(df.limit(0), dim=1)
    assert empty.count() == 0 and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
