"""Block operators against whole-image versions, with blocks so small that everything crosses their borders."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridmark.operators import blocks, components, distance, sweepcounts, thinning, watershed
from gridmark.operators.raster import disk

FRAME = "image_id long, height int, width int, y int, x int"


def pixels(spark, image, *values):
    """All pixels of the arrays in ``values`` = (ddl, array)."""
    h, w = values[0][1].shape
    rows = [(image, h, w, y, x, *(v[y, x].item() for _, v in values)) for y in range(h) for x in range(w)]
    return spark.createDataFrame(rows, f"{FRAME}, {', '.join(d for d, _ in values)}")


def blobs(seed, h, w, n=9, r=9):
    rng, out = random.Random(seed), np.zeros((h, w), bool)
    yy, xx = np.mgrid[:h, :w]
    for _ in range(n):
        y, x, a, b = rng.randrange(h), rng.randrange(w), rng.randint(1, r), rng.randint(1, r)
        out |= ((yy - y) / a) ** 2 + ((xx - x) / b) ** 2 <= 1
    return out


def thinned(mask):
    mask = mask.copy()
    while True:
        before = mask.copy()
        for second in (False, True):
            gone = []
            for y, x in zip(*np.nonzero(mask)):
                ring = [0 <= y + dy < mask.shape[0] and 0 <= x + dx < mask.shape[1] and bool(mask[y + dy, x + dx]) for dy, dx in thinning.CLOCKWISE]
                if thinning._removable(sum(r << i for i, r in enumerate(ring)), second):
                    gone.append((y, x))
            for p in gone:
                mask[p] = False
        if (mask == before).all():
            return mask


@pytest.mark.parametrize(("passes", "block"), [(1, 8), (2, 16), (8, 256)])
def test_thinning(spark, monkeypatch, passes, block):
    monkeypatch.setattr(thinning, "PASSES", passes)
    images = {i: blobs(i, 45, 38) for i in range(3)} | {7: np.ones((30, 30), bool), 8: np.eye(20, dtype=bool)}
    rows = [(i, *m.shape, int(y), int(x)) for i, m in images.items() for y, x in zip(*np.nonzero(m))]
    got = thinning.skeletonize(spark.createDataFrame(rows, FRAME), block=block)
    want = sorted((i, int(y), int(x)) for i, m in images.items() for y, x in zip(*np.nonzero(thinned(m))))
    assert sorted((r.image_id, r.y, r.x) for r in got.collect()) == want


def flooded(level, seed):
    """The fixed point of offers between neighbours, round by round."""
    h, w = level.shape
    value = {p: (-1.0, 0, int(seed[p])) if seed[p] else None for p in np.ndindex(h, w)}
    while True:
        new = {}
        for (y, x), v in value.items():
            offers = []
            for q in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
                if value.get(q):
                    z, s, r = value[q]
                    offers.append((level[y, x], 1, r) if z < level[y, x] else (z, s + 1, r))
            new[y, x] = v if seed[y, x] else min(offers, default=None)
        if new == value:
            return {p: v[2] if v else 1 for p, v in value.items()}
        value = new


@pytest.mark.parametrize("block", [4, 7, 256])
def test_watershed(spark, block):
    rng = np.random.default_rng(block)
    levels = {i: (rng.integers(1, n, (17, 22)) / 10).astype(np.float32) for i, n in ((1, 10), (2, 4), (3, 30))}
    levels[4] = np.full((9, 9), 0.9, np.float32)  # no seed: one region
    levels[5] = np.full((12, 30), 0.8, np.float32)
    levels[5][5, 0] = levels[5][0, 29] = 0.1  # a plateau wider than any block
    df = None
    for i, v in levels.items():
        df = pixels(spark, i, ("prob float", v)) if df is None else df.unionByName(pixels(spark, i, ("prob float", v)))
    seeds = components.connected_components(df.filter(F.col("prob") < F.lit(0.25).cast("float")), 8).collect()
    got = {(r.image_id, r.y, r.x): r.region for r in watershed.watershed_regions(df, 0.25, block=block).collect()}
    for i, v in levels.items():
        seed = np.zeros(v.shape, np.int64)
        for r in seeds:
            if r.image_id == i:
                seed[r.y, r.x] = r.component
        for (y, x), region in flooded(v.astype(float), seed).items():
            assert got[i, y, x] == region


def test_nearest_site(spark):
    rng = np.random.default_rng(3)
    images = {1: rng.random((20, 31)) < 0.03, 2: rng.random((9, 9)) < 0.3, 3: np.zeros((5, 5), bool), 4: np.zeros((7, 40), bool)}
    images[4][3, [0, 13, 26, 39]] = True
    df, payload = None, {}
    for i, m in images.items():
        payload[i] = rng.integers(0, 4, m.shape)
        one = pixels(spark, i, ("site boolean", m), ("p long", payload[i]))
        df = one if df is None else df.unionByName(one)
    got = {(r.image_id, r.y, r.x): (r.d2, r.payload) for r in distance.nearest_site(df.repartition(3), "site", "p").collect()}
    want = {}
    for i, m in images.items():
        sites = list(zip(*np.nonzero(m)))
        for y, x in zip(*np.nonzero(~m)):
            if sites:
                want[i, y, x] = min(((y - a) ** 2 + (x - b) ** 2, payload[i][a, b]) for a, b in sites)
    assert got == want
    some = distance.nearest_site(df, "site", asked=(F.col("x") == 3) & ~F.col("site")).collect()
    assert {(r.image_id, r.y, r.x): r.d2 for r in some} == {k: v[0] for k, v in want.items() if k[2] == 3}


def test_rows_over_several_arrow_batches(spark):
    m = np.zeros((6, 50), bool)
    m[2, 7] = m[4, 44] = True
    df = pixels(spark, 1, ("site boolean", m))
    whole = sorted(map(tuple, distance.nearest_site(df, "site").collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert sorted(map(tuple, distance.nearest_site(df, "site").collect())) == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_proximity_and_sweep_counts(spark):
    rng = np.random.default_rng(5)
    true, prob = rng.random((19, 23)) < 0.15, (rng.integers(0, 21, (19, 23)) / 20).astype(np.float32)
    df = pixels(spark, 1, ("true boolean", true), ("prob float", prob)).withColumn("dataset", F.lit("d"))
    near = {(r.y, r.x): r.d2_true for r in distance.proximity(df, ["true"], 3, ["prob"], block=5).collect()}
    sites = list(zip(*np.nonzero(true)))
    for y, x in np.ndindex(true.shape):
        d = min((y - a) ** 2 + (x - b) ** 2 for a, b in sites)
        assert near[y, x] == (d if d <= 9 else None)
    grid = [0.25, 0.5, 0.75]
    buckets = sweepcounts.block_buckets(df, grid, 2, size=6)
    got = {r.threshold: (r.tp, r.n_pred, r.hits_p, r.hits_r, r.tiles, r.total_px) for r in sweepcounts.counters_from_buckets(buckets, grid).collect()}

    def wide(m):
        out = np.zeros_like(m)
        for dy, dx in disk(2):
            out |= blocks.shifted(m, dy, dx, False)
        return out

    for t in grid:
        pred = prob >= np.float32(t)
        assert got[t] == ((pred & true).sum(), pred.sum(), (pred & wide(true)).sum(), (true & wide(pred)).sum(), 1, true.size)


def test_regions_seen_from_an_outline(spark):
    from gridmark.operators.attribution import outline_regions

    rng = np.random.default_rng(6)
    region, line = rng.integers(0, 4, (13, 11)), rng.random((13, 11)) < 0.3
    df = pixels(spark, 1, ("region long", region), ("line boolean", line)).filter("region > 0")
    outline = pixels(spark, 1, ("line boolean", line)).filter("line")
    got = {(r.y, r.x, r.region) for r in outline_regions(df, outline, block=4).collect()}
    want = {(y, x, int(region[a, b])) for y, x in zip(*np.nonzero(line)) for a in range(y - 1, y + 2) for b in range(x - 1, x + 2)
            if 0 <= a < 13 and 0 <= b < 11 and region[a, b]}
    assert got == want
