"""Hand-built cases with known answers, brute-force comparisons and refusals."""

import random

import pytest
from pyspark.sql import functions as F

from gridmark.functions import names, scalars
from gridmark.operators import components, folds, partition_scores, postprocess, raster, regions, selection, sweepcounts, thinning, tiles
from gridmark.operators.checks import ValidationError
from gridmark.operators.folds import check_fractions


def pixels(df):
    return {(r.y, r.x) for r in df.select("y", "x").collect()}


def flood(cells, steps):
    """Brute-force components of a set of cells as a map cell -> smallest cell."""
    out = {}
    for start in sorted(cells):
        if start in out:
            continue
        stack = [start]
        while stack:
            y, x = stack.pop()
            if (y, x) in out or (y, x) not in cells:
                continue
            out[y, x] = start
            stack += [(y + dy, x + dx) for dy, dx in steps]
    return out


@pytest.mark.parametrize("connectivity", [4, 8])
@pytest.mark.parametrize("block", [(512, 2048), (4, 8)])
def test_components_match_flood_fill(spark, monkeypatch, connectivity, block):
    monkeypatch.setattr(components, "BLOCK_ROWS", block[0])
    monkeypatch.setattr(components, "BLOCK_COLUMNS", block[1])
    rng = random.Random(connectivity)
    cells = {(y, x) for y in range(24) for x in range(30) if rng.random() < 0.55}
    px = spark.createDataFrame([(1, 24, 30, y, x) for y, x in cells], "image_id long, height int, width int, y int, x int")
    steps = [o for o in raster.RING if connectivity == 8 or 0 in o]
    want = flood(cells, steps)
    got = {(r.y, r.x): r.component for r in components.connected_components(px, connectivity).collect()}
    assert {k: (v[0] << 32) + v[1] + 1 for k, v in want.items()} == got


def test_thinning_keeps_a_line_and_thins_a_bar(mask):
    line = mask("......... .#######. .........")
    assert pixels(thinning.skeletonize(line)) == {(1, x) for x in range(1, 8)}
    bar = mask("......... .#######. .#######. .#######. .........")
    assert {y for y, _ in pixels(thinning.skeletonize(bar))} == {2}


@pytest.mark.parametrize("width", [1, 2, 3, 4, 5])
def test_line_grows_to_exact_width(mask, width):
    grown = pixels(raster.dilate_to_width(mask(".......... " * 5 + "########## " + ".......... " * 5), width))
    assert len({y for y, _ in grown}) == width


def test_diagonal_outline_does_not_leak(spark):
    from gridmark.operators.regions import regions_from_outline

    px = spark.createDataFrame([(1, 10, 10, y, x, y == x) for y in range(10) for x in range(10)],
                               "image_id long, height int, width int, y int, x int, outline boolean")
    assert regions_from_outline(px).select("region").distinct().count() == 2


def test_all_outline_image_is_one_region(spark):
    from gridmark.operators.regions import regions_from_outline

    px = spark.createDataFrame([(1, 4, 4, y, x, True) for y in range(4) for x in range(4)],
                               "image_id long, height int, width int, y int, x int, outline boolean")
    out = regions_from_outline(px)
    assert out.count() == 16 and out.select("region").distinct().count() == 1


def test_watershed_basins(spark):
    from gridmark.operators.watershed import watershed_regions

    def build(low):
        return spark.createDataFrame([(1, 12, 12, y, x, 0.05 if (y, x) in low else 0.9) for y in range(12) for x in range(12)],
                                     "image_id long, height int, width int, y int, x int, prob double").withColumn("prob", F.col("prob").cast("float"))

    two = {(y, x) for y in (2, 3) for x in (2, 3)} | {(y, x) for y in (8, 9) for x in (8, 9)}
    assert watershed_regions(build(two), 0.3).select("region").distinct().count() == 2
    assert watershed_regions(build(set()), 0.3).select("region").distinct().count() == 1


def test_bridge_closes_a_short_gap_only(mask):
    gap = mask("........... ####...#### ...........")
    assert pixels(postprocess.bridge(gap, 4.0)) == {(1, x) for x in range(11)}
    assert pixels(postprocess.bridge(gap, 3.0)) == pixels(gap)


def test_partition_scores(spark):
    def table(rows):
        return spark.createDataFrame([(1, *r) for r in rows], "image_id long, t long, p long, n long")

    same = partition_scores.region_row(table([(1, 7, 50), (2, 9, 50)])).first()
    assert same.ari == 1.0 and abs(same.vi) < 1e-12 and same.pq == 1.0
    close = partition_scores.panoptic_quality(table([(1, 1, 100), (2, 1, 20), (2, 2, 880)])).first()
    assert abs(close.sq - (100 / 120 + 880 / 900) / 2) < 1e-12 and close.pq_fn == 0
    empty = partition_scores.panoptic_quality(table([(0, 0, 10)])).first()
    assert empty.pq == 1.0


def test_value_on_a_threshold_counts(spark):
    df = spark.createDataFrame([(0.05,), (0.5,), (0.95,), (0.5,)], "v double").select(F.col("v").cast("float").alias("v"))
    got = {r.threshold: r.n for r in sweepcounts.ge_counts(df, F.col("v"), [0.05, 0.5, 0.95]).collect()}
    assert got == {0.05: 4, 0.5: 3, 0.95: 1}


def test_tile_positions(spark):
    def at(size):
        return spark.range(1).select(tiles.positions(F.lit(size), 256, 128).alias("p")).first().p

    assert at(200) == [0] and at(256) == [0] and at(512) == [0, 128, 256]
    assert at(261) == [5] and at(645) == [0, 128, 256, 389]


def test_names(spark):
    df = spark.createDataFrame([("Masks",), ("my_images",), ("groundtruth2",), ("other",)], "n string")
    assert [r.r for r in df.select(names.dir_role(F.col("n")).alias("r")).collect()] == ["mask", "image", "mask", None]


def test_refusals(spark):
    with pytest.raises(ValueError):
        check_fractions({"train": 0.5, "val": 0.2, "test": 0.2})
    with pytest.raises(ValueError):
        postprocess.check_mode("morph_close", 2)
    with pytest.raises(ValueError):
        sweepcounts.threshold_grid(0.9, 0.1, 0.1)
    rows = spark.createDataFrame([("d", "test", 1.0)], "dataset string, split string, pq double")
    with pytest.raises(ValidationError):
        selection.only_validation(rows)


def test_snapping_keeps_a_grid_that_would_collapse():
    assert scalars.snapped([0.5, 0.5 + 1e-12]) == [0.5, 0.5 + 1e-12]


def absorbed(grid, min_area):
    """Brute force: small 8-connected components in order of (label, first pixel) take the majority of their border."""
    cells = {(y, x): v for y, row in enumerate(grid) for x, v in enumerate(row)}
    parts = []
    for value in sorted(set(cells.values())):
        roots = flood({c for c, v in cells.items() if v == value}, raster.RING)
        for root in sorted(set(roots.values())):
            parts.append({c for c, r in roots.items() if r == root})
    for part in parts:
        ring = {(y + dy, x + dx) for y, x in part for dy, dx in raster.PLUS} - part
        seen = [cells[c] for c in ring if c in cells]
        if len(part) < min_area and seen:
            best = min(set(seen), key=lambda v: (-seen.count(v), v))
            cells |= dict.fromkeys(part, best)
    return cells


@pytest.mark.parametrize("seed,min_area", [(1, 4), (2, 9), (3, 1000), (4, 0)])
def test_small_regions_match_one_ascending_pass(spark, seed, min_area):
    rng = random.Random(seed)
    grid = [[rng.randrange(4) for _ in range(17)] for _ in range(13)]
    px = spark.createDataFrame([(1, 13, 17, y, x, v) for y, r in enumerate(grid) for x, v in enumerate(r)],
                               "image_id long, height int, width int, y int, x int, label int")
    got = {(r.y, r.x): r.label for r in regions.merge_small_regions(px, min_area).collect()}
    assert got == absorbed(grid, min_area)


def test_two_halves_below_the_area_become_one(spark):
    px = spark.createDataFrame([(1, 4, 8, y, x, 1 if x < 4 else 2) for y in range(4) for x in range(8)],
                               "image_id long, height int, width int, y int, x int, label int")
    merged, stats = regions.merge_with_statistics(px, 100)
    assert {r.label for r in merged.collect()} == {2}
    row = stats.first()
    assert (row.n_components_total, row.n_components_merged, row.n_pixels_reassigned, row.outline_px_after) == (2, 2, 32, 0)


def test_allocation_in_chunks_equals_allocation_at_once(spark, monkeypatch):
    tiles = spark.sql("SELECT CONCAT('d', id % 3) AS dataset, id % 61 AS parent_id, id AS tile_id FROM range(700) WHERE id % 7 < 5 OR id % 11 < 3")
    shares = {"train": 0.7, "val": 0.15, "test": 0.15}
    once = sorted(map(tuple, folds.allocate_by_tile_ratio(tiles, shares, 3).collect()))
    monkeypatch.setattr(folds, "CHUNK", 16)
    assert sorted(map(tuple, folds.allocate_by_tile_ratio(tiles, shares, 3).collect())) == once
    assert len(once) == tiles.select("dataset", "parent_id").distinct().count()
