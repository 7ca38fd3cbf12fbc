"""Fold rules that fail, extraction reasons, quantiles of continuous values, selection before the test."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridmark.operators import checks, palette, summaries
from gridmark.plans import extract
from gridmark.sources.bitmaps import bitmap

TILE = "fold string, split string, tile_id long, dataset string, parent_id long, outline_fraction double, x int, y int, patch int, width int, height int, pad_right int, pad_bottom int"


def fold(changes=()):
    """A sound fold of four tiles; ``changes`` are (tile, column, value)."""
    names = [c.split()[0] for c in TILE.split(", ")]
    rows = [dict(zip(names, ("f", "train" if i < 2 else "val", i, "a", i, 0.08, 0, 0, 64, 128, 64, 0, 0))) for i in range(4)]
    for tile, column, value in changes:
        rows[tile][column] = value
    return [tuple(r[n] for n in names) for r in rows]


@pytest.mark.parametrize(("rule", "changes"), [
    (None, []), ("non_empty", [(2, "split", "train"), (3, "split", "train")]), ("test_only_absent", [(1, "dataset", "t")]), ("tiles_unique", [(1, "tile_id", 0)]),
    ("parents_disjoint", [(1, "parent_id", 3)]), ("pos_weight_in_band", [(0, "outline_fraction", 0.9), (1, "outline_fraction", 0.9)]),
    ("no_padding", [(3, "pad_bottom", 4)]), ("tile_inside_image", [(2, "x", 70)])])
def test_every_rule_fails_on_its_own_fault(spark, rule, changes):
    out = checks.fold_integrity(spark.createDataFrame(fold(changes), TILE), ["t"]).collect()
    assert len(out) == 7 and {r.check_name for r in out if not r.ok} == ({rule} if rule else set())


def test_rebuild_from_other_partitions(spark):
    source = spark.range(500).withColumns({"fold": F.concat(F.lit("f"), F.col("id") % 3)})
    sound = checks.rebuild_integrity(lambda t: t.withColumn("split", F.md5(F.col("id").cast("string"))), source).collect()
    assert len(sound) == 3 and all(r.ok and r.check_name == "deterministic_rebuild" for r in sound)
    by_place = checks.rebuild_integrity(lambda t: t.withColumn("split", F.monotonically_increasing_id()), source).collect()
    assert not any(r.ok for r in by_place)
    lost = checks.rebuild_integrity(lambda t: t.filter((F.spark_partition_id() == 0) | (F.col("fold") != "f1")), source.coalesce(1)).collect()
    assert {r.fold for r in lost if not r.ok} == {"f1"}


def test_quantiles_of_continuous_values(spark):
    rng = random.Random(3)
    rows = [(g, rng.gauss(0, 10 ** g)) for g in range(3) for _ in range(700)] + [(7, 1.5), (8, None), (None, 2.0), (None, 4.0)] + [(9, 5.0)] * 300
    df = spark.createDataFrame(rows, "g int, value double").repartition(5)
    points = (0.0, 0.05, 0.5, 0.777, 1.0)
    got = {r.g: list(r)[1:] for r in summaries.quantiles(df, F.col("value"), points, ["g"], ["a", "b", "c", "d", "e"]).collect()}
    for g in (0, 1, 2, 7, 9, None):
        want = np.quantile([v for k, v in rows if k == g], points)
        assert np.allclose(got[g], want, rtol=1e-12)
    assert 8 not in got
    full = {r.g: r for r in summaries.describe(df, F.col("value"), ["g"]).collect()}
    assert full[8].n == 0 and full[8].median is None and full[None].median == 3.0 and full[9].n == 300


def pair(image, colours, h=8, w=9):
    return [(image, "d", h, w, y, x, colours(y, x)) for y in range(h) for x in range(w)]


def test_extraction_has_a_reason_for_every_rejected_pair(spark):
    red, blue, odd = 200 << 16, 200, (90 << 16) + (90 << 8) + 90
    halves = lambda y, x: red if x < 4 else blue
    px = pair(1, halves) + pair(2, lambda y, x: red) + pair(3, lambda y, x: odd if y < 3 else halves(y, x)) + pair(4, halves) + pair(5, halves) + pair(6, halves, h=10)
    mask = spark.createDataFrame(px, "image_id long, dataset string, height int, width int, y int, x int, rgb int")
    sizes = spark.createDataFrame([(i, "d", 9, 8, 9, 8) for i in (1, 2, 3, 4)] + [(5, "d", 20, 8, 9, 8), (6, "d", 9, 8, 9, 10)],
                                  "image_id long, dataset string, image_width int, image_height int, mask_width int, mask_height int")
    peaks = spark.createDataFrame([("d", 0, red, 10), ("d", 1, blue, 10)], "dataset string, idx int, rgb int, n long")
    status, outline = extract.extract_dataset(sizes, mask, excluded=sizes.filter("image_id = 4"), artifact=F.col("rgb") == blue, peaks=peaks, max_levels=2)
    got = {r.image_id: r for r in status.collect()}
    assert len(got) == 6
    assert {i: r.reason for i, r in got.items() if i != 5} == {1: None, 2: "single label", 3: "unsnapped pixels", 4: "excluded", 6: None}
    assert got[5].size_status == "rejected" and "20 x 8" in got[5].reason and got[6].size_status == "cropped"
    assert got[1].artifact_pixels == 40 and got[1].artifact_share == 1.0 and got[2].artifact_pixels is None
    assert {r.image_id for r in outline.select("image_id").distinct().collect()} == {1, 6}
    assert outline.filter("image_id = 6").agg(F.max("height")).first()[0] == 8  # cut to the common middle
    many, _ = extract.extract_dataset(sizes.filter("image_id = 1"), mask, peaks=peaks, max_levels=1)
    assert many.first().reason == "more levels than the palette may have"


def test_outline_colour_falls_back_to_the_candidate(spark):
    verdict = spark.createDataFrame([("a", "A", 5), ("b", "B", 6)], "dataset string, mode string, rgb int")
    candidate = spark.createDataFrame([("b", 9)], "dataset string, rgb int")
    assert {r.dataset: r.rgb for r in palette.outline_colour(verdict, candidate).collect()} == {"a": 5, "b": 9}
    with pytest.raises(checks.ValidationError, match="no outline colour"):
        palette.outline_colour(verdict)


def test_bitmap_bytes():
    raw = bitmap(np.array([[[1, 2, 3], [4, 5, 6]], [[7, 8, 9], [10, 11, 12]]], np.uint8))
    assert raw[:2] == b"BM" and len(raw) == 54 + 2 * 8 and raw[54:60] == bytes([9, 8, 7, 12, 11, 10])
