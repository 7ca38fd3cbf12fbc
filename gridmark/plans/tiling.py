"""Tile index: paired, planned, measured, filtered tiles with the status of everything left out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmark.functions.names import file_name, parent_id, stem, tile_id
from gridmark.operators import tiles


def build_index(pairs: DataFrame, mask_px: DataFrame, patch: int, stride: int, rules: Mapping[str, str] | None = None,
                minimum: float = 0.005, excluded: DataFrame | None = None) -> DataFrame:
    """All planned tiles of ``pairs(image_id, dataset, image_path, width, height)`` with ``kept``.

    Images named in ``excluded (dataset, source_image)`` are not planned.
    """
    if excluded is not None:
        pairs = pairs.withColumn("source_image", file_name(F.col("image_path"))).join(excluded, ["dataset", "source_image"], "left_anti").drop("source_image")
    plan = tiles.plan_tiles(pairs, patch, stride)
    measured = tiles.outline_fractions(mask_px, plan, patch, stride)
    s = stem(F.col("image_path"))
    out = tiles.keep_by_content(measured, minimum)
    return out.select(tile_id(F.col("dataset"), s, F.col("tile_x"), F.col("tile_y")).alias("tile_id"), "dataset",
                      parent_id(F.col("dataset"), s, rules or {}).alias("parent_id"), file_name(F.col("image_path")).alias("source_image"),
                      F.col("tile_x").alias("x"), F.col("tile_y").alias("y"), "outline_fraction", F.lit(patch).alias("patch"),
                      "pad_right", "pad_bottom", "kept")


def index_status(index: DataFrame) -> DataFrame:
    """Per dataset: planned, kept and dropped tiles, parents of the kept ones, images lost whole."""
    per = index.groupBy("dataset", "parent_id", "source_image").agg(
        F.count("*").alias("planned"), F.sum(F.col("kept").cast("bigint")).alias("kept"))
    parents = per.groupBy("dataset", "parent_id").agg(F.sum("planned").alias("planned"), F.sum("kept").alias("kept"),
                                                      F.sum(((F.col("kept") == 0) & (F.col("planned") == 1)).cast("bigint")).alias("lost"))
    return parents.groupBy("dataset").agg(
        F.sum("planned").alias("planned"), F.sum("kept").alias("kept"), (F.sum("planned") - F.sum("kept")).alias("dropped"),
        F.sum((F.col("kept") > 0).cast("bigint")).alias("parents"), F.sum("lost").alias("images_lost"))


def index_report(pairs: DataFrame, index: DataFrame, expected: DataFrame, single_tile: Sequence[str] = ()) -> DataFrame:
    """:func:`index_status` of every dataset of ``pairs`` beside what was asked of it.

    ``excluded`` are images that were not planned, ``parents_ok`` compares the parents of kept tiles with
    ``expected (dataset, parents)`` (null: nothing is expected), ``single_ok`` says of datasets that come
    as tiles already that no image has more than one.
    """
    named = pairs.select("dataset", file_name(F.col("image_path")).alias("source_image"))
    per = index.groupBy("dataset", "source_image").agg(F.count("*").alias("tiles"))
    seen = named.join(per, ["dataset", "source_image"], "left").groupBy("dataset").agg(
        F.count("*").alias("images"), F.sum(F.col("tiles").isNull().cast("bigint")).alias("excluded"), F.max("tiles").alias("most"))
    out = seen.join(index_status(index), "dataset", "left").na.fill(0).join(expected.select("dataset", F.col("parents").alias("wanted")), "dataset", "left")
    return out.select("dataset", "images", "excluded", "planned", "kept", "dropped", "parents", "images_lost", (F.col("parents") == F.col("wanted")).alias("parents_ok"),
                      F.when(F.col("dataset").isin(*single_tile), F.col("most") <= 1).alias("single_ok"))


def parent_count_mismatch(index: DataFrame, expected: Mapping[str, int]) -> DataFrame:
    """Datasets whose parent count is not the expected one (must be empty)."""
    want = F.create_map(*[x for d, n in expected.items() for x in (F.lit(d), F.lit(n))])
    have = index.filter("kept").select("dataset", "parent_id").distinct().groupBy("dataset").agg(F.count("*").alias("parents"))
    return have.filter(F.col("parents") != F.try_element_at(want, F.col("dataset")))
