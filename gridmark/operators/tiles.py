"""Tile planning, pixel-to-tile coverage, padding, cropping and tile statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmark.operators.raster import KEYS


def positions(size: Column, patch: int, stride: int) -> Column:
    """Tile offsets along one axis; a close tail moves the last tile, a wide tail adds one."""
    if patch <= 0 or stride <= 0:
        raise ValueError(f"patch {patch} and stride {stride} must be positive")
    last = F.greatest(size - patch, F.lit(0))
    steps = F.sequence(F.lit(0), last, F.lit(stride))
    gap = last % stride
    return (F.when(size <= patch, F.array(F.lit(0)))
            .when(gap == 0, steps)
            .when(gap * 2 < stride, F.concat(F.slice(steps, F.lit(1), F.size(steps) - 1), F.array(last)))
            .otherwise(F.concat(steps, F.array(last))))


def padding(size: Column, patch: int) -> Column:
    return F.greatest(F.lit(patch) - size, F.lit(0))


def plan_tiles(images: DataFrame, patch: int, stride: int) -> DataFrame:
    """One row per planned tile of every image (columns ``width`` and ``height``)."""
    ys = images.withColumns({"pad_right": padding(F.col("width"), patch), "pad_bottom": padding(F.col("height"), patch),
                             "tile_y": F.explode(positions(F.col("height"), patch, stride))})
    return ys.withColumn("tile_x", F.explode(positions(F.col("width"), patch, stride)))


def covering(at: Column, size: Column, patch: int, stride: int) -> Column:
    """Offsets of all planned tiles that hold coordinate ``at``, by arithmetic alone.

    Replaces a range join: a pixel names its tiles itself, at most patch/stride + 1 per axis.
    """
    last = F.greatest(size - patch, F.lit(0))
    gap = last % stride
    moved = (gap > 0) & (gap * 2 < stride)
    hi = F.least(F.floor(at / stride), F.floor(last / stride) - moved.cast("int")).cast("int")
    lo = F.greatest(F.floor((at - patch) / stride) + 1, F.lit(0)).cast("int")
    regular = F.when(lo <= hi, F.transform(F.sequence(lo, F.greatest(lo, hi)), lambda k: k * stride)).otherwise(
        F.array().cast("array<int>"))
    tail = F.when((gap > 0) & (at >= last), F.array(last)).otherwise(F.array().cast("array<int>"))
    return F.when(size <= patch, F.array(F.lit(0))).otherwise(F.concat(regular, tail))


def tile_pixels(px: DataFrame, patch: int, stride: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Each pixel once per tile that holds it: adds ``tile_y, tile_x``."""
    rows = px.withColumn("tile_y", F.explode(covering(F.col("y"), F.col("height"), patch, stride)))
    return rows.withColumn("tile_x", F.explode(covering(F.col("x"), F.col("width"), patch, stride)))


def outline_fractions(mask: DataFrame, plan: DataFrame, patch: int, stride: int,
                       keys: Sequence[str] = KEYS) -> DataFrame:
    """Planned tiles with the share of their pixels that is outline, rounded to six places."""
    hits = tile_pixels(mask, patch, stride, keys).groupBy(*keys, "tile_y", "tile_x").agg(F.count("*").alias("hits"))
    share = F.round(F.coalesce("hits", F.lit(0)).cast("double") / (patch * patch), 6)
    return plan.join(hits, [*keys, "tile_y", "tile_x"], "left").withColumn("outline_fraction", share).drop("hits")


def keep_by_content(tiles: DataFrame, minimum: float = 0.005) -> DataFrame:
    return tiles.withColumn("kept", F.col("outline_fraction") >= minimum)


def lost_images(flagged: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Images whose only planned tile was dropped."""
    return (flagged.groupBy(*keys).agg(F.count("*").alias("planned"), F.sum(F.col("kept").cast("int")).alias("kept"))
            .filter("planned = 1 and kept = 0").select(*keys))


def crop(px: DataFrame, y0: Column, x0: Column, patch: int) -> DataFrame:
    """Half-open window rebased to the origin."""
    inside = (F.col("y") >= y0) & (F.col("y") < y0 + patch) & (F.col("x") >= x0) & (F.col("x") < x0 + patch)
    return px.filter(inside).withColumns({"y": F.col("y") - y0, "x": F.col("x") - x0,
                                          "height": F.lit(patch), "width": F.lit(patch)})


def _mirrors(at: Column, size: Column, pad: Column, symmetric: Column) -> Column:
    """All coordinates in [0, size + pad) that show source coordinate ``at``."""
    period = size * 2
    turns = F.sequence(F.lit(0), F.floor((size + pad) / period).cast("int"))
    both = F.flatten(F.transform(turns, lambda k: F.array(period * k + at, period * k + period - 1 - at)))
    once = F.array(at, (size - 1) * 2 - at)
    full = F.array_distinct(F.when(symmetric, both).otherwise(once))
    return F.filter(full, lambda c: (c < size + pad) & ((c >= size) | (c == at)))


def pad_reflect(px: DataFrame, patch: int) -> DataFrame:
    """Mirror an image to at least ``patch`` on the right and bottom.

    Every pixel emits its own mirror copies, so no missing coordinate has to be generated and
    joined.  Reflection without the edge, or with it on both axes where the pad reaches the size.
    """
    pad_b, pad_r = padding(F.col("height"), patch), padding(F.col("width"), patch)
    symmetric = (pad_b >= F.col("height")) | (pad_r >= F.col("width"))
    rows = px.withColumn("ny", F.explode(_mirrors(F.col("y"), F.col("height"), pad_b, symmetric)))
    rows = rows.withColumn("nx", F.explode(_mirrors(F.col("x"), F.col("width"), pad_r, symmetric)))
    return rows.withColumns({"y": F.col("ny"), "x": F.col("nx"), "height": F.col("height") + pad_b,
                             "width": F.col("width") + pad_r}).drop("ny", "nx")


def reconcile_size(pairs: DataFrame, tolerance: int = 2) -> DataFrame:
    """Status of each image and mask size pair and the centre crop that brings them together."""
    iw, ih, mw, mh = (F.col(c) for c in ("image_width", "image_height", "mask_width", "mask_height"))
    dw, dh = F.abs(iw - mw), F.abs(ih - mh)
    w, h = F.least(iw, mw), F.least(ih, mh)
    status = (F.when((dw == 0) & (dh == 0), "equal").when((dw > tolerance) | (dh > tolerance), "rejected")
              .otherwise("cropped"))
    ok = status != "rejected"

    def half(size: Column, common: Column) -> Column:
        return F.when(ok, F.floor((size - common) / 2).cast("int"))

    message = F.when(~ok, F.format_string("sizes differ: mask %d x %d, image %d x %d, apart by %d x %d where %d is allowed",
                                          mw, mh, iw, ih, dw, dh, F.lit(tolerance)))
    return pairs.withColumns({
        "status": status, "final_width": F.when(ok, w), "final_height": F.when(ok, h),
        "image_left": half(iw, w), "image_top": half(ih, h), "mask_left": half(mw, w), "mask_top": half(mh, h),
        "message": message})


def cache_estimate(images: DataFrame) -> DataFrame:
    """Bytes of a two-plane decoded cache per dataset and in total, each image counted once."""
    once = images.groupBy("dataset", "image_id").agg(F.max("width").alias("w"), F.max("height").alias("h"))
    size = F.sum(F.col("w").cast("bigint") * F.col("h") * 2).alias("bytes")
    rolled = once.groupingSets([["dataset"], []], "dataset").agg(size, F.count("*").alias("images"),
                                                                 F.grouping("dataset").alias("g"))
    return rolled.select(F.when(F.col("g") == 1, "__total__").otherwise(F.col("dataset")).alias("dataset"), "images",
                         "bytes", F.round(F.col("bytes") / 1048576.0, 3).alias("megabytes"))
