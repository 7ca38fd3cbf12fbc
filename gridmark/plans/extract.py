"""Outline extraction: from coloured masks to cleaned, uniform-width outline maps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmark.functions import colour
from gridmark.functions.scalars import safe_div
from gridmark.operators import components, palette, raster, regions, thinning, tiles
from gridmark.operators.profiles import artifact_overlap
from gridmark.operators.raster import KEYS, frame
from gridmark.session import cut


def clean_outline(raw: DataFrame, width: int, open_kernel: int = 3, close: bool = True, open_mode: str = "speckle",
                   keys: Sequence[str] = KEYS) -> dict[str, DataFrame]:
    """Despeckle, close, thin and grow to one width; the mask after every stage by name."""
    if open_mode not in ("speckle", "morph"):
        raise ValueError(f"open_mode must be 'speckle' or 'morph', got {open_mode!r}")
    stages = {"raw": cut(raw.select(*frame(keys)))}
    if open_mode == "speckle":
        stages["open"] = cut(components.despeckle(stages["raw"], open_kernel, keys))
    else:
        stages["open"] = cut(raster.opening(stages["raw"], keys)) if open_kernel > 1 else stages["raw"]
    stages["close"] = cut(raster.closing(stages["open"], keys)) if close else stages["open"]
    stages["skeleton"] = thinning.skeletonize(stages["close"], keys)
    stages["outline"] = cut(raster.dilate_to_width(stages["skeleton"], width, keys))
    return stages


def stage_fractions(stages: dict[str, DataFrame], images: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Foreground share of every image after every stage."""
    k, area = list(keys), F.col("height") * F.col("width")
    tagged = None
    for name, mask in stages.items():
        part = mask.select(*k, F.lit(name).alias("stage"))
        tagged = part if tagged is None else tagged.unionByName(part)
    counted = tagged.groupBy(*k).agg(*[F.sum((F.col("stage") == n).cast("bigint")).alias(f"px_{n}") for n in stages])
    j = images.select(*k, "height", "width").join(counted, k, "left").na.fill(0)
    return j.select(*k, *[safe_div(F.col(f"px_{n}"), area).alias(n) for n in stages])


def _labels_left(px: DataFrame, keys: Sequence[str]) -> DataFrame:
    return px.groupBy(*keys).agg((F.min("label") == F.max("label")).alias("flat"))


def _reject(judged: DataFrame, flags: DataFrame, flag: str, reason: str, keys: Sequence[str]) -> DataFrame:
    """Give images with a true flag the reason, unless they already have one."""
    j = judged.join(flags.select(*keys, flag), list(keys), "left")
    return j.withColumn("reason", F.coalesce("reason", F.when(F.col(flag), F.lit(reason)))).drop(flag)


def extract(mask_px: DataFrame, width: int = 2, min_region: int = 0, max_unsnapped: float = 0.02,
            watched: DataFrame | None = None, min_share: float = 0.002, merge_distance: float = 48.0,
            line_thickness: float | None = None, peaks: DataFrame | None = None, max_levels: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``(status, outline)`` for masks whose colours are phases.

    Per image: snap to the dataset palette, reject where too many pixels fit no colour, fold watched
    colours, absorb small regions, reject where one label is left, draw and clean the outline, and
    report an empty result.  With ``line_thickness`` the darkest class counts as a painted line; with
    ``max_levels`` a mask that shows more palette colours is rejected.  ``peaks`` is a palette to use
    in place of the one these masks give.  Every image gets a status row; only accepted ones get an outline.
    """
    keys = ("image_id", "dataset")
    mask_px = cut(mask_px.select(*frame(keys), "rgb"))
    if peaks is None:
        peaks = palette.derive_palette(palette.pooled_shares(palette.colour_counts(mask_px, keys)), min_share, merge_distance)
    peaks = cut(peaks)
    snapped = cut(palette.snap_to_palette(mask_px, peaks))
    judged = palette.unsnapped_share(snapped, peaks, keys).withColumn(
        "reason", F.when(F.col("unsnapped") > max_unsnapped, "unsnapped pixels"))
    if max_levels is not None:
        shown = snapped.groupBy(*keys).agg((F.count_distinct("label") > max_levels).alias("many"))
        judged = _reject(judged, shown, "many", "more levels than the palette may have", keys)
    px = palette.fold_colours(snapped, peaks, watched, True) if watched is not None else snapped
    px = px.select(*frame(keys), "label")
    judged = cut(_reject(judged, _labels_left(px, keys), "flat", "single label", keys))
    px = px.join(judged.filter("reason is null").select(*keys), list(keys), "left_semi")
    if min_region > 0:
        px = cut(regions.merge_small_regions(px, min_region, keys=keys))
        judged = cut(_reject(judged, _labels_left(px, keys), "flat", "merged to a single label", keys))
        px = px.join(judged.filter("reason is null").select(*keys), list(keys), "left_semi")
    if line_thickness is None:
        raw = raster.find_outlines(px, keys=keys)
    else:
        raw = regions.line_class_outline(px, regions.line_class(peaks), line_thickness, keys)
    return _finish(raw, judged, mask_px, width, keys)


def extract_dataset(sizes: DataFrame, mask_px: DataFrame, tolerance: int = 2, excluded: DataFrame | None = None, artifact: Column | None = None,
                    **settings) -> tuple[DataFrame, DataFrame]:
    """``(status, outline)`` of all image and mask pairs of ``sizes``, from their sizes to the artifact check.

    ``sizes(image_id, dataset, image_width, image_height, mask_width, mask_height)``.  Pairs listed in
    ``excluded (image_id, dataset)`` and pairs whose sizes differ by more than ``tolerance`` are not read
    further; masks that differ by less are cut to the common middle.  The rest goes through
    :func:`extract` with ``settings``.  ``artifact`` says which mask pixels show a watched colour: accepted
    images get their number and the outline's share on or beside them.  Every pair has one status row, with
    the first reason that applies.
    """
    keys = ("image_id", "dataset")
    k = list(keys)
    listed = tiles.reconcile_size(sizes.select(*k, "image_width", "image_height", "mask_width", "mask_height"), tolerance)
    listed = listed.withColumnRenamed("status", "size_status")
    if excluded is not None:
        listed = listed.join(excluded.select(*k, F.lit("excluded").alias("out")).distinct(), k, "left")
    else:
        listed = listed.withColumn("out", F.lit(None).cast("string"))
    listed = cut(listed.withColumn("early", F.coalesce("out", "message")))
    window = listed.filter("early is null").select(*k, "mask_left", "mask_top", "final_width", "final_height")
    y, x = F.col("y") - F.col("mask_top"), F.col("x") - F.col("mask_left")
    hit = artifact if artifact is not None else F.lit(False)
    px = mask_px.withColumn("hit", F.coalesce(hit, F.lit(False))).join(window, k).withColumns({"y": y, "x": x, "height": F.col("final_height"), "width": F.col("final_width")})
    px = cut(px.filter((F.col("y") >= 0) & (F.col("x") >= 0) & (F.col("y") < F.col("height")) & (F.col("x") < F.col("width"))).select(*frame(keys), "rgb", "hit"))
    status, outline = extract(px.drop("hit"), **settings)
    outline = outline.join(status.filter("status = 'ok'").select(*k), k, "left_semi")
    seen = artifact_overlap(px, outline, keys).select(*k, F.col("pixels").alias("artifact_pixels"), F.col("share_of_outline").alias("artifact_share"))
    found = status.join(seen, k, "left")
    rest = [c for c in found.columns if c not in (*keys, "reason", "status")]
    ok = F.col("status") == "ok"
    out = listed.select(*k, "size_status", "early").join(found, k, "left")
    keep = [F.when(ok, F.col(c)).alias(c) if c not in ("unsnapped",) else F.col(c) for c in rest]
    return out.select(*k, "size_status", F.coalesce("early", "reason").alias("reason"), F.coalesce("status", F.lit("rejected")).alias("status"), *keep), outline


def extract_painted(mask_px: DataFrame, windows: DataFrame, width: int = 2) -> tuple[DataFrame, DataFrame]:
    """``(status, outline)`` for masks whose outline is painted: pixels inside the HSV window."""
    keys = ("image_id", "dataset")
    mask_px = cut(mask_px.select(*frame(keys), "rgb"))
    rgb = F.col("rgb")
    c = colour.hsv_bytes(colour.red(rgb), colour.green(rgb), colour.blue(rgb))
    hit = colour.in_window(c["h"], c["s"], c["v"], F.col("lower"), F.col("upper"))
    raw = mask_px.join(windows.select("dataset", "lower", "upper"), "dataset").filter(hit).select(*frame(keys))
    judged = mask_px.filter("y = 0 and x = 0").select(*keys, F.lit(0.0).alias("unsnapped"), F.lit(None).cast("string").alias("reason"))
    return _finish(raw, judged, mask_px, width, keys)


def _finish(raw: DataFrame, judged: DataFrame, mask_px: DataFrame, width: int, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    stages = clean_outline(raw, width, keys=keys)
    images = mask_px.filter("y = 0 and x = 0").select(*keys, "height", "width")
    j = judged.join(stage_fractions(stages, images, keys), list(keys))
    reason = F.coalesce("reason", F.when(F.col("outline") == 0, "cleaned outline is empty"))
    status = j.withColumn("reason", reason).withColumn("status", F.when(F.col("reason").isNull(), "ok").otherwise("rejected"))
    return status, stages["outline"]
