"""Shape, size and endpoint profiles of classes, regions and outlines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmark.functions.scalars import safe_div
from gridmark.operators import components, distance
from gridmark.operators.raster import KEYS, SQUARE, dilate, frame
from gridmark.operators.summaries import describe, quantiles, tally
from gridmark.session import cut

AREA_POINTS = (5, 10, 25, 50, 75, 90, 95, 99)
AREA_LIMITS = (10, 25, 50, 100)


def artifact_overlap(px: DataFrame, outline: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Is the watched colour (boolean ``hit``) present, and how much outline lies on it or its ring?"""
    k = list(keys)
    present = px.groupBy(*k).agg(F.sum(F.col("hit").cast("bigint")).alias("pixels"), F.count("*").alias("px"))
    near = dilate(px.filter("hit").select(*frame(keys)), SQUARE, keys).select(*k, "y", "x", F.lit(1).alias("near"))
    touched = outline.select(*k, "y", "x").join(near, [*k, "y", "x"], "left").groupBy(*k).agg(
        F.count("*").alias("outline_px"), F.count("near").alias("outline_pixels_on_outline"))
    j = present.join(touched, k, "left").na.fill(0, ["outline_px", "outline_pixels_on_outline"])
    return j.select(*k, (F.col("pixels") > 0).alias("present"), "pixels", safe_div(F.col("pixels"), F.col("px")).alias("fraction"),
                    "outline_pixels_on_outline",
                    safe_div(F.col("outline_pixels_on_outline"), F.col("outline_px")).alias("share_of_outline"))


def artifact_rollup(per_image: DataFrame, group: str = "dataset", places: int = 6) -> DataFrame:
    """Images with the artifact, images checked, and the spread of the outline's share on it, per group."""
    files = per_image.groupBy(group).agg(F.sum(F.col("present").cast("bigint")).alias("files_present"), F.count("*").alias("files_checked"))
    spread = describe(per_image, F.col("share_of_outline"), [group], places)
    return files.join(spread.select(group, *[F.col(c).alias(f"share_{c}") for c in ("min", "median", "max")]), group, "left")


def label_map_stats(px: DataFrame, label: str = "label", keys: Sequence[str] = KEYS) -> DataFrame:
    """Per label: pixels, share, 4-connected components with area range; structure of the majority."""
    k = list(keys)
    runs = components.label_runs(px, 4, label, keys)
    sizes = components.component_sizes(runs, label, keys)
    per = sizes.groupBy(*k, label).agg(
        F.sum("area").alias("px"), F.count("*").alias("n_components"), F.min("area").cast("double").alias("amin"),
        F.median("area").cast("double").alias("amed"), F.max("area").cast("double").alias("amax"))
    per = cut(per)
    whole = per.groupBy(*k).agg(F.sum("px").alias("all_px"),
                                F.max_by(label, F.struct(F.col("px"), -F.col(label))).alias("majority"))
    is_major = F.col(label) == F.col("majority")
    shape = F.when(is_major, F.when(F.col("n_components") <= 1, "islands").otherwise("tessellation"))
    return per.join(whole, k).select(*k, label, "px", (F.col("px") / F.col("all_px")).alias("fraction"), "n_components", "amin",
                                     "amed", "amax", is_major.alias("is_majority"), shape.alias("structure"))


def region_size_profile(areas: DataFrame, group: Sequence[str] = ("dataset",), keys: Sequence[str] = KEYS) -> DataFrame:
    """Regions per tile, area percentiles and how many regions fall below each area limit."""
    g = list(group)
    per_tile = areas.groupBy(*g, *keys).agg(F.count("*").alias("c"))
    tiles = per_tile.groupBy(*g, "c").agg(F.count("*").alias("n")).groupBy(*g).agg(
        (F.sum(F.col("c") * F.col("n")) / F.sum("n")).alias("regions_mean"), F.percentile("c", 0.5, F.col("n")).alias("regions_median"),
        F.min("c").alias("regions_min"), F.max("c").alias("regions_max"), F.sum("n").alias("tiles"))
    below = [F.sum(F.when(F.col("v") < t, F.col("n")).otherwise(0)).alias(f"below_{t}") for t in AREA_LIMITS]
    sizes = quantiles(areas, F.col("area"), [p / 100 for p in AREA_POINTS], g, [f"p{p}" for p in AREA_POINTS],
                      extra=[F.sum("n").alias("n_regions"), *below])
    shares = {f"below_{t}_fraction": safe_div(F.col(f"below_{t}"), F.col("n_regions")) for t in AREA_LIMITS}
    return sizes.join(tiles, g).withColumns(shares)


def endpoint_profile(counts: DataFrame, group: Sequence[str] = ("dataset",)) -> DataFrame:
    """Endpoints per tile (columns ``ends``, ``skeleton_px``): spread, share without, per 1000 pixels."""
    g = list(group)
    t = counts.groupBy(*g, "ends").agg(F.count("*").alias("n"), F.sum("skeleton_px").alias("s"))
    return t.groupBy(*g).agg(
        F.sum("n").alias("tiles"), F.round(F.sum(F.col("ends") * F.col("n")) / F.sum("n"), 6).alias("mean"),
        F.round(F.percentile("ends", 0.5, F.col("n")), 6).alias("median"), F.round(F.percentile("ends", 0.95, F.col("n")), 6).alias("p95"),
        F.max("ends").alias("max"), F.round(F.sum(F.when(F.col("ends") == 0, F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("share_without"),
        F.round(safe_div(F.sum(F.col("ends") * F.col("n")) * 1000, F.sum("s")), 6).alias("per_1000"))


def colour_geometry(px: DataFrame, colour: str = "rgb", keys: Sequence[str] = KEYS) -> DataFrame:
    """Per image and colour: area, share, skeleton length, thickness, components, span, frame lengths.

    All colours of all images are thinned and labelled in the same passes; the colour is a key.
    """
    from gridmark.operators.thinning import skeletonize

    k = [*keys, colour]
    px = cut(px.select(*frame(k)))
    # min/max of run ends give the box; nothing here needs the mask gathered per colour
    box = px.groupBy(*k, "height", "width").agg(
        F.count("*").alias("pixels"),
        ((F.max("y") - F.min("y") + 1) * (F.max("x") - F.min("x") + 1)).alias("bbox"))
    skeleton = skeletonize(px, k).groupBy(*k).agg(F.count("*").alias("skeleton_pixels"))
    parts = components.component_sizes(components.label_runs(px, 8, keys=k), keys=k).groupBy(*k).agg(F.count("*").alias("n_components"))
    j = box.join(skeleton, k, "left").join(parts, k).na.fill(0, ["skeleton_pixels"])
    area = (F.col("height") * F.col("width")).cast("double")
    sk = F.col("skeleton_pixels")
    return j.select(*k, "pixels", (F.col("pixels") / area).alias("fraction"), "skeleton_pixels",
                    F.when(sk > 0, sk / F.col("pixels")).alias("skeleton_to_area"), F.when(sk > 0, F.col("pixels") / sk).alias("mean_thickness_px"),
                    "n_components", (F.col("bbox") / area).alias("span"), (sk / F.greatest("height", "width")).alias("skeleton_spans"))


def class_widths(px: DataFrame, mask: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """``(keys, y, x, d2)`` at the skeleton of a boolean class column."""
    from gridmark.operators.thinning import skeletonize

    return distance.skeleton_widths(px, mask, skeletonize(px.filter(F.col(mask)), keys), keys)


def class_shape_profile(px: DataFrame, mask: str, group: Sequence[str] = ("dataset",), thin: float = 8.0, grey: str | None = None,
                        keys: Sequence[str] = KEYS, widths: DataFrame | None = None) -> DataFrame:
    """Shape of a class pooled over the images of a group: raw values are pooled, never averages.

    ``group`` columns must be constant per image; pass a group that identifies the image for the
    single-image profile.  ``widths`` are those of :func:`class_widths` where a caller has them.
    """
    g = list(group)
    k = list(dict.fromkeys((*keys, *g)))
    px = cut(px)
    widths = class_widths(px, mask, k) if widths is None else widths
    w = F.sqrt(F.col("d2").cast("double")) * 2
    spread = tally(widths, w, g).groupBy(*g).agg(
        F.percentile("v", F.array(F.lit(0.5), F.lit(0.95)), F.col("n")).alias("q"), F.sum("n").alias("n_skeleton_px"),
        (F.sum(F.when(F.col("v") < thin, F.col("n")).otherwise(0)) / F.sum("n")).alias("share_thin"))
    sizes = components.component_sizes(components.label_runs(px.filter(F.col(mask)), 8, keys=k), keys=k)
    per_image = sizes.groupBy(*k).agg(F.max("area").alias("largest"), F.count("*").alias("parts"))
    comps = per_image.groupBy(*g).agg(F.sum("largest").alias("largest"), F.sum("parts").alias("n_components"))
    value = F.col(grey).cast("double") if grey else F.lit(None).cast("double")
    inside = F.col(mask)
    base = px.groupBy(*g).agg(F.count("*").alias("px"), F.sum(inside.cast("bigint")).alias("class_px"),
                              F.avg(F.when(inside, value)).alias("mean_inside"), F.avg(F.when(~inside, value)).alias("mean_outside"))
    j = base.join(spread, g, "left").join(comps, g, "left")
    return j.select(*g, "class_px", safe_div(F.col("class_px"), F.col("px")).alias("pixel_share"), F.get("q", F.lit(0)).alias("width_p50"),
                    F.get("q", F.lit(1)).alias("width_p95"), "share_thin", F.coalesce("n_skeleton_px", F.lit(0)).alias("n_skeleton_px"),
                    F.when(F.col("class_px") > 0, F.col("largest") / F.col("class_px")).alias("largest_cc_share"),
                    F.coalesce("n_components", F.lit(0)).alias("n_components"), "mean_inside", "mean_outside")


def threshold_sensitivity(px: DataFrame, grey: str, cuts: Sequence[float], thin: float = 8.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """The class profile of 'darker than the cut' for every cut, plus skeleton length per image.

    Pixels are exploded over the cuts once and the cut is a key, so one set of passes serves all.
    """
    cuts_ = F.explode(F.array(*[F.lit(c) for c in cuts]))
    k = [*keys, "dataset", "cut"]
    each = px.withColumn("cut", cuts_)
    each = cut(each.select(*frame(k), grey, (F.col(grey) < F.col("cut")).alias("dark")))
    widths = cut(class_widths(each, "dark", k))
    out = class_shape_profile(each, "dark", ("dataset", "cut"), thin, grey, k, widths)
    lengths = widths.groupBy(*k).agg(F.count("*").alias("length"))
    images = each.filter("y = 0 and x = 0").select(*k).join(lengths, k, "left").na.fill(0, ["length"])
    per = images.groupBy("dataset", "cut", "length").agg(F.count("*").alias("n")).groupBy("dataset", "cut").agg(
        (F.sum(F.col("length") * F.col("n")) / F.sum("n")).alias("skeleton_mean"), F.percentile("length", 0.5, F.col("n")).alias("skeleton_median"))
    return out.join(per, ["dataset", "cut"])
