"""Colour histograms, palettes, snapping and audit votes on pixel colours (packed ``rgb``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridmark.functions import colour
from gridmark.operators.checks import require_none
from gridmark.operators.raster import KEYS
from gridmark.operators.sampling import first_per_group
from gridmark.session import cut

# ---- fixed values of the audit ----
TOP_COLOURS = 20
MAX_LABELS = 32
QUANTIZED_COVERAGE = 0.995
QUANTIZED_MAX_COLOURS = 512
MIN_COLOUR_PIXELS = 64
MAX_TESTED_COLOURS = 64
FILE_QUORUM = 0.60
MAX_THICKNESS = 4.0
MIN_SPAN = 0.50
MIN_SKELETON_SPANS = 2.0
# ---- end of fixed values ----


def colour_counts(px: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Exact colour histogram per image; pixels fold on the map side."""
    return px.groupBy(*keys, "rgb").agg(F.count("*").alias("n"))


def top_colours(counts: DataFrame, n: int = TOP_COLOURS, group: Sequence[str] = KEYS) -> DataFrame:
    """Most frequent colours per group, ties by colour; the rank limit is applied before the shuffle."""
    return first_per_group(counts, n, [F.col("n").desc(), "rgb"], group)


def palette_report(counts: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Distinct colours, coverage of the 32 most frequent, and whether the image is quantized."""
    whole = counts.groupBy(*keys).agg(F.count("*").alias("n_unique"), F.sum("n").alias("pixels"))
    head = top_colours(counts, MAX_LABELS, keys).groupBy(*keys).agg(F.sum("n").alias("head"))
    coverage = F.col("head") / F.col("pixels")
    quantized = (F.col("n_unique") <= MAX_LABELS) | (
        (coverage >= QUANTIZED_COVERAGE) & (F.col("n_unique") <= QUANTIZED_MAX_COLOURS))
    return whole.join(head, list(keys)).select(*keys, "n_unique", "pixels", coverage.alias("coverage"),
                                               quantized.alias("quantized"))


def pooled_shares(counts: DataFrame, group: Sequence[str] = ("dataset",)) -> DataFrame:
    """Share of every colour over all pixels of a group, via per-group totals joined back."""
    pooled = counts.groupBy(*group, "rgb").agg(F.sum("n").alias("n"))
    total = counts.groupBy(*group).agg(F.sum("n").alias("total"))
    return pooled.join(total, list(group)).select(*group, "rgb", "n", (F.col("n") / F.col("total")).alias("share"))


def pooled_palette(counts: DataFrame, group: Sequence[str] = ("dataset",), keys: Sequence[str] = KEYS) -> DataFrame:
    """Top colours of each image summed per group; fraction is over those pooled pixels."""
    tops = top_colours(counts, TOP_COLOURS, keys)
    return top_colours(pooled_shares(tops, group), TOP_COLOURS, group)


def derive_palette(shares: DataFrame, min_share: float = 0.002, merge_distance: float = 48.0,
                   group: Sequence[str] = ("dataset",)) -> DataFrame:
    """``(group, idx, rgb, share)``: colours walked by share, kept if far from every kept one.

    The share floor admits at most 1/min_share colours per group, so the walk is an ordered fold
    over one short array.
    """
    if min_share <= 0:
        raise ValueError("min_share must be positive: it bounds the palette walk")
    held = shares.filter(F.col("share") >= min_share)
    entry = F.struct((-F.col("share")).alias("k"), F.col("rgb"), F.col("share"))
    walk = held.groupBy(*group).agg(F.array_sort(F.collect_list(entry)).alias("walk"))
    limit = merge_distance * merge_distance
    start = F.array().cast("array<struct<k:double,rgb:int,share:double>>")

    def keep(kept: Column, c: Column) -> Column:
        far = F.forall(kept, lambda p: colour.distance2(p.getField("rgb"), c.getField("rgb")) > limit)
        return F.when(far, F.concat(kept, F.array(c))).otherwise(kept)

    peaks = walk.select(*group, F.aggregate("walk", start, keep).alias("peaks"))
    return peaks.select(*group, F.posexplode("peaks").alias("idx", "p")).select(
        *group, "idx", F.col("p.rgb").alias("rgb"), F.col("p.share").alias("share"))


def palette_arrays(palette: DataFrame, group: Sequence[str] = ("dataset",)) -> DataFrame:
    """The palette of each group as one array ordered by index (at most 1/min_share entries)."""
    return palette.groupBy(*group).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("idx", "rgb"))), lambda p: p.getField("rgb")).alias("palette"))


def _nearest(rgb: Column, palette: Column) -> Column:
    return F.array_min(F.transform(palette, lambda p, i: F.struct(colour.distance2(rgb, p).alias("d2"), i.alias("idx"))))


def nearest_colours(colours: DataFrame, arrays: DataFrame, group: Sequence[str] = ("dataset",)) -> DataFrame:
    """``(group, rgb, label, d2)`` of every distinct colour: nearest palette entry, ties to the lowest index."""
    hit = _nearest(F.col("rgb"), F.col("palette"))
    return (colours.select(*group, "rgb").distinct().join(arrays, list(group)).withColumn("hit", hit)
            .select(*group, "rgb", F.col("hit.idx").alias("label"), F.col("hit.d2").alias("d2")))


def snap_to_palette(px: DataFrame, palette: DataFrame, group: Sequence[str] = ("dataset",)) -> DataFrame:
    """Pixels with the index of the nearest palette colour.

    The distance search runs once per distinct colour, not per pixel; the colour map is written and
    joins back by equality, so its measured size decides between broadcast and a shuffle, in which
    adaptive execution splits a dominant colour.
    """
    mapped = cut(nearest_colours(px, palette_arrays(palette, group), group))
    return px.join(mapped, [*group, "rgb"])


def palette_gap(palette: DataFrame, group: Sequence[str] = ("dataset",)) -> DataFrame:
    """Smallest squared distance between two palette entries of a group."""
    arrays = palette_arrays(palette, group)
    each = arrays.select(*group, "palette", F.posexplode("palette").alias("i", "c"))
    near = F.array_min(F.filter(F.transform("palette", lambda p, j: F.when(
        j != F.col("i"), colour.distance2(p, F.col("c")))), lambda v: v.isNotNull()))
    return each.groupBy(*group).agg(F.min(near).alias("gap2"))


def unsnapped_share(snapped: DataFrame, palette: DataFrame, keys: Sequence[str] = KEYS,
                    group: Sequence[str] = ("dataset",)) -> DataFrame:
    """Share of an image's pixels further than half the smallest palette gap from their colour."""
    dims = list(dict.fromkeys((*keys, *group)))
    tally = snapped.groupBy(*dims, "d2").agg(F.count("*").alias("n")).join(palette_gap(palette, group), list(group), "left")
    far = F.col("d2") * 4 > F.col("gap2")
    return tally.groupBy(*dims).agg(
        (F.sum(F.when(far, F.col("n")).otherwise(0)) / F.sum("n")).alias("unsnapped"))


def label_map(px: DataFrame, keys: Sequence[str] = KEYS, max_labels: int = MAX_LABELS) -> DataFrame:
    """Labels by nearest of an image's own most frequent colours (exact when it has few)."""
    counts = colour_counts(px, keys)
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.col("n").desc(), "rgb")) - 1
    top = top_colours(counts, max_labels, keys).withColumn("idx", rank)
    return px.join(cut(nearest_colours(counts, palette_arrays(top, keys), keys)), [*keys, "rgb"])


def test_order(counts: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Which colours of an image are tested: not the majority, not tiny, not past the cap.

    Ranks beyond the cap are all the same answer, so only the head of each image is ranked.
    """
    head = top_colours(counts, MAX_TESTED_COLOURS + 1, keys)
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.col("n").desc(), "rgb"))
    ranked = head.select(*keys, "rgb", rank.alias("place"))
    place, n = F.col("place"), F.col("n")
    status = (F.when(place == 1, "majority").when(n < MIN_COLOUR_PIXELS, "too small")
              .when(place.isNull() | (place > MAX_TESTED_COLOURS + 1), "past cap").otherwise("tested"))
    return counts.join(ranked, [*keys, "rgb"], "left").withColumn("status", status).drop("place")


def line_tests(shapes: DataFrame) -> DataFrame:
    """Thin, spanning and extensive flags of colour shapes, and whether all hold."""
    thin = F.coalesce(F.col("mean_thickness_px") <= MAX_THICKNESS, F.lit(False))
    return shapes.withColumns({
        "thin": thin, "spanning": F.col("span") >= MIN_SPAN, "extensive": F.col("skeleton_spans") >= MIN_SKELETON_SPANS,
    }).withColumn("qualifies", F.col("thin") & F.col("spanning") & F.col("extensive"))


MEASURES = ("fraction", "mean_thickness_px", "skeleton_to_area", "skeleton_spans", "span", "n_components")


def tally_colours(tests: DataFrame, group: Sequence[str] = ("dataset",)) -> DataFrame:
    """Votes and measure summaries per colour over the sampled files (a bounded number per group)."""
    def fails(flag: str) -> Column:
        return F.sum((~F.col(flag)).cast("bigint")).alias(f"failed_{flag}")

    stats = []
    for m in MEASURES:
        v = F.col(m).cast("double")
        stats += [F.min(v).alias(f"{m}_min"), F.median(v).alias(f"{m}_median"), F.max(v).alias(f"{m}_max"),
                  F.count(v).alias(f"{m}_n")]
    return tests.groupBy(*group, "rgb").agg(
        F.count("*").alias("files_present"), F.sum(F.col("qualifies").cast("bigint")).alias("files_qualifying"),
        fails("thin"), fails("spanning"), fails("extensive"), *stats)


def vote_order() -> Column:
    return F.struct((-F.col("files_qualifying")).alias("a"),
                    F.coalesce("mean_thickness_px_median", F.lit(1e9)).alias("b"), F.col("rgb").alias("c"))


def mode_verdict(tally: DataFrame, files: DataFrame, group: Sequence[str] = ("dataset",)) -> DataFrame:
    """Verdict per dataset: A where some colour qualifies in the quorum of sampled files.

    ``files(group, n_files)``; the winner is the first colour by votes, then thinness.
    """
    win = F.min_by(F.struct("rgb", "files_qualifying"), vote_order()).alias("w")
    best = tally.groupBy(*group).agg(win)
    j = files.join(best, list(group), "left")
    passes = F.coalesce(F.col("w.files_qualifying") >= F.col("n_files") * FILE_QUORUM, F.lit(False))
    return j.select(*group, "n_files", F.when(passes, "A").otherwise("B").alias("mode"), F.col("w.rgb").alias("rgb"),
                    F.coalesce("w.files_qualifying", F.lit(0)).alias("files_qualifying"))


def votes(df: DataFrame, value: str, group: Sequence[str] = ("dataset",)) -> DataFrame:
    """Value counts as a map plus the majority value (ties to the lowest value)."""
    counted = df.groupBy(*group, value).agg(F.count("*").alias("n"))
    return counted.groupBy(*group).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(value).alias("k"), F.col("n").alias("v"))))).alias("votes"),
        F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias("majority"))


def hsv_window(px: DataFrame, lo: float = 0.02, hi: float = 0.98, group: Sequence[str] = ("dataset",)) -> DataFrame:
    """Percentile window of H, S and V over pixels of the outline colour.

    Hue is circular: when it spreads over more than 90 it is shifted by 90, taken again and
    shifted back.  All inputs are bytes, so tallies bound the percentile state to 256 values.
    """
    from gridmark.functions.colour import hsv_bytes

    parts = hsv_bytes(colour.red(F.col("rgb")), colour.green(F.col("rgb")), colour.blue(F.col("rgb")))
    tally = px.groupBy(*group, "rgb").agg(F.count("*").alias("n")).withColumns(parts)
    tally = tally.withColumn("turned", F.pmod(F.col("h") + 90, F.lit(180)))

    def q(column: str) -> Column:
        return F.percentile(F.col(column), F.array(F.lit(lo), F.lit(hi)), F.col("n"))

    rows = tally.groupBy(*group).agg(*[q(c).alias(c) for c in ("h", "s", "v", "turned")], F.sum("n").alias("n_pixels"))
    wraps = (F.get("h", F.lit(1)) - F.get("h", F.lit(0))) > 90

    def edge(i: int) -> Column:
        turned = F.pmod(F.get("turned", F.lit(i)) - 90, F.lit(180.0))
        return F.array(F.when(wraps, turned).otherwise(F.get("h", F.lit(i))), F.get("s", F.lit(i)), F.get("v", F.lit(i)))

    return rows.select(*group, "n_pixels", wraps.alias("wraps_hue"), edge(0).alias("lower"), edge(1).alias("upper"))


def outline_colour(verdict: DataFrame, candidate: DataFrame | None = None, group: Sequence[str] = ("dataset",)) -> DataFrame:
    """``(group, rgb)``: the colour that passed the audit, else the dataset's ``candidate (group, rgb)``; a dataset with neither is an error."""
    named = verdict.select(*group, F.when(F.col("mode") == "A", F.col("rgb")).alias("passed"))
    if candidate is not None:
        named = named.join(candidate.select(*group, F.col("rgb").alias("else_")), list(group), "left")
    else:
        named = named.withColumn("else_", F.lit(None).cast("int"))
    found = named.select(*group, F.coalesce("passed", "else_").alias("rgb"))
    require_none(found.filter("rgb is null").select(*group), "no outline colour: none passed the audit and no candidate is given")
    return found


def outline_window(mask_px: DataFrame, verdict: DataFrame, candidate: DataFrame | None = None, group: Sequence[str] = ("dataset",)) -> DataFrame:
    """:func:`hsv_window` of the pixels that have the outline colour of their dataset's audit."""
    return hsv_window(mask_px.join(outline_colour(verdict, candidate, group), [*group, "rgb"], "left_semi"), group=group)


def fold_colours(px: DataFrame, palette: DataFrame, watched: DataFrame, enabled: bool,
                 group: Sequence[str] = ("dataset",)) -> DataFrame:
    """Labels whose palette colour is watched become label 0 when folding is on (index 0 stays)."""
    if not enabled:
        return px
    fold = (palette.join(watched.select(*group, "rgb").distinct(), [*group, "rgb"]).filter("idx <> 0")
            .select(*group, F.col("idx").alias("label"), F.lit(True).alias("fold")))
    return px.join(cut(fold), [*group, "label"], "left").withColumn(
        "label", F.when(F.col("fold"), 0).otherwise(F.col("label"))).drop("fold")
