"""Region partitions of outline masks and label maps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmark.functions.scalars import safe_div
from gridmark.operators import components, distance
from gridmark.operators.raster import KEYS, PLUS, find_outlines, frame, scatter
from gridmark.session import cut


def regions_from_outline(px: DataFrame, outline: str = "outline", connectivity: int = 4,
                          keys: Sequence[str] = KEYS) -> DataFrame:
    """Partition implied by an outline: connected background, grown into the outline by nearest.

    Background is labelled 4-connected so that a diagonal outline cannot leak; ties in the growth
    go to the lowest region; an image that is all outline is one region.
    """
    k = list(keys)
    ground = px.filter(~F.col(outline))
    runs = components.label_runs(ground, connectivity, keys=keys)
    known = components.expand_runs(runs, "component", keys=keys)
    labelled = cut(px.select(*frame(keys), F.col(outline).alias("b")).join(known, [*k, "y", "x"], "left"))
    grown = distance.nearest_site(labelled.withColumn("site", ~F.col("b")), "site", "component", keys=keys)
    filled = labelled.join(grown.select(*k, "y", "x", "payload"), [*k, "y", "x"], "left")
    return filled.select(*frame(keys), F.coalesce("component", "payload", F.lit(1).cast("bigint")).alias("region"))


def connectivity_difference(px: DataFrame, outline: str = "outline", keys: Sequence[str] = KEYS) -> DataFrame:
    """Regions of the 4-connected partition strictly inside a larger 8-connected one."""
    from gridmark.operators.partition_scores import contingency, overlay

    k = list(keys)
    fine = cut(regions_from_outline(px, outline, 4, keys))
    coarse = cut(regions_from_outline(px, outline, 8, keys))
    cells = contingency(overlay(fine, coarse, keys), keys)
    home = cells.groupBy(*k, "t").agg(F.sum("n").alias("area_px"),
                                      F.max_by("p", F.struct(F.col("n"), -F.col("p"))).alias("p"))
    outer = cells.groupBy(*k, "p").agg(F.sum("n").alias("old_region_area_px"))
    return (home.join(outer, [*k, "p"]).filter(F.col("old_region_area_px") > F.col("area_px"))
            .select(*k, F.col("t").alias("region"), "area_px", "old_region_area_px"))


def small_region_moves(labels: DataFrame, min_area: int, label: str = "label", keys: Sequence[str] = KEYS) -> tuple[DataFrame, DataFrame]:
    """``(components, pixels)``: every 8-connected component of one label with its area and, if it is
    below ``min_area`` and has a border, the ``majority`` label it takes; the pixels of small components.

    Components decide once, in ascending order of (label, first pixel), and see the labels that earlier
    ones took.  A border pixel counts once per component; ties go to the lowest label; a component that
    fills its image has no border and stays.  Touching components differ in label, so a round settles
    all components whose earlier small neighbours are settled, and the rounds end after the longest
    chain of touching small components of ascending labels.
    """
    k = list(keys)
    state = labels.select(*frame(keys), F.col(label).alias("label"))
    runs = cut(components.label_runs(state, 8, "label", keys))
    sizes = cut(components.component_sizes(runs, "label", keys))
    small = sizes.filter(F.col("area") < min_area)
    pixels = cut(components.expand_runs(runs.join(small.select(*k, "component"), [*k, "component"], "left_semi"),
                                        "label", "component", keys=keys))
    marked = state.join(pixels.select(*k, "y", "x", "component"), [*k, "y", "x"], "left")
    sides = (scatter(marked.filter("component is not null"), PLUS[1:], ["label", "component"], keys)
             .select(*k, "y", "x", F.col("label").alias("own"), F.col("component").alias("c")).distinct()
             .join(marked.select(*k, "y", "x", "label", F.col("component").alias("d")), [*k, "y", "x"])
             .filter(~F.col("d").eqNullSafe(F.col("c"))))
    # only a small neighbour of a lower label decides earlier; every other one shows its own label
    earlier = F.when(F.col("label") < F.col("own"), F.col("d")).alias("waits_for")
    edges = cut(sides.groupBy(*k, F.col("c").alias("component"), "label", earlier).agg(F.count("*").alias("n")))
    moves = None
    while True:
        votes = edges.groupBy(*k, "component", "label").agg(F.sum("n").alias("n"), F.bool_or(F.col("waits_for").isNotNull()).alias("open"))
        turn = cut(votes.groupBy(*k, "component").agg(F.bool_or("open").alias("open"),
                                                      F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("majority")))
        settled = turn.filter("not open").select(*k, "component", "majority")
        moves = settled if moves is None else moves.unionByName(settled)
        waiting = turn.filter("open").select(*k, "component")
        if waiting.isEmpty():
            break
        shown = settled.select(*k, F.col("component").alias("waits_for"), "majority")
        edges = cut(edges.join(waiting, [*k, "component"], "left_semi").join(shown, [*k, "waits_for"], "left")
                    .select(*k, "component", F.coalesce("majority", "label").alias("label"),
                            F.when(F.col("majority").isNull(), F.col("waits_for")).alias("waits_for"), "n"))
    return sizes.join(moves, [*k, "component"], "left"), pixels


def merge_small_regions(labels: DataFrame, min_area: int, label: str = "label", keys: Sequence[str] = KEYS) -> DataFrame:
    """Small components take the majority label of their border, as :func:`small_region_moves` decides; ``min_area <= 0`` is off."""
    if min_area <= 0:
        return labels
    return merge_with_statistics(labels, min_area, label, keys)[0]


def merge_with_statistics(labels: DataFrame, min_area: int, label: str = "label", keys: Sequence[str] = KEYS) -> tuple[DataFrame, DataFrame]:
    """The merged label map, and per image the components, those merged, their pixels and the outline pixels before and after."""
    k = list(keys)
    judged, pixels = small_region_moves(labels, min_area, label, keys)
    judged = cut(judged)
    moved = (pixels.join(judged.filter("majority is not null").select(*k, "component", "majority"), [*k, "component"])
             .select(*k, "y", "x", "majority"))
    merged = cut(labels.select(*frame(keys), F.col(label).alias("was")).join(moved, [*k, "y", "x"], "left")
                 .select(*frame(keys), F.coalesce("majority", "was").alias(label)))
    taken = F.col("majority").isNotNull()
    stats = judged.groupBy(*k).agg(F.count("*").alias("n_components_total"), F.count_if(taken).alias("n_components_merged"),
                                   F.coalesce(F.sum(F.when(taken, F.col("area"))), F.lit(0)).alias("n_pixels_reassigned"))
    for name, source in (("outline_px_before", labels), ("outline_px_after", merged)):
        drawn = find_outlines(source, label, keys).groupBy(*k).agg(F.count("*").alias(name))
        stats = stats.join(drawn, k, "left").na.fill(0, [name])
    removed = F.col("outline_px_before") - F.col("outline_px_after")
    return merged, stats.withColumn("removed_fraction", safe_div(removed, F.col("outline_px_before")))


def merge_rollup(stats: DataFrame, group: str) -> DataFrame:
    """Per ``group``: images, components, merged components, reassigned pixels and the spread of the removed outline share."""
    from gridmark.operators.summaries import describe

    totals = stats.groupBy(group).agg(F.count("*").alias("n_files"), *[F.sum(c).alias(c + "_sum") for c in (
        "n_components_total", "n_components_merged", "n_pixels_reassigned")])
    spread = describe(stats, F.col("removed_fraction"), [group]).select(group, *[F.col(c).alias("removed_" + c) for c in ("min", "median", "max")])
    return totals.join(spread, group)


def split_lines_and_blobs(labels: DataFrame, thickness: float, label: str = "label", keys: Sequence[str] = KEYS) -> DataFrame:
    """``(keys, component, width_px, kind)`` per 8-connected component of a class mask."""
    from gridmark.operators.thinning import skeletonize

    k = [*keys, "component"]
    runs = cut(components.label_runs(labels, 8, keys=keys))
    inside = labels.select(*frame(keys)).join(components.expand_runs(runs, "component", keys=keys), [*keys, "y", "x"])
    inside = cut(inside)
    skeleton = skeletonize(inside, k)
    # width needs the background around each component: its own pixels plus their one-pixel ring
    from gridmark.operators.raster import SQUARE, centre, focal

    ringed = focal(inside.withColumn("one", F.lit(1)), SQUARE, [centre(F.col("one")).alias("own")], ["one"], k, ring=True)
    widths = distance.skeleton_widths(ringed.withColumn("m", F.col("own").isNotNull()), "m", skeleton, k)
    measured = distance.line_width(widths, keys=k)
    every = inside.select(*k).distinct().join(measured, k, "left")
    kind = F.when(F.col("width_px") <= thickness, "line").otherwise("blob")
    return every.select(*k, "width_px", kind.alias("kind"))


def line_class_outline(labels: DataFrame, line_label: DataFrame, thickness: float, keys: Sequence[str] = KEYS,
                        group: str = "dataset") -> DataFrame:
    """Raw outline where one class is itself the painted line: line pixels and outlines of blobs."""
    hit = cut(labels.join(line_label, group).filter(F.col("label") == F.col("line_label")))
    kinds = cut(split_lines_and_blobs(hit, thickness, keys=keys))
    runs = components.label_runs(hit, 8, keys=keys)
    inside = components.expand_runs(runs, "component", keys=keys).join(kinds, [*keys, "component"])
    marked = labels.join(inside.select(*keys, "y", "x", "kind"), [*keys, "y", "x"], "left")
    marked = cut(marked.select(*frame(keys), "kind"))
    lines = marked.filter("kind = 'line'").select(*frame(keys))
    outline = find_outlines(marked.withColumn("blob", F.coalesce((F.col("kind") == "blob").cast("int"), F.lit(0))), "blob", keys)
    return lines.unionByName(outline).distinct()


def line_class(palette: DataFrame, group: str = "dataset") -> DataFrame:
    """The darkest palette entry per dataset (lowest channel sum, first on a tie)."""
    from gridmark.functions import colour

    total = colour.red(F.col("rgb")) + colour.green(F.col("rgb")) + colour.blue(F.col("rgb"))
    return palette.groupBy(group).agg(F.min_by("idx", F.struct(total, F.col("idx"))).alias("line_label"))


def region_areas(regions: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return regions.groupBy(*keys, "region").agg(F.count("*").alias("area"))


def border_constant(px: DataFrame, value: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Largest uniform 4-connected component that touches the image border.

    Candidates are the three most frequent values of the border ring.
    """
    from gridmark.operators.sampling import first_per_group

    k = list(keys)
    edge = (F.col("y") == 0) | (F.col("y") == F.col("height") - 1) | (F.col("x") == 0) | (F.col("x") == F.col("width") - 1)
    ring = px.filter(edge).groupBy(*k, value).agg(F.count("*").alias("n"))
    top = first_per_group(ring, 3, [F.col("n").desc(), value], keys).select(*k, value)
    runs = cut(components.label_runs(px.join(top, [*k, value], "left_semi"), 4, value, keys))
    sizes = components.component_sizes(runs, value, keys)
    dims = px.select(*k, "height", "width").distinct()
    on_edge = (runs.join(dims, k).filter((F.col("y") == 0) | (F.col("y") == F.col("height") - 1) | (F.col("x0") == 0)
                                         | (F.col("x1") == F.col("width") - 1)).select(*k, value, "component").distinct())
    best = F.max_by(F.struct(F.col(value).alias("value"), "component", "area"), F.struct(F.col("area"), -F.col("component")))
    return (sizes.join(on_edge, [*k, value, "component"], "left_semi").groupBy(*k).agg(best.alias("b")).select(*k, "b.*"))
