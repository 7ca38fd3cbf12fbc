"""Neighbourhood operators on pixel tables.

All of them are one *scatter*: every pixel row is exploded over a short literal list of
offsets to the pixels it influences, followed by one ``groupBy`` on ``(keys, y, x)``.  Map-side
partial aggregation folds most of the expansion before the shuffle, the shuffle key is the
single pixel (so one huge image spreads over every task), and no join or broadcast is needed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Offset = tuple[int, int]
KEYS = ("image_id",)
PLUS: tuple[Offset, ...] = ((0, 0), (-1, 0), (1, 0), (0, -1), (0, 1))
SQUARE: tuple[Offset, ...] = tuple((dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1))
RING: tuple[Offset, ...] = tuple(o for o in SQUARE if o != (0, 0))
CORNER: tuple[Offset, ...] = ((0, 0), (0, 1), (1, 0), (1, 1))


def disk(radius: int) -> tuple[Offset, ...]:
    """All offsets within Euclidean distance ``radius``."""
    if radius < 0:
        raise ValueError(f"radius must be >= 0, got {radius}")
    reach = range(-radius, radius + 1)
    return tuple((dy, dx) for dy in reach for dx in reach if dy * dy + dx * dx <= radius * radius)


def disk_of(table: DataFrame, radius: str) -> DataFrame:
    """Explode each row over the disk offsets ``(dy, dx)`` of its own radius column."""
    r = F.col(radius)
    rows = table.withColumn("dy", F.explode(F.sequence(-r, r)))
    return (rows.withColumn("dx", F.explode(F.sequence(-r, r)))
            .filter(F.col("dy") * F.col("dy") + F.col("dx") * F.col("dx") <= r * r))


def frame(keys: Sequence[str] = KEYS) -> list[str]:
    """Column names of a mask row."""
    return [*keys, "height", "width", "y", "x"]


def offset_literal(offsets: Sequence[Offset]) -> Column:
    return F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in offsets])


def in_bounds(y: Column, x: Column) -> Column:
    return (y >= 0) & (y < F.col("height")) & (x >= 0) & (x < F.col("width"))


def scatter(px: DataFrame, offsets: Sequence[Offset], carry: Sequence[str] = (),
            keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per (pixel, offset) that lands inside the image, at ``(y + dy, x + dx)``."""
    moved = px.select(*frame(keys), *carry, F.explode(offset_literal(offsets)).alias("o"))
    y, x = F.col("y") + F.col("o.dy"), F.col("x") + F.col("o.dx")
    return (moved.filter(in_bounds(y, x))
            .select(*keys, "height", "width", y.alias("y"), x.alias("x"), *carry,
                    F.col("o.dy").alias("dy"), F.col("o.dx").alias("dx")))


def focal(px: DataFrame, offsets: Sequence[Offset], aggregates: Sequence[Column],
          carry: Sequence[str], keys: Sequence[str] = KEYS, ring: bool = False) -> DataFrame:
    """Aggregate a symmetric neighbourhood, centre included, into every pixel of ``px``; with ``ring`` into all it touches."""
    spread = scatter(px, offsets, carry, keys).groupBy(*frame(keys))
    if ring:
        return spread.agg(*aggregates)
    there = F.bool_or((F.col("dy") == 0) & (F.col("dx") == 0)).alias("_there")
    return spread.agg(*aggregates, there).filter("_there").drop("_there")


def centre(column: Column) -> Column:
    """Inside :func:`focal` aggregates: the value of the pixel itself."""
    return F.max(F.when((F.col("dy") == 0) & (F.col("dx") == 0), column))


def _inside(mask: DataFrame, within: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    return mask if within is None else mask.join(within.select(*keys, "y", "x"), [*keys, "y", "x"], "left_semi")


def dilate(mask: DataFrame, offsets: Sequence[Offset] = SQUARE, keys: Sequence[str] = KEYS, within: DataFrame | None = None) -> DataFrame:
    """Union of the mask shifted by every offset, clipped to the image.

    ``within`` holds the pixels of images that do not fill their rectangle; what has no row there is outside.
    """
    return _inside(scatter(mask, offsets, keys=keys).select(*frame(keys)).distinct(), within, keys)


def erode(mask: DataFrame, offsets: Sequence[Offset] = SQUARE, keys: Sequence[str] = KEYS, within: DataFrame | None = None) -> DataFrame:
    """Pixels all of whose in-image neighbours are set; outside the image counts as set; ``within`` as in :func:`dilate`."""
    if within is not None:
        marked = within.select(*frame(keys)).join(mask.select(*keys, "y", "x", F.lit(True).alias("set")), [*keys, "y", "x"], "left")
        near = focal(marked.na.fill(False, ["set"]), offsets, [F.bool_and("set").alias("all")], ["set"], keys)
        return near.filter("all").select(*frame(keys))
    expected = F.lit(0)
    for dy, dx in offsets:
        expected = expected + in_bounds(F.col("y") - dy, F.col("x") - dx).cast("int")
    hits = scatter(mask, offsets, keys=keys).groupBy(*frame(keys)).agg(F.count("*").alias("hits"))
    return hits.filter(F.col("hits") == expected).select(*frame(keys))


def closing(mask: DataFrame, keys: Sequence[str] = KEYS, within: DataFrame | None = None) -> DataFrame:
    return erode(dilate(mask, SQUARE, keys, within), SQUARE, keys, within)


def opening(mask: DataFrame, keys: Sequence[str] = KEYS, within: DataFrame | None = None) -> DataFrame:
    return dilate(erode(mask, SQUARE, keys, within), SQUARE, keys, within)


def dilate_to_width(skeleton: DataFrame, width: int, keys: Sequence[str] = KEYS, within: DataFrame | None = None) -> DataFrame:
    """Grow a one-pixel line to ``width``: one 2x2 step for even widths, then 3x3 steps.

    ``k`` 3x3 steps equal one (2k+1) square, applied here as a row pass and a column pass so
    that the expansion is 2(2k+1) and not (2k+1) squared.  ``within`` as in :func:`dilate`.
    """
    if width < 1:
        raise ValueError(f"line width must be >= 1, got {width}")
    out = skeleton.select(*frame(keys))
    if width % 2 == 0:
        out = dilate(out, CORNER, keys)
    steps = (width - 1) // 2
    if steps == 1:
        return dilate(out, SQUARE, keys, within)
    if steps > 1:
        out = dilate(out, [(0, d) for d in range(-steps, steps + 1)], keys)
        out = dilate(out, [(d, 0) for d in range(-steps, steps + 1)], keys)
    return _inside(out, within, keys)


def find_outlines(labels: DataFrame, label: str = "label", keys: Sequence[str] = KEYS) -> DataFrame:
    """Pixels that differ from some in-image 4-neighbour, as a mask."""
    spread = focal(labels, PLUS, [F.min(label).alias("lo"), F.max(label).alias("hi")], [label], keys)
    return spread.filter(F.col("lo") < F.col("hi")).select(*frame(keys))


def interior(mask: DataFrame, margin: int) -> DataFrame:
    """Mask pixels further than ``margin`` from every image edge; none where the image is too small."""
    y, x, h, w = (F.col(c) for c in ("y", "x", "height", "width"))
    return mask.filter((h > 2 * margin) & (w > 2 * margin)
                       & (y >= margin) & (y < h - margin) & (x >= margin) & (x < w - margin))


def endpoints(skeleton: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mask pixels with exactly one 8-neighbour in the mask."""
    near = focal(skeleton.withColumn("one", F.lit(1)), SQUARE,
                 [centre(F.col("one")).alias("self"), F.count("*").alias("n")], ["one"], keys)
    return near.filter(F.col("self").isNotNull() & (F.col("n") == 2)).select(*frame(keys))


def erase_every(mask: DataFrame, spacing: int, gap: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Erase the block reaching ``gap // 2`` each way at every ``spacing``-th pixel in raster order.

    The raster rank is a per-row rank plus the running count of the rows above, so no window
    ever spans more than one image row or one list of row counts.
    """
    from pyspark.sql import Window as W

    if spacing < 1 or gap < 1:
        raise ValueError(f"spacing and gap must be >= 1, got {spacing}, {gap}")
    rows = mask.groupBy(*keys, "y").agg(F.count("*").alias("n"))
    above = W.partitionBy(*keys).orderBy("y").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.select(*keys, "y", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("before"))
    ranked = (mask.withColumn("k", F.row_number().over(W.partitionBy(*keys, "y").orderBy("x")))
              .join(rows, [*keys, "y"]))
    picked = ranked.filter((F.col("before") + F.col("k") - 1) % spacing == 0)
    reach = range(-(gap // 2), gap // 2 + 1)
    block = [(dy, dx) for dy in reach for dx in reach]
    hole = scatter(picked, block, keys=keys).select(*keys, "y", "x").distinct()
    return mask.join(hole, [*keys, "y", "x"], "left_anti").select(*frame(keys))
