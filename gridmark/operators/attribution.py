"""Why a true region found no match: tiny, merged, split or other."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmark.functions.scalars import safe_div
from gridmark.operators.blocks import BLOCK, Block, over_blocks, pixel_schema, shifted
from gridmark.operators.partition_scores import dominant_share
from gridmark.operators.raster import KEYS, SQUARE, dilate, disk, frame
from gridmark.operators.summaries import quantiles
from gridmark.session import cut

CLASSES = ("TINY", "MERGED", "SPLIT", "OTHER")
POINTS = (0.05, 0.25, 0.50, 0.75, 0.95)


def classify(table: DataFrame, tiny_area: int, keys: Sequence[str] = KEYS, iou: float = 0.5) -> DataFrame:
    """One row per unmatched true region: class, natural class, area, best IoU, dominant share."""
    natural = (F.when((F.col("dominant_share") > 0.5) & (F.col("rivals") > 0), "MERGED")
               .when(F.col("dominant_share") <= 0.5, "SPLIT").otherwise("OTHER"))
    missed = dominant_share(table, keys).filter(F.col("best_iou") <= iou).withColumn("natural", natural)
    return missed.withColumn("class", F.when(F.col("area") < tiny_area, "TINY").otherwise(F.col("natural")))


def outline_regions(regions: DataFrame, outline: DataFrame, keys: Sequence[str] = KEYS, block: int = BLOCK) -> DataFrame:
    """``(keys, y, x, region)``: the different regions in the 3 x 3 of every outline pixel.

    A region pixel goes to its block once; only outline pixels look around, and only what they see leaves.
    """
    k = [*keys, "y", "x"]
    marked = regions.select(*frame(keys), "region", F.lit(False).alias("line")).unionByName(
        outline.select(*frame(keys), F.lit(None).cast(regions.schema["region"].dataType).alias("region"), F.lit(True).alias("line")))
    schema = pixel_schema(regions, keys, region=regions.schema["region"].dataType)

    def run(b: Block) -> pa.Table:
        # an outline pixel may be a region pixel too, so the two are laid down apart
        line = np.zeros(b.shape, bool)
        on = b.table.column("line").to_numpy().astype(bool)
        line[b.y[on], b.x[on]] = True
        region, known = np.zeros(b.shape, np.int64), np.zeros(b.shape, bool)
        region[b.y[~on], b.x[~on]] = b.table.column("region").drop_null().to_numpy()
        known[b.y[~on], b.x[~on]] = True
        y, x = np.nonzero(b.inner(line))
        y, x = y + b.core[0].start, x + b.core[1].start
        seen, has = (np.stack([shifted(v, dy, dx, 0)[y, x] for dy, dx in SQUARE], axis=1) for v in (region, known))
        order = np.argsort(seen, axis=1, kind="stable")
        seen, has = np.take_along_axis(seen, order, 1), np.take_along_axis(has, order, 1)
        first = has.copy()
        first[:, 1:] &= (seen[:, 1:] != seen[:, :-1]) | ~has[:, :-1]
        at, which = np.nonzero(first)
        ints = lambda v: pa.array(v.astype(np.int32))
        out = {"height": ints(np.full(len(at), b.height)), "width": ints(np.full(len(at), b.width)), "y": ints(y[at] + b.top), "x": ints(x[at] + b.left),
               "region": pa.array(seen[at, which]).cast(b.table.schema.field("region").type)}
        return b.made(len(at), out)

    return over_blocks(marked, ["region", "line"], 1, run, schema, keys, block).select(*k, "region").distinct()


def merge_gaps(missed: DataFrame, table: DataFrame, true_regions: DataFrame, true_outline: DataFrame,
               pred_outline: DataFrame, gap_tolerance: int = 1, keys: Sequence[str] = KEYS) -> DataFrame:
    """``(keys, t, interface_px, gap_px)`` of merged regions.

    An interface pixel is true outline with the region and a merge partner in its 3 x 3; it is a
    gap where no predicted outline lies within the tolerance.  A pixel sees at most nine regions,
    so partners meet per pixel and never as region pairs.
    """
    k = list(keys)
    if gap_tolerance < 0:
        raise ValueError("gap_tolerance must be >= 0")
    groups = dominant_share(table, keys).filter("dominant_share > 0.5 and rivals > 0").select(
        *k, F.col("t").alias("region"), F.col("p").alias("merge"))
    seen = outline_regions(true_regions, true_outline, keys).join(groups, [*k, "region"])
    together = (seen.groupBy(*k, "y", "x", "merge").agg(F.collect_set("region").alias("regions"))
                .filter(F.size("regions") > 1))
    near = pred_outline if gap_tolerance == 0 else dilate(pred_outline.select(*frame(keys)), disk(gap_tolerance), keys)
    touched = together.join(near.select(*k, "y", "x", F.lit(1).alias("covered")), [*k, "y", "x"], "left")
    per = touched.select(*k, F.explode("regions").alias("t"), "covered").groupBy(*k, "t").agg(
        F.count("*").alias("interface_px"), F.sum(F.when(F.col("covered").isNull(), 1).otherwise(0)).alias("gap_px"))
    merged = missed.filter(F.col("class") == "MERGED").select(*k, "t")
    return merged.join(per, [*k, "t"], "left").na.fill(0, ["interface_px", "gap_px"])


def summarise(missed: DataFrame, gaps: DataFrame, sizes: DataFrame, group: Sequence[str] = ("dataset",),
              keys: Sequence[str] = KEYS) -> DataFrame:
    """Class counts and fractions, percentiles of areas and gaps, pooled gap share per group.

    ``sizes(group, tiles, n_true)`` supplies the denominators.  The joined rows are written once: counts and
    every percentile read them again.
    """
    g, rows = list(group), cut(missed.join(gaps, [*keys, "t"], "left"))
    counts = [F.sum((F.col("class") == c).cast("bigint")).alias(f"n_{c.lower()}") for c in CLASSES]
    inside = [F.sum(((F.col("class") == "TINY") & (F.col("natural") == c)).cast("bigint")).alias(f"tiny_{c.lower()}")
              for c in CLASSES[1:]]
    base = rows.groupBy(*g).agg(F.count("*").alias("n_fn"), *counts, *inside, F.sum("gap_px").alias("gap"),
                                F.sum("interface_px").alias("interface"),
                                F.sum((F.col("gap_px") < F.col("interface_px")).cast("bigint")).alias("gap_under_interface"))
    out = sizes.join(base, g, "left").na.fill(0)
    shares = {f"fraction_{c.lower()}": safe_div(F.col(f"n_{c.lower()}"), F.col("n_fn")) for c in CLASSES}
    out = out.withColumns({**shares, "fn_per_tile": safe_div(F.col("n_fn"), F.col("tiles")),
                           "gap_fraction": F.when(F.col("interface") > 0, F.col("gap") / F.col("interface"))})
    names = ["p5", "p25", "p50", "p75", "p95"]
    for column in ("area", "gap_px", "interface_px"):
        q = quantiles(rows.filter(F.col(column).isNotNull()), F.col(column), POINTS, g, [f"{column}_{n}" for n in names])
        out = out.join(q, g, "left")
    return out
