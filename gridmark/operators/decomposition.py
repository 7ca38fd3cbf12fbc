"""Splitting an outline error into placement, thickness and over-detection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmark.functions.scalars import safe_div
from gridmark.operators.distance import proximity
from gridmark.operators.raster import KEYS, frame
from gridmark.operators.thinning import skeletonize

# ---- fixed values of the verdict ----
FOUND_OK = 0.70
REAL_OK = 0.80
WIDTH_HIGH = 1.40
EXACT_OVERLAP_OK = 0.50
STRUCTURE_OK = 0.25
# ---- end of fixed values ----
RADII = (0, 1, 2, 3)
DISTANCES = (1, 2, 3, 5)


def check_reaches(radii: Sequence[int], distances: Sequence[int]) -> tuple[list[int], list[int]]:
    """Sorted radii with 0 added, sorted distances; negatives and no distance at all are errors."""
    radii, distances = sorted({0} | {int(r) for r in radii}), sorted({int(x) for x in distances})
    if not distances:
        raise ValueError("at least one proximity distance is needed")
    if radii[0] < 0 or distances[0] < 0:
        raise ValueError("radii and distances must be non-negative")
    return radii, distances


def with_skeletons(px: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Adds boolean ``skel_pred`` and ``skel_true`` to pixels with ``pred`` and ``true``.

    Both masks are thinned in one loop, told apart by an extra key.
    """
    k = list(keys)
    masks = px.select(*frame(keys), F.explode(F.filter(F.array(
        F.when(F.col("pred"), "pred"), F.when(F.col("true"), "true")), lambda m: m.isNotNull())).alias("mask"))
    thin = skeletonize(masks, [*k, "mask"])
    flags = thin.groupBy(*k, "y", "x").agg(F.max((F.col("mask") == "pred").cast("int")).alias("sp"),
                                           F.max((F.col("mask") == "true").cast("int")).alias("st"))
    j = px.join(flags, [*k, "y", "x"], "left")
    return j.withColumns({"skel_pred": F.coalesce(F.col("sp") == 1, F.lit(False)),
                          "skel_true": F.coalesce(F.col("st") == 1, F.lit(False))}).drop("sp", "st")


def decomposition_counts(px: DataFrame, group: Sequence[str] = ("dataset",), radii: Sequence[int] = RADII,
                         distances: Sequence[int] = DISTANCES, keys: Sequence[str] = KEYS) -> DataFrame:
    """All counts the split needs, pooled per group.

    Dilation by r and proximity within d are both "squared distance at most", so one distance
    field per mask answers every radius at once.  ``group`` columns must be among ``keys``.
    """
    radii, distances = check_reaches(radii, distances)
    near = proximity(px, ["pred", "true", "skel_pred", "skel_true"], max(*radii, *distances), keys=keys)

    def n(condition: Column, name: str) -> Column:
        return F.sum(F.coalesce(condition, F.lit(False)).cast("bigint")).alias(name)

    pred, true, sp, st = (F.col(c) for c in ("pred", "true", "skel_pred", "skel_true"))

    def within(mask: str, d: int) -> Column:
        return F.col(f"d2_{mask}") <= d * d

    origin = (F.col("y") == 0) & (F.col("x") == 0)
    sums = [n(origin, "tiles"), n(sp & st, "skel_tp"), n(sp, "skel_pred_px"), n(st, "skel_true_px")]
    for r in radii:
        sums += [n(within("pred", r) & within("true", r), f"dil_tp_{r}"), n(within("pred", r), f"dil_pred_{r}"),
                 n(within("true", r), f"dil_true_{r}")]
    for d in distances:
        sums += [n(pred & within("true", d), f"pred_near_{d}"), n(true & within("pred", d), f"true_near_{d}"),
                 n(sp & within("skel_true", d), f"skel_pred_near_{d}"), n(st & within("skel_pred", d), f"skel_true_near_{d}")]
    return near.groupBy(*group).agg(*sums)


def nearest_distance(distances: Sequence[int], tolerance: float) -> int:
    return min(sorted(distances), key=lambda d: abs(d - tolerance))


def verdict(counts: DataFrame, radii: Sequence[int] = RADII, distances: Sequence[int] = DISTANCES,
            tolerance: float = 2.0) -> DataFrame:
    """Ratios of pooled counts and the label they imply."""
    radii, distances = check_reaches(radii, distances)
    d = nearest_distance(distances, tolerance)
    pred, true = F.col("dil_pred_0"), F.col("dil_true_0")
    table = counts.withColumns({
        "pixel_dice": safe_div(2 * F.col("dil_tp_0"), pred + true),
        "skeleton_dice": safe_div(2 * F.col("skel_tp"), F.col("skel_pred_px") + F.col("skel_true_px")),
        "real": safe_div(F.col(f"skel_pred_near_{d}"), F.col("skel_pred_px")),
        "found": safe_div(F.col(f"skel_true_near_{d}"), F.col("skel_true_px")),
        "width_pred": safe_div(pred, F.col("skel_pred_px")), "width_true": safe_div(true, F.col("skel_true_px")),
        "curve_length_ratio": safe_div(F.col("skel_pred_px"), F.col("skel_true_px")), "tolerance_px": F.lit(d),
        **{f"dilated_dice_{r}": safe_div(2 * F.col(f"dil_tp_{r}"), F.col(f"dil_pred_{r}") + F.col(f"dil_true_{r}")) for r in radii},
        **{f"pred_within_{x}": safe_div(F.col(f"pred_near_{x}"), pred) for x in distances},
        **{f"true_within_{x}": safe_div(F.col(f"true_near_{x}"), true) for x in distances}})
    table = table.withColumn("width_ratio", safe_div(F.col("width_pred"), F.col("width_true")))
    fat = F.col("width_ratio") >= WIDTH_HIGH
    label = (F.when(F.col("found") < FOUND_OK, "MISPLACED")
             .when((F.col("real") < REAL_OK) & (F.col("skeleton_dice") < STRUCTURE_OK), "MISPLACED")
             .when(F.col("real") < REAL_OK, F.when(fat, "OVER-DETECTION + THICKNESS").otherwise("OVER-DETECTION"))
             .when(fat, "THICKNESS").when(F.col("skeleton_dice") < EXACT_OVERLAP_OK, "OFFSET").otherwise("GOOD"))
    return table.withColumn("label", label)
