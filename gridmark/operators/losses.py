"""Loss values of stored predictions, as evaluation columns (logits and 0/1 truth per pixel)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridmark.functions.scalars import safe_div
from gridmark.operators.blocks import BLOCK, Block, extreme, over_blocks, pixel_schema
from gridmark.operators.raster import KEYS, PLUS, SQUARE, focal


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def bce(logit: Column, truth: Column, pos_weight: Column) -> Column:
    """Class-weighted binary cross entropy on the logit, stable for large magnitudes."""
    soft = F.log1p(F.exp(-F.abs(logit))) + F.greatest(-logit, F.lit(0.0))
    return (1 - truth) * logit + (1 + (pos_weight - 1) * truth) * soft


def tile_losses(px: DataFrame, pos_weight: Column, keys: Sequence[str] = KEYS, smooth: float = 1.0) -> DataFrame:
    """Mean BCE and soft Dice loss of every tile (columns ``logit``, ``true``)."""
    t, p = F.col("true").cast("double"), sigmoid(F.col("logit"))
    s = px.groupBy(*keys).agg(F.avg(bce(F.col("logit"), t, pos_weight)).alias("bce"), F.sum(p * t).alias("both"),
                              F.sum(p).alias("p"), F.sum(t).alias("t"))
    return s.select(*keys, "bce", (1 - (2 * F.col("both") + smooth) / (F.col("p") + F.col("t") + smooth)).alias("dice_loss"))


def focal_extreme(px: DataFrame, column: str, largest: bool, offsets=SQUARE, keys: Sequence[str] = KEYS) -> DataFrame:
    """Minimum or maximum of a neighbourhood; outside the image is ignored."""
    pick = F.max if largest else F.min
    return focal(px, offsets, [pick(column).alias(column)], [column], keys)


def soft_skeleton(px: DataFrame, columns: Sequence[str], iterations: int, keys: Sequence[str] = KEYS, block: int = BLOCK) -> DataFrame:
    """Soft skeletons of several value columns at once: what each erosion removes beyond its opening.

    Erosion is the cross-shaped minimum, dilation the 3 x 3 maximum; both ignore nulls and pixels without
    a row.  One pass over blocks with a halo as wide as the last opening reaches.
    """
    if iterations < 1:
        raise ValueError(f"iterations must be >= 1, got {iterations}")
    kinds = {c: px.schema[c].dataType for c in columns}
    schema = pixel_schema(px, keys, **kinds, **{f"skel_{c}": T.DoubleType() for c in columns})

    def run(b: Block) -> pa.Table:
        keep, out = b.inner(b.present), {}
        for c in columns:
            x, k = b.array(c, np.inf, np.float64), np.zeros(b.shape)  # infinite: no value
            for step in range(iterations + 1):
                eroded = np.where(b.present, extreme(x, PLUS, np.inf, lower=True), np.inf)
                opened = extreme(np.where(np.isinf(eroded), -np.inf, eroded), SQUARE, -np.inf)
                some = np.isfinite(x) & np.isfinite(opened)
                delta = np.maximum(np.subtract(x, opened, out=np.zeros(b.shape), where=some), 0)
                k = delta if step == 0 else k + np.maximum(delta - k * delta, 0)
                x = eroded
            out[f"skel_{c}"] = b.inner(k)
        own_row = np.zeros(b.shape, np.int64)
        own_row[b.y, b.x] = np.arange(len(b.table))
        at = pa.array(b.inner(own_row)[keep])
        return b.pixels(keep, **{c: b.table.column(c).combine_chunks().take(at) for c in kinds}, **out)

    return over_blocks(px, list(kinds), iterations + 2, run, schema, keys, max(block, iterations + 2))


def cldice_parts(px: DataFrame, iterations: int = 3, keys: Sequence[str] = KEYS, smooth: float = 1.0, eps: float = 1e-6) -> DataFrame:
    """Centreline Dice of every tile with all its parts (columns ``p`` in [0, 1] and ``t`` 0/1)."""
    s = soft_skeleton(px, ["p", "t"], iterations, keys)
    sp, st, p, t = (F.col(c) for c in ("skel_p", "skel_t", "p", "t"))
    sums = s.groupBy(*keys).agg(F.sum(p).alias("pred_sum"), F.sum(t).alias("true_sum"), F.sum(sp).alias("skel_pred_sum"),
                                F.sum(st).alias("skel_true_sum"), F.sum(sp * t).alias("skel_pred_on_true"),
                                F.sum(st * p).alias("skel_true_on_pred"))
    prec = (F.col("skel_pred_on_true") + smooth) / (F.col("skel_pred_sum") + smooth)
    rec = (F.col("skel_true_on_pred") + smooth) / (F.col("skel_true_sum") + smooth)
    sums = sums.withColumns({"t_prec": prec, "t_rec": rec})
    score = 2 * F.col("t_prec") * F.col("t_rec") / (F.col("t_prec") + F.col("t_rec") + eps)
    return sums.withColumn("cldice", score).withColumn("loss", 1 - F.col("cldice"))


def invariance_checks(parts: DataFrame, dice_loss: Column, width: float) -> DataFrame:
    """Does the centreline term ignore thickness for a genuine reason?  Four flags per tile."""
    if width < 1:
        raise ValueError(f"line width must be >= 1, got {width}")
    return parts.withColumns({
        "cldice_below_quarter_of_dice": F.col("loss") < 0.25 * dice_loss,
        "pred_skeleton_real": F.col("skel_pred_sum") > 0.25 * F.col("skel_true_sum"),
        "true_skeleton_real": F.col("skel_true_sum") > 0.25 * F.col("true_sum") / width,
        "pred_skeleton_on_true": F.col("skel_pred_on_true") > 0.8 * F.col("skel_pred_sum")})


def weighted_mean(batches: DataFrame, value: str, weight: str, group: Sequence[str] = ()) -> DataFrame:
    """Mean of batch values weighted by batch size."""
    total = safe_div(F.sum(F.col(value) * F.col(weight)), F.sum(weight)).alias("mean")
    return batches.groupBy(*group).agg(total)


def z_score(px: DataFrame, value: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Value standardised per tile; a flat tile is only centred.

    Moments are aggregated and joined back, so no window holds a whole tile.
    """
    v = F.col(value).cast("double")
    m = px.groupBy(*keys).agg(F.avg(v).alias("_m"), F.stddev_pop(v).alias("_s"))
    scale = F.when(F.col("_s") < 1e-6, F.lit(1.0)).otherwise(F.col("_s"))
    return px.join(m, list(keys)).withColumn("z", (v - F.col("_m")) / scale).drop("_m", "_s")
