"""Deterministic augmentation: every draw is a hash of (seed, tile, operation)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmark.functions.scalars import hash_unit
from gridmark.operators.raster import KEYS


def coin(seed: int, tile: Column, operation: str, p: float) -> Column:
    """True with probability p, the same for image and mask of a tile."""
    return hash_unit(F.lit(seed), tile, F.lit(operation)) < int(p * 2 ** 32)


def uniform(seed: int, tile: Column, operation: str, lo: float, hi: float) -> Column:
    return F.lit(lo) + (hi - lo) * hash_unit(F.lit(seed), tile, F.lit(operation)) / F.lit(float(2 ** 32))


def geometric(px: DataFrame, seed: int, p: float = 0.5, keys: Sequence[str] = KEYS) -> DataFrame:
    """Horizontal flip, vertical flip and quarter turn, each with probability p; pure arithmetic."""
    tile = F.concat_ws("/", *keys)
    h, w = F.col("height"), F.col("width")
    x = F.when(coin(seed, tile, "hflip", p), w - 1 - F.col("x")).otherwise(F.col("x"))
    y = F.when(coin(seed, tile, "vflip", p), h - 1 - F.col("y")).otherwise(F.col("y"))
    flipped = px.withColumns({"x": x, "y": y})
    turn = coin(seed, tile, "rot90", p)
    return flipped.withColumns({
        "y": F.when(turn, w - 1 - F.col("x")).otherwise(F.col("y")), "x": F.when(turn, F.col("y")).otherwise(F.col("x")),
        "height": F.when(turn, w).otherwise(h), "width": F.when(turn, h).otherwise(w)})


def photometric(px: DataFrame, value: str, seed: int, p: float = 0.5, brightness: float = 0.2, contrast: float = 0.2,
                gamma: float = 0.2, noise: float = 4.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """Brightness, contrast, gamma and noise on the image value (0-255); masks are never passed in."""
    tile = F.concat_ws("/", *keys)
    v = F.col(value).cast("double")
    v = F.when(coin(seed, tile, "contrast", p), (v - 127.5) * (1 + uniform(seed, tile, "c", -contrast, contrast)) + 127.5).otherwise(v)
    v = F.when(coin(seed, tile, "brightness", p), v + 255 * uniform(seed, tile, "b", -brightness, brightness)).otherwise(v)
    v = F.least(F.greatest(v, F.lit(0.0)), F.lit(255.0))
    v = F.when(coin(seed, tile, "gamma", p), 255 * F.pow(v / 255, 1 + uniform(seed, tile, "g", -gamma, gamma))).otherwise(v)
    place = F.concat_ws("/", tile, F.col("y"), F.col("x"))
    v = F.when(coin(seed, tile, "noise", p), v + uniform(seed, place, "n", -noise, noise)).otherwise(v)
    return px.withColumn(value, F.least(F.greatest(F.round(v, 0), F.lit(0.0)), F.lit(255.0)).cast("int"))
