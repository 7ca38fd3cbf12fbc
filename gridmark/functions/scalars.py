"""Scalar helpers shared by all operators (null and zero rules live here)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_div(numerator: Column, denominator: Column) -> Column:
    """Ratio as double; anything over zero (0/0 included) is 0.0."""
    top, bottom = numerator.cast("double"), denominator.cast("double")
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def choose_two(n: Column) -> Column:
    """n choose 2 as double, exact below 2**53."""
    n = n.cast("double")
    return n * (n - 1) / 2


def cleared(value: Column, thresholds: Sequence[float]) -> Column:
    """How many of the ascending ``thresholds`` satisfy ``value >= t``.

    A sum of comparisons: stays inside whole-stage codegen, no array per row.  Thresholds are
    compared at the precision of the data (see :func:`snapped`).
    """
    total = F.lit(0)
    for t in snapped(thresholds):
        total = total + (value >= F.lit(t).cast("float")).cast("int")
    return total


def snapped(thresholds: Sequence[float]) -> list[float]:
    """The grid rounded to float32, so a value stored as float32 that equals a threshold clears it.

    If rounding would merge two grid points the double grid is kept.
    """
    import numpy as np

    grid = [float(t) for t in thresholds]
    low = [float(np.float32(t)) for t in grid]
    return low if all(b > a for a, b in zip(low, low[1:])) else grid


def snapped_grid(grid: Column) -> Column:
    """Column form of :func:`snapped` for an ascending array of doubles."""
    low = F.transform(grid, lambda t: t.cast("float").cast("double"))
    rises = F.forall(F.sequence(F.lit(1), F.greatest(F.size(grid) - 1, F.lit(1))),
                     lambda i: (F.get(low, i) > F.get(low, i - 1)) | F.get(low, i).isNull())
    return F.when(rises, low).otherwise(grid)


def hypotenuse_ceiling(width: int) -> int:
    """Erosion rounds needed to empty a line of ``width``: ceil((width + 2) / sqrt 2)."""
    import math

    return math.ceil((width + 2) / math.sqrt(2))


def hash_unit(*parts: Column) -> Column:
    """Deterministic integer in [0, 2**32) from md5 of the parts joined by '|'."""
    joined = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, 8), 16, 10).cast("bigint")


def hash_order(seed: int, *parts: Column) -> Column:
    """md5 of seed and parts: the sort key behind every seeded choice."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))
