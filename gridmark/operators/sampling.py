"""Seeded samples, top-k picks and weighted draws."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridmark.functions.scalars import hash_order

FANOUT = 4096


def seeded_sample(df: DataFrame, k: int, seed: int, ident: Column, group: Sequence[str] = ()) -> DataFrame:
    """k rows per group in seeded order (all rows of smaller groups).

    With groups the rank filter is pushed into each partition as a group limit; without, it is a
    top-k: neither gathers a group whole.
    """
    key = hash_order(seed, ident)
    if not group:
        return df.orderBy(key, ident).limit(k)
    order = W.partitionBy(*group).orderBy(key, ident)
    return df.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= k).drop("_k")


def first_per_group(df: DataFrame, k: int, order: Sequence[Column | str], group: Sequence[str]) -> DataFrame:
    """The first k rows of every group."""
    rank = F.row_number().over(W.partitionBy(*group).orderBy(*order))
    return df.withColumn("_k", rank).filter(F.col("_k") <= k).drop("_k")


def densest_tile(tiles: DataFrame, minimum_px: int = 200, top: int = 20) -> DataFrame:
    """Among the ``top`` tiles by fraction the first with more than ``minimum_px`` outline pixels."""
    head = tiles.orderBy(F.col("outline_fraction").desc(), "tile_id").limit(top)
    return (head.filter(F.col("outline_px") > minimum_px)
            .orderBy(F.col("outline_fraction").desc(), "tile_id").limit(1))


def running_ranges(df: DataFrame, ident: str, weight: str) -> DataFrame:
    """Adds the half-open range ``[lo, hi)`` of the running weight in md5 order.

    Two-level prefix sum: FANOUT bucket totals first, then inside a bucket, so no task sees more
    than one bucket and the only ordered global step has FANOUT rows.
    """
    h = F.md5(F.col(ident).cast("string"))
    rows = df.withColumns({"_h": h, "_b": F.substring(h, 1, 3)})
    sums = rows.groupBy("_b").agg(F.sum(weight).alias("s"))
    before = F.coalesce(F.sum("s").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select("_b", before.alias("_start"))  # at most FANOUT rows
    upto = F.sum(weight).over(W.partitionBy("_b").orderBy("_h", ident).rowsBetween(W.unboundedPreceding, W.currentRow))
    return (rows.withColumn("_hi", upto).join(F.broadcast(starts), "_b")
            .withColumn("hi", F.col("_start") + F.col("_hi")).withColumn("lo", F.col("hi") - F.col(weight))
            .drop("_h", "_b", "_hi", "_start"))


def weighted_draws(df: DataFrame, ident: str, weight: str, draws: int, seed: int) -> DataFrame:
    """``(draw, ident)``: draws with replacement, probability proportional to an integer weight.

    Draw j lands at ``hash(seed, j) mod total``.  Ranges are cut at a grid of cells as wide as the
    mean weight; a range meets a draw by equality of the cell, so there is no range join.
    """
    ranges = running_ranges(df, ident, weight)
    total, n = df.agg(F.sum(weight), F.count("*")).first()
    if not total:
        raise ValueError("weights sum to zero")
    cell = max(1, total // n)
    spans = ranges.filter(F.col(weight) > 0).withColumn(
        "cell", F.explode(F.sequence(F.floor(F.col("lo") / cell), F.floor((F.col("hi") - 1) / cell))))
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col("id").cast("string"))), 1, 15), 16, 10).cast("bigint")
    at = df.sparkSession.range(draws).select(F.col("id").alias("draw"), (h % total).alias("at"))
    at = at.withColumn("cell", F.floor(F.col("at") / cell))
    return (at.join(spans, "cell").filter((F.col("at") >= F.col("lo")) & (F.col("at") < F.col("hi")))
            .select("draw", ident))
