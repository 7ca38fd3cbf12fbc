"""One-pass threshold sweeps: counts at every threshold from a single scan.

A pixel's value is reduced to how many thresholds it clears; bucket histograms of at most K + 1
rows per dataset are what leaves the scan, and a reverse cumulative sum turns them into counts
for every threshold.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridmark.functions.scalars import cleared, safe_div, snapped
from gridmark.operators.blocks import BLOCK, Block, extreme, over_blocks
from gridmark.operators.raster import KEYS, disk

POOLED = "__pooled__"
COUNTS = ("tp", "n_pred", "hits_p", "hits_r")
TOTALS = ("tiles", "total_px", "true_px", "prob_sum")


def threshold_grid(lo: float, hi: float, step: float, fixed: float = 0.5) -> list[float]:
    """Thresholds from ``lo`` to ``hi`` about ``step`` apart, to six places, and ``fixed`` among them.

    All thresholds lie strictly between 0 and 1, and at least one step fits.
    """
    outside = [t for t in (lo, hi, fixed) if t <= 0.0 or t >= 1.0]
    if outside or not 0.0 < step <= hi - lo:
        raise ValueError(f"no grid from {lo} to {hi} in steps of {step} with {fixed}" + (f": {outside} not between 0 and 1" if outside else ""))
    points = round((hi - lo) / step)
    return sorted({round(lo + (hi - lo) * i / points, 6) for i in range(points + 1)} | {round(fixed, 6)})


def grid_of(lo: Column, hi: Column, step: float, fixed: float = 0.5) -> Column:
    """The array of :func:`threshold_grid` for bounds that are columns, at least one step."""
    n = F.greatest(F.lit(1), F.round((hi - lo) / F.lit(float(step))).cast("int"))
    points = F.transform(F.sequence(F.lit(0), n), lambda i: F.round(lo + (hi - lo) * i / n, 6))
    return F.array_sort(F.array_distinct(F.concat(points, F.array(F.lit(round(fixed, 6))))))


def bucket_counts(df: DataFrame, value: Column, thresholds: Sequence[float], group: Sequence[str]) -> DataFrame:
    """Histogram over the number of thresholds cleared: ``(group, bucket, n)``."""
    return df.groupBy(*group, cleared(value, thresholds).alias("bucket")).agg(F.count("*").alias("n"))


def tail_counts(buckets: DataFrame, thresholds: Sequence[float], group: Sequence[str],
                counts: Sequence[str] = ("n",), totals: Sequence[Column] = ()) -> DataFrame:
    """``#{v >= t}`` for every threshold from bucket histograms.

    A group has at most K + 1 histogram rows, so they fit one array; summing its tail per
    threshold needs neither a second scan for missing buckets nor a window.
    """
    cells = F.collect_list(F.struct("bucket", *counts)).alias("cells")
    rows = buckets.groupBy(*group).agg(cells, *totals)
    steps = [F.struct(F.lit(i + 1).alias("i"), F.lit(float(t)).alias("threshold")) for i, t in enumerate(thresholds)]
    names = [c for c in rows.columns if c not in ("cells", *group)]
    rows = rows.select(*group, *names, "cells", F.explode(F.array(*steps)).alias("s"))

    def tail(name: str) -> Column:
        held = F.filter("cells", lambda c: c.getField("bucket") >= F.col("s.i"))
        return F.aggregate(held, F.lit(0).cast("bigint"), lambda acc, c: acc + c.getField(name))

    return rows.select(*group, F.col("s.threshold").alias("threshold"), *[tail(c).alias(c) for c in counts], *names)


def ge_counts(df: DataFrame, value: Column, thresholds: Sequence[float], group: Sequence[str] = ()) -> DataFrame:
    """``(group, threshold, n)`` with n = #{v >= threshold}, in one pass."""
    if not group:
        counted = bucket_counts(df, value, thresholds, []).withColumn("_g", F.lit(0))
        return tail_counts(counted, thresholds, ["_g"]).drop("_g")
    return tail_counts(bucket_counts(df, value, thresholds, group), thresholds, group)


def pixel_buckets(prob: np.ndarray, near: np.ndarray, true: np.ndarray, true_near: np.ndarray, grid: np.ndarray, origin: bool) -> dict[str, pa.Array]:
    """Counter columns per bucket of some pixels in raster order, the first of them a tile's origin if ``origin``.

    ``near`` and ``true_near`` are the largest probability and any truth in each pixel's disk; minus
    infinity stands for no probability, which clears no threshold and takes no part in sums.
    """
    levels = len(grid) + 1
    own, wide = np.searchsorted(grid, prob, "right"), np.searchsorted(grid, near, "right")
    count = lambda at, some=None: np.bincount(at if some is None else at[some], minlength=levels)
    some = prob > -np.inf
    least, most = np.full(levels, np.inf, prob.dtype), np.full(levels, -np.inf, prob.dtype)
    np.minimum.at(least, own[some], prob[some])
    np.maximum.at(most, own[some], prob[some])
    first = np.zeros(levels, np.int64)
    if origin:
        first[own[0]] = 1
    n, hits_r = count(own), count(wide, true)
    columns = dict(bucket=np.arange(levels, dtype=np.int32), tp=count(own, true), n_pred=n, hits_p=count(own, true_near), hits_r=hits_r, tiles=first, total_px=n,
                   true_px=count(own, true), prob_sum=np.bincount(own[some], prob[some].astype(float), minlength=levels))
    used = n + hits_r > 0
    none = (most == -np.inf)[used]
    return {c: pa.array(v[used]) for c, v in columns.items()} | {"prob_min": pa.array(least[used], mask=none), "prob_max": pa.array(most[used], mask=none)}


def block_buckets(prob_px: DataFrame, thresholds: Sequence[float], tolerance: int = 2, group: str = "dataset",
                  keys: Sequence[str] = KEYS, size: int = BLOCK) -> DataFrame:
    """Histograms and totals per ``(group, bucket)``; the only table that leaves the pixel scan.

    A pixel goes once to its block, with probability and truth; the group, which is constant per image,
    travels on the first pixels of block rows only.  The block counts its own pixels, so what is shuffled
    on is a few rows a block.  Mergeable: sums (and min/max) of these rows over batches, streams or
    partitions are the rows of the whole.  A tile is counted at its origin pixel.
    """
    grid = np.array(snapped(thresholds), np.float32)
    offsets = disk(tolerance)
    kind = np.float64 if prob_px.schema["prob"].dataType == T.DoubleType() else np.float32
    schema = T.StructType([T.StructField(group, prob_px.schema[group].dataType), T.StructField("bucket", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in (*COUNTS, *TOTALS[:-1])],
                           T.StructField("prob_sum", T.DoubleType()), *[T.StructField(c, prob_px.schema["prob"].dataType) for c in ("prob_min", "prob_max")]])

    def run(block: Block) -> pa.Table:
        low = kind(-np.inf)
        prob, true = block.array("prob", low, kind), block.array("true", False, bool)
        keep = block.inner(block.present)
        near, true_near = (block.inner(extreme(v, offsets, fill))[keep] for v, fill in ((prob, low), (true, False)))
        first = block.by == 0 and block.bx == 0 and keep.size and keep[0, 0]
        counted = pixel_buckets(block.inner(prob)[keep], near, block.inner(true)[keep], true_near, grid, bool(first))
        value = pa.scalar(block.constant("_group"), block.table.schema.field("_group").type)
        return pa.table({group: pa.repeat(value, len(counted["bucket"]))} | counted)

    rows = prob_px.withColumn("_group", F.when(F.col("x") % max(size, tolerance) == 0, F.col(group)))
    parts = over_blocks(rows, ["prob", "true", "_group"], tolerance, run, schema, keys, max(size, tolerance))
    return parts.groupBy(group, "bucket").agg(*[F.sum(c).alias(c) for c in (*COUNTS, *TOTALS)], F.min("prob_min").alias("prob_min"), F.max("prob_max").alias("prob_max"))


def counters_from_buckets(buckets: DataFrame, thresholds: Sequence[float], group: str = "dataset") -> DataFrame:
    """Counters at every threshold beside the dataset totals."""
    totals = [*[F.sum(c).alias(c) for c in TOTALS], F.min("prob_min").alias("prob_min"), F.max("prob_max").alias("prob_max")]
    return tail_counts(buckets, thresholds, [group], COUNTS, totals)


def accumulate(prob_px: DataFrame, thresholds: Sequence[float], tolerance: int = 2,
               group: str = "dataset", keys: Sequence[str] = KEYS) -> DataFrame:
    """Counters of every dataset and threshold from one pass over the pixels."""
    return counters_from_buckets(block_buckets(prob_px, thresholds, tolerance, group, keys), thresholds, group)


def with_pooled(counters: DataFrame, group: str = "dataset") -> DataFrame:
    """Dataset rows plus the pooled row of every threshold, by grouping sets over the counters."""
    sums = [F.sum(c).alias(c) for c in (*COUNTS, *TOTALS)]
    rolled = counters.groupingSets([[group, "threshold"], ["threshold"]], group, "threshold").agg(
        *sums, F.min("prob_min").alias("prob_min"), F.max("prob_max").alias("prob_max"),
        F.grouping(group).alias("g"))
    return rolled.withColumn(group, F.when(F.col("g") == 1, F.lit(POOLED)).otherwise(F.col(group))).drop("g")


def metrics_from_counts(counters: DataFrame) -> DataFrame:
    """IoU, Dice, precision, recall, F1 and the outline scores; zero wherever the base is empty."""
    tp, n_pred, true_px = F.col("tp"), F.col("n_pred"), F.col("true_px")

    def harmonic(p: Column, r: Column) -> Column:
        return safe_div(2 * p * r, p + r)

    table = counters.withColumns({
        "precision": safe_div(tp, n_pred), "recall": safe_div(tp, true_px),
        "iou": safe_div(tp, n_pred + true_px - tp), "dice": safe_div(2 * tp, n_pred + true_px),
        "outline_precision": safe_div(F.col("hits_p"), n_pred), "outline_recall": safe_div(F.col("hits_r"), true_px),
        "true_fraction": safe_div(true_px, F.col("total_px")), "pred_fraction": safe_div(n_pred, F.col("total_px")),
        "prob_mean": safe_div(F.col("prob_sum"), F.col("total_px"))})
    return table.withColumns({
        "f1": harmonic(F.col("precision"), F.col("recall")),
        "outline_f": harmonic(F.col("outline_precision"), F.col("outline_recall"))})


def best_threshold(metrics: DataFrame, group: str = "dataset") -> DataFrame:
    """Row of the highest Dice per dataset; ties go to the higher threshold.

    ``max_by`` keeps one row per group in the partial aggregate: no window, no sort.
    """
    rest = [c for c in metrics.columns if c != group]
    pick = F.max_by(F.struct(*rest), F.struct("dice", "threshold")).alias("r")
    return metrics.groupBy(group).agg(pick).select(group, "r.*")


def tile_scores(binary_px: DataFrame, keys: Sequence[str] = KEYS, carry: Sequence[str] = ("dataset",)) -> DataFrame:
    """Dice and the true and predicted fractions of every tile (columns ``pred`` and ``true``)."""
    p, t = F.col("pred").cast("bigint"), F.col("true").cast("bigint")
    sums = binary_px.groupBy(*keys, *carry).agg(
        F.sum(p * t).alias("tp"), F.sum(p).alias("pred_px"), F.sum(t).alias("true_px"), F.count("*").alias("px"))
    return sums.select(*keys, *carry, safe_div(2 * F.col("tp"), F.col("pred_px") + F.col("true_px")).alias("dice"),
                       safe_div(F.col("true_px"), F.col("px")).alias("true_fraction"),
                       safe_div(F.col("pred_px"), F.col("px")).alias("pred_fraction"))
