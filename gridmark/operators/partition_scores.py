"""Scores between two region partitions, all derived from one sparse contingency table.

``contingency(keys, t, p, n)`` is linear in pixels and everything after it works on region
pairs.  Margins come from grouping sets over that table, so hot regions are folded by partial
aggregation and no window spans an image.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmark.functions.scalars import choose_two, safe_div
from gridmark.operators.raster import KEYS


def overlay(true_regions: DataFrame, pred_regions: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Pixels with both regions ``t`` and ``p`` (0 where one partition has none)."""
    j = true_regions.select(*keys, "y", "x", F.col("region").alias("t")).join(
        pred_regions.select(*keys, "y", "x", F.col("region").alias("p")), [*keys, "y", "x"], "full_outer")
    return j.na.fill(0, ["t", "p"])


def contingency(both: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return both.groupBy(*keys, "t", "p").agg(F.count("*").alias("n"))


def _rolled(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    k = list(keys)
    return (table.groupingSets([[*k, "t", "p"], [*k, "t"], [*k, "p"]], *k, "t", "p")
            .agg(F.sum("n").alias("n"), F.grouping("t").alias("gt"), F.grouping("p").alias("gp")))


def rand_and_information(table: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Adjusted Rand index and variation of information (nats) per image.

    With H = ln N - (sum n ln n)/N the information distance 2 H(t,p) - H(t) - H(p) needs three
    sums, taken together with the pair counts in one aggregate over cells and margins.
    """
    rolled = _rolled(table, keys)
    cell, row, col = (F.col("gt") + F.col("gp") == 0), F.col("gp") == 1, F.col("gt") == 1
    n = F.col("n").cast("double")
    pairs, logs = choose_two(n), n * F.log(n)
    sums = []
    for name, which in (("c", cell), ("a", row), ("b", col)):
        sums += [F.sum(F.when(which, pairs).otherwise(0.0)).alias(f"pairs_{name}"),
                 F.sum(F.when(which, logs).otherwise(0.0)).alias(f"logs_{name}")]
    s = rolled.groupBy(*keys).agg(F.sum(F.when(cell, n).otherwise(0.0)).alias("total"), *sums,
                                  F.sum(F.when(row, 1).otherwise(0)).alias("n_true_regions"),
                                  F.sum(F.when(col, 1).otherwise(0)).alias("n_pred_regions"))
    expected = safe_div(F.col("pairs_a") * F.col("pairs_b"), choose_two(F.col("total")))
    top = (F.col("pairs_a") + F.col("pairs_b")) * 0.5
    ari = (F.when(F.col("total") < 2, 1.0)
           .when(top - expected == 0, F.when(F.col("pairs_c") == top, 1.0).otherwise(0.0))
           .otherwise((F.col("pairs_c") - expected) / (top - expected)))
    vi = F.when(F.col("total") > 0,
                (F.col("logs_a") + F.col("logs_b") - 2 * F.col("logs_c")) / F.col("total")).otherwise(0.0)
    return s.select(*keys, ari.alias("ari"), vi.alias("vi"), "n_true_regions", "n_pred_regions")


def overlaps(table: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Cells of two real regions (label 0 left out) with areas, IoU and share of the true region.

    Areas count label-0 pixels of the other side, as a union of pixel sets does.
    """
    k = list(keys)
    area_t = table.groupBy(*k, "t").agg(F.sum("n").alias("area_t"))
    area_p = table.groupBy(*k, "p").agg(F.sum("n").alias("area_p"))
    j = table.filter("t <> 0 and p <> 0").join(area_t, [*k, "t"]).join(area_p, [*k, "p"])
    union = F.col("area_t") + F.col("area_p") - F.col("n")
    return j.withColumns({"iou": F.col("n") / union, "share": F.col("n") / F.col("area_t")})


def panoptic_quality(table: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """PQ, SQ, RQ and match counts per image.

    Two regions can exceed IoU 0.5 only with each other, so matching is a filter.
    """
    rolled = _rolled(table, keys)
    sizes = rolled.groupBy(*keys).agg(
        F.sum(F.when((F.col("gp") == 1) & (F.col("t") != 0), 1).otherwise(0)).alias("n_true"),
        F.sum(F.when((F.col("gt") == 1) & (F.col("p") != 0), 1).otherwise(0)).alias("n_pred"))
    hits = overlaps(table, keys).filter("iou > 0.5").groupBy(*keys).agg(
        F.count("*").alias("tp"), F.sum("iou").alias("iou"))
    j = sizes.join(hits, list(keys), "left").na.fill(0, ["tp"]).na.fill(0.0, ["iou"])
    fp, fn = F.col("n_pred") - F.col("tp"), F.col("n_true") - F.col("tp")
    base = F.col("tp") + 0.5 * fp + 0.5 * fn
    return j.select(*keys, F.when(base > 0, F.col("iou") / base).otherwise(1.0).alias("pq"),
                    safe_div(F.col("iou"), F.col("tp")).alias("sq"), safe_div(F.col("tp"), base).alias("rq"),
                    F.col("tp").alias("pq_tp"), fp.alias("pq_fp"), fn.alias("pq_fn"))


def without_tiny(table: DataFrame, min_area: Column, keys: Sequence[str] = KEYS) -> DataFrame:
    """Contingency with every true region below ``min_area`` zeroed on both sides."""
    k = list(keys)
    tiny = (table.groupBy(*k, "t").agg(F.sum("n").alias("a")).filter((F.col("t") != 0) & (F.col("a") < min_area))
            .select(*k, "t", F.lit(True).alias("tiny")))
    marked = table.join(tiny, [*k, "t"], "left")
    gone = F.coalesce("tiny", F.lit(False))
    return (marked.withColumns({"t": F.when(gone, 0).otherwise(F.col("t")), "p": F.when(gone, 0).otherwise(F.col("p"))})
            .groupBy(*k, "t", "p").agg(F.sum("n").alias("n")))


def panoptic_quality_excluding_tiny(table: DataFrame, min_area: int, keys: Sequence[str] = KEYS) -> DataFrame:
    if min_area < 0:
        raise ValueError(f"min_area must be >= 0, got {min_area}")
    k = list(keys)
    areas = table.groupBy(*k, "t").agg(F.sum("n").alias("a"))
    excluded = areas.groupBy(*k).agg(
        F.sum(F.when((F.col("t") != 0) & (F.col("a") < min_area), 1).otherwise(0)).alias("n_true_excluded"))
    return panoptic_quality(without_tiny(table, F.lit(min_area), keys), keys).join(excluded, k)


def region_row(table: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """All region scores of an image in one row."""
    both = rand_and_information(table, keys).join(panoptic_quality(table, keys), list(keys))
    return both.withColumn("over_segmentation_factor", safe_div(F.col("n_pred_regions"), F.col("n_true_regions")))


REGION_METRICS = ("ari", "vi", "pq", "sq", "rq", "pq_tp", "pq_fp", "pq_fn", "n_true_regions", "n_pred_regions",
                  "over_segmentation_factor")


def mean_rows(rows: DataFrame, group: Sequence[str] = ("dataset",), metrics: Sequence[str] = REGION_METRICS) -> DataFrame:
    """Unweighted mean of every metric over the tiles of a group."""
    return rows.groupBy(*group).agg(F.count("*").alias("tiles"), *[F.avg(m).alias(m) for m in metrics])


def dominant_share(table: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per true region: area, best IoU, the predicted region holding most of it, and rivals there.

    ``rivals`` counts the *other* true regions of which that predicted region holds more than half.
    """
    k = list(keys)
    cells = overlaps(table, keys)
    best = cells.groupBy(*k, "t").agg(
        F.max("iou").alias("best_iou"),
        F.max_by(F.struct("p", "share"), F.struct(F.col("share"), -F.col("p"))).alias("d"))
    held = cells.filter("share > 0.5").groupBy(*k, "p").agg(F.count("*").alias("held"))
    areas = table.filter("t <> 0").groupBy(*k, "t").agg(F.sum("n").alias("area"))
    j = areas.join(best, [*k, "t"], "left").select(
        *k, "t", "area", F.coalesce("best_iou", F.lit(0.0)).alias("best_iou"), F.col("d.p").alias("p"),
        F.coalesce("d.share", F.lit(0.0)).alias("dominant_share"))
    own = (F.col("dominant_share") > 0.5).cast("bigint")
    return (j.join(held, [*k, "p"], "left")
            .withColumn("rivals", F.coalesce(F.col("held") - own, F.lit(0).cast("bigint"))).drop("held"))
