"""Threshold sweeps, pooled metrics and best thresholds."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridmark.operators import raster, sweepcounts
from gridmark.workload import fixtures
from gridmark.workload.registry import query
from gridmark.workload.views import ratio, view

GRID = sweepcounts.threshold_grid(0.05, 0.95, 0.05)
RATIOS = ("precision", "recall", "iou", "dice", "f1", "outline_precision", "outline_recall", "outline_f",
          "true_fraction", "pred_fraction")


def rounded(df, *columns, places: int = 6):
    return df.withColumns({c: F.round(c, places) for c in columns})


@query("A19_ge_counts", "prob_px grid", """
SELECT dataset, threshold, count(*) FILTER (p100 >= t100) AS n FROM prob_px, grid GROUP BY 1, 2""")
def ge_counts(spark, d):
    return sweepcounts.ge_counts(fixtures.px(spark, d), F.col("prob"), GRID, ["dataset"])


@query("A19_ge_counts_scores", "scores grid", """
SELECT dataset, threshold, count(*) FILTER (p100 >= t100) AS n FROM scores, grid GROUP BY 1, 2""")
def ge_counts_scores(spark, d):
    return sweepcounts.ge_counts(fixtures.scores(spark, d), F.col("prob"), GRID, ["dataset"])


@query("A20_metric_accumulation", "counters", """
SELECT dataset, threshold, tp, n_pred, hits_p, hits_r, tiles, total_px, true_px,
       round(pmin / 100.0::DOUBLE, 6) AS prob_min, round(pmax / 100.0::DOUBLE, 6) AS prob_max,
       round(psum / 100.0::DOUBLE, 3) AS prob_sum FROM counters""")
def metric_accumulation(spark, d):
    out = sweepcounts.accumulate(fixtures.prob_px(spark, d), GRID)
    return out.select("dataset", "threshold", "tp", "n_pred", "hits_p", "hits_r", "tiles", "total_px", "true_px",
                      F.round(F.col("prob_min").cast("double"), 6).alias("prob_min"),
                      F.round(F.col("prob_max").cast("double"), 6).alias("prob_max"),
                      F.round("prob_sum", 3).alias("prob_sum"))


def _metrics_sql(source: str) -> str:
    p, r = "(CASE WHEN n_pred > 0 THEN tp / n_pred::DOUBLE ELSE 0 END)", "(CASE WHEN true_px > 0 THEN tp / true_px::DOUBLE ELSE 0 END)"
    bp, br = p.replace("tp", "hits_p"), r.replace("tp", "hits_r")
    return f"""
SELECT dataset, threshold, tp::BIGINT AS tp, n_pred::BIGINT AS n_pred, {ratio("tp", "n_pred")} AS precision,
       {ratio("tp", "true_px")} AS recall, {ratio("tp", "n_pred + true_px - tp")} AS iou,
       {ratio("2 * tp", "n_pred + true_px")} AS dice, {ratio(f"2 * {p} * {r}", f"{p} + {r}")} AS f1,
       {ratio("hits_p", "n_pred")} AS outline_precision, {ratio("hits_r", "true_px")} AS outline_recall,
       {ratio(f"2 * {bp} * {br}", f"{bp} + {br}")} AS outline_f, {ratio("true_px", "total_px")} AS true_fraction,
       {ratio("n_pred", "total_px")} AS pred_fraction FROM {source}"""


view("pooled", """
SELECT CASE WHEN grouping(dataset) = 1 THEN '__pooled__' ELSE dataset END AS dataset, threshold,
       sum(tp)::BIGINT AS tp, sum(n_pred)::BIGINT AS n_pred, sum(hits_p)::BIGINT AS hits_p, sum(hits_r)::BIGINT AS hits_r,
       sum(total_px)::BIGINT AS total_px, sum(true_px)::BIGINT AS true_px
FROM counters GROUP BY GROUPING SETS ((dataset, threshold), (threshold))""", "counters")
view("metrics", _metrics_sql("pooled"), "pooled")


@query("A21_metrics_from_counts", "counters", _metrics_sql("counters"))
def metrics_from_counts(spark, d):
    out = sweepcounts.metrics_from_counts(sweepcounts.accumulate(fixtures.prob_px(spark, d), GRID))
    return rounded(out.select("dataset", "threshold", "tp", "n_pred", *RATIOS), *RATIOS)


@query("A22_sweep_grouping_sets", "metrics", "SELECT * FROM metrics")
def sweep_grouping_sets(spark, d):
    counters = sweepcounts.accumulate(fixtures.prob_px(spark, d), GRID)
    out = sweepcounts.metrics_from_counts(sweepcounts.with_pooled(counters))
    return rounded(out.select("dataset", "threshold", "tp", "n_pred", *RATIOS), *RATIOS)


@query("W06_best_threshold", "metrics", """
SELECT dataset, threshold, dice, outline_f FROM metrics
QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY dice DESC, threshold DESC) = 1""")
def best_threshold(spark, d):
    out = rounded(sweepcounts.metrics_from_counts(sweepcounts.with_pooled(
        sweepcounts.accumulate(fixtures.prob_px(spark, d), GRID))), "dice", "outline_f")
    return sweepcounts.best_threshold(out.select("dataset", "threshold", "dice", "outline_f"))


@query("P18_threshold_grid", "scores", """
SELECT dataset, round(lo + (hi - lo) * i / n, 6) AS threshold FROM (
  SELECT dataset, lo, hi, greatest(1, CAST(round((hi - lo) / 0.05::DOUBLE) AS INTEGER)) AS n, unnest(range(0, greatest(1, CAST(round((hi - lo) / 0.05::DOUBLE) AS INTEGER)) + 1)) AS i
  FROM (SELECT dataset, least(0.45, greatest(0.05, min(p100) / 100.0::DOUBLE)) AS lo, greatest(0.55, least(0.95, max(p100) / 100.0::DOUBLE)) AS hi FROM scores GROUP BY 1))
UNION SELECT DISTINCT dataset, 0.5 FROM scores""")
def threshold_grid(spark, d):
    """Each dataset's own grid, over the range its scores span."""
    s = fixtures.scores(spark, d).groupBy("dataset").agg(F.min("p100").alias("a"), F.max("p100").alias("b"))
    lo = F.least(F.lit(0.45), F.greatest(F.lit(0.05), F.col("a") / F.lit(100.0)))
    hi = F.greatest(F.lit(0.55), F.least(F.lit(0.95), F.col("b") / F.lit(100.0)))
    return s.select("dataset", F.explode(sweepcounts.grid_of(lo, hi, 0.05)).alias("threshold"))


@query("P06_binarize", "prob_px", """
SELECT image_id, y, x FROM prob_px WHERE p100 >= CASE dataset WHEN 'd0' THEN 50 WHEN 'd1' THEN 60 ELSE 70 END""")
def binarize(spark, d):
    from gridmark.operators.postprocess import binarize as run
    limits = spark.createDataFrame([("d0", 0.5), ("d1", 0.6), ("d2", 0.7)], "dataset string, threshold double")
    return run(fixtures.px(spark, d), limits).select("image_id", "y", "x")


@query("P22_euclidean_disk", "scores", """
SELECT dataset, dy, dx FROM (SELECT dataset, CAST(max(p100) % 4 + 2 AS INTEGER) AS radius FROM scores GROUP BY 1),
       (SELECT CAST(i AS INTEGER) AS dy FROM range(-5, 6) t(i)) a,
       (SELECT CAST(i AS INTEGER) AS dx FROM range(-5, 6) t(i)) b WHERE dy * dy + dx * dx <= radius * radius""")
def euclidean_disk(spark, d):
    r = fixtures.scores(spark, d).groupBy("dataset").agg((F.max("p100") % 4 + 2).alias("radius"))
    return raster.disk_of(r, "radius").select("dataset", "dy", "dx")
