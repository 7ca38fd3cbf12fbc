"""Evaluation of stored predictions at one operating point per dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmark.operators import attribution, partition_scores, regions
from gridmark.plans.sweep import sweep
from gridmark.session import cut


def operating_point(limits: DataFrame, name: str = "none@tuned") -> DataFrame:
    """``limits(dataset, threshold)`` as a configuration table without post-processing."""
    null = F.lit(None).cast("double")
    return limits.select("dataset", F.lit(name).alias("config"), F.lit("none").alias("mode"), F.col("threshold").cast("double").alias("threshold"),
                         null.alias("radius"), null.alias("bridge"), null.alias("marker"),
                         F.lit("binary_outline").alias("partition"), F.lit(False).alias("reference"))


def evaluate(prob_px: DataFrame, limits: DataFrame, name: str | None = None) -> DataFrame:
    """Decomposition and mean region scores per dataset at the given thresholds, as configuration ``name``."""
    return sweep(prob_px, operating_point(limits, name) if name else operating_point(limits))


def attribute_false_negatives(prob_px: DataFrame, limits: DataFrame, tiny_area: int, gap_tolerance: int = 1) -> DataFrame:
    """Why true regions stay unmatched, per dataset."""
    px = cut(prob_px.join(limits.select("dataset", F.col("threshold").cast("float").alias("t")), "dataset")
             .withColumn("pred", F.col("prob") >= F.col("t")).drop("t"))
    keys = ("image_id", "dataset")
    truth = cut(regions.regions_from_outline(px.withColumn("outline", F.col("true")), keys=keys))
    found = regions.regions_from_outline(px.withColumn("outline", F.col("pred")), keys=keys)
    table = cut(partition_scores.contingency(partition_scores.overlay(truth, found, keys), keys))
    missed = cut(attribution.classify(table, tiny_area, keys))
    gaps = attribution.merge_gaps(missed, table, truth, px.filter(F.col("true")), px.filter(F.col("pred")), gap_tolerance, keys)
    sizes = (table.filter("t <> 0").select(*keys, "t").distinct().groupBy(*keys).agg(F.count("*").alias("r"))
             .groupBy("dataset").agg(F.count("*").alias("tiles"), F.sum("r").alias("n_true")))
    return attribution.summarise(missed, gaps, sizes, keys=keys)
