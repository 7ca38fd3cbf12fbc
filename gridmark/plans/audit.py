"""Audit of paired masks: colours, line-likeness votes and the outline mode of every dataset."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmark.functions import colour
from gridmark.operators import pairing, palette, profiles, sampling
from gridmark.session import cut
from gridmark.sources import files

KEYS = ("image_id", "dataset")


def sample_images(mask_px: DataFrame, size: int = 24, seed: int = 0) -> DataFrame:
    """The images audited per dataset, in seeded order."""
    images = mask_px.filter("y = 0 and x = 0").select(*KEYS)
    return sampling.seeded_sample(images, size, seed, F.col("image_id"), ["dataset"])


def colour_tests(mask_px: DataFrame) -> DataFrame:
    """Line-likeness of every tested colour of every image."""
    counts = cut(palette.colour_counts(mask_px, KEYS))
    tested = palette.test_order(counts, KEYS).filter("status = 'tested'").select(*KEYS, "rgb")
    held = mask_px.join(tested, [*KEYS, "rgb"], "left_semi")
    return palette.line_tests(profiles.colour_geometry(held, "rgb", KEYS))


def audit(mask_px: DataFrame, size: int | None = 24, seed: int = 0) -> DataFrame:
    """Mode verdict, palette votes and number of audited images per dataset; ``size`` None audits every image."""
    chosen = cut(mask_px.filter("y = 0 and x = 0").select(*KEYS) if size is None else sample_images(mask_px, size, seed))
    px = cut(mask_px.join(chosen, list(KEYS), "left_semi"))
    tests = cut(colour_tests(px))
    files = chosen.groupBy("dataset").agg(F.count("*").alias("n_files"))
    verdict = palette.mode_verdict(palette.tally_colours(tests), files)
    report = palette.palette_report(palette.colour_counts(px, KEYS), KEYS)
    votes = report.groupBy("dataset").agg(F.sum(F.col("quantized").cast("bigint")).alias("quantized_files"),
                                          F.min("n_unique").alias("colours_min"), F.max("n_unique").alias("colours_max"))
    return verdict.join(votes, "dataset")


def audit_folder(spark: SparkSession, root: str, size: int = 24, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """``(report, errors)`` of the image folders below ``root``, one dataset each.

    Pairs are found over all files, at most ``size`` masks a dataset are read.  ``errors(dataset,
    path, problem)`` lists the sampled masks without pixels; they do not stop the audit, and the
    report counts the others.
    """
    home = F.regexp_extract("path", f"^(.*?{re.escape(root.rstrip('/'))}/[^/]+)/", 1)
    pairs = pairing.discover_pairs(pairing.discover(files.scan_files(spark, root), home)).filter("image_path is not null")
    chosen = cut(sampling.seeded_sample(pairs.select("dataset", files.one_form(F.col("mask_path")).alias("path")), size, seed, F.col("path"), ["dataset"]))
    paths = [r.path for r in chosen.select("path").collect()]  # at most ``size`` a dataset
    if not paths:
        raise ValueError(f"{root}: no image and mask pair up")
    px = (files.scan_pixels(spark, paths).join(chosen, "path")
          .select(F.col("path").alias("image_id"), "dataset", "height", "width", "y", "x", colour.pack(F.col("r"), F.col("g"), F.col("b")).alias("rgb")))
    errors = files.image_problems(spark, paths).join(chosen, "path").select("dataset", "path", "problem")
    return audit(cut(px), None), errors
