"""Configuration grids and the sweep that scores every configuration on stored predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmark.operators import partition_scores, postprocess, regions, selection
from gridmark.operators.checks import require_none
from gridmark.operators.decomposition import DISTANCES, RADII, decomposition_counts, verdict, with_skeletons
from gridmark.operators.raster import frame
from gridmark.operators.watershed import watershed_regions
from gridmark.session import cut

FIELDS = ("config", "mode", "threshold", "radius", "bridge", "marker", "partition", "reference")
SHAPES = ("config", "image_id", "dataset")


def _cell(name: Column, mode: str, threshold: Column, partition: str = "binary_outline", radius=None, bridge=None,
          marker=None, reference: bool = False) -> Column:
    def opt(v) -> Column:
        return F.lit(None if v is None else float(v)).cast("double")

    return F.struct(name.alias("config"), F.lit(mode).alias("mode"), threshold.cast("double").alias("threshold"),
                    opt(radius).alias("radius"), opt(bridge).alias("bridge"), opt(marker).alias("marker"),
                    F.lit(partition).alias("partition"), F.lit(reference).alias("reference"))


def _check_open(values: Sequence[float], what: str) -> None:
    bad = [v for v in values if not 0.0 < float(v) < 1.0]
    if bad:
        raise ValueError(f"{what} must be in (0, 1), got {bad}")


def _points(thresholds: Sequence[float]) -> list[tuple[str, Column]]:
    _check_open(thresholds, "thresholds")
    return [(f"{float(t):.2f}", F.lit(float(t))) for t in thresholds] + [("tuned", F.col("tuned"))]


def _explode(datasets: DataFrame, cells: list[Column]) -> DataFrame:
    return datasets.select("dataset", F.inline(F.array(*cells)))


def postprocess_grid(datasets: DataFrame, modes: Sequence[str], thresholds: Sequence[float], reference: bool = True) -> DataFrame:
    """Every mode at every threshold and at the dataset's tuned one, plus the watershed reference row.

    ``datasets(dataset, tuned)``; the grid is a literal list each dataset is exploded over.
    """
    unknown = [m for m in modes if m not in postprocess.MODES]
    if unknown:
        raise ValueError(f"unknown modes {unknown}")
    cells = [_cell(F.lit(f"{m}@{label}"), m, t) for m in modes for label, t in _points(thresholds)]
    if reference:
        cells.append(_cell(F.lit("reference: watershed_prob@tuned"), "none", F.col("tuned"), "watershed_prob", reference=True))
    return _explode(datasets, cells)


def gap_closing_grid(datasets: DataFrame, radii: Sequence[int], bridges: Sequence[float], thresholds: Sequence[float],
                     reference: bool = True) -> DataFrame:
    """Closing radii and bridge distances, each at every threshold and at the tuned one."""
    if any(int(r) < 1 for r in radii) or any(float(b) <= 0 for b in bridges):
        raise ValueError("closing radii must be >= 1 and bridges > 0")
    cells = [_cell(F.lit(f"morph_close_r{int(r)}@{label}"), "morph_close", t, radius=r) for r in radii for label, t in _points(thresholds)]
    cells += [_cell(F.lit(f"skeleton_bridge_{float(b):g}px@{label}"), "skeleton_bridge", t, bridge=b)
              for b in bridges for label, t in _points(thresholds)]
    if reference:
        cells.append(_cell(F.lit("reference: watershed_prob@tuned"), "none", F.col("tuned"), "watershed_prob", reference=True))
    return _explode(datasets, cells)


def marker_grid(datasets: DataFrame, markers: Sequence[float]) -> DataFrame:
    """One watershed configuration per marker, at the tuned threshold."""
    _check_open(markers, "markers")
    return _explode(datasets, [_cell(F.lit(f"watershed_prob@marker{float(m):.2f}"), "none", F.col("tuned"), "watershed_prob", marker=m)
                               for m in markers])


def invalid_configs(configs: DataFrame, width: int | None) -> DataFrame:
    """Configuration rows that break a rule, with the rule (must be empty)."""
    outside = lambda c: ~((F.col(c) > 0) & (F.col(c) < 1))
    rule = (F.when(~F.col("mode").isin(*postprocess.MODES), "unknown mode")
            .when(~F.col("partition").isin("binary_outline", "watershed_prob"), "unknown partition")
            .when((F.col("partition") == "watershed_prob") & (F.col("mode") != "none"), "watershed takes no post-processing")
            .when(F.coalesce(outside("threshold"), F.lit(True)), "threshold outside (0, 1)")
            .when(F.coalesce(outside("marker"), F.lit(False)), "marker outside (0, 1)")
            .when((F.col("mode") != "none") & F.lit(width is None or width < 1), "mode needs a target width")
            .when((F.col("mode") == "morph_close") & F.coalesce(F.col("radius") < 1, F.lit(True)), "morph_close needs a radius")
            .when((F.col("mode") == "skeleton_bridge") & F.coalesce(F.col("bridge") <= 0, F.lit(True)), "skeleton_bridge needs a distance"))
    return configs.withColumn("rule", rule).filter("rule is not null")


def predicted_masks(prob_px: DataFrame, configs: DataFrame, width: int | None) -> DataFrame:
    """Outline mask of every configuration and image, keyed by ``config``.

    Configurations that share a post-processing shape run through it together: the loop is over
    the few distinct (mode, radius, bridge) shapes, never over configurations or tiles.
    """
    j = prob_px.join(F.broadcast(configs.select("dataset", *FIELDS)), "dataset")
    on = cut(j.filter(F.col("prob") >= F.col("threshold").cast("float")).select(*frame(SHAPES), "mode", "radius", "bridge"))
    out = None
    for s in configs.select("mode", "radius", "bridge").distinct().collect():
        shape = (F.col("mode") == s.mode) & F.col("radius").eqNullSafe(F.lit(s.radius)) & F.col("bridge").eqNullSafe(F.lit(s.bridge))
        # a closing thins what it dilated, which must not reach beyond the pixels there are; the other modes are clipped by their reader
        within = j.filter(shape) if s.mode == "morph_close" else None
        done = postprocess.postprocess(on.filter(shape), s.mode, width, s.radius, s.bridge, SHAPES, within)
        out = done if out is None else out.unionByName(done)
    return out


def sweep(prob_px: DataFrame, configs: DataFrame, width: int | None = None, marker: float = 0.3, tolerance: float = 2.0,
          radii: Sequence[int] = RADII, distances: Sequence[int] = DISTANCES, decompose: bool = True) -> DataFrame:
    """One row per configuration and dataset: pooled decomposition and mean region scores.

    ``prob_px`` has ``image_id, dataset, split, height, width, y, x, prob, true``.  The true
    partition is computed once per image and shared by all configurations.  Without ``decompose`` the
    columns of the decomposition are left out, and nothing is thinned for them.
    """
    require_none(invalid_configs(configs, width), "invalid configuration")
    prob_px = cut(prob_px.select("image_id", "dataset", "split", "height", "width", "y", "x", "prob", "true"))
    missing = prob_px.select("dataset").distinct().join(configs.select("dataset").distinct(), "dataset", "left_anti")
    require_none(missing, "datasets without configuration")
    truth = cut(regions.regions_from_outline(prob_px.withColumn("outline", F.col("true"))))
    pred = predicted_masks(prob_px, configs, width)
    j = prob_px.join(F.broadcast(configs.select("dataset", *FIELDS)), "dataset")
    scored = cut(j.join(pred.select(*SHAPES, "y", "x", F.lit(True).alias("hit")), [*SHAPES, "y", "x"], "left")
                 .select(*frame(SHAPES), "prob", "true", "partition", F.coalesce("marker", F.lit(float(marker))).alias("marker"),
                         F.coalesce("hit", F.lit(False)).alias("pred")))
    line = scored.filter("partition = 'binary_outline'").withColumn("outline", F.col("pred"))
    flood = scored.filter("partition = 'watershed_prob'")
    found = regions.regions_from_outline(line, keys=SHAPES)
    if not flood.isEmpty():
        found = found.unionByName(watershed_regions(flood, "marker", keys=SHAPES))
    both = found.select(*SHAPES, "y", "x", F.col("region").alias("p")).join(
        truth.select("image_id", "y", "x", F.col("region").alias("t")), ["image_id", "y", "x"])
    rows = partition_scores.region_row(cut(partition_scores.contingency(both, SHAPES)), SHAPES)
    means = partition_scores.mean_rows(rows, ("config", "dataset"))
    area = scored.groupBy(*SHAPES).agg(F.avg(F.col("pred").cast("double")).alias("f")).groupBy("config", "dataset").agg(
        F.avg("f").alias("pred_fraction"))
    splits = prob_px.select("dataset", "split").distinct().groupBy("dataset").agg(
        F.array_join(F.array_sort(F.collect_set("split")), ",").alias("split"))
    out = configs.select("dataset", *FIELDS)
    if decompose:
        counts = decomposition_counts(with_skeletons(scored, SHAPES), ("config", "dataset"), radii, distances, SHAPES)
        out = out.join(verdict(counts, radii, distances, tolerance).drop("tiles"), ["config", "dataset"])
    return out.join(means, ["config", "dataset"]).join(area, ["config", "dataset"]).join(splits, "dataset")


FLAT = ("config", "dataset", "split", "mode", "threshold", "partition", "reference", "radius", "bridge", "tiles", "pixel_dice",
        "skeleton_dice", "width_ratio", "real", "found", "label", "tolerance_px", "pq", "sq", "rq", "over_segmentation_factor",
        "n_true_regions", "n_pred_regions", "pred_fraction")


def flatten(rows: DataFrame) -> DataFrame:
    """The flat report record of a sweep row."""
    return rows.select(*FLAT)


def config_from_selection(selected: DataFrame, name: str = "selected (val-best)") -> DataFrame:
    """The selected rows as one configuration, parameters carried through; the only thing scored on test."""
    require_none(selected.filter("partition <> 'binary_outline'").select("dataset", "partition"),
                 "a selected configuration must use the binary outline")
    return selected.select("dataset", F.lit(name).alias("config"), *[c for c in FIELDS if c not in ("config", "reference")],
                           F.lit(False).alias("reference"))


def marker_config_from_selection(selected: DataFrame, name: str = "watershed_prob@val-best marker") -> DataFrame:
    """The selected markers as one watershed configuration."""
    return selected.select("dataset", F.lit(name).alias("config"), F.lit("none").alias("mode"), "threshold",
                           *[F.lit(None).cast("double").alias(c) for c in ("radius", "bridge")], "marker",
                           F.lit("watershed_prob").alias("partition"), F.lit(False).alias("reference"))


def select_then_test(val_px: DataFrame, test_px: DataFrame, configs: DataFrame, width: int, metric: str = "pq") -> DataFrame:
    """Choose per dataset on validation tiles, then score only that choice on test tiles.

    A choice by a region score needs no decomposition of the validation tiles.
    """
    judged = sweep(val_px, configs, width, decompose=metric not in partition_scores.REGION_METRICS)
    chosen = cut(selection.select_config(cut(judged), metric))
    return sweep(test_px, cut(config_from_selection(chosen)), width)
