"""Validation as data: every check is a table of violations or of (check, ok) rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ValidationError(ValueError):
    """A table breaks a rule; the message quotes the first offenders."""


def require_none(violations: DataFrame, message: str, show: int = 5) -> None:
    """Raise when a violation table has rows; only ``show`` of them reach the driver."""
    rows = violations.limit(show).collect()
    if rows:
        raise ValidationError(f"{message}: {[r.asDict() for r in rows]}")


def missing_names(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Required column names the table does not have."""
    spark = df.sparkSession
    need = spark.createDataFrame([(c,) for c in required], "missing string")
    have = spark.createDataFrame([(c,) for c in df.columns], "missing string")
    return need.exceptAll(have)


def rows_without(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """``(missing, n_rows)``: required columns that some rows have no value in; all rows where the column is absent."""
    present = [c for c in required if c in df.columns]
    counts = df.agg(F.count("*").alias("rows"), *[F.count(c).alias(c) for c in present])
    lacking = [F.struct(F.lit(c).alias("missing"), (F.col("rows") - (F.col(c) if c in present else 0)).alias("n_rows")) for c in required]
    return counts.select(F.inline(F.array(*lacking))).filter("n_rows > 0")


def missing_groups(df: DataFrame, have: DataFrame, group: Sequence[str]) -> DataFrame:
    """Groups of ``df`` that ``have`` does not list."""
    return df.select(*group).distinct().join(have.select(*group), list(group), "left_anti")


def outside_domain(df: DataFrame, value: str, allowed: Sequence) -> DataFrame:
    """Offending values with their counts."""
    return (df.filter(F.col(value).isNull() | ~F.col(value).isin(*allowed))
            .groupBy(value).agg(F.count("*").alias("n")))


def exclude_from_train(folds: DataFrame, names: Sequence[str]) -> DataFrame:
    """Drop datasets from the training rows only."""
    return folds.filter(~((F.col("split") == "train") & F.col("dataset").isin(*sorted(set(names)))))


def unknown_exclusions(folds: DataFrame, names: Sequence[str]) -> DataFrame:
    """Excluded names that no training row carries (must be empty)."""
    want = folds.sparkSession.createDataFrame([(n,) for n in sorted(set(names))], "dataset string")
    return want.join(folds.filter("split = 'train'").select("dataset").distinct(), "dataset", "left_anti")


def sanity_bands(table: DataFrame, width: Column, pos_weight: Column, fraction: Column) -> DataFrame:
    """Whether class weight and outline fraction lie in the bands a line width allows."""
    return table.withColumns({
        "pos_weight_ok": pos_weight.between(F.greatest(F.lit(1.0), 10.0 / width), 400.0 / width),
        "fraction_ok": fraction.between(F.lit(0.005), F.least(F.lit(0.95), 0.25 * width / 2)),
        "tolerance_px": F.greatest(F.lit(1), F.round(width, 0).cast("int"))})


#: Where a tile lies: offset, patch size, image size and padding.
GEOMETRY = ("x", "y", "patch", "width", "height", "pad_right", "pad_bottom")


def _faults(folds: DataFrame) -> dict[str, Column]:
    """Marks of padded tiles and of tiles that reach out of their padded image; none where the geometry is not known."""
    if not set(GEOMETRY) <= set(folds.columns):
        return {"padded_": F.lit(0), "outside_": F.lit(0)}
    x, y, patch, w, h, r, b = map(F.col, GEOMETRY)
    inside = (x >= 0) & (y >= 0) & (x + patch <= w + r) & (y + patch <= h + b)
    return {"padded_": ((r != 0) | (b != 0)).cast("int"), "outside_": (~F.coalesce(inside, F.lit(False))).cast("int")}


def table_print(df: DataFrame, group: Sequence[str]) -> DataFrame:
    """``(group, n, total, mixed)``: equal for equal rows in any order or partitioning; a repeated row counts."""
    row = F.struct(*sorted(df.columns))
    return df.groupBy(*group).agg(F.count("*").alias("n"), F.sum(F.xxhash64(F.lit(1), row).cast("decimal(38,0)")).alias("total"),
                                  F.sum(F.xxhash64(F.lit(2), row).cast("decimal(38,0)")).alias("mixed"))


def rebuild_integrity(build: Callable[[DataFrame], DataFrame], source: DataFrame, partitions: int = 5) -> DataFrame:
    """``(fold, check_name, ok, detail)`` of the rule that folds built twice, from differently dealt and ordered rows, are the same.

    Only prints of the two builds meet, a row a fold; a fold that one build lacks fails.
    """
    order = F.xxhash64(F.lit(7), F.struct(*source.columns))
    first = table_print(build(source), ["fold"])
    again = table_print(build(source.repartition(partitions, order).sortWithinPartitions(order.desc())), ["fold"])
    both = first.join(again.select("fold", *[F.col(c).alias(f"{c}_") for c in ("n", "total", "mixed")]), "fold", "full")
    same = F.lit(True)
    for c in ("n", "total", "mixed"):
        same = same & F.coalesce(F.col(c) == F.col(f"{c}_"), F.lit(False))
    return both.select("fold", F.lit("deterministic_rebuild").alias("check_name"), same.alias("ok"),
                       F.concat_ws("/", F.coalesce("n", F.lit(0)), F.coalesce("n_", F.lit(0))).alias("detail"))


def fold_integrity(folds: DataFrame, test_only: Sequence[str], width: float = 2.0) -> DataFrame:
    """``(fold, check_name, ok, detail)``: one row per fold and rule.

    Tiles are grouped by parent first, so distinct counts never expand the whole fold.  Where the folds
    carry tile geometry (:data:`GEOMETRY`) two more rules look at it; :func:`rebuild_integrity` has the last.
    """
    folds = folds.withColumns(_faults(folds))
    split = F.col("split")
    sides = folds.groupBy("fold", "dataset", "parent_id").agg(
        F.sum((split == "train").cast("int")).alias("train"), F.sum((split == "val").cast("int")).alias("val"),
        F.sum(F.when(split == "train", F.col("outline_fraction"))).alias("mass"), F.sum("padded_").alias("padded"), F.sum("outside_").alias("outside"))
    per = sides.groupBy("fold").agg(
        F.sum("train").alias("train"), F.sum("val").alias("val"), F.sum("mass").alias("mass"),
        F.sum(((F.col("train") > 0) & (F.col("val") > 0)).cast("int")).alias("shared"),
        F.sum(F.col("dataset").isin(*test_only).cast("int")).alias("test_rows"), F.sum("padded").alias("padded"), F.sum("outside").alias("outside"))
    repeats = (folds.groupBy("fold", "tile_id").agg(F.count("*").alias("n"))
               .groupBy("fold").agg(F.sum((F.col("n") > 1).cast("int")).alias("repeats")))
    mean = F.col("mass") / F.col("train")
    weight = F.when(mean > 0, (1 - mean) / mean)
    rules = {
        "non_empty": ((F.col("train") > 0) & (F.col("val") > 0), F.concat_ws("/", "train", "val")),
        "test_only_absent": (F.col("test_rows") == 0, F.col("test_rows").cast("string")),
        "tiles_unique": (F.col("repeats") == 0, F.col("repeats").cast("string")),
        "parents_disjoint": (F.col("shared") == 0, F.col("shared").cast("string")),
        "pos_weight_in_band": (weight.between(max(1.0, 10.0 / width), 400.0 / width), F.round(weight, 3).cast("string")),
    }
    if set(GEOMETRY) <= set(folds.columns):
        rules["no_padding"] = F.col("padded") == 0, F.col("padded").cast("string")
        rules["tile_inside_image"] = F.col("outside") == 0, F.col("outside").cast("string")
    cells = F.array(*[F.struct(F.lit(n).alias("check_name"), ok.alias("ok"), detail.alias("detail"))
                      for n, (ok, detail) in rules.items()])
    return per.join(repeats, "fold").select("fold", F.inline(cells))
