"""Tile manifests: fixed schema, validated on read, one file set per fold on write."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridmark.operators.checks import ValidationError, require_none

_TEXT, _INT, _REAL = T.StringType(), T.IntegerType(), T.DoubleType()
#: fixed columns of a manifest, in file order
MANIFEST = T.StructType([T.StructField(n, t) for n, t in (
    ("tile_id", _TEXT), ("dataset", _TEXT), ("parent_id", _TEXT), ("source_image", _TEXT), ("x", _INT), ("y", _INT),
    ("outline_fraction", _REAL), ("split", _TEXT), ("patch", _INT), ("image_path", _TEXT), ("gt_path", _TEXT), ("crop_left", _INT),
    ("crop_top", _INT), ("crop_width", _INT), ("crop_height", _INT), ("pad_right", _INT), ("pad_bottom", _INT))])


def manifest_violations(rows: DataFrame) -> DataFrame:
    """Rows a tile reader cannot use, with the reason."""
    needed = [c for c in MANIFEST.fieldNames() if c not in ("outline_fraction", "split")]
    absent = F.lit(False)
    for c in needed:
        absent = absent | F.col(c).isNull()
    reason = (F.when(absent, "missing value").when((F.col("pad_right") != 0) | (F.col("pad_bottom") != 0), "padded tile")
              .when(F.col("patch") <= 0, "patch not positive")
              .when((F.col("x") < 0) | (F.col("y") < 0) | (F.col("x") + F.col("patch") > F.col("crop_width"))
                    | (F.col("y") + F.col("patch") > F.col("crop_height")), "tile outside its image"))
    return rows.withColumn("reason", reason).filter("reason is not null")


def read_manifest(spark: SparkSession, path: str, split: str | None = None, datasets: Sequence[str] | None = None) -> DataFrame:
    """Validated manifest rows of a split and datasets; an empty result is an error."""
    header = spark.read.option("header", "true").csv(path)
    missing = sorted(set(MANIFEST.fieldNames()) - set(header.columns))
    if missing:
        raise ValidationError(f"{path}: manifest lacks columns {missing}")
    schema = T.StructType([MANIFEST[c] if c in MANIFEST.fieldNames() else T.StructField(c, _TEXT) for c in header.columns])
    rows = (spark.read.option("header", "true").option("mode", "FAILFAST").option("enforceSchema", "false").schema(schema).csv(path)
            .select(*MANIFEST.fieldNames()))
    require_none(manifest_violations(rows).select("tile_id", "reason"), f"{path}: unusable rows")
    if split:
        rows = rows.filter(F.col("split") == split)
    if datasets:
        rows = rows.filter(F.col("dataset").isin(*datasets))
    if rows.isEmpty():
        raise ValidationError(f"{path}: no rows for split {split} and datasets {datasets}")
    return rows


def write_manifest(rows: DataFrame, path: str) -> None:
    """Manifest in canonical order, fixed columns only, partitioned by fold when there is one."""
    columns = MANIFEST.fieldNames()
    if "fold" in rows.columns:
        (rows.select("fold", *columns).repartitionByRange("fold", "dataset", "tile_id").sortWithinPartitions("fold", "dataset", "tile_id")
         .write.mode("overwrite").option("header", "true").partitionBy("fold").csv(path))
    else:
        rows.select(*columns).orderBy("dataset", "tile_id").write.mode("overwrite").option("header", "true").csv(path)
