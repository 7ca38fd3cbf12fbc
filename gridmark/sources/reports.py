"""Nested JSON reports: reading, flattening, merging and writing them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_report(spark: SparkSession, path: str, schema: T.StructType | str | None = None, lines: bool = False) -> DataFrame:
    """JSON reports with their file name; a report without datasets is an error.

    A file is one report, or, with ``lines``, a report per line as :func:`write_report` writes them.
    """
    reader = spark.read.option("multiLine", not lines).option("mode", "FAILFAST")
    df = (reader.schema(schema) if schema else reader).json(path).withColumn("file", F.input_file_name())
    if "datasets" not in df.columns:
        raise ValueError(f"{path}: report has no datasets")
    if isinstance(df.schema["datasets"].dataType, (T.MapType, T.ArrayType)):
        bad = df.filter(F.size("datasets") < 1).limit(1).collect()
        if bad:
            raise ValueError(f"{path}: report has an empty datasets section")
    return df


def report_datasets(report: DataFrame) -> DataFrame:
    """One row per dataset of a report: ``(file, dataset, body)``; struct or map layouts."""
    kind = report.schema["datasets"].dataType
    if isinstance(kind, T.MapType):
        return report.select("file", F.explode("datasets").alias("dataset", "body"))
    if isinstance(kind, T.ArrayType):
        return report.select("file", F.explode("datasets").alias("body")).select("file", "body.dataset", "body")
    cells = [F.struct(F.lit(f.name).alias("dataset"), F.to_json(F.col(f"datasets.`{f.name}`")).alias("body")) for f in kind.fields]
    return report.select("file", F.inline(F.array(*cells))).filter("body is not null")  # files of one read share their fields


def dataset_modes(spark: SparkSession, path: str, overrides: Mapping[str, str] | None = None) -> DataFrame:
    """Mode of every dataset in an audit report, ``(dataset, mode)``: the override where there is one, else the inferred mode."""
    rows = report_datasets(read_report(spark, path))
    body = F.col("body") if isinstance(rows.schema["body"].dataType, T.StringType) else F.to_json("body")
    given = F.create_map(*[F.lit(x) for pair in (overrides or {}).items() for x in pair]) if overrides else F.lit(None).cast("map<string,string>")
    return rows.select("dataset", get_or(given, F.col("dataset"), F.get_json_object(body, "$.mode.inferred")).alias("mode"))


def overlay(base: Column, over: Column) -> Column:
    """The keys of both maps; where both have a key, the value of ``over``.  A null map has no keys."""
    return F.when(base.isNull(), over).when(over.isNull(), base).otherwise(
        F.map_zip_with(base, over, lambda k, a, b: F.when(F.map_contains_key(over, k), b).otherwise(a)))


def without_blank(cells: Column) -> Column:
    """The map without the keys whose value is null."""
    return F.map_filter(cells, lambda _, v: v.isNotNull())


def get_or(cells: Column, key: Column, default: Column) -> Column:
    """The value of ``key``, or ``default`` where the map, the key or the value is missing."""
    return F.coalesce(F.try_element_at(cells, key), default)


def explode_rows(report: DataFrame, column: str, keep: Sequence[str]) -> DataFrame:
    """The columns ``keep`` beside the fields of every struct in the array ``column``; an empty array has no rows."""
    return report.select(*keep, F.inline(column))


def run_of_file(file: str = "file", pattern: str = r"([^/]+)_([^_/]+)\.json$") -> tuple:
    """Run and host columns parsed from a report's file name ``<prefix>_<run>_<host>.json``."""
    name = F.regexp_extract(F.col(file), pattern, 1)
    return F.regexp_replace(name, "^[a-z]+_", "").alias("run"), F.regexp_extract(F.col(file), pattern, 2).alias("host")


def runs_of_fold(runs: DataFrame, fold: str) -> DataFrame:
    """Reports of a fold: the run equals its name or starts with it and a dash."""
    return runs.filter((F.col("run") == fold) | F.startswith(F.col("run"), F.lit(f"{fold}-")))


def crop_lookup(report: DataFrame) -> DataFrame:
    """``(dataset, image, left, top, width, height)`` from nested reconciled lists."""
    return explode_rows(report, "reconciled", ["dataset"]).select("dataset", "image", "image_crop.left", "image_crop.top", "image_crop.width", "image_crop.height")


def settings_drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """Settings ``(key, value)`` that changed; a key only the new run has, with an empty value, is fine."""
    j = old.select("key", F.col("value").alias("old")).join(new.select("key", F.col("value").alias("new")), "key", "full_outer")
    blank = F.col("old").isNull() & F.coalesce(F.col("new").isin("", "null", "[]", "{}"), F.lit(True))
    return j.filter(~F.col("old").eqNullSafe(F.col("new")) & ~blank)


def merge_by_key(existing: DataFrame, fresh: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fresh rows replace existing rows of the same key; all others stay."""
    gone = fresh.select(*keys).distinct()
    return existing.join(gone, list(keys), "left_anti").unionByName(fresh)


def merge_status(existing: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """What a merge does to every key: added, replaced or untouched."""
    j = existing.select(key).distinct().withColumn("old", F.lit(True)).join(
        fresh.select(key).distinct().withColumn("new", F.lit(True)), key, "full_outer")
    return j.select(key, F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "untouched").otherwise("replaced").alias("action"))


def write_report(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Report tables as JSON lines, written by the executors."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).json(path)
