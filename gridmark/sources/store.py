"""Materialised tables: fingerprints, keyed caches, outline tables and fold statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmark.operators.checks import outside_domain, require_none

CACHE_VERSION = 1


def fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> str:
    """Order-insensitive content fingerprint of a table: 16 hex digits.

    Row hashes are summed in four 16-bit lanes with the row count, then hashed; the table never
    leaves the executors and repeated rows count.
    """
    row = F.sha2(F.to_json(F.struct(*sorted(columns or df.columns)), {"ignoreNullFields": "false"}), 256)
    lanes = [F.sum(F.conv(F.substring(row, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(8)]
    return df.agg(F.substring(F.sha2(F.concat_ws("|", F.count("*").cast("string"), *lanes), 256), 1, 16)).first()[0]


def group_fingerprints(df: DataFrame, group: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Fingerprint of every group's rows, order-insensitive, by partial sums of row hashes."""
    row = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in columns]))
    lanes = [F.sum(F.conv(F.substring(row, 1 + 8 * i, 8), 16, 10).cast("bigint")).cast("string") for i in range(4)]
    return df.groupBy(*group).agg(F.substring(F.sha2(F.concat_ws("|", F.count("*").cast("string"), *lanes), 256), 1, 16).alias("fingerprint"))


def _state(spark: SparkSession, folder: str) -> tuple[str, int, int] | None:
    try:
        row = spark.read.parquet(f"{folder}/_state").first()
    except AnalysisException:
        return None
    return (row["key"], row["version"], row["rows"]) if row else None


def materialize(df: DataFrame, folder: str, key: str) -> tuple[DataFrame, str]:
    """The table stored under ``folder`` for ``key``, rebuilt when it is stale, and why.

    The state row is written last, so a build that was cut off is never taken for complete.
    """
    spark = df.sparkSession
    state = _state(spark, folder)
    if state is None:
        reason = "no cache"
    elif state[1] != CACHE_VERSION:
        reason = "old version"
    elif state[0] != key:
        reason = "stale key"
    else:
        try:
            stored = spark.read.parquet(f"{folder}/key={key}")
            if stored.count() == state[2]:
                return stored, "reused"
            reason = "truncated"
        except AnalysisException:
            reason = "missing data"
    df.write.mode("overwrite").parquet(f"{folder}/key={key}")
    stored = spark.read.parquet(f"{folder}/key={key}")
    (spark.createDataFrame([(key, CACHE_VERSION, stored.count())], "key string, version int, rows bigint")
     .coalesce(1).write.mode("overwrite").parquet(f"{folder}/_state"))
    return stored, reason


def write_outline(px: DataFrame, path: str, value: str = "value") -> None:
    """Outline raster as a table by dataset; any value but 0 and 255 is refused."""
    require_none(outside_domain(px, value, (0, 255)), "an outline map holds 0 and 255 only")
    px.write.mode("overwrite").partitionBy("dataset").parquet(path)


SETTINGS = ("patch", "stride", "min_frac", "seed")


def other_settings(existing: DataFrame, fresh: DataFrame, settings: Sequence[str] = SETTINGS) -> DataFrame:
    """Settings of ``fresh`` under which no row of ``existing`` was made; none if there is no such row at all."""
    held = existing.select(*settings).distinct()
    return fresh.select(*settings).distinct().join(held, list(settings), "left_anti").filter(F.lit(not existing.isEmpty()))


def merge_fold_stats(existing: DataFrame, fresh: DataFrame, settings: Sequence[str] = SETTINGS) -> DataFrame:
    """Fresh folds replace existing ones of the same name; differing tiling settings are refused."""
    require_none(other_settings(existing, fresh, settings), "fold statistics were made under other settings")
    gone = fresh.select("fold").distinct()
    return existing.join(gone, "fold", "left_anti").unionByName(fresh)


def write_fold_stats(stats: DataFrame, path: str) -> None:
    """Only the folds present are replaced on disk."""
    (stats.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("fold").parquet(path))
