"""Choosing configurations, markers and tiles: validation rows only, ties always resolved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmark.operators.checks import require_none
from gridmark.operators.postprocess import MODES


def only_validation(rows: DataFrame) -> None:
    """Raise when a row comes from another split: choosing on test would tune the test number."""
    require_none(rows.filter(~F.col("split").eqNullSafe(F.lit("val"))).select("split").distinct(), "selection needs VAL rows only")


def mode_rank(mode: Column) -> Column:
    return F.coalesce(*[F.when(mode == m, i) for i, m in enumerate(MODES)], F.lit(len(MODES)))


def select_config(rows: DataFrame, metric: str = "pq", check: bool = True) -> DataFrame:
    """Best non-reference row per dataset; ties to the plainer mode, then the lower threshold."""
    if check:
        only_validation(rows)
    best = F.struct(-F.col(metric), mode_rank(F.col("mode")), F.col("threshold"), F.col("config"))
    rest = [c for c in rows.columns if c != "dataset"]
    return (rows.filter(~F.col("reference")).groupBy("dataset").agg(F.min_by(F.struct(*rest), best).alias("r"))
            .select("dataset", "r.*"))


def select_marker(rows: DataFrame, default: float, metric: str = "pq", check: bool = True) -> DataFrame:
    """Best watershed marker per dataset; ties to the one nearest the default, then the lower."""
    if check:
        only_validation(rows)
    best = F.struct(-F.col(metric), F.round(F.abs(F.col("marker") - default), 9), F.col("marker"))
    rest = [c for c in rows.columns if c != "dataset"]
    return (rows.filter("partition = 'watershed_prob'").groupBy("dataset").agg(F.min_by(F.struct(*rest), best).alias("r"))
            .select("dataset", "r.*"))


def rank_tiles(scores: DataFrame) -> DataFrame:
    """Best, median, worst and second worst tile per dataset by Dice (ties: later row is worse).

    The extremes are partial-aggregated; the median needs one rank, found by counting scores
    first and looking only inside the score that holds the middle.
    """
    order = F.struct("dice", -F.col("row_index"))
    tile = F.struct("tile_id", "dice", "row_index")
    sizes = scores.groupBy("dataset").agg(F.count("*").alias("n_tiles"), F.max_by(tile, order).alias("best"),
                                          F.min_by(tile, order).alias("worst"))
    second = (scores.join(sizes.select("dataset", F.col("worst.row_index").alias("w")), "dataset")
              .filter(F.col("row_index") != F.col("w")).groupBy("dataset").agg(F.min_by(tile, order).alias("worst2")))
    middle = _median_row(scores, sizes, tile)
    j = sizes.join(second, "dataset", "left").join(middle, "dataset")
    cells = [F.struct(F.lit(k).alias("place"), c.alias("t")) for k, c in (
        ("best", F.col("best")), ("median", F.col("median")), ("worst", F.col("worst")), ("worst2", F.coalesce("worst2", "worst")))]
    return j.select("dataset", "n_tiles", F.explode(F.array(*cells)).alias("c")).select("dataset", "n_tiles", "c.place", "c.t.*")


def _median_row(scores: DataFrame, sizes: DataFrame, tile: Column) -> DataFrame:
    from pyspark.sql import Window as W

    # two-level rank: buckets of the score first, rows only inside the bucket with the middle
    bucket = F.floor(F.col("dice") * 4096)
    tally = scores.groupBy("dataset", bucket.alias("b")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(W.partitionBy("dataset").orderBy("b"))
    place = F.floor(F.col("n_tiles") / 2)
    held = (tally.withColumn("upto", upto).join(sizes.select("dataset", "n_tiles"), "dataset")
            .filter((F.col("upto") > place) & (F.col("upto") - F.col("n") <= place))
            .select("dataset", "b", (place - (F.col("upto") - F.col("n"))).alias("inner")))
    rows = scores.withColumn("b", bucket).join(held, ["dataset", "b"])
    rank = F.row_number().over(W.partitionBy("dataset", "b").orderBy("dice", F.col("row_index").desc())) - 1
    return rows.withColumn("k", rank).filter(F.col("k") == F.col("inner")).select("dataset", tile.alias("median"))


def closest_fraction(rows: DataFrame, target: str, value: str = "pred_fraction") -> DataFrame:
    """Per dataset the row whose value is nearest the target (first by name on a tie)."""
    order = F.struct(F.abs(F.col(value) - F.col(target)), F.col("name"))
    rest = [c for c in rows.columns if c != "dataset"]
    return rows.groupBy("dataset").agg(F.min_by(F.struct(*rest), order).alias("r")).select("dataset", "r.*")


def wrong_multiplicity(rows: DataFrame, kinds: list[str]) -> DataFrame:
    """Datasets that do not have exactly one row of every kind (must be empty)."""
    per = rows.groupBy("dataset").agg(*[F.sum((F.col("kind") == k).cast("bigint")).alias(k) for k in kinds])
    bad = F.lit(False)
    for k in kinds:
        bad = bad | (F.col(k) != 1)
    return per.filter(bad)
