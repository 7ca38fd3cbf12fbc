"""Run histories: running best, early stopping, best epochs and run comparison.

Running values are two-level: inside blocks of epochs, then over block maxima, so a run of any
length never sits in one window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK = 1024


def running_max(df: DataFrame, value: str, out: str, key: str = "run", order: str = "epoch",
                inclusive: bool = False) -> DataFrame:
    """Maximum of ``value`` over earlier rows (and this one if inclusive); ``order`` is an integer."""
    rows = df.withColumn("_b", F.floor(F.col(order) / BLOCK))
    last = W.currentRow if inclusive else -1
    inside = F.max(value).over(W.partitionBy(key, "_b").orderBy(order).rowsBetween(W.unboundedPreceding, last))
    tops = rows.groupBy(key, "_b").agg(F.max(value).alias("_top"))
    before = F.max("_top").over(W.partitionBy(key).orderBy("_b").rowsBetween(W.unboundedPreceding, -1))
    tops = tops.select(key, "_b", before.alias("_before"))
    return rows.withColumn("_in", inside).join(tops, [key, "_b"]).withColumn(out, F.greatest("_in", "_before")).drop(
        "_b", "_in", "_before")


def running_best(history: DataFrame) -> DataFrame:
    """Adds ``is_best``: strictly above every earlier score of the run."""
    prior = running_max(history, "score", "_prior")
    return prior.withColumn("is_best", F.col("score").isNotNull() & (F.col("_prior").isNull() | (F.col("score") > F.col("_prior")))).drop("_prior")


def since_improvement(history: DataFrame) -> DataFrame:
    """Adds ``since``: epochs since the last best one; all epochs so far where there was none."""
    marked = running_best(history).withColumn("_hit", F.when(F.col("is_best"), F.col("epoch")))
    last = running_max(marked, "_hit", "_last", inclusive=True)
    return last.withColumn("since", F.coalesce(F.col("epoch") - F.col("_last"), F.col("epoch") + 1)).drop("_hit", "_last")


def early_stop(history: DataFrame, patience: int, total: int) -> DataFrame:
    """Per run: first epoch with ``patience`` stale epochs, and whether the run is complete."""
    s = since_improvement(history).groupBy("run").agg(
        F.min(F.when(F.col("since") >= patience, F.col("epoch"))).alias("stop_epoch"), F.max("epoch").alias("last_epoch"))
    return s.withColumn("complete", (F.col("last_epoch") >= total - 1) | F.col("stop_epoch").isNotNull())


def best_epoch(history: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    """The row of the highest score per run, the earliest on a tie."""
    pick = F.max_by(F.struct("epoch", "score", *columns), F.struct("score", -F.col("epoch"))).alias("b")
    return history.filter("score is not null").groupBy("run").agg(pick).select("run", "b.*")


def score_key(history: DataFrame, held_out: str, pooled: str = "__pooled__") -> DataFrame:
    """Checkpoint score per run and epoch: the held-out dataset's, else the pooled one."""
    pick = lambda name: F.max(F.when(F.col("dataset") == name, F.col("score")))
    return history.groupBy("run", "epoch").agg(F.coalesce(pick(held_out), pick(pooled)).alias("score"))


def compare_runs(history: DataFrame, metric: str = "dice") -> DataFrame:
    """Datasets of all runs at each run's best epoch: comparable only when tile counts agree."""
    best = best_epoch(history.select("run", "epoch", "score").distinct()).select("run", "epoch")
    rows = history.join(best, ["run", "epoch"], "left_semi")
    spread = rows.groupBy("dataset").agg(F.count_distinct("tiles").alias("k"), F.count("*").alias("runs"))
    return rows.join(spread, "dataset").select("run", "dataset", "epoch", metric, "tiles", "runs", (F.col("k") == 1).alias("comparable"))


def metric_delta(old: DataFrame, new: DataFrame, keys: Sequence[str], metric: str) -> DataFrame:
    """Old, new and difference of a metric; sides that lack the key stay null."""
    j = old.select(*keys, F.col(metric).alias("old")).join(new.select(*keys, F.col(metric).alias("new")), list(keys), "full_outer")
    return j.withColumn("delta", F.col("new") - F.col("old"))


def config_diff(old: DataFrame, new: DataFrame, absent: str = "<absent>") -> DataFrame:
    """Keys ``(key, value)`` whose value differs, with a marker where a side lacks the key."""
    j = old.select("key", F.col("value").alias("old"), F.lit(True).alias("_o")).join(
        new.select("key", F.col("value").alias("new"), F.lit(True).alias("_n")), "key", "full_outer")
    changed = F.col("_o").isNull() | F.col("_n").isNull() | ~F.col("old").eqNullSafe(F.col("new"))
    return j.filter(changed).select("key", F.when(F.col("_o").isNull(), absent).otherwise(F.col("old")).alias("old"),
                                    F.when(F.col("_n").isNull(), absent).otherwise(F.col("new")).alias("new"))
