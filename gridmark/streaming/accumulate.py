"""Incremental threshold sweep: counters grow batch by batch and can be read at any time."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridmark.functions.scalars import snapped
from gridmark.operators import sweepcounts
from gridmark.operators.blocks import extreme
from gridmark.operators.raster import disk
from gridmark.session import settings

IMAGE = ("image_id", "dataset")
#: Pixels of the largest tile that is held as state.
TILE_PIXELS = 1 << 24
_COUNTERS = ("bucket int, tp long, n_pred long, hits_p long, hits_r long, tiles long, total_px long, true_px long, "
             "prob_sum double, prob_min float, prob_max float")
_OUT = f"image_id long, dataset string, received long, expected long, {_COUNTERS}"


def tile_counters(stream: DataFrame, thresholds: Sequence[float], tolerance: int = 2, patience_ms: int = 600_000, pixels: str | None = None) -> DataFrame:
    """Bucket counters of every tile of a pixel stream, once all its pixels have come, in whatever batches they come.

    The pixels of a tile that is not whole are the state of its key; a pixel that comes twice counts
    once.  ``pixels`` names a column with the number of pixels a tile has, for tiles that do not fill
    their rectangle: what has no row there is outside.  A tile to which nothing came for ``patience_ms``
    is given up: one row with what was received and expected, and no counters.  A tile that comes whole
    again is counted again.
    """
    grid, offsets = np.array(snapped(thresholds), np.float32), disk(tolerance)
    names = [x.split()[0] for x in _OUT.split(", ")]

    def run(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = pickle.loads(state.get[0]) if state.exists else None
        if state.hasTimedOut:
            state.remove()
            blank = {n: [None] for n in names}
            yield pd.DataFrame(blank | {"image_id": [key[0]], "dataset": [key[1]], "received": [int(held["seen"].sum())], "expected": [held["pixels"]]})
            return
        for part in parts:
            if not len(part):
                continue
            if held is None:
                shape = int(part["height"].iloc[0]), int(part["width"].iloc[0])
                if shape[0] * shape[1] > TILE_PIXELS:
                    raise ValueError(f"tile {key} has {shape[0]} x {shape[1]} pixels, more than {TILE_PIXELS}")
                held = {"seen": np.zeros(shape, bool), "prob": np.full(shape, -np.inf, np.float32), "true": np.zeros(shape, bool), "pixels": int(part["pixels"].iloc[0])}
            y, x = part["y"].to_numpy(), part["x"].to_numpy()
            prob = part["prob"].to_numpy(np.float32, na_value=np.nan)
            held["seen"][y, x] = True
            held["prob"][y, x] = np.where(np.isnan(prob), -np.inf, prob)
            held["true"][y, x] = part["true"].to_numpy(bool)
        if held is None:
            return
        seen = held["seen"]
        if seen.sum() < held["pixels"]:
            state.update((pickle.dumps(held),))
            state.setTimeoutDuration(patience_ms)
            return
        if state.exists:
            state.remove()
        near, true_near = extreme(held["prob"], offsets, np.float32(-np.inf)), extreme(held["true"], offsets, False)
        counted = sweepcounts.pixel_buckets(held["prob"][seen], near[seen], held["true"][seen], true_near[seen], grid, True)
        out = pd.DataFrame({c: v.to_pandas() for c, v in counted.items()})
        yield out.assign(image_id=key[0], dataset=key[1], received=int(seen.sum()), expected=held["pixels"])[names]

    size = F.col("height").cast("long") * F.col("width")
    cells = stream.select(*IMAGE, "height", "width", "y", "x", "prob", "true", (F.coalesce(pixels, size) if pixels else size).cast("long").alias("pixels"))
    return cells.groupBy(*IMAGE).applyInPandasWithState(run, _OUT, "held binary", "append", "ProcessingTimeTimeout")


def accumulate_stream(stream: DataFrame, folder: str, thresholds: Sequence[float], tolerance: int = 2,
                      prepare: Callable[[DataFrame], DataFrame] | None = None, patience_ms: int = 600_000, pixels: str | None = None, **trigger) -> StreamingQuery:
    """Write each micro-batch's counters to ``folder/counters/batch=<id>`` and tiles given up to ``folder/incomplete/batch=<id>``.

    The counters of a batch are a few rows per dataset and overwrite the batch's own folder, so a replayed
    batch counts once.  Tiles are given up in batches that bring pixels, of any tile.  ``pixels`` is that of
    :func:`tile_counters`, a column of what ``prepare`` returns.
    """
    def sink(batch: DataFrame, batch_id: int) -> None:
        rows = batch.persist()
        whole = rows.filter("bucket is not null").groupBy("dataset", "bucket").agg(
            *[F.sum(c).alias(c) for c in (*sweepcounts.COUNTS, *sweepcounts.TOTALS)], F.min("prob_min").alias("prob_min"), F.max("prob_max").alias("prob_max"))
        whole.write.mode("overwrite").parquet(f"{folder}/counters/batch={batch_id}")
        rows.filter("bucket is null").select(*IMAGE, "received", "expected").write.mode("overwrite").parquet(f"{folder}/incomplete/batch={batch_id}")
        rows.unpersist()

    counters = tile_counters(prepare(stream) if prepare else stream, thresholds, tolerance, patience_ms, pixels)
    # a timer would else keep a stream that only works off what is there going for ever
    with settings(stream.sparkSession, {"spark.sql.streaming.noDataMicroBatches.enabled": "false"}):
        return (counters.writeStream.foreachBatch(sink).outputMode("append").option("checkpointLocation", f"{folder}/checkpoint")
                .trigger(**(trigger or {"availableNow": True})).start())


def result(spark: SparkSession, folder: str, thresholds: Sequence[float]) -> DataFrame:
    """Metrics over everything accumulated so far."""
    parts = spark.read.parquet(f"{folder}/counters")
    merged = parts.groupBy("dataset", "bucket").agg(
        *[F.sum(c).alias(c) for c in (*sweepcounts.COUNTS, *sweepcounts.TOTALS)],
        F.min("prob_min").alias("prob_min"), F.max("prob_max").alias("prob_max"))
    return sweepcounts.metrics_from_counts(sweepcounts.with_pooled(sweepcounts.counters_from_buckets(merged, thresholds)))


def incomplete(spark: SparkSession, folder: str) -> DataFrame:
    """Tiles that were given up: ``(image_id, dataset, received, expected)``."""
    return spark.read.parquet(f"{folder}/incomplete").select(*IMAGE, "received", "expected")


def bucket_stream(stream: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """Native streaming aggregate of score buckets (complete or update mode)."""
    return sweepcounts.bucket_counts(stream, F.col("prob"), thresholds, ["dataset"])
