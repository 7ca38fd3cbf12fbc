"""Pixels per second of the threshold sweep and of connected components: python tools/raster.py [pixels] [image side] [cores]."""

from __future__ import annotations

import json
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import functions as F  # noqa: E402

from gridmark.operators import components, sweepcounts  # noqa: E402
from gridmark.session import get_session  # noqa: E402


def main() -> None:
    pixels, side, cores = [int(a) for a in [*sys.argv[1:], *("100000000", "1024", "8")[len(sys.argv) - 1:]]]
    spark = get_session("raster", f"local[{cores}]", 8 * cores, spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    area = side * side
    at = F.col("id") % area
    patch = F.xxhash64(F.expr(f"id div {area}"), F.expr(f"id % {area} div {side * 8}"), F.expr(f"id % {side} div 8"))  # 8 x 8 patches of one value
    px = spark.range(pixels // area * area, numPartitions=8 * cores).select(
        F.expr(f"id div {area}").alias("image_id"), F.lit("d").alias("dataset"), F.lit(side).alias("height"), F.lit(side).alias("width"),
        F.expr(f"cast(id % {area} div {side} as int)").alias("y"), (at % side).cast("int").alias("x"),
        (F.pmod(patch, F.lit(100)) / F.lit(100.0)).cast("float").alias("prob"), (F.pmod(patch, F.lit(7)) == 0).alias("true"))
    grid = sweepcounts.threshold_grid(0.05, 0.95, 0.05)
    work = {"sweep": lambda: sweepcounts.accumulate(px, grid),
            "components": lambda: components.component_sizes(components.label_runs(px.filter(F.col("prob") >= F.lit(0.5).cast("float")), 8))}
    out = {"pixels": pixels // area * area, "side": side, "cores": cores}
    for name, made in work.items():
        start = time.perf_counter()
        made().write.format("noop").mode("overwrite").save()
        seconds = time.perf_counter() - start
        out[name] = {"seconds": round(seconds, 1), "pixels_per_second": round(out["pixels"] / seconds)}
    print(json.dumps(out))


if __name__ == "__main__":
    main()
