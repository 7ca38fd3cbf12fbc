"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ("A22_sweep_grouping_sets", "W06_best_threshold", "A10_tile_outline_fraction", "F02_build_folds", "A16_fold_statistics",
            "K05_weighted_sample", "A09_derive_palette", "J05_nearest_colour", "A02_palette_report", "G04_components_labels_4",
            "G06_skeletonize_truth", "G10_regions_from_outline", "A27_panoptic_quality", "A25_adjusted_rand_index")


def main() -> None:
    from gridmark.session import get_session
    from gridmark.workload import catalogue

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session("bench", f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8,
                        spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    catalogue.QUERIES["A19_ge_counts"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline queries, total time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/")), "cores": cpus, "spark": spark.version,
                      "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions")}))


if __name__ == "__main__":
    main()
