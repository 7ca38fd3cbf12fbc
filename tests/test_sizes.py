"""What queries over larger tables cost: inputs read once, tasks dealt by sizes in memory, nothing thinned for a choice that does not need it."""

from pyspark.sql import functions as F

from gridmark import session
from gridmark.operators import attribution
from gridmark.plans import sweep


def test_summary_reads_its_gaps_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = [(i, 1, "d0", "MERGED" if i % 2 else "TINY", "MERGED", 10 + i) for i in range(6)]
    missed = spark.createDataFrame(rows, "image_id long, t long, dataset string, class string, natural string, area long")
    gaps = spark.createDataFrame([(i, 1, 4, i) for i in range(1, 6, 2)], "image_id long, t long, interface_px long, gap_px long").mapInArrow(
        counted, "image_id long, t long, interface_px long, gap_px long")
    sizes = spark.createDataFrame([("d0", 6, 9)], "dataset string, tiles long, n_true long")
    out = attribution.summarise(missed, gaps, sizes).collect()
    assert [(r.n_fn, r.n_merged, r.n_tiny, r.gap, r.interface, r.gap_px_p50, r.area_p50) for r in out] == [(6, 3, 3, 9, 12, 3.0, 12.5)]
    assert seen.value == 3


def test_tasks_are_dealt_by_sizes_in_memory(spark):
    keys = ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.minPartitionSize", "spark.gridmark.partitionSize")
    with session.settings(spark, dict(zip(keys, ("64m", "1m", "none")))):
        for _ in range(2):  # divided once
            session.expect_expansion(spark)
            assert [spark.conf.get(k) for k in keys] == [str(4 << 20), str(256 << 10), str(4 << 20)]
        with session.settings(spark, {keys[0]: "32m"}):  # a size of the session's own
            session.expect_expansion(spark)
            assert spark.conf.get(keys[0]) == str(2 << 20)


def test_choice_by_a_region_score_thins_no_validation_tiles(spark, monkeypatch):
    thinned = []
    plain = sweep.with_skeletons
    monkeypatch.setattr(sweep, "with_skeletons", lambda px, keys: thinned.append(1) or plain(px, keys))
    at = F.col("id") % 144
    px = spark.range(2 * 144).select(
        F.expr("id div 144").alias("image_id"), F.lit("d0").alias("dataset"), F.expr("if(id < 144, 'val', 'test')").alias("split"),
        F.lit(12).alias("height"), F.lit(12).alias("width"), F.expr("cast(id % 144 div 12 as int)").alias("y"), (at % 12).cast("int").alias("x"),
        F.when(at % 12 == 6, 0.9).otherwise(0.1).cast("float").alias("prob"), (at % 12 == 6).alias("true"))
    configs = sweep.postprocess_grid(spark.createDataFrame([("d0", 0.5)], "dataset string, tuned double"), ("none",), (0.6, 0.95), reference=False)
    rows = sweep.select_then_test(px.filter("split = 'val'"), px.filter("split = 'test'"), configs.filter("config not like '%tuned'"), 2).collect()
    assert [(r.config, r.split, r.threshold, r.pq, r.pixel_dice) for r in rows] == [("selected (val-best)", "test", 0.6, 1.0, 1.0)]
    assert len(thinned) == 1
