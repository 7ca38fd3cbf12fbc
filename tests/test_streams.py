"""Streams: repeated, late and replayed deliveries count once; tiles may come in parts."""

from gridmark.streaming import accumulate, arrivals


def deliver(spark, folder, *paths):
    spark.createDataFrame([("d", p) for p in paths], "dataset string, path string").coalesce(1).write.mode("append").parquet(str(folder))


def test_files_are_recorded_once_over_runs_and_late_duplicates(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    deliver(spark, source, "/a/1.png", "/a/1.png", "/a/2.png", "/a/notes.txt")

    def run():
        stream = spark.readStream.schema("dataset string, path string").option("maxFilesPerTrigger", 1).parquet(str(source))
        arrivals.record_arrivals(stream, out).awaitTermination()
        return sorted(r.path for r in spark.read.parquet(f"{out}/files").collect())

    assert run() == ["/a/1.png", "/a/2.png"]
    assert run() == ["/a/1.png", "/a/2.png"]
    deliver(spark, source, "/a/2.png", "/a/3.png")
    deliver(spark, source, "/a/3.png", "/a/1.png")
    assert run() == ["/a/1.png", "/a/2.png", "/a/3.png"]


PIXELS = "image_id long, dataset string, height int, width int, y int, x int, prob float, `true` boolean"


def test_split_tiles_are_held_until_whole(spark, tmp_path):
    import numpy as np

    from gridmark.operators import sweepcounts

    rng = np.random.default_rng(4)
    cells = [(i, f"d{i % 2}", 5, 6, y, x, float(np.float32(rng.integers(0, 11) / 10)), bool(rng.random() < 0.3)) for i in range(4) for y in range(5) for x in range(6)]
    rng.shuffle(cells)
    cells = [(int(i), d, int(h), int(w), int(y), int(x), float(p), t in (True, "True")) for i, d, h, w, y, x, p, t in cells]
    whole = spark.createDataFrame(cells, PIXELS)
    for lo in range(0, len(cells), 50):  # every batch holds parts of all tiles, and some pixels come twice
        spark.createDataFrame(cells[max(lo - 5, 0):lo + 50], PIXELS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    stream = spark.readStream.schema(PIXELS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    accumulate.accumulate_stream(stream, out, [0.3, 0.6]).awaitTermination()
    want = sweepcounts.metrics_from_counts(sweepcounts.with_pooled(sweepcounts.accumulate(whole, [0.3, 0.6])))
    columns = ["dataset", "threshold", "tp", "n_pred", "hits_p", "hits_r", "tiles", "total_px", "true_px", "prob_min", "prob_max", "dice"]
    assert sorted(map(tuple, accumulate.result(spark, out, [0.3, 0.6]).select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
    assert accumulate.incomplete(spark, out).count() == 0


def test_incomplete_tiles_are_reported_after_their_time(spark, tmp_path):
    cells = [(i, "d", 2, 2, y, x, 0.5, True) for i in (1, 2) for y in range(2) for x in range(2)]
    out = str(tmp_path / "out")

    def run(rows):
        spark.createDataFrame(rows, PIXELS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(PIXELS).parquet(str(tmp_path / "in"))
        accumulate.accumulate_stream(stream, out, [0.5], patience_ms=1).awaitTermination()

    run(cells[:7])  # tile 1 whole, tile 2 lacks a pixel
    run([(3, "d", 1, 1, 0, 0, 0.1, False)])
    assert [tuple(r) for r in accumulate.incomplete(spark, out).collect()] == [(2, "d", 3, 4)]
    assert {(r.dataset, r.tiles, r.total_px) for r in accumulate.result(spark, out, [0.5]).filter("dataset = 'd'").collect()} == {("d", 2, 5)}


def test_tiles_that_do_not_fill_their_rectangle_are_whole_with_all_their_pixels(spark, tmp_path):
    cells = [(1, "d", 2, 2, 0, 0, 0.5, False), (1, "d", 2, 2, 0, 1, 0.9, True), (1, "d", 2, 2, 1, 0, 0.1, False), (2, "d", 2, 2, 1, 1, 0.9, True)]
    out = str(tmp_path / "out")

    def run(rows):
        spark.createDataFrame([(*r, {1: 3, 2: 2, 3: None}[r[0]]) for r in rows], f"{PIXELS}, n long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(f"{PIXELS}, n long").parquet(str(tmp_path / "in"))
        accumulate.accumulate_stream(stream, out, [0.4], tolerance=1, patience_ms=1, pixels="n").awaitTermination()

    run(cells[:2])
    run(cells[2:])  # tile 1 whole without its fourth pixel, tile 2 lacks one of two
    run([(3, "d", 1, 1, 0, 0, 0.1, False)])  # no count: the rectangle
    assert [tuple(r) for r in accumulate.incomplete(spark, out).collect()] == [(2, "d", 1, 2)]
    r = accumulate.result(spark, out, [0.4]).filter("dataset = 'd'").first()
    assert (r.tiles, r.total_px, r.true_px, r.n_pred, r.tp, r.hits_p, r.hits_r) == (2, 4, 1, 2, 1, 2, 1)
