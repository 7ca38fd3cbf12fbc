"""Images that do not fill their rectangle, as the last mosaic does when the vectors run out: queries against their SQL."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from gridmark.operators import losses, raster

NAMES = ["A20_metric_accumulation", "A23_tile_scores", "G02_close", "G02_erode", "G05_find_outlines", "G10_regions_from_outline", "A38_class_shape_profile",
         "G14_morph_close", "G14_skeleton_bridge", "G14_skeleton_redilate", "G22_focal_minmax", "G22_soft_skeleton", "J12_mask_overlap", "W10_cut_gaps",
         "S02_scan_pixels", "S08_write_outline"]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Two mosaics, the second with 10 of 16 blocks."""
    place, rng, n = tmp_path_factory.mktemp("ragged"), np.random.default_rng(3), 26
    values = pa.array(list(rng.normal(0.05, 0.25, (n, 64)).astype(np.float32)), pa.list_(pa.float32()))
    pq.write_table(pa.table({"vec_id": np.arange(n), "embedding": values, "label": rng.integers(0, 4, n).astype(np.int32)}), place / "embeddings.parquet")
    return str(place)


def plain(table):
    rows = zip(*[table.column(c).to_pylist() for c in sorted(table.column_names)])
    return sorted((tuple(round(v, 5) + 0.0 if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    want = con.sql(entry.oracle_sql()[name]).to_arrow_table()
    assert plain(entry.queries()[name](spark, folder).toArrow()) == plain(want)


def test_missing_pixels_are_outside(spark):
    px = spark.createDataFrame([(1, 2, 2, 0, 0, 5), (1, 2, 2, 0, 1, 5), (1, 2, 2, 1, 0, 7)], "image_id long, height int, width int, y int, x int, label int")
    assert {(r.y, r.x) for r in raster.find_outlines(px).collect()} == {(0, 0), (1, 0)}
    assert raster.dilate(px.filter("label = 7"), within=px).count() == 3
    assert raster.erode(px, within=px).count() == 3 and raster.erode(px).count() == 0


def test_soft_skeleton_across_blocks_holes_and_nulls(spark):
    rng, (h, w) = np.random.default_rng(5), (23, 17)
    v, there = rng.random((h, w)), rng.random((h, w)) > 0.1
    null = rng.random((h, w)) < 0.05
    rows = [(1, h, w, y, x, None if null[y, x] else float(v[y, x])) for y in range(h) for x in range(w) if there[y, x]]
    px = spark.createDataFrame(rows, "image_id long, height int, width int, y int, x int, p double")
    x, k = {(r[3], r[4]): r[5] for r in rows}, {}
    near = lambda m, at, offsets: [m[q] for q in ((at[0] + dy, at[1] + dx) for dy, dx in offsets) if m.get(q) is not None]
    for step in range(4):
        eroded = {at: min(near(x, at, raster.PLUS), default=None) for at in x}
        for at in x:
            opened = max(near(eroded, at, raster.SQUARE), default=None)
            delta = 0.0 if x[at] is None or opened is None else max(x[at] - opened, 0.0)
            k[at] = delta if step == 0 else k[at] + max(delta - k[at] * delta, 0.0)
        x = eroded
    got = {(r.y, r.x): r for r in losses.soft_skeleton(px, ["p"], 3, block=5).collect()}
    assert got.keys() == k.keys() and all(abs(got[at].skel_p - k[at]) < 1e-12 for at in k)
    assert {at: got[at].p for at in got} == {(r[3], r[4]): r[5] for r in rows}


def test_streamed_sweep_equals_its_sql(spark, folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    want = con.sql(entry.oracle_sql()["T01_streaming_sweep"]).to_arrow_table()
    assert plain(entry.queries()["T01_streaming_sweep"](spark, folder).toArrow()) == plain(want)
