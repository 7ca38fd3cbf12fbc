"""Images, manifests, reports and caches on files that the tests write."""

import struct
import zlib

import pytest
from pyspark.sql import functions as F

from gridmark.operators.checks import ValidationError
from gridmark.plans import audit
from gridmark.sources import files, manifest, reports, store


def png(rows, kind, depth=8, palette=b""):
    """A PNG of the given sample rows; ``kind`` is the colour type of the format."""
    def chunk(name, body):
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    width = len(rows[0]) // {0: 1, 2: 3, 3: 1, 6: 4}[kind] // (depth // 8)
    head = struct.pack(">IIBBBBB", width, len(rows), depth, kind, 0, 0, 0)
    body = zlib.compress(b"".join(b"\0" + bytes(r) for r in rows))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + (chunk(b"PLTE", palette) if palette else b"") + chunk(b"IDAT", body) + chunk(b"IEND", b"")


@pytest.fixture
def folder(tmp_path):
    where = tmp_path / "set" / "images"
    where.mkdir(parents=True)
    images = {"grey.png": png([[0, 50, 255], [7, 8, 9]], 0), "rgb.png": png([[1, 2, 3, 4, 5, 6]], 2), "flat.PNG": png([[9, 9, 9, 4, 4, 4]], 2),
              "palette.png": png([[0, 1]], 3, palette=bytes([10, 20, 30, 40, 50, 60])), "alpha.png": png([[1, 2, 3, 255]], 6),
              "deep.png": png([[1, 2, 3, 4]], 0, 16), "cut.png": png([[0] * 64] * 64, 0)[:40], "junk.png": b"no image either", "notes.txt": b"no image"}
    images["deep.tif"] = b"II*\0" + struct.pack("<IH", 8, 1) + struct.pack("<HHIHH", 258, 3, 1, 16, 0) + struct.pack("<I", 0)
    images["deep.pgm"] = b"P5\n# made here\n1 1\n65535\n\0\1"
    for name, data in images.items():
        (where / name).write_bytes(data)
    return str(tmp_path)


def by_name(df):
    return {r["path"].rsplit("/", 1)[1]: r for r in df.collect()}


def test_listing_holds_images_only(spark, folder):
    rows = by_name(files.scan_files(spark, folder))
    assert "notes.txt" not in rows and len(rows) == 10
    assert rows["flat.PNG"]["dataset"] == "set"


def test_meta_names_every_file(spark, folder):
    rows = {n: (r["format"], r["height"], r["width"], r["bit_depth"], r["colour_mode"]) for n, r in by_name(files.image_meta(spark, folder)).items()}
    assert rows["grey.png"] == ("PNG", 2, 3, 8, "grayscale")
    assert rows["rgb.png"] == ("PNG", 1, 2, 8, "rgb")
    assert rows["flat.PNG"] == ("PNG", 1, 2, 8, "rgb-but-gray")
    assert rows["palette.png"] == ("PNG", 1, 2, 8, "rgb")
    assert rows["deep.png"][:4] == ("PNG", 1, 2, 16)
    assert rows["cut.png"] == ("PNG", None, None, 8, None)
    assert rows["junk.png"] == (None, None, None, None, None)
    assert rows["deep.tif"][0] == "TIFF" and rows["deep.tif"][3] == 16
    assert rows["deep.pgm"][0] == "PGM" and rows["deep.pgm"][3] == 16


def test_pixels_or_a_problem(spark, folder):
    px = files.scan_pixels(spark, folder).collect()
    got = {}
    for r in px:
        got.setdefault(r["path"].rsplit("/", 1)[1], {})[r["y"], r["x"]] = (r["r"], r["g"], r["b"])
    assert got == {"grey.png": {(0, 0): (0,) * 3, (0, 1): (50,) * 3, (0, 2): (255,) * 3, (1, 0): (7,) * 3, (1, 1): (8,) * 3, (1, 2): (9,) * 3},
                   "rgb.png": {(0, 0): (1, 2, 3), (0, 1): (4, 5, 6)}, "flat.PNG": {(0, 0): (9, 9, 9), (0, 1): (4, 4, 4)},
                   "palette.png": {(0, 0): (10, 20, 30), (0, 1): (40, 50, 60)}, "alpha.png": {(0, 0): (1, 2, 3)}}
    problems = by_name(files.image_problems(spark, folder))
    assert set(problems) == {"cut.png", "junk.png", "deep.png", "deep.tif", "deep.pgm"}
    assert problems["cut.png"]["problem"] == "cannot be decoded"
    assert problems["deep.png"]["problem"] == "more than 8 bits a sample"


TILE = {"tile_id": "a/1", "dataset": "a", "parent_id": "p", "source_image": "i.png", "x": 0, "y": 0, "outline_fraction": 0.5, "split": "val", "patch": 8,
        "image_path": "i", "gt_path": "g", "crop_left": 0, "crop_top": 0, "crop_width": 16, "crop_height": 16, "pad_right": 0, "pad_bottom": 0}


def write_csv(path, *rows, drop=()):
    columns = [c for c in TILE if c not in drop]
    path.write_text("\n".join([",".join(columns)] + [",".join(str(r[c]) for c in columns) for r in rows]) + "\n")
    return str(path)


def test_manifest_refusals(spark, tmp_path):
    good = write_csv(tmp_path / "good.csv", TILE, {**TILE, "tile_id": "b/1", "dataset": "b", "split": "train"})
    assert [r["tile_id"] for r in manifest.read_manifest(spark, good, "val").collect()] == ["a/1"]
    with pytest.raises(ValidationError, match="no rows"):
        manifest.read_manifest(spark, good, "val", ["b"])
    with pytest.raises(ValidationError, match="pad_right"):
        manifest.read_manifest(spark, write_csv(tmp_path / "narrow.csv", TILE, drop=["pad_right"]))
    for name, change in (("padded", {"pad_bottom": 3}), ("outside", {"x": 12}), ("blank", {"gt_path": ""})):
        with pytest.raises(ValidationError, match="unusable"):
            manifest.read_manifest(spark, write_csv(tmp_path / f"{name}.csv", {**TILE, **change}))
    with pytest.raises(Exception, match="(?i)malformed|parse|cast"):
        manifest.read_manifest(spark, write_csv(tmp_path / "text.csv", {**TILE, "x": "4.5"})).collect()


def test_report_layouts_and_overrides(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "one.json").write_text('{\n"datasets": {"a": {"mode": {"inferred": "A"}}, "b": {"mode": {"inferred": "B"}}}}')
    (tmp_path / "r" / "two.json").write_text('{"datasets": {"c": {"n": 3}}}')
    path = str(tmp_path / "r")
    assert sorted(map(tuple, reports.dataset_modes(spark, path).collect())) == [("a", "A"), ("b", "B"), ("c", None)]
    assert dict(map(tuple, reports.dataset_modes(spark, path, {"b": "A", "z": "B"}).collect())) == {"a": "A", "b": "A", "c": None}
    (tmp_path / "bare.json").write_text('{"n": 1}')
    with pytest.raises(ValueError, match="no datasets"):
        reports.read_report(spark, str(tmp_path / "bare.json"))


def test_report_lines_are_all_read(spark, tmp_path):
    rows = spark.range(5).select(F.col("id").alias("n"), F.create_map(F.lit("a"), F.col("id")).alias("datasets"))
    reports.write_report(rows.coalesce(1), str(tmp_path / "out"))
    assert reports.read_report(spark, str(tmp_path / "out"), "n long, datasets map<string,long>", lines=True).count() == 5


def test_map_overlay_keeps_null_values_and_null_maps(spark):
    df = spark.sql("SELECT map('a', 1, 'b', 2) AS m, map('b', CAST(NULL AS INT), 'c', 3) AS o, CAST(NULL AS MAP<STRING, INT>) AS n")
    got = df.select(reports.overlay(F.col("m"), F.col("o")).alias("x"), reports.overlay(F.col("m"), F.col("n")).alias("y"),
                    reports.get_or(F.col("o"), F.lit("b"), F.lit(9)).alias("z")).first()
    assert got["x"] == {"a": 1, "b": None, "c": 3} and got["y"] == {"a": 1, "b": 2} and got["z"] == 9


def test_cache_says_why_it_was_rebuilt(spark, tmp_path):
    df, folder = spark.range(10), str(tmp_path / "cache")
    reason = lambda key: store.materialize(df, folder, key)[1]
    assert [reason("k1"), reason("k1"), reason("k2"), reason("k2")] == ["no cache", "reused", "stale key", "reused"]
    spark.range(3).write.mode("overwrite").parquet(f"{folder}/key=k2")
    assert reason("k2") == "truncated"


def test_outline_values_are_checked(spark, tmp_path):
    px = spark.createDataFrame([("a", 1, 0, 0, 7)], "dataset string, image_id long, y int, x int, value int")
    with pytest.raises(ValidationError):
        store.write_outline(px, str(tmp_path / "o"))


def test_audit_names_unreadable_masks_and_goes_on(spark, tmp_path):
    line = [[255 if x == y else 0 for x in range(16)] for y in range(16)]
    for i in range(3):
        for kind, suffix in (("images", ""), ("masks", "_mask")):
            where = tmp_path / "steel" / kind
            where.mkdir(parents=True, exist_ok=True)
            whole = png([[v for p in row for v in (p, p, p)] for row in line], 2)
            (where / f"p{i}{suffix}.png").write_bytes(whole[:45] if (kind, i) == ("masks", 1) else whole)
    report, errors = audit.audit_folder(spark, str(tmp_path))
    assert [(r["dataset"], r["path"].rsplit("/", 1)[1], r["problem"]) for r in errors.collect()] == [("steel", "p1_mask.png", "cannot be decoded")]
    row = report.collect()
    assert [r["dataset"] for r in row] == ["steel"] and row[0]["quantized_files"] == 2
