"""Queries over readers and writers: given tables are written out, read back and returned."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridmark.session import cut, shared_folder
from gridmark.sources import bitmaps, files, manifest, reports, store
from gridmark.workload import fixtures
from gridmark.workload.registry import query
from gridmark.workload.views import view

# ---- manifests ----
view("manifest", """
SELECT CAST(o_orderkey AS VARCHAR) AS tile_id, o_orderpriority AS dataset, CAST(o_custkey % 97 AS VARCHAR) AS parent_id, 'img' || (o_custkey % 97) || '.png' AS source_image,
 CAST(o_orderkey % 5 * 64 AS INTEGER) AS x, CAST(o_custkey % 3 * 64 AS INTEGER) AS y, CAST(o_orderkey % 1000 AS DOUBLE) / 1000 AS outline_fraction,
 CASE WHEN o_custkey % 97 % 5 = 0 THEN 'val' ELSE 'train' END AS split, CAST(64 AS INTEGER) AS patch, '/data/img' || (o_custkey % 97) || '.png' AS image_path,
 '/gt/img' || (o_custkey % 97) || '.png' AS gt_path, CAST(0 AS INTEGER) AS crop_left, CAST(o_custkey % 2 AS INTEGER) AS crop_top, CAST(320 AS INTEGER) AS crop_width,
 CAST(192 AS INTEGER) AS crop_height, CAST(0 AS INTEGER) AS pad_right, CAST(0 AS INTEGER) AS pad_bottom FROM orders
""")


def _manifest(spark, d):
    parent, number = F.col("o_custkey") % 97, lambda c: c.cast("int")
    image = F.concat(F.lit("img"), parent, F.lit(".png"))
    zero = number(F.lit(0))
    return fixtures.table(spark, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("tile_id"), F.col("o_orderpriority").alias("dataset"), parent.cast("string").alias("parent_id"),
        image.alias("source_image"), number(F.col("o_orderkey") % 5 * 64).alias("x"), number(F.col("o_custkey") % 3 * 64).alias("y"),
        ((F.col("o_orderkey") % 1000).cast("double") / F.lit(1000.0)).alias("outline_fraction"),
        F.when(parent % 5 == 0, "val").otherwise("train").alias("split"), number(F.lit(64)).alias("patch"),
        F.concat(F.lit("/data/"), image).alias("image_path"), F.concat(F.lit("/gt/"), image).alias("gt_path"), zero.alias("crop_left"),
        number(F.col("o_custkey") % 2).alias("crop_top"), number(F.lit(320)).alias("crop_width"), number(F.lit(192)).alias("crop_height"),
        zero.alias("pad_right"), zero.alias("pad_bottom"), (F.col("o_custkey") % 2).alias("fold"))


@query("S07_write_manifest", "manifest", """
SELECT m.*, CAST(o_custkey % 2 AS INTEGER) AS fold FROM manifest m JOIN orders ON m.tile_id = CAST(o_orderkey AS VARCHAR)""")
def write_manifest(spark, d):
    folder = shared_folder(spark, "manifest")
    manifest.write_manifest(_manifest(spark, d), folder)
    return spark.read.option("header", "true").schema(T.StructType([*manifest.MANIFEST.fields, T.StructField("fold", T.IntegerType())])).csv(folder)


@query("S04_read_manifest", "manifest", "SELECT * FROM manifest WHERE split = 'val' AND dataset IN ('1-URGENT', '5-LOW')")
def read_manifest(spark, d):
    folder = shared_folder(spark, "manifest")
    manifest.write_manifest(_manifest(spark, d).drop("fold"), folder)
    return manifest.read_manifest(spark, folder, "val", ["1-URGENT", "5-LOW"])


# ---- reports ----
BRANDS = "SELECT p_type, p_brand, count(*) AS n, CASE WHEN count(*) % 2 = 0 THEN 'A' ELSE 'B' END AS inferred FROM part GROUP BY 1, 2"
_REPORT = "maker string, datasets map<string,struct<n:bigint,mode:struct<inferred:string>>>"


def _report(spark, d):
    brands = fixtures.table(spark, d, "part").groupBy("p_type", "p_brand").agg(F.count("*").alias("n"))
    body = F.struct("n", F.struct(F.when(F.col("n") % 2 == 0, "A").otherwise("B").alias("inferred")).alias("mode"))
    return brands.groupBy(F.col("p_type").alias("maker")).agg(F.map_from_entries(F.collect_list(F.struct("p_brand", body))).alias("datasets"))


@query("S05_read_report", "", f"SELECT p_brand AS dataset, n, inferred FROM ({BRANDS})")
def read_report(spark, d):
    folder = shared_folder(spark, "report")
    reports.write_report(_report(spark, d), folder)
    return reports.report_datasets(reports.read_report(spark, folder, _REPORT, lines=True)).select("dataset", "body.n", "body.mode.inferred")


@query("S12_write_report", "", f"SELECT p_type AS maker, count(*) AS brands, CAST(sum(n) AS BIGINT) AS parts FROM ({BRANDS}) GROUP BY 1")
def write_report(spark, d):
    folder = shared_folder(spark, "report")
    reports.write_report(_report(spark, d), folder, ["maker"])
    back = spark.read.schema(_REPORT).json(folder)
    return back.select("maker", F.size("datasets").cast("bigint").alias("brands"),
                       F.aggregate(F.map_values("datasets"), F.lit(0).cast("bigint"), lambda s, b: s + b["n"]).alias("parts"))


@query("X09_explode_nested", "", "SELECT r_name AS region, n_name AS nation, CAST(n_nationkey AS BIGINT) AS nation_id FROM nation JOIN region ON n_regionkey = r_regionkey")
def explode_nested(spark, d):
    n, r = fixtures.table(spark, d, "nation"), fixtures.table(spark, d, "region")
    nested = (n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("r_name").alias("region"))
              .agg(F.collect_list(F.struct(F.col("n_name").alias("nation"), F.col("n_nationkey").cast("bigint").alias("nation_id"))).alias("nations")))
    folder = shared_folder(spark, "nested")
    reports.write_report(nested, folder)
    back = spark.read.schema("region string, nations array<struct<nation:string,nation_id:bigint>>").json(folder)
    return reports.explode_rows(back, "nations", ["region"])


@query("X08_map_overlay", "", """
WITH a AS (SELECT user_id, event_type, max(value) AS v FROM events WHERE event_id % 3 <> 0 GROUP BY 1, 2),
b AS (SELECT user_id, event_type, min(value) AS v FROM events WHERE event_id % 3 = 0 GROUP BY 1, 2),
m AS (SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.event_type, b.event_type) AS event_type, CASE WHEN b.user_id IS NOT NULL THEN b.v ELSE a.v END AS v
      FROM a FULL JOIN b ON a.user_id = b.user_id AND a.event_type = b.event_type)
SELECT user_id, count(*) AS n_keys, count(v) AS n_values, coalesce(max(v) FILTER (event_type = 'click'), -1) AS click, coalesce(max(v) FILTER (event_type = 'nothing'), -1) AS nothing FROM m GROUP BY 1""")
def map_overlay(spark, d):
    e = fixtures.table(spark, d, "events")

    def cells(part, pick, name):
        per = part.groupBy("user_id", "event_type").agg(pick("value").alias("v"))
        return per.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "v"))).alias(name))

    base, over = cells(e.filter("event_id % 3 <> 0"), F.max, "base"), cells(e.filter("event_id % 3 = 0"), F.min, "over")
    both = base.join(over, "user_id", "full_outer").select("user_id", reports.overlay(F.col("base"), F.col("over")).alias("m"))
    read = lambda k: reports.get_or(F.col("m"), F.lit(k), F.lit(-1.0))
    return both.select("user_id", F.size("m").cast("bigint").alias("n_keys"), F.size(reports.without_blank(F.col("m"))).cast("bigint").alias("n_values"),
                       read("click").alias("click"), read("nothing").alias("nothing"))


# ---- materialised tables ----
@query("S08_write_outline", "prob_px", """SELECT dataset, image_id, y, x, CAST(CASE WHEN "true" THEN 255 ELSE 0 END AS INTEGER) AS value FROM prob_px""")
def write_outline(spark, d):
    folder = shared_folder(spark, "outline")
    px = fixtures.prob_px(spark, d)
    store.write_outline(px.select("dataset", "image_id", "y", "x", F.when(F.col("true"), 255).otherwise(0).cast("int").alias("value")), folder)
    return spark.read.parquet(folder).select("dataset", "image_id", "y", "x", "value")


@query("S09_materialize", "", """
SELECT step, reason, CASE WHEN step = 3 THEN count(*) FILTER (event_id % 2 = 0) ELSE count(*) END AS n_rows
FROM events CROSS JOIN (VALUES (1, 'no cache'), (2, 'reused'), (3, 'stale key')) s(step, reason) GROUP BY 1, 2""")
def materialize(spark, d):
    e = fixtures.table(spark, d, "events").select("event_id", "event_type", "value")
    folder, out = shared_folder(spark, "cache"), None
    for step, df in enumerate((e, e, e.filter("event_id % 2 = 0")), 1):
        stored, reason = store.materialize(df, folder, store.fingerprint(df))
        row = stored.agg(F.lit(step).alias("step"), F.lit(reason).alias("reason"), F.count("*").alias("n_rows"))
        out = row if out is None else out.unionByName(row)
    return out


# ---- image files ----
def _bitmaps(spark, d):
    """Folder in which every mosaic stands as a colour bitmap."""
    folder = shared_folder(spark, "bitmaps")
    px = fixtures.mask_px(spark, d).withColumn("stem", F.concat(F.lit("im"), "image_id"))
    cut(bitmaps.write_bitmaps(px, folder))
    return folder


def _all_images(folder):
    return f"{folder}/*/images"


@query("S01_scan_files", "px", """
SELECT DISTINCT dataset, 'im' || image_id || '.bmp' AS name, 'im' || image_id AS stem, 54 + height * ((3 * width + 3) // 4 * 4)::BIGINT AS length FROM px""")
def scan_files(spark, d):
    return files.scan_files(spark, _bitmaps(spark, d)).select("dataset", "name", "stem", "length")


# a file is a rectangle: pixels that a mosaic does not have are black in it
@query("S02_scan_pixels", "px", """
SELECT 'im' || i.image_id AS stem, i.y, i.x, coalesce(CAST(label * 25 AS INTEGER), 0) AS r, coalesce(CAST(250 - label * 25 AS INTEGER), 0) AS g,
  CASE WHEN p100 IS NULL THEN 0 WHEN p100 >= 90 THEN 108 ELSE 100 END AS b
FROM (SELECT image_id, y, CAST(unnest(range(width)) AS INTEGER) AS x FROM (SELECT image_id, width, CAST(unnest(range(height)) AS INTEGER) AS y FROM (SELECT DISTINCT image_id, height, width FROM px))) i
LEFT JOIN px USING (image_id, y, x)""")
def scan_pixels(spark, d):
    px = files.scan_pixels(spark, _all_images(_bitmaps(spark, d)))
    return px.select(F.regexp_extract("path", "([^/]+)[.]bmp$", 1).alias("stem"), "y", "x", "r", "g", "b")


@query("S03_image_meta", "px", """
SELECT 'im' || image_id AS stem, 'BMP' AS format, height, width, 3 AS channels, 8 AS bit_depth, CASE WHEN bool_and(label * 25 = 250 - label * 25 AND label * 25 = CASE WHEN p100 >= 90 THEN 108 ELSE 100 END)
  THEN 'rgb-but-gray' ELSE 'rgb' END AS colour_mode FROM px GROUP BY image_id, height, width""")
def image_meta(spark, d):
    meta = files.image_meta(spark, _all_images(_bitmaps(spark, d)))
    return meta.select(F.regexp_extract("path", "([^/]+)[.]bmp$", 1).alias("stem"), "format", "height", "width", "channels", "bit_depth", "colour_mode")
