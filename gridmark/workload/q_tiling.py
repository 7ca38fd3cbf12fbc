"""Tile plans, folds, sampling, set checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridmark.operators import checks, folds, raster, sampling, summaries, tiles
from gridmark.workload import fixtures
from gridmark.workload.registry import query
from gridmark.workload.views import view

LODO = ("1-URGENT", "2-HIGH", "3-MEDIUM")
VAL = {"4-NOT SPECIFIED": 10}
TEST_ONLY = ("5-LOW",)
FRACTIONS = {"train": 0.7, "val": 0.15, "test": 0.15}


def kept_tiles(spark, d):
    """Tiles with a source image (ten tiles share one)."""
    return fixtures.tiles(spark, d).withColumn(
        "source_image", F.concat(F.lit("im"), F.expr("tile_id div 10").cast("string")))


def folds_of(tiles_):
    return folds.build_folds(tiles_, LODO, VAL, TEST_ONLY, 7)


def all_folds(spark, d):
    return folds_of(kept_tiles(spark, d))


view("ktiles", "SELECT *, 'im' || (tile_id // 10) AS source_image FROM tiles", "tiles")
view("valparents", """
SELECT dataset, parent_id FROM (SELECT DISTINCT dataset, parent_id FROM ktiles WHERE dataset = '4-NOT SPECIFIED')
QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY md5('7|' || parent_id), parent_id) <= 10""", "ktiles")
view("folds", """
SELECT t.*, held AS held_out, 'fold_' || held AS fold,
       CASE WHEN t.dataset = '4-NOT SPECIFIED' THEN CASE WHEN v.parent_id IS NULL THEN 'train' ELSE 'val' END
            WHEN t.dataset = held THEN 'val' ELSE 'train' END AS split
FROM ktiles t CROSS JOIN (VALUES ('1-URGENT'), ('2-HIGH'), ('3-MEDIUM')) h(held)
LEFT JOIN valparents v ON v.dataset = t.dataset AND v.parent_id = t.parent_id
WHERE t.dataset <> '5-LOW'""", "ktiles valparents")
POSITIONS = """
list_concat(CASE WHEN {s} > {p} AND (({s} - {p}) % {t}) > 0 AND (({s} - {p}) % {t}) * 2 < {t}
                 THEN list_slice(range(0, {s} - {p} + 1, {t}), 1, len(range(0, {s} - {p} + 1, {t})) - 1)
                 WHEN {s} <= {p} THEN [0] ELSE range(0, {s} - {p} + 1, {t}) END,
            CASE WHEN {s} > {p} AND (({s} - {p}) % {t}) > 0 THEN [{s} - {p}] ELSE [] END)"""


def pos_sql(size: str, patch: int, stride: int) -> str:
    return POSITIONS.format(s=size, p=patch, t=stride)


@query("P14_plan_tiles", "image_sizes", f"""
SELECT image_id, CAST(greatest(256 - width, 0) AS INTEGER) AS pad_right,
       CAST(greatest(256 - height, 0) AS INTEGER) AS pad_bottom, CAST(tile_y AS INTEGER) AS tile_y,
       CAST(unnest({pos_sql("width", 256, 128)}) AS INTEGER) AS tile_x
FROM (SELECT *, unnest({pos_sql("height", 256, 128)}) AS tile_y FROM image_sizes)""")
def plan_tiles(spark, d):
    return tiles.plan_tiles(fixtures.image_sizes(spark, d), 256, 128).select(
        "image_id", "pad_right", "pad_bottom", "tile_y", "tile_x")


view("mplan", f"""
SELECT image_id, dataset, CAST(tile_y AS INTEGER) AS tile_y, CAST(unnest({pos_sql("width", 14, 7)}) AS INTEGER) AS tile_x
FROM (SELECT *, unnest({pos_sql("height", 14, 7)}) AS tile_y FROM (SELECT DISTINCT image_id, dataset, height, width FROM px))""",
     "px")
view("mtiles", """
SELECT m.image_id, m.dataset, m.tile_y, m.tile_x, round(count(t.y) / 196.0::DOUBLE, 6) AS outline_fraction
FROM mplan m LEFT JOIN truth t ON t.image_id = m.image_id AND t.y >= tile_y AND t.y < tile_y + 14
     AND t.x >= tile_x AND t.x < tile_x + 14 GROUP BY 1, 2, 3, 4""", "mplan truth")


def mosaic_images(spark, d):
    return fixtures.px(spark, d).filter("y = 0 and x = 0").select("image_id", "dataset", "height", "width")


def mosaic_tiles(spark, d):
    plan = tiles.plan_tiles(mosaic_images(spark, d), 14, 7)
    return tiles.outline_fractions(fixtures.truth(spark, d), plan, 14, 7)


@query("A10_tile_outline_fraction", "mtiles", "SELECT image_id, tile_y, tile_x, outline_fraction FROM mtiles")
def tile_fraction(spark, d):
    return mosaic_tiles(spark, d).select("image_id", "tile_y", "tile_x", "outline_fraction")


@query("J07_pixel_tile_coverage", "px mplan", """
SELECT m.image_id, tile_y, tile_x, count(*) AS n, sum(p100)::BIGINT AS total FROM mplan m JOIN px p
ON p.image_id = m.image_id AND y >= tile_y AND y < tile_y + 14 AND x >= tile_x AND x < tile_x + 14 GROUP BY 1, 2, 3""")
def coverage(spark, d):
    return (tiles.tile_pixels(fixtures.px(spark, d), 14, 7).groupBy("image_id", "tile_y", "tile_x")
            .agg(F.count("*").alias("n"), F.sum("p100").alias("total")))


@query("P05_min_content_filter", "mtiles", """
SELECT image_id, count(*) AS planned, count(*) FILTER (outline_fraction >= 0.3::DOUBLE) AS kept,
       count(*) = 1 AND count(*) FILTER (outline_fraction >= 0.3::DOUBLE) = 0 AS lost FROM mtiles GROUP BY 1""")
def min_content(spark, d):
    flagged = tiles.keep_by_content(mosaic_tiles(spark, d), 0.3)
    lost = tiles.lost_images(flagged).withColumn("lost", F.lit(True))
    sums = flagged.groupBy("image_id").agg(F.count("*").alias("planned"),
                                           F.sum(F.col("kept").cast("bigint")).alias("kept"))
    return sums.join(lost, "image_id", "left").withColumn("lost", F.coalesce("lost", F.lit(False)))


@query("P12_crop_tile", "px", """
SELECT image_id, CAST(y - 3 AS INTEGER) AS y, CAST(x - 5 AS INTEGER) AS x, p100 FROM px
WHERE y >= 3 AND y < 7 AND x >= 5 AND x < 9""")
def crop_tile(spark, d):
    return tiles.crop(fixtures.px(spark, d), F.lit(3), F.lit(5), 4).select("image_id", "y", "x", "p100")


@query("P13_reconcile_size", "", """
SELECT image_id, status, final_width, image_left, mask_top,
  CASE WHEN status = 'rejected' THEN format('sizes differ: mask {} x {}, image {} x {}, apart by {} x {} where 2 is allowed',
       mw, mh, iw, ih, abs(iw - mw), abs(ih - mh)) END AS message
FROM (SELECT *, CASE WHEN iw = mw AND ih = mh THEN 'equal' WHEN abs(iw - mw) > 2 OR abs(ih - mh) > 2 THEN 'rejected'
                     ELSE 'cropped' END AS status,
        CASE WHEN abs(iw - mw) > 2 OR abs(ih - mh) > 2 THEN NULL ELSE least(iw, mw) END AS final_width,
        CASE WHEN abs(iw - mw) > 2 OR abs(ih - mh) > 2 THEN NULL ELSE CAST((iw - least(iw, mw)) // 2 AS INTEGER) END AS image_left,
        CASE WHEN abs(iw - mw) > 2 OR abs(ih - mh) > 2 THEN NULL ELSE CAST((mh - least(ih, mh)) // 2 AS INTEGER) END AS mask_top
 FROM (SELECT p_partkey AS image_id, CAST(200 + p_partkey % 900 AS INTEGER) AS iw, CAST(200 + p_size * 17 AS INTEGER) AS ih,
        CAST(200 + p_partkey % 900 + p_partkey % 4 AS INTEGER) AS mw, CAST(200 + p_size * 17 - p_size % 3 AS INTEGER) AS mh FROM part))""")
def reconcile(spark, d):
    p = fixtures.table(spark, d, "part")
    pairs = fixtures.image_sizes(spark, d).select("image_id", F.col("width").alias("image_width"),
                                                  F.col("height").alias("image_height")).join(
        p.select(F.col("p_partkey").alias("image_id"),
                 (200 + F.col("p_partkey") % 900 + F.col("p_partkey") % 4).cast("int").alias("mask_width"),
                 (200 + F.col("p_size") * 17 - F.col("p_size") % 3).cast("int").alias("mask_height")), "image_id")
    return tiles.reconcile_size(pairs).select("image_id", "status", "final_width", "image_left", "mask_top", "message")


@query("P15_pad_reflect", "px", """
SELECT p.image_id, CAST(ny AS INTEGER) AS y, CAST(nx AS INTEGER) AS x, p100 FROM (
  SELECT s.image_id, ny, nx,
    CASE WHEN sym THEN CASE WHEN ny % (2 * height) < height THEN ny % (2 * height) ELSE 2 * height - 1 - ny % (2 * height) END
         ELSE CASE WHEN ny < height THEN ny ELSE 2 * (height - 1) - ny END END AS sy,
    CASE WHEN sym THEN CASE WHEN nx % (2 * width) < width THEN nx % (2 * width) ELSE 2 * width - 1 - nx % (2 * width) END
         ELSE CASE WHEN nx < width THEN nx ELSE 2 * (width - 1) - nx END END AS sx
  FROM (SELECT DISTINCT image_id, height, width, 40 - height >= height OR 40 - width >= width AS sym FROM px) s,
       range(40) a(ny), range(40) b(nx)) q JOIN px p ON p.image_id = q.image_id AND p.y = q.sy AND p.x = q.sx""")
def pad_reflect(spark, d):
    return tiles.pad_reflect(fixtures.px(spark, d), 40).select("image_id", "y", "x", "p100")


@query("A37_cache_estimate", "image_sizes", """
SELECT CASE WHEN grouping(dataset) = 1 THEN '__total__' ELSE dataset END AS dataset, count(*) AS images,
       sum(width::BIGINT * height * 2)::BIGINT AS bytes, round(sum(width::BIGINT * height * 2) / 1048576.0::DOUBLE, 3) AS megabytes
FROM image_sizes GROUP BY GROUPING SETS ((dataset), ())""")
def cache_estimate(spark, d):
    return tiles.cache_estimate(fixtures.image_sizes(spark, d))


@query("A11_parent_map", "ktiles", """
SELECT dataset, parent_id, count(*) AS tiles, count(DISTINCT source_image) AS images FROM ktiles GROUP BY 1, 2""")
def parent_map(spark, d):
    return folds.parent_map(kept_tiles(spark, d))


@query("A11_composition", "ktiles", """
SELECT dataset, sum(t)::BIGINT AS tiles, sum(i)::BIGINT AS images, count(*) AS parents FROM (
  SELECT dataset, parent_id, count(*) t, count(DISTINCT source_image) i FROM ktiles GROUP BY 1, 2) GROUP BY 1""")
def composition(spark, d):
    return folds.composition(kept_tiles(spark, d))


@query("A12_summary_stats", "tiles", """
SELECT dataset, round(min(outline_fraction), 6) AS min, round(avg(outline_fraction), 6) AS mean,
       round(median(outline_fraction), 6) AS median, round(max(outline_fraction), 6) AS max, count(*) AS n
FROM tiles GROUP BY 1""")
def summary_stats(spark, d):
    return summaries.describe(fixtures.tiles(spark, d), F.col("outline_fraction"), ["dataset"])


@query("A03_minmedmax", "", """
SELECT event_type, round(min(v), 6) AS min, round(median(v), 6) AS median, round(max(v), 6) AS max, count(v) AS n,
       round(avg(v), 6) AS mean FROM (SELECT event_type, CASE WHEN user_id % 3 = 0 OR event_type = 'click' THEN NULL ELSE value END v FROM events) GROUP BY 1""")
def minmedmax(spark, d):
    e = fixtures.table(spark, d, "events")
    v = F.when((F.col("user_id") % 3 != 0) & (F.col("event_type") != "click"), F.col("value"))
    return summaries.describe(e, v, ["event_type"])


@query("A33_percentiles", "", """
SELECT event_type, round(quantile_cont(value, 0.05), 6) AS p5, round(quantile_cont(value, 0.25), 6) AS p25,
  round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.75), 6) AS p75, round(quantile_cont(value, 0.95), 6) AS p95
FROM events GROUP BY 1""")
def percentiles(spark, d):
    return summaries.quantiles(fixtures.table(spark, d, "events"), F.col("value"), (.05, .25, .5, .75, .95),
                               ["event_type"], ["p5", "p25", "p50", "p75", "p95"], 6)


@query("F01_split_parents", "ktiles valparents", """
SELECT DISTINCT t.dataset, t.parent_id, CASE WHEN v.parent_id IS NULL THEN 'train' ELSE 'val' END AS side
FROM ktiles t LEFT JOIN valparents v USING (dataset, parent_id) WHERE t.dataset = '4-NOT SPECIFIED'""")
def split_parents(spark, d):
    return folds.split_parents(kept_tiles(spark, d), VAL, 7)


@query("F02_build_folds", "folds", "SELECT fold, split, tile_id, dataset, parent_id FROM folds")
def build_folds(spark, d):
    return all_folds(spark, d).select("fold", "split", "tile_id", "dataset", "parent_id")


@query("K06_dev_alias", "folds", """
SELECT 'dev' AS fold, tile_id, split FROM folds WHERE fold = (SELECT fold FROM folds GROUP BY fold
  ORDER BY count(*) FILTER (split = 'val'), fold LIMIT 1)""")
def dev_alias(spark, d):
    return folds.with_dev_alias(all_folds(spark, d)).filter("fold = 'dev'").select("fold", "tile_id", "split")


def alloc_views(t: str, where: str) -> None:
    """Allocation of parents to splits, greedy in seeded order, over the pool that ``where`` names."""
    view(f"pcounts{t}", f"""SELECT dataset, parent_id, count(*) AS n, md5('11|' || dataset || '|' || parent_id) AS h
FROM ktiles {where}GROUP BY 1, 2""", f"ktiles")
    view(f"pranked{t}", f"SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY h, parent_id) AS k FROM pcounts{t}", f"pcounts{t}")
    view(f"prest{t}", f"SELECT *, row_number() OVER (ORDER BY h, dataset, parent_id) AS i FROM pranked{t} WHERE k > 3", f"pranked{t}")
    view(f"greedy{t}", f"""(i, dataset, parent_id, split, t0, t1, t2) AS (
  SELECT 0::BIGINT, NULL::VARCHAR, NULL::BIGINT, NULL::VARCHAR, sum(n) FILTER (k = 1)::BIGINT, sum(n) FILTER (k = 2)::BIGINT,
         sum(n) FILTER (k = 3)::BIGINT FROM pranked{t} WHERE k <= 3
  UNION ALL
  SELECT i, dataset, parent_id, s, t0 + CASE WHEN s = 'train' THEN n ELSE 0 END, t1 + CASE WHEN s = 'val' THEN n ELSE 0 END,
         t2 + CASE WHEN s = 'test' THEN n ELSE 0 END
  FROM (SELECT p.*, g.t0, g.t1, g.t2, CASE WHEN 0.7::DOUBLE * a - t0 >= 0.15::DOUBLE * a - t1 AND 0.7::DOUBLE * a - t0 >= 0.15::DOUBLE * a - t2 THEN 'train'
          WHEN 0.15::DOUBLE * a - t1 >= 0.15::DOUBLE * a - t2 THEN 'val' ELSE 'test' END AS s
        FROM greedy{t} g JOIN prest{t} p ON p.i = g.i + 1, (SELECT sum(n)::DOUBLE AS a FROM pcounts{t})))""", f"prest{t}")
    view(f"alloc{t}", f"""
SELECT dataset, parent_id, CASE k WHEN 1 THEN 'train' WHEN 2 THEN 'val' ELSE 'test' END AS split FROM pranked{t} WHERE k <= 3
UNION ALL SELECT dataset, parent_id, split FROM greedy{t} WHERE i > 0""", f"greedy{t}")


alloc_views("", "WHERE dataset IN ('1-URGENT', '2-HIGH') ")
alloc_views("_all", "")


@query("F03_allocate_by_tile_ratio", "alloc_all", "SELECT * FROM alloc_all")
def allocate(spark, d):
    return folds.allocate_by_tile_ratio(kept_tiles(spark, d), FRACTIONS, 11)


@query("F04_pooled_fold", "alloc", """
SELECT 'fold_pooled' AS fold, split, dataset, count(*) AS tiles, count(DISTINCT parent_id) AS parents
FROM ktiles JOIN alloc USING (dataset, parent_id) GROUP BY 1, 2, 3""")
def pooled(spark, d):
    out = folds.pooled_fold(kept_tiles(spark, d), "fold_pooled", ("1-URGENT", "2-HIGH"), FRACTIONS, 11)
    return out.groupBy("fold", "split", "dataset").agg(F.count("*").alias("tiles"),
                                                       F.count_distinct("parent_id").alias("parents"))


@query("A13_pos_weight", "folds", """
SELECT fold, round((1 - avg(outline_fraction)) / avg(outline_fraction), 6) AS pos_weight FROM folds WHERE split = 'train' GROUP BY 1""")
def pos_weight(spark, d):
    return (all_folds(spark, d).filter("split = 'train'").groupBy("fold")
            .agg(F.round(folds.pos_weight(F.avg("outline_fraction")), 6).alias("pos_weight")))


@query("A14_pos_weight_drift", "folds", """
SELECT fold, 20.0::DOUBLE AS recorded, round((1 - avg(outline_fraction)) / avg(outline_fraction), 6) AS implied,
       round(20.0::DOUBLE / ((1 - avg(outline_fraction)) / avg(outline_fraction)), 6) AS ratio
FROM folds WHERE split = 'train' GROUP BY 1""")
def drift(spark, d):
    f = all_folds(spark, d)
    recorded = f.select("fold").distinct().withColumn("recorded", F.lit(20.0))
    return folds.pos_weight_drift(f, recorded).select("fold", "recorded", F.round("implied", 6).alias("implied"),
                                                      F.round("ratio", 6).alias("ratio"))


for _mode, _target in (("parents", "p / sum(p) OVER (PARTITION BY fold)"), ("dataset", "1.0 / count(*) OVER (PARTITION BY fold)"),
                       ("none", "c / sum(c) OVER (PARTITION BY fold)")):
    @query(f"A15_sampling_weights_{_mode}", "folds", f"""
SELECT fold, dataset, c AS raw_count, p AS n_parents, round(tgt * tot / c, 6) AS weight, round(tgt, 4) AS target_share,
       CAST(round(tgt * tot, 0) AS BIGINT) AS effective_count
FROM (SELECT *, CAST({_target} AS DOUBLE) AS tgt, sum(c) OVER (PARTITION BY fold) AS tot FROM (
  SELECT fold, dataset, count(*) AS c, count(DISTINCT parent_id) AS p FROM folds WHERE split = 'train' GROUP BY 1, 2))""")
    def weights(spark, d, mode=_mode):
        return folds.sampling_weights(all_folds(spark, d).filter("split = 'train'"), mode)


@query("A16_fold_statistics", "folds", """
SELECT fold, split, count(*) AS n_tiles, count(DISTINCT dataset || '|' || parent_id) AS n_parents,
       array_to_string(list_sort(list(DISTINCT dataset)), ',') AS datasets, round(min(outline_fraction), 6) AS min,
       round(avg(outline_fraction), 6) AS mean, round(median(outline_fraction), 6) AS median,
       round(max(outline_fraction), 6) AS max,
       CASE WHEN split = 'train' THEN round((1 - avg(outline_fraction)) / avg(outline_fraction), 3) END AS pos_weight
FROM folds GROUP BY 1, 2""")
def fold_statistics(spark, d):
    return folds.fold_statistics(all_folds(spark, d)).withColumn("datasets", F.array_join("datasets", ","))


@query("U01_union_folds", "folds", "SELECT fold, split, count(*) AS n FROM folds WHERE split IN ('train', 'val') GROUP BY 1, 2")
def union_folds(spark, d):
    f = all_folds(spark, d)
    return f.filter("split = 'train'").unionByName(f.filter("split = 'val'")).groupBy("fold", "split").agg(
        F.count("*").alias("n"))


@query("U02_leaking_parents", "folds", """
SELECT fold, dataset, parent_id FROM folds WHERE split = 'train' INTERSECT
SELECT fold, dataset, parent_id FROM folds WHERE split = 'val'""")
def leaking(spark, d):
    return folds.leaking_parents(all_folds(spark, d))


LEAK = "split = 'val' AND parent_id % 5 = 0"


@query("U02_leaking_parents_found", "folds", f"""
SELECT DISTINCT fold, dataset, parent_id FROM folds WHERE {LEAK}""")
def leaking_found(spark, d):
    """Every fifth validation parent also trains."""
    f = all_folds(spark, d)
    return folds.leaking_parents(f.unionByName(f.filter(LEAK).withColumn("split", F.lit("train"))))


@query("U02_image_straddle", "ktiles valparents", """
SELECT DISTINCT t.source_image FROM ktiles t JOIN valparents v USING (dataset, parent_id)
INTERSECT SELECT DISTINCT t.source_image FROM ktiles t ANTI JOIN valparents v USING (dataset, parent_id)
WHERE t.dataset = '4-NOT SPECIFIED'""")
def straddle(spark, d):
    t = kept_tiles(spark, d).filter("dataset = '4-NOT SPECIFIED'").join(
        folds.split_parents(kept_tiles(spark, d), VAL, 7), ["dataset", "parent_id"])
    return t.filter("side = 'val'").select("source_image").intersect(t.filter("side = 'train'").select("source_image"))


view("newfolds", """
SELECT t.tile_id, CASE WHEN v.parent_id IS NULL THEN 'train' ELSE 'val' END AS split
FROM (SELECT * FROM ktiles WHERE dataset = '4-NOT SPECIFIED') t LEFT JOIN (
  SELECT dataset, parent_id FROM (SELECT DISTINCT dataset, parent_id FROM ktiles WHERE dataset = '4-NOT SPECIFIED')
  QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY md5('8|' || parent_id), parent_id) <= 10) v USING (dataset, parent_id)""",
     "ktiles")


@query("U03_membership_diff", "folds newfolds", """
SELECT split, tile_id, 'only_old' AS side FROM (
  SELECT split, tile_id FROM folds WHERE fold = 'fold_1-URGENT' AND dataset = '4-NOT SPECIFIED' EXCEPT ALL SELECT split, tile_id FROM newfolds)
UNION ALL SELECT split, tile_id, 'only_new' FROM (SELECT split, tile_id FROM newfolds EXCEPT ALL
  SELECT split, tile_id FROM folds WHERE fold = 'fold_1-URGENT' AND dataset = '4-NOT SPECIFIED')""")
def membership(spark, d):
    t = kept_tiles(spark, d).filter("dataset = '4-NOT SPECIFIED'")
    sides = [t.join(folds.split_parents(t, VAL, seed), ["dataset", "parent_id"]).withColumnRenamed("side", "split")
             for seed in (7, 8)]
    return folds.membership_diff(*sides)


@query("U05_missing_columns", "tiles", """
SELECT missing, n AS n_rows FROM (SELECT unnest(['tile_id', 'dataset', 'parent_id', 'patch', 'gt_path']) AS missing,
  unnest([count(*) - count(tile_id), count(*) - count(dataset), count(*) - count(nullif(parent_id, 0)), count(*), count(*)]) AS n FROM tiles) WHERE n > 0""")
def missing_columns(spark, d):
    t = fixtures.tiles(spark, d).withColumn("parent_id", F.nullif("parent_id", F.lit(0)))
    return checks.rows_without(t, ("tile_id", "dataset", "parent_id", "patch", "gt_path"))


@query("U05_missing_thresholds", "folds", """
SELECT DISTINCT fold, dataset AS missing FROM folds f WHERE NOT EXISTS (
  SELECT 1 FROM folds t WHERE t.fold = f.fold AND t.dataset = f.dataset AND t.split = 'train' AND t.outline_fraction >= 0.05)""")
def missing_thresholds(spark, d):
    """Datasets of each fold for which its training tiles give no threshold."""
    f = all_folds(spark, d)
    have = f.filter("split = 'train' and outline_fraction >= 0.05D").select("fold", "dataset").distinct()
    return checks.missing_groups(f, have, ["fold", "dataset"]).select("fold", F.col("dataset").alias("missing"))


@query("K02_seeded_sample", "ktiles", """
SELECT dataset, tile_id FROM ktiles QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY md5('3|' || tile_id), tile_id) <= 24""")
def seeded_sample(spark, d):
    return sampling.seeded_sample(kept_tiles(spark, d), 24, 3, F.col("tile_id"), ["dataset"]).select("dataset", "tile_id")


@query("K03_probe_sample", "ktiles", "SELECT tile_id FROM ktiles ORDER BY md5('5|' || tile_id), tile_id LIMIT 64")
def probe_sample(spark, d):
    return sampling.seeded_sample(kept_tiles(spark, d), 64, 5, F.col("tile_id")).select("tile_id")


@query("K04_densest_tile", "mtiles", """
SELECT tile, outline_fraction FROM (SELECT image_id || '/' || tile_y || '/' || tile_x AS tile, outline_fraction FROM mtiles
  ORDER BY outline_fraction DESC, tile LIMIT 20) WHERE outline_fraction * 196 > 80 ORDER BY outline_fraction DESC, tile LIMIT 1""")
def densest(spark, d):
    t = mosaic_tiles(spark, d).withColumns({
        "tile_id": F.concat_ws("/", "image_id", "tile_y", "tile_x"), "outline_px": F.col("outline_fraction") * 196})
    return sampling.densest_tile(t, 80).select(F.col("tile_id").alias("tile"), "outline_fraction")


@query("K05_weighted_sample", "ktiles", """
SELECT draw, tile_id FROM (
  SELECT j AS draw, CAST(concat('0x', substr(md5('9|' || j), 1, 15)) AS BIGINT) % (SELECT sum(w) FROM
    (SELECT CAST(1 + tile_id % 7 AS BIGINT) AS w FROM ktiles))::BIGINT AS at FROM range((SELECT count(*) FROM ktiles)) r(j)) d
JOIN (SELECT tile_id, hi - w AS lo, hi FROM (SELECT tile_id, w, sum(w) OVER (ORDER BY md5(tile_id::VARCHAR), tile_id) AS hi
  FROM (SELECT tile_id, CAST(1 + tile_id % 7 AS BIGINT) AS w FROM ktiles))) r ON d.at >= r.lo AND d.at < r.hi""")
def weighted_sample(spark, d):
    t = kept_tiles(spark, d).withColumn("w", 1 + F.col("tile_id") % 7)
    return sampling.weighted_draws(t, "tile_id", "w", t.count(), 9)


@query("K07_manifest_order", "ktiles", "SELECT dataset, tile_id FROM ktiles ORDER BY dataset, tile_id")
def manifest_order(spark, d):
    return kept_tiles(spark, d).select("dataset", "tile_id").orderBy("dataset", "tile_id")


@query("K08_per_folder_limit", "files", """
SELECT dataset, path FROM files QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY path) <= 5""")
def folder_limit(spark, d):
    return sampling.first_per_group(fixtures.files(spark, d), 5, ["path"], ["dataset"])


@query("P16_resolve_exclusions", "folds", """
SELECT fold, split, count(*) AS n FROM folds WHERE NOT (split = 'train' AND dataset IN ('2-HIGH')) GROUP BY 1, 2""")
def exclusions(spark, d):
    return (checks.exclude_from_train(all_folds(spark, d), ["2-HIGH"]).groupBy("fold", "split")
            .agg(F.count("*").alias("n")))


@query("P17_sanity_bands", "folds", """
SELECT fold, width, pw, pw >= greatest(1.0, 10.0 / width) AND pw <= 400.0 / width AS pos_weight_ok,
       frac, frac >= 0.005 AND frac <= least(0.95, 0.25 * width / 2) AS fraction_ok, greatest(1, round(width, 0))::INTEGER AS tolerance_px
FROM (SELECT fold, 2.0::DOUBLE AS width, round((1 - avg(outline_fraction)) / avg(outline_fraction), 6) AS pw,
      round(avg(outline_fraction), 6) AS frac FROM folds WHERE split = 'train' GROUP BY 1)""")
def sanity(spark, d):
    f = all_folds(spark, d).filter("split = 'train'").groupBy("fold").agg(F.avg("outline_fraction").alias("m"))
    t = f.select("fold", F.lit(2.0).alias("width"), F.round(folds.pos_weight(F.col("m")), 6).alias("pw"),
                 F.round("m", 6).alias("frac"))
    return checks.sanity_bands(t, F.col("width"), F.col("pw"), F.col("frac"))


@query("F06_fold_integrity", "folds", """
SELECT fold, check_name, ok FROM (SELECT fold,
    count(*) FILTER (split = 'train') > 0 AND count(*) FILTER (split = 'val') > 0 AS non_empty,
    bool_and(dataset <> '5-LOW') AS test_only_absent,
    count(DISTINCT tile_id) = count(*) AS tiles_unique,
    count(DISTINCT CASE WHEN split = 'train' THEN dataset || '|' || parent_id END) + count(DISTINCT CASE WHEN split = 'val' THEN dataset || '|' || parent_id END)
      = count(DISTINCT dataset || '|' || parent_id) AS parents_disjoint,
    avg(outline_fraction) FILTER (split = 'train') BETWEEN 1 / 201.0::DOUBLE AND 1 / 6.0::DOUBLE AS pos_weight_in_band,
    bool_and(256 <= 240 + parent_id) AS no_padding,
    bool_and((tile_id % 3) * 64 + 256 <= 384 AND 256 <= greatest(256, 240 + parent_id)) AS tile_inside_image,
    true AS deterministic_rebuild
  FROM folds GROUP BY 1) UNPIVOT (ok FOR check_name IN (non_empty, test_only_absent, tiles_unique, parents_disjoint, pos_weight_in_band, no_padding, tile_inside_image,
                                                       deterministic_rebuild))""")
def integrity(spark, d):
    height = (240 + F.col("parent_id")).cast("int")  # low images are padded to a tile
    placed = all_folds(spark, d).withColumns({
        "x": (F.col("tile_id") % 3 * 64).cast("int"), "y": F.lit(0), "patch": F.lit(256), "width": F.lit(384), "height": height,
        "pad_right": F.lit(0), "pad_bottom": tiles.padding(height, 256)})
    rules = checks.fold_integrity(placed, TEST_ONLY, width=2.0)
    again = checks.rebuild_integrity(folds_of, kept_tiles(spark, d))
    return rules.unionByName(again).select("fold", "check_name", "ok")


@query("X11_tile_id", "mplan", "SELECT dataset || '/im' || image_id || '/x' || tile_x || '_y' || tile_y AS tile_id FROM mplan")
def tile_ids(spark, d):
    from gridmark.functions.names import tile_id
    plan = tiles.plan_tiles(mosaic_images(spark, d), 14, 7)
    return plan.select(tile_id(F.col("dataset"), F.concat(F.lit("im"), "image_id"), F.col("tile_x"), F.col("tile_y")).alias("tile_id"))


@query("W10_cut_gaps", "truth", """
SELECT image_id, y, x FROM truth t WHERE NOT EXISTS (SELECT 1 FROM (
  SELECT image_id, y, x, row_number() OVER (PARTITION BY image_id ORDER BY y, x) - 1 AS k FROM truth) c
  WHERE c.k % 20 = 0 AND c.image_id = t.image_id AND abs(c.y - t.y) <= 1 AND abs(c.x - t.x) <= 1)""")
def cut_gaps(spark, d):
    return raster.erase_every(fixtures.truth(spark, d), 20, 3).select("image_id", "y", "x")
