"""Components, thinning, distances, region partitions and their scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridmark.operators import attribution, components, distance, partition_scores, raster, regions, summaries, thinning
from gridmark.session import cut
from gridmark.workload import fixtures
from gridmark.workload.q_sweep import rounded
from gridmark.workload.registry import query
from gridmark.workload.views import ratio, view

RID = "((y::BIGINT << 32) + {x} + 1)"


def components_view(name: str, source: str, connectivity: int, needs: str, label: str = "0") -> None:
    """Recursive reachability over runs: ``name(image_id, lab, y, x0, x1, id, component)``."""
    s = 0 if connectivity == 4 else 1
    view(f"{name}_runs", f"""SELECT image_id, lab, y, min(x) AS x0, max(x) AS x1, {RID.format(x="min(x)")} AS id FROM (
      SELECT image_id, {label} AS lab, y, x, x - row_number() OVER (PARTITION BY image_id, {label}, y ORDER BY x) AS isl FROM {source})
      GROUP BY image_id, lab, y, isl""", needs)
    view(f"{name}_edges", f"""SELECT a.image_id, a.id AS a, b.id AS b FROM {name}_runs a JOIN {name}_runs b ON a.image_id = b.image_id AND a.lab = b.lab
      AND abs(a.y - b.y) = 1 AND a.x0 <= b.x1 + {s} AND b.x0 <= a.x1 + {s}""", f"{name}_runs")
    view(f"{name}_reach", f"""(image_id, id, root) AS (SELECT image_id, id, id FROM {name}_runs
      UNION SELECT e.image_id, e.b, r.root FROM {name}_reach r JOIN {name}_edges e ON e.image_id = r.image_id AND e.a = r.id WHERE r.root < e.b)""",
         f"{name}_edges")
    view(name, f"SELECT r.*, m.component FROM {name}_runs r JOIN (SELECT image_id, id, min(root) AS component FROM {name}_reach GROUP BY 1, 2) m USING (image_id, id)",
         f"{name}_reach")
    view(f"{name}_px", f"SELECT image_id, lab, y, unnest(range(x0, x1 + 1))::INTEGER AS x, component FROM {name}", name)


components_view("lab8", "px", 8, "px", "label")
components_view("lab4", "px", 4, "px", "label")
view("pred70", "SELECT image_id, height, width, y, x FROM px WHERE p100 >= 70", "px")
view("pred60", "SELECT image_id, height, width, y, x FROM px WHERE p100 >= 60", "px")
components_view("m8", "pred70", 8, "pred70")
components_view("pm8", "pred60", 8, "pred60")
view("ground", 'SELECT * FROM prob_px WHERE NOT "true"', "prob_px")
view("pground", "SELECT * FROM px WHERE p100 < 60", "px")
components_view("g4", "ground", 4, "ground")
components_view("p4", "pground", 4, "pground")
components_view("p8", "pground", 8, "pground")


def region_view(name: str, cc: str, everything: str = "px") -> None:
    """Nearest growth of components over the remaining pixels, lowest region on ties."""
    view(name, f"""
SELECT p.image_id, p.y, p.x, coalesce(c.component, n.region, 1) AS region FROM px p
LEFT JOIN {cc}_px c USING (image_id, y, x) LEFT JOIN (
  SELECT b.image_id, b.y, b.x, arg_min(c.component, ((b.y - c.y) * (b.y - c.y) + (b.x - c.x) * (b.x - c.x))::HUGEINT * 1000000000000000::HUGEINT + c.component) AS region
  FROM (SELECT image_id, y, x FROM px ANTI JOIN {cc}_px USING (image_id, y, x)) b JOIN {cc}_px c ON c.image_id = b.image_id GROUP BY 1, 2, 3) n USING (image_id, y, x)""",
         f"px {cc}_px")


region_view("treg", "g4")
region_view("preg", "p4")
region_view("preg8", "p8")

ZS_BITS = "(VALUES (0, 0, 256), (-1, 0, 1), (-1, 1, 2), (0, 1, 4), (1, 1, 8), (1, 0, 16), (1, -1, 32), (0, -1, 64), (-1, -1, 128)) o(dy, dx, bit)"


def skeleton_view(name: str, source: str, needs: str, group: str = "image_id", steps: int = 24) -> None:
    """Zhang-Suen sub-iterations as recursion; ``steps`` covers shapes up to ``steps`` pixels wide."""
    rises = " + ".join(f"(CASE WHEN (m >> {i}) & 1 = 0 AND (m >> {(i + 1) % 8}) & 1 = 1 THEN 1 ELSE 0 END)" for i in range(8))
    n, e, s, w = ("((m >> 0) & 1)", "((m >> 2) & 1)", "((m >> 4) & 1)", "((m >> 6) & 1)")
    first, second = f"{n} * {e} * {s} = 0 AND {e} * {s} * {w} = 0", f"{n} * {e} * {w} = 0 AND {n} * {s} * {w} = 0"
    view(f"{name}_it", f"""(it, g, y, x) AS (SELECT 0, {group}, y, x FROM {source}
      UNION ALL SELECT it + 1, g, y, x FROM (
        SELECT s.it, s.g, s.y, s.x, sum(o.bit) - 256 AS m FROM {name}_it s CROSS JOIN {ZS_BITS}
        JOIN {name}_it q ON q.g = s.g AND q.y = s.y + o.dy AND q.x = s.x + o.dx WHERE s.it < {steps} GROUP BY 1, 2, 3, 4)
      WHERE NOT (bit_count(m::BIGINT) BETWEEN 2 AND 6 AND ({rises}) = 1 AND CASE WHEN it % 2 = 0 THEN {first} ELSE {second} END))""", needs)
    view(name, f"SELECT g AS {group}, y, x FROM {name}_it WHERE it = {steps}", f"{name}_it")


skeleton_view("tskel", "truth", "truth")
skeleton_view("pskel", "pred60", "pred60")


def mask(spark, d, cut_at):
    return fixtures.px(spark, d).filter(F.col("p100") >= cut_at).select(*raster.frame())


def true_regions(spark, d):
    return regions.regions_from_outline(fixtures.prob_px(spark, d).withColumn("outline", F.col("true")))


def pred_regions(spark, d, cut_at=60, connectivity=4):
    return regions.regions_from_outline(fixtures.px(spark, d).withColumn("outline", F.col("p100") >= cut_at), connectivity=connectivity)


# ---- neighbourhoods ----
@query("G05_find_outlines", "truth", "SELECT image_id, y, x FROM truth")
def find_outlines(spark, d):
    return fixtures.truth(spark, d).select("image_id", "y", "x")


def dilated(source: str, cond: str, span: int) -> str:
    return f"""SELECT DISTINCT t.image_id, (t.y + dy)::INTEGER AS y, (t.x + dx)::INTEGER AS x FROM {source} t,
  range({-span}, {span + 1}) a(dy), range({-span}, {span + 1}) b(dx) WHERE {cond}
  AND t.y + dy BETWEEN 0 AND t.height - 1 AND t.x + dx BETWEEN 0 AND t.width - 1"""


view("close_d", dilated("pred70", "true", 1), "pred70")
view("eroded", """SELECT p.image_id, p.y, p.x FROM px p WHERE NOT EXISTS (
  SELECT 1 FROM px q WHERE q.image_id = p.image_id AND abs(q.y - p.y) <= 1 AND abs(q.x - p.x) <= 1 AND q.p100 < 60)""", "px")


@query("G01_dilate_disk", "pred70", dilated("pred70", "dy * dy + dx * dx <= 9", 3))
def dilate_disk(spark, d):
    return raster.dilate(mask(spark, d, 70), raster.disk(3)).select("image_id", "y", "x")


@query("J08_neighbour_degree", "pred70", """
SELECT a.image_id, a.y, a.x, count(b.y) AS n FROM pred70 a LEFT JOIN pred70 b ON b.image_id = a.image_id AND abs(b.y - a.y) + abs(b.x - a.x) = 1 GROUP BY 1, 2, 3""")
def degree(spark, d):
    m = mask(spark, d, 70).withColumn("one", F.lit(1))
    near = raster.focal(m, raster.PLUS, [raster.centre(F.col("one")).alias("own"), F.count("*").alias("n")], ["one"])
    return near.filter("own is not null").select("image_id", "y", "x", (F.col("n") - 1).alias("n"))


@query("G02_erode", "eroded", "SELECT * FROM eroded")
def erode(spark, d):
    return raster.erode(mask(spark, d, 60), within=fixtures.px(spark, d)).select("image_id", "y", "x")


@query("G02_open", "eroded px", """
SELECT DISTINCT p.image_id, p.y, p.x FROM px p JOIN eroded e ON e.image_id = p.image_id AND abs(e.y - p.y) <= 1 AND abs(e.x - p.x) <= 1""")
def opened(spark, d):
    return raster.opening(mask(spark, d, 60), within=fixtures.px(spark, d)).select("image_id", "y", "x")


CLOSED = """SELECT p.image_id, p.height, p.width, p.y, p.x FROM px p WHERE NOT EXISTS (
  SELECT 1 FROM (SELECT image_id, y, x FROM px ANTI JOIN {src}_d USING (image_id, y, x)) q
  WHERE q.image_id = p.image_id AND abs(q.y - p.y) <= 1 AND abs(q.x - p.x) <= 1)"""


@query("G02_close", "px close_d", "SELECT image_id, y, x FROM (" + CLOSED.format(src="close") + ")")
def closed(spark, d):
    return raster.closing(mask(spark, d, 70), within=fixtures.px(spark, d)).select("image_id", "y", "x")


def width_sql(source: str, lo: int, hi: int) -> str:
    return f"""SELECT DISTINCT t.image_id, (t.y + dy)::INTEGER AS y, (t.x + dx)::INTEGER AS x FROM (SELECT s.*, height, width FROM {source} s JOIN (
    SELECT DISTINCT image_id, height, width FROM px) USING (image_id)) t, range({lo}, {hi + 1}) a(dy), range({lo}, {hi + 1}) b(dx)
  WHERE t.y + dy BETWEEN 0 AND height - 1 AND t.x + dx BETWEEN 0 AND width - 1"""


for _w, _lo, _hi in ((1, 0, 0), (2, 0, 1), (3, -1, 1), (4, -1, 2), (7, -3, 3)):
    @query(f"G07_dilate_to_width_{_w}", "tskel px", width_sql("tskel", _lo, _hi))
    def to_width(spark, d, w=_w):
        return raster.dilate_to_width(thinning.skeletonize(fixtures.truth(spark, d)), w).select("image_id", "y", "x")


@query("G23_artifact_overlap", "px truth", """
SELECT image_id, max(pixels) > 0 AS present, max(pixels)::BIGINT AS pixels, count(*) FILTER (near) AS outline_pixels_on_outline,
  round(count(*) FILTER (near) / count(*)::DOUBLE, 6) AS share_of_outline FROM (
  SELECT t.image_id, (SELECT count(*) FROM px q WHERE q.image_id = t.image_id AND q.label = 3) AS pixels,
    EXISTS (SELECT 1 FROM px q WHERE q.image_id = t.image_id AND q.label = 3 AND abs(q.y - t.y) <= 1 AND abs(q.x - t.x) <= 1) AS near FROM truth t) GROUP BY 1""")
def artifact(spark, d):
    from gridmark.operators.profiles import artifact_overlap
    out = artifact_overlap(fixtures.px(spark, d).withColumn("hit", F.col("label") == 3), fixtures.truth(spark, d))
    return rounded(out.select("image_id", "present", "pixels", "outline_pixels_on_outline", "share_of_outline"), "share_of_outline")


@query("A17_artifact_rollup", "px truth", """
SELECT dataset, count(*) FILTER (pixels > 0) AS files_present, count(*) AS files_checked, round(min(s), 6) AS share_min, round(median(s), 6) AS share_median, round(max(s), 6) AS share_max FROM (
 SELECT dataset, image_id, max(pixels) AS pixels, count(*) FILTER (near) / count(*)::DOUBLE AS s FROM (
  SELECT t.image_id, 'd' || (t.image_id % 3) AS dataset, (SELECT count(*) FROM px q WHERE q.image_id = t.image_id AND q.label = 3) AS pixels,
    EXISTS (SELECT 1 FROM px q WHERE q.image_id = t.image_id AND q.label = 3 AND abs(q.y - t.y) <= 1 AND abs(q.x - t.x) <= 1) AS near FROM truth t) GROUP BY 1, 2) GROUP BY 1""")
def artifact_rollup(spark, d):
    from gridmark.operators.profiles import artifact_overlap
    from gridmark.operators.profiles import artifact_rollup as artifact_rollup_of
    out = artifact_overlap(fixtures.px(spark, d).withColumn("hit", F.col("label") == 3), fixtures.truth(spark, d))
    out = out.withColumn("dataset", F.concat(F.lit("d"), (F.col("image_id") % 3).cast("string")))
    return artifact_rollup_of(out, "dataset")


# ---- components ----
@query("W14_runs", "lab4_runs", "SELECT image_id, lab AS label, y, x0, x1 FROM lab4_runs")
def runs(spark, d):
    return components.runs(fixtures.px(spark, d), "label").select("image_id", "label", "y", "x0", "x1")


for _c, _v in ((4, "lab4"), (8, "lab8")):
    @query(f"G04_components_labels_{_c}", _v, f"""SELECT image_id, lab AS label, component, sum(x1 - x0 + 1)::BIGINT AS area FROM {_v} GROUP BY 1, 2, 3""")
    def cc_labels(spark, d, c=_c):
        return components.component_sizes(components.label_runs(fixtures.px(spark, d), c, "label"), "label")


@query("G04_components_mask_8", "m8_px", "SELECT image_id, y, x, component FROM m8_px")
def cc_mask(spark, d):
    return components.connected_components(mask(spark, d, 70), 8)


@query("G03_despeckle", "m8_px", """
SELECT image_id, y, x FROM m8_px JOIN (SELECT image_id, component FROM m8 GROUP BY 1, 2 HAVING sum(x1 - x0 + 1) >= 9) USING (image_id, component)""")
def despeckle(spark, d):
    return components.despeckle(mask(spark, d, 70), 3).select("image_id", "y", "x")


@query("A41_label_map_stats", "lab4 px", """
SELECT l.image_id, l.label, l.px, round(l.px / t.n::DOUBLE, 6) AS fraction, c.n_components, c.amin, c.amed, c.amax,
  l.label = t.maj AS is_majority, CASE WHEN l.label = t.maj THEN CASE WHEN c.n_components <= 1 THEN 'islands' ELSE 'tessellation' END END AS structure
FROM (SELECT image_id, label, count(*) AS px FROM px GROUP BY 1, 2) l
JOIN (SELECT image_id, sum(px)::BIGINT AS n, arg_max(label, px * 1000 - label) AS maj FROM (SELECT image_id, label, count(*) AS px FROM px GROUP BY 1, 2) GROUP BY 1) t USING (image_id)
JOIN (SELECT image_id, lab, count(*) AS n_components, min(a)::DOUBLE AS amin, median(a)::DOUBLE AS amed, max(a)::DOUBLE AS amax FROM (
  SELECT image_id, lab, component, sum(x1 - x0 + 1)::BIGINT AS a FROM lab4 GROUP BY 1, 2, 3) GROUP BY 1, 2) c ON c.image_id = l.image_id AND c.lab = l.label""")
def label_stats(spark, d):
    from gridmark.operators.profiles import label_map_stats
    return rounded(label_map_stats(fixtures.px(spark, d)), "fraction")


@query("G24_constant_border_region", "px lab4 lab4_px", """
WITH e AS (SELECT DISTINCT l.image_id, l.component FROM lab4_px l JOIN px p USING (image_id, y, x)
   WHERE p.y = 0 OR p.y = p.height - 1 OR p.x = 0 OR p.x = p.width - 1),
 ring AS (SELECT image_id, label FROM px WHERE y = 0 OR y = height - 1 OR x = 0 OR x = width - 1 GROUP BY 1, 2
   QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY count(*) DESC, label) <= 3)
SELECT image_id, lab AS "value", component, area FROM (SELECT image_id, lab, component, sum(x1 - x0 + 1)::BIGINT AS area FROM lab4 GROUP BY 1, 2, 3)
JOIN e USING (image_id, component) JOIN ring r USING (image_id) WHERE r.label = lab
QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY area DESC, component) = 1""".replace("\nWITH e AS", "\n, e AS"))
def border_region(spark, d):
    return regions.border_constant(fixtures.px(spark, d), "label")


# ---- thinning and distances ----
@query("G06_skeletonize_truth", "tskel", "SELECT image_id, y, x FROM tskel")
def skeleton_truth(spark, d):
    return thinning.skeletonize(fixtures.truth(spark, d)).select("image_id", "y", "x")


@query("G06_skeletonize_prediction", "pskel", "SELECT image_id, y, x FROM pskel")
def skeleton_pred(spark, d):
    return thinning.skeletonize(mask(spark, d, 60)).select("image_id", "y", "x")


def ends_sql(skel: str) -> str:
    return f"""SELECT a.image_id, a.y, a.x FROM {skel} a JOIN {skel} b ON b.image_id = a.image_id AND abs(b.y - a.y) <= 1 AND abs(b.x - a.x) <= 1
    GROUP BY 1, 2, 3 HAVING count(*) = 2"""


view("ends", ends_sql("pskel"), "pskel")


@query("G12_skeleton_endpoints", "ends px", """
SELECT e.image_id, count(*) AS n_endpoints, count(*) FILTER (e.y >= 2 AND e.y < height - 2 AND e.x >= 2 AND e.x < width - 2) AS n_interior
FROM ends e JOIN (SELECT DISTINCT image_id, height, width FROM px) USING (image_id) GROUP BY 1""")
def skeleton_ends(spark, d):
    ends = cut(raster.endpoints(thinning.skeletonize(mask(spark, d, 60))))
    inner = raster.interior(ends, 2).withColumn("i", F.lit(1))
    return (ends.join(inner.select("image_id", "y", "x", "i"), ["image_id", "y", "x"], "left").groupBy("image_id")
            .agg(F.count("*").alias("n_endpoints"), F.count("i").alias("n_interior")))


view("ground_d", """SELECT s.image_id, s.y, s.x, min((s.y - b.y) * (s.y - b.y) + (s.x - b.x) * (s.x - b.x))::BIGINT AS d2
FROM tskel s JOIN ground b ON b.image_id = s.image_id GROUP BY 1, 2, 3""", "tskel ground")


@query("G08_distance_at_skeleton", "ground_d", "SELECT * FROM ground_d")
def skeleton_distance(spark, d):
    p = fixtures.prob_px(spark, d)
    return distance.skeleton_widths(p, "true", thinning.skeletonize(p.filter(F.col("true"))))


@query("G08_line_width", "ground_d", "SELECT image_id, round(median(2 * sqrt(d2::DOUBLE)) - 1, 6) AS width_px, count(*) AS n_skeleton_px FROM ground_d GROUP BY 1")
def line_width(spark, d):
    p = fixtures.prob_px(spark, d)
    w = distance.line_width(distance.skeleton_widths(p, "true", thinning.skeletonize(p.filter(F.col("true")))))
    return rounded(w, "width_px")


view("endcounts", """SELECT e.image_id, 'd' || (e.image_id % 3) AS dataset, count(*) AS ends, (SELECT count(*) FROM pskel s WHERE s.image_id = e.image_id) AS skel
FROM ends e GROUP BY 1, 2""", "ends pskel")


@query("A32_endpoint_profile", "endcounts", """
SELECT dataset, count(*) AS tiles, round(avg(ends), 6) AS mean, round(median(ends), 6) AS median, round(quantile_cont(ends, 0.95), 6) AS p95, max(ends) AS max,
  round(count(*) FILTER (ends = 0) / count(*)::DOUBLE, 6) AS share_without, round(1000.0::DOUBLE * sum(ends) / sum(skel), 6) AS per_1000 FROM endcounts GROUP BY 1""")
def endpoint_profile(spark, d):
    from gridmark.operators.profiles import endpoint_profile as run
    skel = thinning.skeletonize(mask(spark, d, 60))
    dataset = F.concat(F.lit("d"), (F.col("image_id") % 3).cast("string"))
    per = (raster.endpoints(skel).groupBy("image_id").agg(F.count("*").alias("ends"))
           .join(skel.groupBy("image_id").agg(F.count("*").alias("skeleton_px")), "image_id").withColumn("dataset", dataset))
    return run(per)


# ---- regions ----
SUMMARY = "image_id, region, count(*) AS n, sum(y * 64 + x)::BIGINT AS place"


@query("G10_regions_from_outline", "treg", f"SELECT {SUMMARY} FROM treg GROUP BY 1, 2")
def regions_true(spark, d):
    return true_regions(spark, d).groupBy("image_id", "region").agg(F.count("*").alias("n"), F.sum(F.col("y") * 64 + F.col("x")).alias("place"))


@query("G10_regions_from_prediction", "preg", f"SELECT {SUMMARY} FROM preg GROUP BY 1, 2")
def regions_pred(spark, d):
    return pred_regions(spark, d).groupBy("image_id", "region").agg(F.count("*").alias("n"), F.sum(F.col("y") * 64 + F.col("x")).alias("place"))


view("conn", """SELECT f.image_id, f.region AS t, c.region AS p, count(*) AS n FROM preg f JOIN preg8 c USING (image_id, y, x) GROUP BY 1, 2, 3""", "preg preg8")


@query("G19_connectivity_difference", "conn", """
SELECT h.image_id, h.t AS region, h.area AS area_px, o.area AS old_region_area_px FROM (
  SELECT image_id, t, sum(n)::BIGINT AS area, arg_max(p, n::HUGEINT * 1000000000000000::HUGEINT - p) AS p FROM conn GROUP BY 1, 2) h
JOIN (SELECT image_id, p, sum(n)::BIGINT AS area FROM conn GROUP BY 1, 2) o ON o.image_id = h.image_id AND o.p = h.p WHERE o.area > h.area""")
def connectivity(spark, d):
    return regions.connectivity_difference(fixtures.px(spark, d).withColumn("outline", F.col("p100") >= 60))


view("areas", "SELECT image_id, 'd' || (image_id % 3) AS dataset, region, count(*) AS area FROM treg GROUP BY 1, 2, 3", "treg")


@query("A31_region_size_profile", "areas", """
SELECT dataset, n_regions, round(regions_mean, 6) AS regions_mean, round(regions_median, 6) AS regions_median, regions_min, regions_max, p5, p50, p95, below_25, round(below_25 / n_regions::DOUBLE, 6) AS below_25_fraction FROM (
  SELECT dataset, count(*) AS n_regions, quantile_cont(area, 0.05) AS p5, quantile_cont(area, 0.5) AS p50, quantile_cont(area, 0.95) AS p95, count(*) FILTER (area < 25) AS below_25 FROM areas GROUP BY 1)
JOIN (SELECT dataset, avg(c) AS regions_mean, median(c) AS regions_median, min(c) AS regions_min, max(c) AS regions_max FROM (SELECT dataset, image_id, count(*) AS c FROM areas GROUP BY 1, 2) GROUP BY 1) USING (dataset)""")
def size_profile(spark, d):
    from gridmark.operators.profiles import region_size_profile
    a = regions.region_areas(true_regions(spark, d)).withColumn("dataset", F.concat(F.lit("d"), (F.col("image_id") % 3).cast("string")))
    out = region_size_profile(cut(a))
    return rounded(out.select("dataset", "n_regions", "regions_mean", "regions_median", "regions_min", "regions_max", "p5", "p50", "p95",
                              "below_25", "below_25_fraction"), "regions_mean", "regions_median", "below_25_fraction")


# ---- absorbing small regions ----
view("little", "SELECT image_id, lab, component, sum(x1 - x0 + 1)::BIGINT AS area FROM lab8 GROUP BY 1, 2, 3", "lab8")
view("little_sides", """SELECT s.image_id, s.component AS c, s.lab AS own, o.component AS d, o.lab AS other, count(DISTINCT (o.y, o.x)) AS n FROM (
  SELECT p.image_id, p.lab, p.component, p.y + dy AS y, p.x + dx AS x FROM lab8_px p JOIN little l USING (image_id, component), (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) v(dy, dx) WHERE l.area < 100) s
  JOIN lab8_px o ON o.image_id = s.image_id AND o.y = s.y AND o.x = s.x WHERE o.component <> s.component GROUP BY 1, 2, 3, 4, 5""", "lab8_px little")
view("absorbed", """(image_id, step, moved) AS (SELECT DISTINCT image_id, -1::BIGINT, MAP {-1::BIGINT: -1::BIGINT} FROM lab8
  UNION ALL SELECT image_id, step + 1, map_concat(any_value(moved), map_from_entries(coalesce(list((c, lab)) FILTER (c IS NOT NULL), []))) FROM (
    SELECT image_id, step, any_value(moved) AS moved, c, arg_min(lab, lab - 1000 * n) AS lab FROM (
      SELECT a.image_id, a.step, any_value(a.moved) AS moved, s.c, coalesce(map_extract(a.moved, s.d)[1], s.other)::BIGINT AS lab, sum(s.n)::BIGINT AS n
      FROM absorbed a LEFT JOIN little_sides s ON s.image_id = a.image_id AND s.own = a.step + 1 WHERE a.step < (SELECT max(lab) FROM lab8) GROUP BY 1, 2, 4, 5)
    GROUP BY 1, 2, 4) GROUP BY 1, 2)""", "lab8 little_sides")
view("taken", "SELECT image_id, unnest(map_keys(moved)) AS component, unnest(map_values(moved)) AS lab FROM absorbed WHERE step = (SELECT max(step) FROM absorbed)", "absorbed")
view("merged100", "SELECT p.image_id, p.y, p.x, coalesce(t.lab, p.lab)::BIGINT AS label FROM lab8_px p LEFT JOIN taken t USING (image_id, component)", "lab8_px taken")


@query("G09_merge_small_regions", "merged100", "SELECT image_id, y, x, label FROM merged100")
def merge_small(spark, d):
    return regions.merge_small_regions(fixtures.px(spark, d), 100).select("image_id", "y", "x", F.col("label").cast("bigint").alias("label"))


def drawn(source: str) -> str:
    return f"""(SELECT a.image_id, count(DISTINCT (a.y, a.x)) AS px FROM {source} a, (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) v(dy, dx), {source} b
      WHERE b.image_id = a.image_id AND b.y = a.y + dy AND b.x = a.x + dx AND b.label <> a.label GROUP BY 1)"""


@query("A18_merge_rollup", "merged100 px little taken", f"""
SELECT dataset, count(*) AS n_files, sum(total)::BIGINT AS n_components_total_sum, sum(merged)::BIGINT AS n_components_merged_sum, sum(reassigned)::BIGINT AS n_pixels_reassigned_sum,
  round(min(f), 6) AS removed_min, round(median(f), 6) AS removed_median, round(max(f), 6) AS removed_max FROM (
  SELECT 'd' || (image_id % 3) AS dataset, s.*, coalesce((coalesce(b.px, 0) - coalesce(a.px, 0)) / nullif(coalesce(b.px, 0), 0)::DOUBLE, 0) AS f FROM (
    SELECT l.image_id, count(*) AS total, count(t.component) AS merged, coalesce(sum(l.area) FILTER (t.component IS NOT NULL), 0) AS reassigned
    FROM little l LEFT JOIN taken t USING (image_id, component) GROUP BY 1) s
  LEFT JOIN {drawn("px")} b USING (image_id) LEFT JOIN {drawn("merged100")} a USING (image_id)) GROUP BY 1""")
def merge_roll(spark, d):
    _, stats = regions.merge_with_statistics(fixtures.px(spark, d), 100)
    return regions.merge_rollup(stats.withColumn("dataset", F.concat(F.lit("d"), (F.col("image_id") % 3).cast("string"))), "dataset")


# ---- contingency scores on label blocks against probability bands ----
view("pairpx", "SELECT image_id, dataset, y, x, label::BIGINT AS t, (p100 // 20)::BIGINT AS p FROM px", "px")
view("cells", "SELECT image_id, dataset, t, p, count(*) AS n FROM pairpx GROUP BY ALL", "pairpx")
KEYS = ("image_id", "dataset")


def cells(spark, d):
    b = fixtures.px(spark, d).select(*KEYS, "y", "x", F.col("label").cast("bigint").alias("t"), F.expr("p100 div 20").alias("p"))
    return partition_scores.contingency(b, KEYS)


view("arivi", """
SELECT image_id, dataset, nt, np, CASE WHEN n < 2 THEN 1.0 WHEN 0.5 * (a + b) - a * b / (n * (n - 1) / 2) = 0 THEN CASE WHEN c = 0.5 * (a + b) THEN 1.0 ELSE 0.0 END
   ELSE (c - a * b / (n * (n - 1) / 2)) / (0.5 * (a + b) - a * b / (n * (n - 1) / 2)) END AS ari, ht + hp - 2 * (ht + hp - htp) AS vi
FROM (SELECT image_id, dataset, sum(n)::DOUBLE AS n, sum(n * (n - 1) / 2)::DOUBLE AS c, -sum((n / tot) * ln(n / tot)) AS htp FROM (SELECT *, sum(n) OVER (PARTITION BY image_id)::DOUBLE AS tot FROM cells) GROUP BY 1, 2)
JOIN (SELECT image_id, count(*) AS nt, sum(n * (n - 1) / 2)::DOUBLE AS a, -sum((n / tot) * ln(n / tot)) AS ht FROM (SELECT image_id, t, sum(n)::DOUBLE AS n, sum(sum(n)) OVER (PARTITION BY image_id)::DOUBLE AS tot FROM cells GROUP BY 1, 2) GROUP BY 1) USING (image_id)
JOIN (SELECT image_id, count(*) AS np, sum(n * (n - 1) / 2)::DOUBLE AS b, -sum((n / tot) * ln(n / tot)) AS hp FROM (SELECT image_id, p, sum(n)::DOUBLE AS n, sum(sum(n)) OVER (PARTITION BY image_id)::DOUBLE AS tot FROM cells GROUP BY 1, 2) GROUP BY 1) USING (image_id)""", "cells")


def pq_views(name: str, source: str) -> None:
    view(f"{name}_ov", f"""SELECT c.image_id, c.dataset, c.t, c.p, c.n, a.area AS at, b.area AS ap, c.n / (a.area + b.area - c.n)::DOUBLE AS iou, c.n / a.area::DOUBLE AS share
FROM {source} c JOIN (SELECT image_id, t, sum(n)::BIGINT AS area FROM {source} GROUP BY 1, 2) a ON a.image_id = c.image_id AND a.t = c.t
JOIN (SELECT image_id, p, sum(n)::BIGINT AS area FROM {source} GROUP BY 1, 2) b ON b.image_id = c.image_id AND b.p = c.p WHERE c.t <> 0 AND c.p <> 0""", source)
    view(name, f"""SELECT s.image_id, s.dataset, coalesce(m.tp, 0) AS tp, np - coalesce(m.tp, 0) AS fp, nt - coalesce(m.tp, 0) AS fn, coalesce(m.s, 0.0) AS s
FROM (SELECT image_id, dataset, count(DISTINCT t) FILTER (t <> 0) AS nt, count(DISTINCT p) FILTER (p <> 0) AS np FROM {source} GROUP BY 1, 2) s
LEFT JOIN (SELECT image_id, count(*) AS tp, sum(iou) AS s FROM {name}_ov WHERE iou > 0.5 GROUP BY 1) m USING (image_id)""", f"{source} {name}_ov")


PQ = """round(CASE WHEN tp + 0.5 * fp + 0.5 * fn > 0 THEN s / (tp + 0.5 * fp + 0.5 * fn) ELSE 1.0 END, 6) AS pq, round(CASE WHEN tp > 0 THEN s / tp ELSE 0 END, 6) AS sq,
 round(CASE WHEN tp + 0.5 * fp + 0.5 * fn > 0 THEN tp / (tp + 0.5 * fp + 0.5 * fn) ELSE 0 END, 6) AS rq, tp::BIGINT AS pq_tp, fp::BIGINT AS pq_fp, fn::BIGINT AS pq_fn"""
view("bcells", """SELECT image_id, dataset, t, CASE WHEN p >= 1 AND image_id % 2 = 0 THEN t + 100 ELSE p END AS p, sum(n)::BIGINT AS n FROM cells GROUP BY 1, 2, 3, 4""", "cells")
pq_views("pqb", "bcells")


def better_cells(spark, d):
    """Contingency in which even images agree with the truth away from the lowest band."""
    good = (F.col("p") >= 1) & (F.col("image_id") % 2 == 0)
    return (cells(spark, d).withColumn("p", F.when(good, F.col("t") + 100).otherwise(F.col("p")))
            .groupBy(*KEYS, "t", "p").agg(F.sum("n").alias("n")))


@query("A24_contingency", "cells", "SELECT image_id, t, p, n FROM cells")
def contingency(spark, d):
    return cells(spark, d).select("image_id", "t", "p", "n")


@query("A25_adjusted_rand_index", "arivi", "SELECT image_id, round(ari, 6) AS ari FROM arivi")
def ari(spark, d):
    return partition_scores.rand_and_information(cells(spark, d), KEYS).select("image_id", F.round("ari", 6).alias("ari"))


@query("A26_variation_of_information", "arivi", "SELECT image_id, round(vi, 6) AS vi FROM arivi")
def vi(spark, d):
    return partition_scores.rand_and_information(cells(spark, d), KEYS).select("image_id", F.round("vi", 6).alias("vi"))


@query("A27_panoptic_quality", "pqb", f"SELECT image_id, {PQ} FROM pqb")
def pq(spark, d):
    out = partition_scores.panoptic_quality(better_cells(spark, d), KEYS)
    return rounded(out.drop("dataset"), "pq", "sq", "rq")


view("tinycells", """SELECT image_id, dataset, CASE WHEN tiny THEN 0 ELSE t END AS t, CASE WHEN tiny THEN 0 ELSE p END AS p, sum(n)::BIGINT AS n FROM (
  SELECT c.*, c.t <> 0 AND a < 100 AS tiny FROM bcells c JOIN (SELECT image_id, t, sum(n) AS a FROM bcells GROUP BY 1, 2) USING (image_id, t)) GROUP BY 1, 2, 3, 4""", "bcells")
pq_views("pqt", "tinycells")


@query("A28_panoptic_quality_excluding_tiny", "pqt bcells", f"""SELECT image_id, {PQ}, x AS n_true_excluded FROM pqt JOIN (
  SELECT image_id, count(*) FILTER (t <> 0 AND a < 100) AS x FROM (SELECT image_id, t, sum(n) AS a FROM bcells GROUP BY 1, 2) GROUP BY 1) USING (image_id)""")
def pq_tiny(spark, d):
    out = partition_scores.panoptic_quality_excluding_tiny(better_cells(spark, d), 100, KEYS)
    return rounded(out.drop("dataset").withColumn("n_true_excluded", F.col("n_true_excluded").cast("bigint")), "pq", "sq", "rq")


view("fcells", "SELECT image_id, 'd' || (image_id % 3) AS dataset, t.region AS t, p.region AS p, count(*) AS n FROM treg t JOIN preg p USING (image_id, y, x) GROUP BY ALL", "treg preg")
pq_views("pqf", "fcells")
view("regionrow", f"""SELECT image_id, dataset, {PQ}, round(ari, 6) AS ari, round(vi, 6) AS vi, nt::BIGINT AS n_true_regions, np::BIGINT AS n_pred_regions, round(np / nt::DOUBLE, 6) AS over_segmentation_factor
FROM pqf JOIN (SELECT image_id, nt, np, ari, vi FROM arivif) USING (image_id)""", "pqf arivif")


def _arivi_on_real():
    from gridmark.workload.views import VIEWS
    view("arivif", VIEWS["arivi"][1].replace("FROM cells", "FROM fcells"), "fcells")


_arivi_on_real()


def real_cells(spark, d):
    t, p = true_regions(spark, d), pred_regions(spark, d)
    return partition_scores.contingency(partition_scores.overlay(t, p)).withColumn(
        "dataset", F.concat(F.lit("d"), (F.col("image_id") % 3).cast("string")))


@query("A29_region_row", "regionrow", "SELECT * FROM regionrow")
def region_row(spark, d):
    out = partition_scores.region_row(cut(real_cells(spark, d)), KEYS)
    return rounded(out, "pq", "sq", "rq", "ari", "vi", "over_segmentation_factor").withColumns(
        {c: F.col(c).cast("bigint") for c in ("n_true_regions", "n_pred_regions", "pq_tp", "pq_fp", "pq_fn")})


@query("A30_mean_of_rows", "pqb", f"""SELECT dataset, count(*) AS tiles, round(avg(pq), 5) AS pq, round(avg(sq), 5) AS sq, round(avg(rq), 5) AS rq, round(avg(pq_fn), 5) AS pq_fn FROM (
  SELECT dataset, {PQ} FROM pqb) GROUP BY 1""")
def mean_of_rows(spark, d):
    rows = rounded(partition_scores.panoptic_quality(better_cells(spark, d), KEYS), "pq", "sq", "rq")
    return rounded(partition_scores.mean_rows(rows, ("dataset",), ("pq", "sq", "rq", "pq_fn")), "pq", "sq", "rq", "pq_fn", places=5)


view("dom", """SELECT a.image_id, a.t, a.area, coalesce(best_iou, 0.0) AS best_iou, p, coalesce(share, 0.0) AS dominant_share FROM (SELECT image_id, t, sum(n)::BIGINT AS area FROM {c} WHERE t <> 0 GROUP BY 1, 2) a
LEFT JOIN (SELECT image_id, t, max(iou) AS best_iou, arg_max(p, n::HUGEINT * 1000000000000000::HUGEINT - p) AS p, max(share) AS share FROM {o}_ov GROUP BY 1, 2) b USING (image_id, t)""".format(c="fcells", o="pqf"), "fcells pqf_ov")
view("riv", """SELECT d.*, coalesce((SELECT count(*) FROM pqf_ov o WHERE o.image_id = d.image_id AND o.p = d.p AND o.share > 0.5 AND o.t <> d.t), 0) AS rivals FROM dom d""", "dom pqf_ov")


@query("W11_dominant_share", "riv", "SELECT image_id, t, area, round(best_iou, 6) AS best_iou, p, round(dominant_share, 6) AS dominant_share, rivals FROM riv")
def dominant(spark, d):
    out = partition_scores.dominant_share(cut(real_cells(spark, d)), KEYS)
    return rounded(out.drop("dataset"), "best_iou", "dominant_share")


view("fn", """SELECT *, 'd' || (image_id % 3) AS dataset, CASE WHEN area < 20 THEN 'TINY' ELSE nat END AS cls FROM (
  SELECT *, CASE WHEN dominant_share > 0.5 AND rivals > 0 THEN 'MERGED' WHEN dominant_share <= 0.5 THEN 'SPLIT' ELSE 'OTHER' END AS nat FROM riv WHERE best_iou <= 0.5)""", "riv")


@query("G21_classify_false_negatives", "fn", 'SELECT image_id, t, area, cls AS "class", nat AS "natural", round(best_iou, 6) AS best_iou FROM fn')
def classify(spark, d):
    out = attribution.classify(cut(real_cells(spark, d)), 20, KEYS)
    return out.select("image_id", "t", "area", "class", "natural", F.round("best_iou", 6).alias("best_iou"))


view("grp", "SELECT image_id, t, p FROM riv WHERE dominant_share > 0.5 AND rivals > 0", "riv")
view("gaps", """SELECT f.image_id, f.t, count(i.y) AS interface_px, count(i.y) FILTER (NOT cov) AS gap_px FROM fn f LEFT JOIN (
  SELECT b.image_id, b.y, b.x, g.t, EXISTS (SELECT 1 FROM px q WHERE q.image_id = b.image_id AND q.p100 >= 60 AND (q.y - b.y) * (q.y - b.y) + (q.x - b.x) * (q.x - b.x) <= 1) AS cov
  FROM truth b JOIN grp g ON g.image_id = b.image_id
  WHERE EXISTS (SELECT 1 FROM treg r WHERE r.image_id = b.image_id AND r.region = g.t AND abs(r.y - b.y) <= 1 AND abs(r.x - b.x) <= 1)
    AND EXISTS (SELECT 1 FROM treg r JOIN grp k ON k.image_id = r.image_id AND k.t = r.region AND k.p = g.p AND k.t <> g.t WHERE r.image_id = b.image_id AND abs(r.y - b.y) <= 1 AND abs(r.x - b.x) <= 1)) i
  ON i.image_id = f.image_id AND i.t = f.t WHERE f.cls = 'MERGED' GROUP BY 1, 2""", "fn grp truth treg px")


def _gaps(spark, d):
    px = cut(fixtures.prob_px(spark, d).select(*raster.frame(), "true", (F.col("p100") >= 60).alias("pred")))
    t = cut(regions.regions_from_outline(px, "true"))
    table = cut(partition_scores.contingency(partition_scores.overlay(t, regions.regions_from_outline(px, "pred"))))
    missed = cut(attribution.classify(table, 20))
    gaps = attribution.merge_gaps(missed, table, t, px.filter(F.col("true")), px.filter(F.col("pred")))
    return table, missed, gaps


@query("G21_merge_gaps", "gaps", "SELECT * FROM gaps")
def merge_gaps(spark, d):
    return _gaps(spark, d)[2]


@query("A36_attribution_summary", "fn gaps areas", """
SELECT s.dataset, tiles, n_true, n_fn, n_tiny, n_merged, n_split, n_other, round(n_fn / tiles::DOUBLE, 6) AS fn_per_tile, round(n_merged / n_fn::DOUBLE, 6) AS fraction_merged,
  gap::BIGINT AS gap, interface::BIGINT AS interface, round(gap / interface::DOUBLE, 6) AS gap_fraction, area_p50, gap_p50 AS gap_px_p50
FROM (SELECT dataset, count(DISTINCT image_id) AS tiles, count(*) AS n_true FROM areas GROUP BY 1) s
JOIN (SELECT f.dataset, count(*) AS n_fn, count(*) FILTER (cls = 'TINY') AS n_tiny, count(*) FILTER (cls = 'MERGED') AS n_merged, count(*) FILTER (cls = 'SPLIT') AS n_split, count(*) FILTER (cls = 'OTHER') AS n_other,
   sum(gap_px) AS gap, sum(interface_px) AS interface, quantile_cont(area, 0.5) AS area_p50, quantile_cont(gap_px, 0.5) AS gap_p50 FROM fn f LEFT JOIN gaps USING (image_id, t) GROUP BY 1) m USING (dataset)""")
def attribution_summary(spark, d):
    table, missed, gaps = _gaps(spark, d)
    ds = F.concat(F.lit("d"), (F.col("image_id") % 3).cast("string")).alias("dataset")
    areas = table.groupBy("image_id", "t").agg(F.sum("n").alias("n"))
    sizes = areas.select(ds, "image_id").groupBy("dataset", "image_id").agg(F.count("*").alias("r")).groupBy("dataset").agg(
        F.count("*").alias("tiles"), F.sum("r").alias("n_true"))
    out = attribution.summarise(missed.select("*", ds), gaps, sizes)
    return rounded(out.select("dataset", "tiles", "n_true", "n_fn", "n_tiny", "n_merged", "n_split", "n_other", "fn_per_tile", "fraction_merged",
                              "gap", "interface", "gap_fraction", "area_p50", "gap_px_p50"), "fn_per_tile", "fraction_merged", "gap_fraction")
