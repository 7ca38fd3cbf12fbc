"""Decomposition, losses, post-processing, sweeps, augmentation."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridmark.functions.scalars import safe_div
from gridmark.operators import (augment, components, decomposition, losses, palette, postprocess, profiles, raster, regions, selection,
                                sweepcounts, thinning, watershed)
from gridmark.plans import audit, evaluate, extract, sweep
from gridmark.session import cut
from gridmark.workload import fixtures
from gridmark.workload.q_regions import components_view, mask, pq_views, region_view, skeleton_view
from gridmark.workload.q_sweep import rounded
from gridmark.workload.registry import query
from gridmark.workload.views import VIEWS, ratio, view

IMG = ("image_id", "dataset")
RADII, DISTANCES = decomposition.RADII, decomposition.DISTANCES


def dataset_of(column: str = "image_id"):
    return F.concat(F.lit("d"), (F.col(column) % 3).cast("string"))


# ---- decomposition ----
def near_view(name: str, source: str, needs: str) -> None:
    view(name, f"""SELECT p.image_id, p.y, p.x, min(o.dy * o.dy + o.dx * o.dx) AS d2 FROM {source} s, disk5 o, px p
WHERE p.image_id = s.image_id AND p.y = s.y + o.dy AND p.x = s.x + o.dx GROUP BY 1, 2, 3""", f"{needs} disk5 px")


view("disk5", "SELECT dy, dx FROM range(-5, 6) a(dy), range(-5, 6) b(dx) WHERE dy * dy + dx * dx <= 25")
near_view("near_true", "truth", "truth")
near_view("near_tskel", "tskel", "tskel")


def decomposition_views(tag: str, source: str, skel: str) -> None:
    near_view(f"near_{tag}", source, source)
    near_view(f"near_{tag}_skel", skel, skel)
    parts = ["count(DISTINCT image_id) AS tiles", "count(*) FILTER (sp = 0 AND st = 0) AS skel_tp", "count(*) FILTER (sp = 0) AS skel_pred_px",
             "count(*) FILTER (st = 0) AS skel_true_px"]
    for r in RADII:
        parts += [f"count(*) FILTER (p <= {r * r} AND t <= {r * r}) AS dil_tp_{r}", f"count(*) FILTER (p <= {r * r}) AS dil_pred_{r}",
                  f"count(*) FILTER (t <= {r * r}) AS dil_true_{r}"]
    for n in DISTANCES:
        parts += [f"count(*) FILTER (p = 0 AND t <= {n * n}) AS pred_near_{n}", f"count(*) FILTER (t = 0 AND p <= {n * n}) AS true_near_{n}",
                  f"count(*) FILTER (sp = 0 AND st <= {n * n}) AS skel_pred_near_{n}", f"count(*) FILTER (st = 0 AND sp <= {n * n}) AS skel_true_near_{n}"]
    view(f"dec_{tag}", f"""SELECT dataset, {", ".join(parts)} FROM (SELECT px.image_id, px.dataset, a.d2 AS t, b.d2 AS p, c.d2 AS st, e.d2 AS sp FROM px
  LEFT JOIN near_true a USING (image_id, y, x) LEFT JOIN near_{tag} b USING (image_id, y, x) LEFT JOIN near_tskel c USING (image_id, y, x)
  LEFT JOIN near_{tag}_skel e USING (image_id, y, x)) GROUP BY 1""", f"px near_true near_{tag} near_tskel near_{tag}_skel")
    view(f"verdict_{tag}", f"""SELECT *, CASE WHEN found < 0.7 OR (real < 0.8 AND skeleton_dice < 0.25) THEN 'MISPLACED'
  WHEN real < 0.8 THEN CASE WHEN width_ratio >= 1.4 THEN 'OVER-DETECTION + THICKNESS' ELSE 'OVER-DETECTION' END
  WHEN width_ratio >= 1.4 THEN 'THICKNESS' WHEN skeleton_dice < 0.5 THEN 'OFFSET' ELSE 'GOOD' END AS "label" FROM (
 SELECT dataset, tiles, {ratio("2 * dil_tp_0", "dil_pred_0 + dil_true_0", 9)} AS pixel_dice, {ratio("2 * skel_tp", "skel_pred_px + skel_true_px", 9)} AS skeleton_dice,
  {ratio("skel_pred_near_2", "skel_pred_px", 9)} AS real, {ratio("skel_true_near_2", "skel_true_px", 9)} AS found, {ratio("2 * dil_tp_2", "dil_pred_2 + dil_true_2", 9)} AS dilated_dice_2,
  {ratio("(dil_pred_0 / skel_pred_px::DOUBLE)", "dil_true_0 / skel_true_px::DOUBLE", 9)} AS width_ratio, {ratio("skel_pred_px", "skel_true_px", 9)} AS curve_length_ratio FROM dec_{tag})""",
         f"dec_{tag}")


decomposition_views("p60", "pred60", "pskel")
COUNTS = ["tiles", "skel_tp", "skel_pred_px", "skel_true_px", *[f"dil_{a}_{r}" for r in RADII for a in ("tp", "pred", "true")],
          *[f"{a}_near_{n}" for n in DISTANCES for a in ("pred", "true", "skel_pred", "skel_true")]]
VERDICT = ["pixel_dice", "skeleton_dice", "real", "found", "dilated_dice_2", "width_ratio", "curve_length_ratio"]


def decomposed(spark, d):
    px = fixtures.prob_px(spark, d).withColumn("pred", F.col("p100") >= 60)
    px = cut(px.select(*raster.frame(IMG), "pred", "true"))
    return decomposition.decomposition_counts(decomposition.with_skeletons(px, IMG), ("dataset",), keys=IMG)


@query("A34_decomposition_counts", "dec_p60", f"SELECT dataset, {', '.join(COUNTS)} FROM dec_p60")
def decomposition_counts(spark, d):
    return decomposed(spark, d).select("dataset", *COUNTS)


@query("A35_decomposition_verdict", "verdict_p60", f"""SELECT dataset, {', '.join(f'round({c}, 6) AS {c}' for c in VERDICT)}, "label" FROM verdict_p60""")
def decomposition_verdict(spark, d):
    return rounded(decomposition.verdict(decomposed(spark, d)).select("dataset", *VERDICT, "label"), *VERDICT)


@query("J12_mask_overlap", "prob_px", """SELECT image_id, count(*) FILTER ("true" AND p100 >= 60) AS both, count(*) FILTER (p100 >= 60) AS pred, count(*) FILTER ("true") AS "true" FROM prob_px GROUP BY 1""")
def overlap(spark, d):
    p = mask(spark, d, 60).withColumn("p", F.lit(1))
    t = fixtures.truth(spark, d).withColumn("t", F.lit(1))
    j = p.select("image_id", "y", "x", "p").join(t.select("image_id", "y", "x", "t"), ["image_id", "y", "x"], "full_outer")
    return j.groupBy("image_id").agg(F.sum(F.coalesce(F.col("p") * F.col("t"), F.lit(0))).alias("both"), F.count("p").alias("pred"), F.count("t").alias("true"))


@query("A23_tile_scores", "prob_px", f"""SELECT image_id, {ratio("2 * tp", "p + t")} AS dice, {ratio("t", "n")} AS true_fraction, {ratio("p", "n")} AS pred_fraction FROM (
 SELECT image_id, count(*) FILTER ("true" AND p100 >= 60) AS tp, count(*) FILTER (p100 >= 60) AS p, count(*) FILTER ("true") AS t, count(*) AS n FROM prob_px GROUP BY 1)""")
def tile_scores(spark, d):
    px = fixtures.prob_px(spark, d).withColumn("pred", F.col("p100") >= 60)
    return rounded(sweepcounts.tile_scores(px).drop("dataset"), "dice", "true_fraction", "pred_fraction")


view("docscores", """SELECT doc_id, dataset, CASE WHEN a + b > 0 THEN 2.0::DOUBLE * least(a, b) / (a + b) ELSE 0.0::DOUBLE END AS dice FROM (
  SELECT doc_id, lang AS dataset, n_chars % 17 AS a, n_chars % 23 AS b FROM documents)""")


@query("W01_rank_tiles", "docscores", """
SELECT dataset, n AS n_tiles, place, doc_id AS tile_id, dice, doc_id AS row_index FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY dice, doc_id DESC) - 1 AS k, count(*) OVER (PARTITION BY dataset) AS n FROM docscores)
JOIN (VALUES ('best'), ('median'), ('worst'), ('worst2')) p(place) ON k = CASE place WHEN 'best' THEN n - 1 WHEN 'median' THEN n // 2 WHEN 'worst' THEN 0 ELSE least(1, n - 1) END""")
def rank_tiles(spark, d):
    t = fixtures.table(spark, d, "documents")
    a, b = F.col("n_chars") % 17, F.col("n_chars") % 23
    s = t.select(F.col("doc_id").alias("tile_id"), F.col("doc_id").alias("row_index"), F.col("lang").alias("dataset"), safe_div(2.0 * F.least(a, b), a + b).alias("dice"))
    return selection.rank_tiles(s)


# ---- losses ----
view("logits", """SELECT p.*, (p100 - 50) / 10.0::DOUBLE AS logit, CASE WHEN "true" THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS t FROM prob_px p""", "prob_px")


@query("A42_tile_losses", "logits", """
SELECT image_id, round(avg((1 - t) * logit + (1 + 6 * t) * (ln(1 + exp(-abs(logit))) + greatest(-logit, 0))), 6) AS bce,
  round(1 - (2 * sum(t / (1 + exp(-logit))) + 1) / (sum(1 / (1 + exp(-logit))) + sum(t) + 1), 6) AS dice_loss FROM logits GROUP BY 1""")
def tile_losses(spark, d):
    px = fixtures.prob_px(spark, d).withColumn("logit", (F.col("p100") - 50) / F.lit(10.0))
    return rounded(losses.tile_losses(px, F.lit(7.0)), "bce", "dice_loss")


@query("A44_batch_weighted_mean", "logits", """
SELECT dataset, round(sum(loss * n) / sum(n), 6) AS mean FROM (SELECT dataset, image_id, avg(ln(1 + exp(-abs(logit)))) AS loss, count(*) AS n FROM logits GROUP BY 1, 2) GROUP BY 1""")
def batch_mean(spark, d):
    px = fixtures.prob_px(spark, d).withColumn("logit", (F.col("p100") - 50) / F.lit(10.0))
    per = px.groupBy("dataset", "image_id").agg(F.avg(F.log1p(F.exp(-F.abs("logit")))).alias("loss"), F.count("*").alias("n"))
    return rounded(losses.weighted_mean(per, "loss", "n", ["dataset"]), "mean")


def _soft_views(name: str, source: str, steps: int) -> None:
    """x_k, erosion and opening of a value view, then the accumulated skeleton."""
    for i in range(steps + 1):
        x = source if i == 0 else f"{name}_e{i - 1}"
        view(f"{name}_e{i}", f"""SELECT p.image_id, p.y, p.x, min(q.v) AS v FROM {x} p JOIN {x} q ON q.image_id = p.image_id AND abs(q.y - p.y) + abs(q.x - p.x) <= 1
          AND q.y BETWEEN p.y - 1 AND p.y + 1 GROUP BY 1, 2, 3""", x)
        view(f"{name}_o{i}", f"""SELECT p.image_id, p.y, p.x, max(q.v) AS v FROM {name}_e{i} p, (SELECT unnest([-1, 0, 1]) AS dy) a, (SELECT unnest([-1, 0, 1]) AS dx) b, {name}_e{i} q
          WHERE q.image_id = p.image_id AND q.y = p.y + dy AND q.x = p.x + dx GROUP BY 1, 2, 3""", f"{name}_e{i}")
        prev = "" if i == 0 else f" JOIN {name}_k{i - 1} k USING (image_id, y, x)"
        expr = "greatest(x.v - o.v, 0)" if i == 0 else "k.v + greatest(greatest(x.v - o.v, 0) - k.v * greatest(x.v - o.v, 0), 0)"
        view(f"{name}_k{i}", f"SELECT x.image_id, x.y, x.x, {expr} AS v FROM {x} x JOIN {name}_o{i} o USING (image_id, y, x){prev}",
             f"{x} {name}_o{i}" + ("" if i == 0 else f" {name}_k{i - 1}"))


view("pv", "SELECT image_id, y, x, p100 / 100.0::DOUBLE AS v FROM px", "px")
view("tv", 'SELECT image_id, y, x, CASE WHEN "true" THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM prob_px', "prob_px")
_soft_views("sp", "pv", 3)
_soft_views("st", "tv", 3)
view("parts", """SELECT image_id, sum(p.v) AS pred_sum, sum(t.v) AS true_sum, sum(a.v) AS skel_pred_sum, sum(b.v) AS skel_true_sum, sum(a.v * t.v) AS spt, sum(b.v * p.v) AS stp
FROM pv p JOIN tv t USING (image_id, y, x) JOIN sp_k3 a USING (image_id, y, x) JOIN st_k3 b USING (image_id, y, x) GROUP BY 1""", "pv tv sp_k3 st_k3")


def _parts(spark, d):
    px = fixtures.prob_px(spark, d).withColumns({"p": F.col("p100") / F.lit(100.0), "t": F.col("true").cast("double")})
    return losses.cldice_parts(px, 3)


@query("G22_soft_skeleton", "sp_k3", "SELECT image_id, y, x, round(v, 6) AS skel FROM sp_k3")
def soft_skeleton(spark, d):
    px = fixtures.px(spark, d).withColumn("p", F.col("p100") / F.lit(100.0))
    return losses.soft_skeleton(px, ["p"], 3).select("image_id", "y", "x", F.round("skel_p", 6).alias("skel"))


@query("G22_focal_minmax", "px", """SELECT p.image_id, p.y, p.x, min(q.p100) FILTER (abs(q.y - p.y) + abs(q.x - p.x) <= 1) AS lo, max(q.p100) AS hi FROM px p,
 (SELECT unnest([-1, 0, 1]) AS dy) a, (SELECT unnest([-1, 0, 1]) AS dx) b, px q WHERE q.image_id = p.image_id AND q.y = p.y + dy AND q.x = p.x + dx GROUP BY 1, 2, 3""")
def focal_minmax(spark, d):
    px = fixtures.px(spark, d)
    plus = F.abs("dy") + F.abs("dx") <= 1
    return raster.focal(px, raster.SQUARE, [F.min(F.when(plus, F.col("p100"))).alias("lo"), F.max("p100").alias("hi")], ["p100"]).select("image_id", "y", "x", "lo", "hi")


@query("A42_cldice_parts", "parts", """
SELECT image_id, round(pred_sum, 4) AS pred_sum, round(skel_pred_sum, 4) AS skel_pred_sum, round(skel_true_sum, 4) AS skel_true_sum,
  round((spt + 1) / (skel_pred_sum + 1), 6) AS t_prec, round((stp + 1) / (skel_true_sum + 1), 6) AS t_rec FROM parts""")
def cldice(spark, d):
    out = _parts(spark, d)
    return rounded(rounded(out.select("image_id", "pred_sum", "skel_pred_sum", "skel_true_sum", "t_prec", "t_rec"), "t_prec", "t_rec"),
                   "pred_sum", "skel_pred_sum", "skel_true_sum", places=4)


@query("A43_invariance_checks", "parts", """
SELECT image_id, skel_pred_sum > 0.25 * skel_true_sum AS pred_skeleton_real, skel_true_sum > 0.25 * true_sum / 2 AS true_skeleton_real, spt > 0.8 * skel_pred_sum AS pred_skeleton_on_true,
  1 - 2 * tp * tr / (tp + tr + 1e-6) < 0.25 * 0.6 AS cldice_below_quarter_of_dice FROM (SELECT *, (spt + 1) / (skel_pred_sum + 1) AS tp, (stp + 1) / (skel_true_sum + 1) AS tr FROM parts)""")
def invariance(spark, d):
    return losses.invariance_checks(_parts(spark, d), F.lit(0.6), 2.0).select(
        "image_id", "pred_skeleton_real", "true_skeleton_real", "pred_skeleton_on_true", "cldice_below_quarter_of_dice")


@query("W12_z_score", "px", """SELECT image_id, y, x, round((p100 - avg(p100) OVER w) / CASE WHEN stddev_pop(p100) OVER w < 1e-6 THEN 1 ELSE stddev_pop(p100) OVER w END, 6) AS z FROM px WINDOW w AS (PARTITION BY image_id)""")
def z_score(spark, d):
    return losses.z_score(fixtures.px(spark, d), "p100").select("image_id", "y", "x", F.round("z", 6).alias("z"))


# ---- augmentation ----
COIN = "CAST(concat('0x', substr(md5('5|' || image_id || '|{op}'), 1, 8)) AS BIGINT) < 2147483648"


@query("P20_geometric_augmentation", "px", f"""
SELECT image_id, CASE WHEN t THEN width - 1 - x1 ELSE y1 END AS y, CASE WHEN t THEN y1 ELSE x1 END AS x, CASE WHEN t THEN width ELSE height END AS height, p100 FROM (
 SELECT *, CASE WHEN {COIN.format(op="hflip")} THEN width - 1 - x ELSE x END AS x1, CASE WHEN {COIN.format(op="vflip")} THEN height - 1 - y ELSE y END AS y1, {COIN.format(op="rot90")} AS t FROM px)""")
def geometric(spark, d):
    return augment.geometric(fixtures.px(spark, d), 5).select("image_id", "y", "x", "height", "p100")


def _drawn(*parts: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('|', 5, {', '.join(parts)})), 1, 8) AS BIGINT)"


def _coin(operation: str) -> str:
    return f"{_drawn('image_id', repr(operation))} < 2147483648"


def _amount(operation: str, span: str, *place: str) -> str:
    tile = "concat_ws('/', " + ", ".join(("image_id", *place)) + ")" if place else "image_id"
    return f"(-{span}::DOUBLE + (2 * {span}::DOUBLE) * {_drawn(tile, repr(operation))} / 4294967296.0::DOUBLE)"


@query("P21_photometric_augmentation", "px", f"""
SELECT * FROM (WITH c AS (SELECT *, CASE WHEN {_coin("contrast")} THEN (p100 - 127.5::DOUBLE) * (1 + {_amount("c", "0.2")}) + 127.5::DOUBLE ELSE p100::DOUBLE END AS v FROM px),
b AS (SELECT * REPLACE (least(greatest(CASE WHEN {_coin("brightness")} THEN v + 255 * {_amount("b", "0.2")} ELSE v END, 0), 255) AS v) FROM c),
g AS (SELECT * REPLACE (CASE WHEN {_coin("gamma")} THEN 255 * pow(v / 255, 1 + {_amount("g", "0.2")}) ELSE v END AS v) FROM b),
n AS (SELECT * REPLACE (CASE WHEN {_coin("noise")} THEN v + {_amount("n", "4.0", "y", "x")} ELSE v END AS v) FROM g)
SELECT image_id, y, x, CAST(least(greatest(round(v), 0), 255) AS INTEGER) AS p100 FROM n)""")
def photometric(spark, d):
    return augment.photometric(fixtures.px(spark, d), "p100", 5).select("image_id", "y", "x", "p100")


# ---- shapes of classes ----
@query("A38_class_shape_profile", "px ground_d m8x", """
SELECT b.dataset, class_px, round(class_px / n::DOUBLE, 6) AS pixel_share, round(p50, 6) AS width_p50, round(p95, 6) AS width_p95, round(thin, 6) AS share_thin, n_skel AS n_skeleton_px,
  n_components, round(largest / class_px::DOUBLE, 6) AS largest_cc_share, round(mi, 6) AS mean_inside, round(mo, 6) AS mean_outside
FROM (SELECT dataset, count(*) AS n, count(*) FILTER ("true") AS class_px, avg(p100) FILTER ("true") AS mi, avg(p100) FILTER (NOT "true") AS mo FROM prob_px GROUP BY 1) b
JOIN (SELECT 'd' || (image_id % 3) AS dataset, quantile_cont(2 * sqrt(d2::DOUBLE), 0.5) AS p50, quantile_cont(2 * sqrt(d2::DOUBLE), 0.95) AS p95, count(*) FILTER (2 * sqrt(d2::DOUBLE) < 3) / count(*)::DOUBLE AS thin, count(*) AS n_skel FROM ground_d GROUP BY 1) w USING (dataset)
JOIN (SELECT dataset, sum(big)::BIGINT AS largest, sum(c)::BIGINT AS n_components FROM (SELECT image_id, 'd' || (image_id % 3) AS dataset, max(a) AS big, count(*) AS c FROM (
   SELECT image_id, component, sum(x1 - x0 + 1) AS a FROM m8x GROUP BY 1, 2) GROUP BY 1, 2) GROUP BY 1) c USING (dataset)""")
def class_shape(spark, d):
    px = fixtures.prob_px(spark, d)
    out = profiles.class_shape_profile(px, "true", ("dataset",), 3.0, "p100")
    return rounded(out, "pixel_share", "width_p50", "width_p95", "share_thin", "largest_cc_share", "mean_inside", "mean_outside")


components_view("m8x", "truth", 8, "truth")
components_view("dk30", "(SELECT image_id, 30 AS c, y, x FROM px WHERE p100 < 30)", 8, "px")


# every image once per cut, as an image of its own
view("cuts", "SELECT px.image_id * 1000 + c AS image_id, dataset, c, y, x, p100, p100 < c AS dark FROM px, (VALUES (40), (50)) t(c)", "px")
view("dk", "SELECT image_id, y, x FROM cuts WHERE dark", "cuts")
skeleton_view("dksk", "dk", "dk", steps=32)
components_view("dkc", "dk", 8, "dk")
view("dk_d", """SELECT s.image_id, s.y, s.x, min((s.y - b.y) * (s.y - b.y) + (s.x - b.x) * (s.x - b.x))::BIGINT AS d2
FROM dksk s JOIN (SELECT * FROM cuts WHERE NOT dark) b ON b.image_id = s.image_id GROUP BY 1, 2, 3""", "dksk cuts")


@query("A39_threshold_sensitivity", "cuts dk_d dkc", """
SELECT b.dataset, b.c AS cut, class_px, round(class_px / n::DOUBLE, 6) AS pixel_share, round(p50, 6) AS width_p50, round(p95, 6) AS width_p95, round(thin, 6) AS share_thin,
  n_skel AS n_skeleton_px, n_components, round(largest / class_px::DOUBLE, 6) AS largest_cc_share, round(mi, 6) AS mean_inside, round(mo, 6) AS mean_outside,
  round(skeleton_mean, 6) AS skeleton_mean, round(skeleton_median, 6) AS skeleton_median
FROM (SELECT dataset, c, count(*) AS n, count(*) FILTER (dark) AS class_px, avg(p100) FILTER (dark) AS mi, avg(p100) FILTER (NOT dark) AS mo FROM cuts GROUP BY 1, 2) b
JOIN (SELECT 'd' || (image_id // 1000 % 3) AS dataset, image_id % 1000 AS c, quantile_cont(2 * sqrt(d2::DOUBLE), 0.5) AS p50, quantile_cont(2 * sqrt(d2::DOUBLE), 0.95) AS p95,
  count(*) FILTER (2 * sqrt(d2::DOUBLE) < 8) / count(*)::DOUBLE AS thin, count(*) AS n_skel FROM dk_d GROUP BY 1, 2) w USING (dataset, c)
JOIN (SELECT dataset, c, sum(big)::BIGINT AS largest, sum(k)::BIGINT AS n_components FROM (SELECT image_id, 'd' || (image_id // 1000 % 3) AS dataset, image_id % 1000 AS c, max(a) AS big, count(*) AS k
  FROM (SELECT image_id, component, sum(x1 - x0 + 1) AS a FROM dkc GROUP BY 1, 2) GROUP BY 1) GROUP BY 1, 2) p USING (dataset, c)
JOIN (SELECT dataset, c, avg(n) AS skeleton_mean, median(n) AS skeleton_median FROM (SELECT i.image_id, i.dataset, i.c, count(s.y) AS n
  FROM (SELECT DISTINCT image_id, dataset, c FROM cuts) i LEFT JOIN dk_d s USING (image_id) GROUP BY 1, 2, 3) GROUP BY 1, 2) l USING (dataset, c)""")
def threshold_sensitivity(spark, d):
    out = profiles.threshold_sensitivity(fixtures.px(spark, d), "p100", (40, 50))
    return rounded(out, "pixel_share", "width_p50", "width_p95", "share_thin", "largest_cc_share", "mean_inside", "mean_outside", "skeleton_mean", "skeleton_median")


# ---- audit of colours ----
view("tested", """SELECT m.image_id, m.dataset, m.rgb, m.image_id::BIGINT * 16777216 + m.rgb AS g, y, x FROM mask_px m JOIN (
  SELECT image_id, rgb FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, rgb) AS k FROM cc) WHERE k > 1 AND n >= 64) USING (image_id, rgb)""", "mask_px cc")
skeleton_view("csk", "tested", "tested", "g", 32)
VIEWS["tested_cc_src"] = ("tested", "SELECT g AS image_id, y, x FROM tested")
components_view("tcc", "tested_cc_src", 8, "tested_cc_src")
view("geometry", """SELECT b.image_id, b.dataset, b.rgb, b.px AS pixels, b.px / area AS fraction, coalesce(s.n, 0) AS skeleton_pixels, CASE WHEN s.n > 0 THEN b.px / s.n::DOUBLE END AS mean_thickness_px,
  c.n AS n_components, bbox / area AS span, coalesce(s.n, 0) / side::DOUBLE AS skeleton_spans FROM (
 SELECT t.image_id, t.dataset, rgb, g, count(*) AS px, (max(t.y) - min(t.y) + 1) * (max(t.x) - min(t.x) + 1) AS bbox, any_value(height * width)::DOUBLE AS area, any_value(greatest(height, width)) AS side
 FROM tested t JOIN (SELECT DISTINCT image_id, height, width FROM px) USING (image_id) GROUP BY 1, 2, 3, 4) b
LEFT JOIN (SELECT g, count(*) AS n FROM csk GROUP BY 1) s USING (g) JOIN (SELECT image_id AS g, count(DISTINCT component) AS n FROM tcc GROUP BY 1) c USING (g)""", "tested px csk tcc")
view("linetests", "SELECT *, coalesce(mean_thickness_px <= 4, false) AS thin, span >= 0.5 AS spanning, skeleton_spans >= 2 AS extensive FROM geometry", "geometry")
view("votes", """SELECT dataset, rgb, count(*) AS files_present, count(*) FILTER (thin AND spanning AND extensive) AS files_qualifying, count(*) FILTER (NOT thin) AS failed_thin,
  count(*) FILTER (NOT spanning) AS failed_spanning, median(mean_thickness_px) AS thick FROM linetests GROUP BY 1, 2""", "linetests")


def _tests(spark, d):
    return audit.colour_tests(cut(fixtures.mask_px(spark, d)))


@query("G20_colour_line_likeness", "linetests", """
SELECT image_id, rgb, pixels, skeleton_pixels, round(mean_thickness_px, 6) AS mean_thickness_px, n_components, round(span, 6) AS span, round(skeleton_spans, 6) AS skeleton_spans,
  thin AND spanning AND extensive AS qualifies FROM linetests""")
def line_likeness(spark, d):
    out = _tests(spark, d)
    return rounded(out.select("image_id", "rgb", "pixels", "skeleton_pixels", "mean_thickness_px", "n_components", "span", "skeleton_spans", "qualifies"),
                   "mean_thickness_px", "span", "skeleton_spans")


@query("A04_colour_vote_tally", "votes", "SELECT dataset, rgb, files_present, files_qualifying, failed_thin, failed_spanning, round(thick, 6) AS thickness FROM votes")
def vote_tally(spark, d):
    out = palette.tally_colours(_tests(spark, d))
    return out.select("dataset", "rgb", "files_present", "files_qualifying", "failed_thin", "failed_spanning", F.round("mean_thickness_px_median", 6).alias("thickness"))


@query("A07_mode_verdict", "votes px", """
SELECT n.dataset, n_files, CASE WHEN q >= 0.6 * n_files THEN 'A' ELSE 'B' END AS mode, rgb, q AS files_qualifying FROM (SELECT dataset, count(DISTINCT image_id) AS n_files FROM px GROUP BY 1) n
JOIN (SELECT dataset, rgb, files_qualifying AS q FROM votes QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY files_qualifying DESC, coalesce(thick, 1e9), rgb) = 1) v USING (dataset)""")
def mode_verdict(spark, d):
    px = cut(fixtures.mask_px(spark, d))
    files = px.filter("y = 0 and x = 0").groupBy("dataset").agg(F.count("*").alias("n_files"))
    return palette.mode_verdict(palette.tally_colours(audit.colour_tests(px)), files)


@query("A40_window_of_audit", "votes px", """
WITH n AS (SELECT dataset, count(DISTINCT image_id) AS n_files, min(label) AS low FROM px GROUP BY 1),
c AS (SELECT n.dataset, CASE WHEN q >= 0.6 * n_files THEN rgb ELSE (low * 25) * 65536 + (250 - low * 25) * 256 + 100 END AS rgb FROM n
  JOIN (SELECT dataset, rgb, files_qualifying AS q FROM votes QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY files_qualifying DESC, coalesce(thick, 1e9), rgb) = 1) v USING (dataset))
SELECT c.dataset, count(*) AS n, greatest(c.rgb >> 16, (c.rgb >> 8) & 255, c.rgb & 255)::DOUBLE AS v_lo FROM c JOIN px p ON p.dataset = c.dataset
  AND (p.label * 25) * 65536 + (250 - p.label * 25) * 256 + CASE WHEN p.p100 >= 90 THEN 108 ELSE 100 END = c.rgb GROUP BY 1, c.rgb""".replace("WITH n AS", ", n AS"))
def window_of_audit(spark, d):
    """The window of the audit's outline colour; where none passed, of the plain colour of the dataset's lowest label."""
    px = cut(fixtures.mask_px(spark, d))
    files = px.filter("y = 0 and x = 0").groupBy("dataset").agg(F.count("*").alias("n_files"))
    verdict = palette.mode_verdict(palette.tally_colours(audit.colour_tests(px)), files)
    low = F.min("label")
    plain = px.groupBy("dataset").agg((low * 25 * 65536 + (250 - low * 25) * 256 + 100).cast("int").alias("rgb"))
    w = palette.outline_window(px, verdict, plain)
    return w.select("dataset", F.col("n_pixels").alias("n"), F.get("lower", F.lit(2)).alias("v_lo"))


@query("F10_audit", "votes px cc", """
SELECT n.dataset, n_files, CASE WHEN q >= 0.6 * n_files THEN 'A' ELSE 'B' END AS mode, rgb, q AS files_qualifying, u.n AS quantized_files, u.lo AS colours_min, u.hi AS colours_max
FROM (SELECT dataset, count(DISTINCT image_id) AS n_files FROM px GROUP BY 1) n
JOIN (SELECT dataset, rgb, files_qualifying AS q FROM votes QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY files_qualifying DESC, coalesce(thick, 1e9), rgb) = 1) v USING (dataset)
JOIN (SELECT dataset, count(*) FILTER (k <= 32) AS n, min(k) AS lo, max(k) AS hi FROM (SELECT dataset, image_id, count(*) AS k FROM cc GROUP BY 1, 2) GROUP BY 1) u USING (dataset)""")
def run_audit(spark, d):
    return audit.audit(fixtures.mask_px(spark, d), None)


# ---- label maps to outlines ----
view("zero", "SELECT image_id, height, width, y, x FROM px WHERE label = 3", "px")
components_view("z8", "zero", 8, "zero")
view("zpx", "SELECT image_id, y, x, component, image_id * 4294967296000 + component AS g FROM z8_px", "z8_px")
skeleton_view("zsk", "zpx", "zpx", "g", 40)
view("zwidth", """SELECT s.g, median(2 * sqrt(d2::DOUBLE)) - 1 AS w FROM (SELECT s.g, s.y, s.x, min((s.y - b.y) * (s.y - b.y) + (s.x - b.x) * (s.x - b.x)) AS d2
  FROM zsk s JOIN (SELECT DISTINCT g, image_id, component FROM zpx) k USING (g) JOIN px b ON b.image_id = k.image_id AND NOT EXISTS (SELECT 1 FROM zpx z WHERE z.g = s.g AND z.y = b.y AND z.x = b.x) GROUP BY 1, 2, 3) s GROUP BY 1""", "zsk zpx px")
view("kinds", "SELECT DISTINCT z.image_id, z.component, z.g, w.w, CASE WHEN w.w <= 7 THEN 'line' ELSE 'blob' END AS kind FROM zpx z LEFT JOIN zwidth w USING (g)", "zpx zwidth")


@query("G15_line_blob_split", "kinds", "SELECT image_id, component, round(w, 6) AS width_px, kind FROM kinds")
def line_blob(spark, d):
    hit = fixtures.px(spark, d).filter("label = 3")
    return rounded(regions.split_lines_and_blobs(hit, 7.0), "width_px")


@query("G16_line_class_outline", "kinds zpx px", """
WITH b AS (SELECT p.image_id, p.y, p.x, k.kind, coalesce(k.kind = 'blob', false) AS blob FROM px p LEFT JOIN (SELECT z.image_id, z.y, z.x, kind FROM zpx z JOIN kinds USING (g)) k USING (image_id, y, x))
SELECT image_id, y, x FROM b WHERE kind = 'line' UNION
SELECT DISTINCT p.image_id, p.y, p.x FROM b p JOIN b q ON q.image_id = p.image_id AND abs(q.y - p.y) + abs(q.x - p.x) = 1 AND q.y BETWEEN p.y - 1 AND p.y + 1 WHERE p.blob <> q.blob""".replace("\nWITH b AS", "\n, b AS"))
def line_class(spark, d):
    px = cut(fixtures.px(spark, d).select("image_id", "dataset", "height", "width", "y", "x", "label"))
    lines = px.select("dataset").distinct().withColumn("line_label", F.lit(3))
    return regions.line_class_outline(px, lines, 7.0).select("image_id", "y", "x")


@query("G16_line_class_index", "palette", """SELECT dataset, arg_min(idx, ((rgb >> 16) + ((rgb >> 8) & 255) + (rgb & 255)) * 1000 + idx) AS line_label FROM palette GROUP BY 1""")
def line_index(spark, d):
    from gridmark.workload.q_audit import _palette
    return regions.line_class(_palette(spark, d))


# cleaning: despeckle 3 -> close -> thin -> width 2 on the prediction at 0.70
def clean_views(tag: str, parts: str) -> None:
    """Views ``{tag}_open``, ``_close``, ``_skel`` and ``_out`` from the components view ``parts`` of the raw mask."""
    near = "CROSS JOIN (SELECT unnest([-1, 0, 1]) AS dy) a CROSS JOIN (SELECT unnest([-1, 0, 1]) AS dx) b"
    view(f"{tag}_open", f"SELECT image_id, y, x FROM {parts}_px JOIN (SELECT image_id, component FROM {parts} GROUP BY 1, 2 HAVING sum(x1 - x0 + 1) >= 9) USING (image_id, component)",
         f"{parts} {parts}_px")
    view(f"{tag}_dil", f"""SELECT DISTINCT p.image_id, p.y, p.x FROM {tag}_open s {near} JOIN px p ON p.image_id = s.image_id AND p.y = s.y + dy AND p.x = s.x + dx""", f"{tag}_open px")
    view(f"{tag}_close", f"""SELECT p.image_id, p.y, p.x FROM px p {near} LEFT JOIN {tag}_dil c ON c.image_id = p.image_id AND c.y = p.y + dy AND c.x = p.x + dx
WHERE p.y + dy BETWEEN 0 AND p.height - 1 AND p.x + dx BETWEEN 0 AND p.width - 1 GROUP BY 1, 2, 3 HAVING count(*) = count(c.y)""", f"px {tag}_dil")
    skeleton_view(f"{tag}_skel", f"{tag}_close", f"{tag}_close")
    view(f"{tag}_out", f"""SELECT DISTINCT p.image_id, p.y, p.x FROM {tag}_skel s CROSS JOIN (SELECT unnest([0, 1]) AS dy) a CROSS JOIN (SELECT unnest([0, 1]) AS dx) b JOIN px p
ON p.image_id = s.image_id AND p.y = s.y + dy AND p.x = s.x + dx""", f"{tag}_skel px")


def stage_shares(tag: str, raw: str) -> str:
    return ", ".join(f"round((SELECT count(*) FROM {v} s WHERE s.image_id = i.image_id) / (i.height * i.width)::DOUBLE, 6) AS {n}" for n, v in (
        ("raw", raw), ("open", f"{tag}_open"), ("close", f"{tag}_close"), ("skeleton", f"{tag}_skel"), ("outline", f"{tag}_out")))


clean_views("c", "m8")


@query("G17_clean_outline_stages", "pred70 c_open c_close c_skel c_out px", f"""
SELECT i.image_id, {stage_shares("c", "pred70")} FROM (SELECT DISTINCT image_id, height, width FROM px) i""")
def clean(spark, d):
    stages = extract.clean_outline(mask(spark, d, 70), 2)
    images = fixtures.px(spark, d).filter("y = 0 and x = 0").select("image_id", "height", "width")
    return rounded(extract.stage_fractions(stages, images), *stages)


# extraction: images judged on their snapped colours, the outline of the accepted ones cleaned
view("judged", """SELECT image_id, any_value(unsnapped) AS unsnapped, CASE WHEN any_value(unsnapped) > 0.02 THEN 'unsnapped pixels' WHEN min(label2) = max(label2) THEN 'single label' END AS reason
FROM snapped JOIN (SELECT image_id, count(*) FILTER (d2 * 4 > gap) / count(*)::DOUBLE AS unsnapped FROM snapped LEFT JOIN (
  SELECT p.dataset, min(power((p.rgb >> 16) - (m.rgb >> 16), 2) + power(((p.rgb >> 8) & 255) - ((m.rgb >> 8) & 255), 2) + power((p.rgb & 255) - (m.rgb & 255), 2)) AS gap
  FROM palette p JOIN palette m ON m.dataset = p.dataset AND m.idx <> p.idx GROUP BY 1) USING (dataset) GROUP BY 1) USING (image_id) GROUP BY 1""", "snapped palette")
view("e_raw", """SELECT image_id, height, width, y, x FROM (
  SELECT *, lag(label2) OVER h AS l, lead(label2) OVER h AS r, lag(label2) OVER v AS u, lead(label2) OVER v AS d
  FROM snapped WHERE image_id IN (SELECT image_id FROM judged WHERE reason IS NULL)
  WINDOW h AS (PARTITION BY image_id, y ORDER BY x), v AS (PARTITION BY image_id, x ORDER BY y))
WHERE l <> label2 OR r <> label2 OR u <> label2 OR d <> label2""", "snapped judged")
components_view("e8", "e_raw", 8, "e_raw")
clean_views("e", "e8")


@query("G18_extract_status", "judged e_raw e_open e_close e_skel e_out px", f"""
SELECT image_id, round(unsnapped, 6) AS unsnapped, coalesce(reason, CASE WHEN outline = 0 THEN 'cleaned outline is empty' END) AS reason, raw, open, close, skeleton, outline,
  CASE WHEN reason IS NULL AND outline <> 0 THEN 'ok' ELSE 'rejected' END AS status
FROM judged JOIN (SELECT i.image_id, {stage_shares("e", "e_raw")} FROM (SELECT DISTINCT image_id, height, width FROM px) i) USING (image_id)""")
def extract_status(spark, d):
    status, _ = extract.extract(fixtures.mask_px(spark, d), 2)
    return rounded(status.drop("dataset"), "unsnapped", "raw", "open", "close", "skeleton", "outline")


@query("G18_extract_dataset", "judged e_raw e_out e_open e_close e_skel px", f"""
SELECT i.image_id, dataset, CASE WHEN i.image_id % 7 = 5 THEN 'rejected' ELSE 'equal' END AS size_status, reason, CASE WHEN reason IS NULL THEN 'ok' ELSE 'rejected' END AS status,
  CASE WHEN reason IS NULL THEN outline END AS outline, CASE WHEN reason IS NULL THEN pixels END AS artifact_pixels, CASE WHEN reason IS NULL THEN share END AS artifact_share
FROM (SELECT i.*, CASE WHEN i.image_id % 7 = 3 THEN 'excluded' WHEN i.image_id % 7 = 5 THEN format('sizes differ: mask {{}} x {{}}, image {{}} x {{}}, apart by 9 x 0 where 2 is allowed', width, height, width + 9, height)
             ELSE coalesce(j.reason, CASE WHEN outline = 0 THEN 'cleaned outline is empty' END) END AS reason, s.outline
      FROM (SELECT DISTINCT image_id, dataset, height, width FROM px) i JOIN judged j USING (image_id)
      JOIN (SELECT i.image_id, {stage_shares("e", "e_raw")} FROM (SELECT DISTINCT image_id, height, width FROM px) i) s USING (image_id)) i
LEFT JOIN (SELECT image_id, count(*) FILTER (label = 3) AS pixels FROM px GROUP BY 1) a USING (image_id)
LEFT JOIN (SELECT image_id, round(count(*) FILTER (near) / count(*)::DOUBLE, 6) AS share FROM (SELECT e.image_id, EXISTS (
  SELECT 1 FROM px q WHERE q.image_id = e.image_id AND q.label = 3 AND abs(q.y - e.y) <= 1 AND abs(q.x - e.x) <= 1) AS near FROM e_out e) GROUP BY 1) b USING (image_id)""")
def extract_dataset(spark, d):
    mask = cut(fixtures.mask_px(spark, d))
    sizes = mask.filter("y = 0 and x = 0").select("image_id", "dataset", F.col("width").alias("mask_width"), F.col("height").alias("mask_height"),
                                                  (F.col("width") + F.when(F.col("image_id") % 7 == 5, 9).otherwise(0)).alias("image_width"), F.col("height").alias("image_height"))
    peaks = palette.derive_palette(palette.pooled_shares(palette.colour_counts(mask, IMG)), 0.002, 48.0)
    excluded = sizes.filter("image_id % 7 = 3").select(*IMG)
    status, _ = extract.extract_dataset(sizes, mask, excluded=excluded, artifact=F.col("label") == 3, peaks=peaks)
    return rounded(status.select(*IMG, "size_status", "reason", "status", "outline", "artifact_pixels", "artifact_share"), "outline", "artifact_share")


# ---- post-processing ----
view("redilated", """SELECT DISTINCT p.image_id, p.height, p.width, p.y, p.x FROM pskel s CROSS JOIN (SELECT unnest([0, 1]) AS dy) a CROSS JOIN (SELECT unnest([0, 1]) AS dx) b JOIN px p
ON p.image_id = s.image_id AND p.y = s.y + dy AND p.x = s.x + dx""", "pskel px")


@query("G14_skeleton_redilate", "redilated", "SELECT image_id, y, x FROM redilated")
def redilate(spark, d):
    return postprocess.postprocess(mask(spark, d, 60), "skeleton_redilate", 2, within=fixtures.px(spark, d)).select("image_id", "y", "x")


view("fat", """SELECT DISTINCT p.image_id, p.y, p.x FROM pred80 s CROSS JOIN (SELECT unnest([-1, 0, 1]) AS dy) a CROSS JOIN (SELECT unnest([-1, 0, 1]) AS dx) b JOIN px p
ON p.image_id = s.image_id AND p.y = s.y + dy AND p.x = s.x + dx WHERE abs(dy) + abs(dx) <= 1""", "pred80 px")
view("pred80", "SELECT image_id, height, width, y, x FROM px WHERE p100 >= 80", "px")
skeleton_view("fatskel", "fat", "fat")


@query("G14_morph_close", "fatskel pred80 px", """SELECT image_id, y, x FROM pred80 UNION SELECT p.image_id, p.y, p.x FROM fatskel s CROSS JOIN (SELECT unnest([0, 1]) AS dy) a
CROSS JOIN (SELECT unnest([0, 1]) AS dx) b JOIN px p ON p.image_id = s.image_id AND p.y = s.y + dy AND p.x = s.x + dx""")
def morph_close(spark, d):
    return postprocess.postprocess(mask(spark, d, 80), "morph_close", 2, radius=1, within=fixtures.px(spark, d)).select("image_id", "y", "x")


skeleton_view("p80skel", "pred80", "pred80")
components_view("f8", "p80skel", 8, "p80skel")
view("f8ends", """SELECT a.image_id, a.y, a.x, any_value(a.component) AS f FROM f8_px a JOIN f8_px b ON b.image_id = a.image_id AND abs(b.y - a.y) <= 1 AND abs(b.x - a.x) <= 1 GROUP BY 1, 2, 3 HAVING count(*) = 2""", "f8_px")


def thin80(spark, d):
    s = cut(thinning.skeletonize(mask(spark, d, 80)))
    f = components.connected_components(s, 8).withColumnRenamed("component", "fragment")
    return cut(raster.endpoints(s).join(f, ["image_id", "y", "x"]).select(*raster.frame(), "fragment"))


@query("J09_endpoint_pairs", "f8ends", """SELECT p.image_id, p.y AS py, p.x AS px, q.y AS qy, q.x AS qx, ((p.y - q.y) * (p.y - q.y) + (p.x - q.x) * (p.x - q.x))::BIGINT AS d2
FROM f8ends p JOIN f8ends q ON q.image_id = p.image_id AND q.f <> p.f AND (p.y < q.y OR (p.y = q.y AND p.x < q.x)) WHERE (p.y - q.y) * (p.y - q.y) + (p.x - q.x) * (p.x - q.x) <= 25""")
def endpoint_pairs(spark, d):
    return postprocess.endpoint_pairs(thin80(spark, d), 5.0).select("image_id", "py", "px", "qy", "qx", "d2")


# a pair is a bridge if no chain of pairs before it in the order connects its two fragments
view("loose", """SELECT p.image_id, p.y AS py, p.x AS px, q.y AS qy, q.x AS qx, p.f AS pf, q.f AS qf,
 row_number() OVER (PARTITION BY p.image_id ORDER BY (p.y - q.y) * (p.y - q.y) + (p.x - q.x) * (p.x - q.x), p.y, p.x, q.y, q.x) AS r
FROM f8ends p JOIN f8ends q ON q.image_id = p.image_id AND q.f <> p.f AND (p.y < q.y OR (p.y = q.y AND p.x < q.x)) WHERE (p.y - q.y) * (p.y - q.y) + (p.x - q.x) * (p.x - q.x) <= 25""", "f8ends")
view("joined", """(image_id, r, f) AS (SELECT image_id, r, pf FROM loose
 UNION SELECT t.image_id, t.r, CASE WHEN e.pf = t.f THEN e.qf ELSE e.pf END FROM joined t JOIN loose e ON e.image_id = t.image_id AND e.r < t.r AND (e.pf = t.f OR e.qf = t.f))""", "loose")
view("bridges", "SELECT * FROM loose b WHERE NOT EXISTS (SELECT 1 FROM joined t WHERE t.image_id = b.image_id AND t.r = b.r AND t.f = b.qf)", "loose joined")


@query("G13_bridges", "bridges", "SELECT image_id, py, px, qy, qx FROM bridges")
def bridges(spark, d):
    return postprocess.spanning_bridges(postprocess.endpoint_pairs(thin80(spark, d), 5.0))


view("bridged", """SELECT image_id, y, x FROM p80skel UNION SELECT image_id, py + sign(qy - py)::INTEGER * CAST(floor((abs(qy - py) * i * 2 + n) / (n * 2)::DOUBLE) AS INTEGER),
 px + sign(qx - px)::INTEGER * CAST(floor((abs(qx - px) * i * 2 + n) / (n * 2)::DOUBLE) AS INTEGER)
FROM (SELECT *, unnest(range(n + 1)) AS i FROM (SELECT *, greatest(abs(qy - py), abs(qx - px)) AS n FROM bridges))""", "p80skel bridges")


@query("G14_skeleton_bridge", "bridged px", """SELECT DISTINCT p.image_id, p.y, p.x FROM bridged s CROSS JOIN (SELECT unnest([0, 1]) AS dy) a CROSS JOIN (SELECT unnest([0, 1]) AS dx) b JOIN px p
ON p.image_id = s.image_id AND p.y = s.y + dy AND p.x = s.x + dx""")
def skeleton_bridge(spark, d):
    return postprocess.postprocess(mask(spark, d, 80), "skeleton_bridge", 2, bridge_px=5.0, within=fixtures.px(spark, d)).select("image_id", "y", "x")


# ---- watershed ----
components_view("s8", "(SELECT * FROM px WHERE p100 < 40)", 8, "px")
view("flood", """(it, image_id, y, x, lvl, seed, h, s, r) AS (
 SELECT 0, p.image_id, p.y, p.x, p.p100, c.component, CASE WHEN c.component IS NOT NULL THEN -1 END, CASE WHEN c.component IS NOT NULL THEN 0 END, c.component
 FROM px p LEFT JOIN s8_px c USING (image_id, y, x)
 UNION ALL
 SELECT it + 1, image_id, y, x, lvl, seed, CASE WHEN seed IS NOT NULL THEN -1 ELSE b.h END, CASE WHEN seed IS NOT NULL THEN 0 ELSE b.s END, CASE WHEN seed IS NOT NULL THEN seed ELSE b.r END FROM (
  SELECT p.it, p.image_id, p.y, p.x, p.lvl, p.seed, min({'h': greatest(q.h, p.lvl), 's': CASE WHEN q.h < p.lvl THEN 1 ELSE q.s + 1 END, 'r': q.r}) FILTER (q.r IS NOT NULL) AS b
  FROM flood p CROSS JOIN (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) o(dy, dx) LEFT JOIN flood q ON q.image_id = p.image_id AND q.y = p.y + o.dy AND q.x = p.x + o.dx
  WHERE p.it < 40 GROUP BY 1, 2, 3, 4, 5, 6))""", "px s8_px")


@query("G11_watershed_regions", "flood", "SELECT image_id, y, x, coalesce(r, 1) AS region FROM flood WHERE it = 40")
def flood(spark, d):
    return watershed.watershed_regions(fixtures.px(spark, d), 0.4).select("image_id", "y", "x", "region")


# ---- grids, sweeps, selection ----
view("tuned", "SELECT * FROM (VALUES ('d0', 0.6::DOUBLE), ('d1', 0.6::DOUBLE), ('d2', 0.7::DOUBLE)) t(dataset, tuned)")


def tuned(spark):
    return spark.createDataFrame([("d0", 0.6), ("d1", 0.6), ("d2", 0.7)], "dataset string, tuned double")


def priority_tuned(spark, d):
    """Tuned thresholds per tile dataset, derived from the tiles."""
    return fixtures.tiles(spark, d).groupBy("dataset").agg(F.round(0.3 + F.max("outline_fraction"), 6).alias("tuned"))


view("ptuned", "SELECT dataset, round(0.3::DOUBLE + max(outline_fraction), 6) AS tuned FROM tiles GROUP BY 1", "tiles")


@query("F07_postprocess_grid", "ptuned", """
SELECT dataset, m || '@' || coalesce(format('{:.2f}', t), 'tuned') AS config, m AS mode, coalesce(t, tuned) AS threshold, 'binary_outline' AS partition, false AS reference
FROM ptuned, (VALUES ('none'), ('skeleton_redilate')) a(m), (VALUES (0.5::DOUBLE), (0.6::DOUBLE), (NULL)) b(t)
UNION ALL SELECT dataset, 'reference: watershed_prob@tuned', 'none', tuned, 'watershed_prob', true FROM ptuned""")
def grid(spark, d):
    g = sweep.postprocess_grid(priority_tuned(spark, d), ("none", "skeleton_redilate"), (0.5, 0.6))
    return g.select("dataset", "config", "mode", "threshold", "partition", "reference")


@query("F07_gap_closing_grid", "ptuned", """
SELECT dataset, CASE WHEN r IS NULL THEN 'skeleton_bridge_' || b || 'px@' ELSE 'morph_close_r' || r || '@' END || coalesce(format('{:.2f}', t), 'tuned') AS config, coalesce(t, tuned) AS threshold,
  r::DOUBLE AS radius, b::DOUBLE AS bridge FROM ptuned, (VALUES (1, NULL), (2, NULL), (NULL, 4)) a(r, b), (VALUES (0.5::DOUBLE), (NULL)) c(t)
UNION ALL SELECT dataset, 'reference: watershed_prob@tuned', tuned, NULL, NULL FROM ptuned""")
def gap_grid(spark, d):
    return sweep.gap_closing_grid(priority_tuned(spark, d), (1, 2), (4.0,), (0.5,)).select("dataset", "config", "threshold", "radius", "bridge")


@query("F07_marker_grid", "ptuned", """SELECT dataset, 'watershed_prob@marker' || format('{:.2f}', m) AS config, tuned AS threshold, m AS marker FROM ptuned, (VALUES (0.3::DOUBLE), (0.6::DOUBLE)) a(m)""")
def markers(spark, d):
    return sweep.marker_grid(priority_tuned(spark, d), (0.3, 0.6)).select("dataset", "config", "threshold", "marker")


@query("J10_config_by_tile", "ptuned tiles", """
SELECT t.dataset, m AS config, count(*) AS n, count(*) FILTER (outline_fraction >= tuned - 0.35) AS hits FROM tiles t JOIN ptuned USING (dataset), (VALUES ('a'), ('b')) c(m) GROUP BY 1, 2""")
def config_by_tile(spark, d):
    configs = priority_tuned(spark, d).withColumn("config", F.explode(F.array(F.lit("a"), F.lit("b"))))
    j = fixtures.tiles(spark, d).join(configs, "dataset")
    return j.groupBy("dataset", "config").agg(F.count("*").alias("n"), F.count_if(F.col("outline_fraction") >= F.col("tuned") - 0.35).alias("hits"))


@query("P26_request_validation", "ptuned", """
SELECT dataset, config, 'morph_close needs a radius' AS rule FROM ptuned, (VALUES ('b')) c(config) UNION ALL
SELECT dataset, 'c', 'watershed takes no post-processing' FROM ptuned UNION ALL SELECT dataset, 'd', 'threshold outside (0, 1)' FROM ptuned""")
def validation(spark, d):
    null = F.lit(None).cast("double")
    def cell(name, mode, t, partition="binary_outline"):
        return F.struct(F.lit(name).alias("config"), F.lit(mode).alias("mode"), F.lit(t).alias("threshold"), null.alias("radius"), null.alias("bridge"),
                        null.alias("marker"), F.lit(partition).alias("partition"))
    cells = F.array(cell("a", "none", 0.5), cell("b", "morph_close", 0.5), cell("c", "skeleton_redilate", 0.5, "watershed_prob"), cell("d", "none", 1.5))
    return sweep.invalid_configs(priority_tuned(spark, d).select("dataset", F.inline(cells)), 2).select("dataset", "config", "rule")


view("sweeprows", """
SELECT 'd' || (user_id % 3) AS dataset, 'c' || event_id AS config, CASE event_id % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'skeleton_redilate' WHEN 2 THEN 'morph_close' ELSE 'skeleton_bridge' END AS mode,
  (1 + event_id % 19) * 0.05::DOUBLE AS threshold, CASE WHEN event_id % 5 = 0 THEN 'watershed_prob' ELSE 'binary_outline' END AS partition, event_id % 11 = 0 AS reference, 'val' AS split,
  (1 + event_id % 9) / 10.0::DOUBLE AS marker, round(value / 500, 2) AS pq FROM events""")


def sweep_rows(spark, d):
    e, i = fixtures.table(spark, d, "events"), F.col("event_id")
    k = i % 4
    return e.select(F.concat(F.lit("d"), F.col("user_id") % 3).alias("dataset"), F.concat(F.lit("c"), i).alias("config"),
                    F.when(k == 0, "none").when(k == 1, "skeleton_redilate").when(k == 2, "morph_close").otherwise("skeleton_bridge").alias("mode"),
                    ((1 + i % 19) * F.lit(0.05)).alias("threshold"), F.when(i % 5 == 0, "watershed_prob").otherwise("binary_outline").alias("partition"),
                    (i % 11 == 0).alias("reference"), F.lit("val").alias("split"), ((1 + i % 9) / F.lit(10.0)).alias("marker"), F.round(F.col("value") / 500, 2).alias("pq"))


RANK = "CASE mode WHEN 'none' THEN 0 WHEN 'skeleton_redilate' THEN 1 WHEN 'morph_close' THEN 2 ELSE 3 END"


@query("W07_select_config", "sweeprows", f"""SELECT dataset, config, mode, threshold, pq FROM sweeprows WHERE NOT reference
QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY pq DESC, {RANK}, threshold, config) = 1""")
def select_config(spark, d):
    return selection.select_config(sweep_rows(spark, d)).select("dataset", "config", "mode", "threshold", "pq")


@query("W08_select_marker", "sweeprows", """SELECT dataset, marker, max(pq) AS pq FROM sweeprows WHERE partition = 'watershed_prob' GROUP BY 1, 2
QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY max(pq) DESC, round(abs(marker - 0.3), 9), marker) = 1""")
def select_marker(spark, d):
    return selection.select_marker(sweep_rows(spark, d), 0.3).select("dataset", "marker", "pq")


@query("A45_closest_match", "sweeprows", """SELECT dataset, config AS name, pq FROM sweeprows QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY abs(pq - 0.1), config) = 1""")
def closest(spark, d):
    rows = sweep_rows(spark, d).select("dataset", F.col("config").alias("name"), "pq").withColumn("target", F.lit(0.1))
    return selection.closest_fraction(rows, "target", "pq").select("dataset", "name", "pq")


@query("A45_row_multiplicity", "sweeprows", """SELECT dataset, count(*) FILTER (mode = 'none') AS none, count(*) FILTER (mode = 'morph_close') AS morph_close FROM sweeprows GROUP BY 1
HAVING count(*) FILTER (mode = 'none') <> 1 OR count(*) FILTER (mode = 'morph_close') <> 1""")
def multiplicity(spark, d):
    return selection.wrong_multiplicity(sweep_rows(spark, d).withColumn("kind", F.col("mode")), ["none", "morph_close"])


@query("F09_selected_config", "sweeprows", f"""SELECT dataset, 'selected (val-best)' AS config, mode, threshold, partition FROM sweeprows WHERE NOT reference AND partition = 'binary_outline'
QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY pq DESC, {RANK}, threshold, config) = 1""")
def selected(spark, d):
    rows = sweep_rows(spark, d).filter("partition = 'binary_outline'").withColumns({c: F.lit(None).cast("double") for c in ("radius", "bridge")})
    return sweep.config_from_selection(selection.select_config(rows)).select("dataset", "config", "mode", "threshold", "partition")


# full sweep: none@0.60, skeleton_redilate@0.60 against the true partition
VIEWS["redilated_ground"] = ("redilated px", "SELECT p.image_id, p.y, p.x FROM px p ANTI JOIN redilated USING (image_id, y, x)")
components_view("rd4", "redilated_ground", 4, "redilated_ground")
region_view("rreg", "rd4")
skeleton_view("rskel", "redilated", "redilated")
decomposition_views("rd", "redilated", "rskel")
view("rcells", "SELECT image_id, 'd' || (image_id % 3) AS dataset, t.region AS t, p.region AS p, count(*) AS n FROM treg t JOIN rreg p USING (image_id, y, x) GROUP BY ALL", "treg rreg")
pq_views("pqr", "rcells")
MEANPQ = """SELECT dataset, avg(CASE WHEN tp + 0.5 * fp + 0.5 * fn > 0 THEN s / (tp + 0.5 * fp + 0.5 * fn) ELSE 1.0 END) AS pq, avg((tp + fp)::DOUBLE) AS n_pred_regions FROM {v} GROUP BY 1"""
view("sweepsql", f"""SELECT 'none@0.60' AS config, v.dataset, round(pixel_dice, 6) AS pixel_dice, round(real, 6) AS real, "label", round(pq, 6) AS pq, round(n_pred_regions, 6) AS n_pred_regions
  FROM verdict_p60 v JOIN ({MEANPQ.format(v="pqf")}) USING (dataset)
UNION ALL SELECT 'skeleton_redilate@0.60', v.dataset, round(pixel_dice, 6), round(real, 6), "label", round(pq, 6), round(n_pred_regions, 6) FROM verdict_rd v JOIN ({MEANPQ.format(v="pqr")}) USING (dataset)""",
     "verdict_p60 verdict_rd pqf pqr")


def sweep_configs(spark):
    return sweep.postprocess_grid(tuned(spark), ("none", "skeleton_redilate"), (0.6,), reference=False).filter("config not like '%tuned'")


@query("F08_sweep", "sweepsql", "SELECT * FROM sweepsql")
def run_sweep(spark, d):
    out = sweep.sweep(fixtures.prob_px(spark, d), cut(sweep_configs(spark)), 2)
    return rounded(out.select("config", "dataset", "pixel_dice", "real", "label", "pq", "n_pred_regions"), "pixel_dice", "real", "pq", "n_pred_regions")


@query("P19_flatten_sweep_row", "verdict_p60 regionrow px", """
SELECT 'operating point' AS config, v.dataset, 'test,train,val' AS split, 'none' AS mode, 0.6::DOUBLE AS threshold, 'binary_outline' AS partition, false AS reference,
  NULL::DOUBLE AS radius, NULL::DOUBLE AS bridge, r.tiles, round(pixel_dice, 4) AS pixel_dice, round(skeleton_dice, 4) AS skeleton_dice, round(width_ratio, 4) AS width_ratio,
  round(real, 4) AS real, round(found, 4) AS found, "label", 2::INTEGER AS tolerance_px, pq, sq, rq, over_segmentation_factor, n_true_regions, n_pred_regions, pred_fraction
FROM verdict_p60 v JOIN (SELECT dataset, count(*) AS tiles, round(avg(pq), 4) AS pq, round(avg(sq), 4) AS sq, round(avg(rq), 4) AS rq, round(avg(over_segmentation_factor), 4) AS over_segmentation_factor,
  round(avg(n_true_regions), 4) AS n_true_regions, round(avg(n_pred_regions), 4) AS n_pred_regions FROM regionrow GROUP BY 1) r USING (dataset)
JOIN (SELECT dataset, round(avg(f), 4) AS pred_fraction FROM (SELECT image_id, dataset, count(*) FILTER (p100 >= 60) / count(*)::DOUBLE AS f FROM px GROUP BY 1, 2) GROUP BY 1) USING (dataset)""")
def flatten(spark, d):
    limits = fixtures.px(spark, d).select("dataset").distinct().withColumn("threshold", F.lit(0.6))
    rows = sweep.flatten(evaluate.evaluate(fixtures.prob_px(spark, d), limits, "operating point"))
    return rounded(rows, "pixel_dice", "skeleton_dice", "width_ratio", "real", "found", "pq", "sq", "rq", "over_segmentation_factor", "n_true_regions", "n_pred_regions",
                   "pred_fraction", places=4)


view("splitpq", f"""SELECT r.*, CASE WHEN (image_id // 4) % 5 = 0 THEN 'val' WHEN (image_id // 4) % 5 = 1 THEN 'test' ELSE 'train' END AS split FROM (
  SELECT 'none' AS mode, 0 AS rank, image_id, dataset, CASE WHEN tp + 0.5 * fp + 0.5 * fn > 0 THEN s / (tp + 0.5 * fp + 0.5 * fn) ELSE 1.0 END AS pq, (tp + fp)::DOUBLE AS n FROM pqf
  UNION ALL SELECT 'skeleton_redilate', 1, image_id, dataset, CASE WHEN tp + 0.5 * fp + 0.5 * fn > 0 THEN s / (tp + 0.5 * fp + 0.5 * fn) ELSE 1.0 END, (tp + fp)::DOUBLE FROM pqr) r""", "pqf pqr")


@query("F09_select_then_test", "splitpq", """
WITH c AS (SELECT dataset, mode FROM (SELECT dataset, mode, rank, avg(pq) AS pq FROM splitpq WHERE split = 'val' GROUP BY 1, 2, 3)
  QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY round(pq, 9) DESC, rank) = 1)
SELECT dataset, 'selected (val-best)' AS config, 'test' AS split, mode, 0.6::DOUBLE AS threshold, count(*) AS tiles, round(avg(pq), 6) AS pq, round(avg(n), 6) AS n_pred_regions
FROM splitpq JOIN c USING (dataset, mode) WHERE split = 'test' GROUP BY ALL""".replace("WITH c AS", ", c AS"))
def select_then_test(spark, d):
    """The configuration that is best on validation tiles, scored once, on test tiles."""
    px = cut(fixtures.prob_px(spark, d).filter(F.col("split").isin("val", "test")))
    out = sweep.select_then_test(px.filter("split = 'val'"), px.filter("split = 'test'"), cut(sweep_configs(spark)), 2)
    return rounded(out.select("dataset", "config", "split", "mode", "threshold", "tiles", "pq", "n_pred_regions"), "pq", "n_pred_regions")


@query("F12_evaluate_predictions", "verdict_p60 pqf", f"""SELECT v.dataset, round(pixel_dice, 6) AS pixel_dice, "label", round(pq, 6) AS pq FROM verdict_p60 v JOIN ({MEANPQ.format(v="pqf")}) USING (dataset)""")
def evaluate_predictions(spark, d):
    limits = spark.createDataFrame([("d0", 0.6), ("d1", 0.6), ("d2", 0.6)], "dataset string, threshold double")
    out = evaluate.evaluate(fixtures.prob_px(spark, d), limits)
    return rounded(out.select("dataset", "pixel_dice", "label", "pq"), "pixel_dice", "pq")
