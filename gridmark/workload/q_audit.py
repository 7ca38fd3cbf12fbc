"""Names, pairing, colours, palettes and audit votes."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridmark.functions import colour, names
from gridmark.operators import checks, pairing, palette
from gridmark.workload import fixtures
from gridmark.workload.registry import query
from gridmark.workload.views import view

view("mask_px", """SELECT *, CAST(label * 25 * 65536 + (250 - label * 25) * 256 + 100 + CASE WHEN p100 >= 90 THEN 8 ELSE 0 END AS INTEGER) AS rgb
FROM px""", "px")
view("listing", """
SELECT dataset, CASE WHEN dataset = 'src1' THEN replace(path, '_mask.png', '_zz9.png')
  WHEN dataset = 'src2' THEN replace(path, '_mask.png', '.png')
  WHEN dataset = 'src3' AND contains(path, '/images/') THEN regexp_replace(path, '/([0-9]+).png$', '/img\\1.png')
  WHEN dataset = 'src3' THEN regexp_replace(path, '/([0-9]+)_mask.png$', '/IMG\\1_mask.PNG') ELSE path END AS path FROM files""",
     "files")
view("named", """
SELECT dataset, path, name, regexp_replace(name, '\\.[^.]*$', '') AS stem, CASE WHEN contains(path, '/masks/') THEN 'mask' ELSE 'image' END AS role
FROM (SELECT *, list_last(string_split(path, '/')) AS name FROM listing)""", "listing")
AFF = ", ".join(f"('{a}', {i})" for i, a in enumerate(("", *names.AFFIXES)))
STRIP = """CASE WHEN {a} = '' THEN {s} WHEN ends_with({s}, {a}) THEN left({s}, length({s}) - length({a}))
 WHEN starts_with({s}, {a}) THEN substr({s}, length({a}) + 1) ELSE {s} END"""
view("affixes", f"""
SELECT dataset, CASE WHEN s >= 0.5 * n THEN affix WHEN coalesce(fs, 0) > s THEN faffix ELSE affix END AS affix FROM (
  SELECT m.dataset, m.n, coalesce(b.affix, '') AS affix, coalesce(b.s, 0) AS s, f.affix AS faffix, f.s AS fs
  FROM (SELECT dataset, count(*) AS n FROM named WHERE role = 'mask' GROUP BY 1) m
  LEFT JOIN (SELECT m.dataset, a.affix, a.place, count(*) AS s FROM named m, (VALUES {AFF}) a(affix, place)
     WHERE m.role = 'mask' AND EXISTS (SELECT 1 FROM named i WHERE i.role = 'image' AND i.dataset = m.dataset AND i.stem = {STRIP.format(a="a.affix", s="m.stem")})
     GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY m.dataset ORDER BY count(*) DESC, place) = 1) b USING (dataset)
  LEFT JOIN (SELECT m.dataset, a.affix, a.k, count(*) AS s FROM named m JOIN (
       SELECT dataset, k, right(min(stem), k) AS affix FROM named, range(1, 25) r(k) WHERE role = 'mask'
       GROUP BY 1, 2 HAVING min(right(stem, k)) = max(right(stem, k)) AND min(length(stem)) >= k) a USING (dataset)
     WHERE m.role = 'mask' AND EXISTS (SELECT 1 FROM named i WHERE i.role = 'image' AND i.dataset = m.dataset AND i.stem = {STRIP.format(a="a.affix", s="m.stem")})
     GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY m.dataset ORDER BY count(*) DESC, k DESC) = 1) f USING (dataset))""",
     "named")
view("pairs", f"""
SELECT m.dataset, m.path AS mask_path, coalesce(
   (SELECT min(path) FROM named i WHERE i.role = 'image' AND i.dataset = m.dataset AND i.stem = m.key),
   (SELECT min(path) FROM named i WHERE i.role = 'image' AND i.dataset = m.dataset AND lower(i.stem) = lower(m.key))) AS image_path
FROM (SELECT n.dataset, n.path, {STRIP.format(a="a.affix", s="n.stem")} AS key FROM named n JOIN affixes a USING (dataset) WHERE role = 'mask') m""",
     "named affixes")


def files_with_roles(spark, d):
    return pairing.discover(fixtures.listing(spark, d), F.concat(F.lit("/data/"), "dataset"))


def all_pairs(spark, d):
    return pairing.discover_pairs(files_with_roles(spark, d))


NAMES = """
SELECT p_partkey AS id, CASE p_partkey % 8 WHEN 0 THEN p_type || '_Masks' WHEN 1 THEN 'IMG-' || p_brand
  WHEN 2 THEN 'groundtruth' || p_size WHEN 3 THEN '_Data ' WHEN 4 THEN p_name WHEN 5 THEN 'my-label'
  WHEN 6 THEN 'rawphotos' || p_size ELSE p_type END AS name FROM part"""


def _hints(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


@query("P01_dir_role", "", f"""
SELECT id, CASE WHEN list_has_any(tok, {_hints(names.MASK_DIR_HINTS)}) THEN 'mask'
  WHEN list_has_any(tok, {_hints(names.IMAGE_DIR_HINTS)}) THEN 'image'
  WHEN len(list_filter({_hints(names.MASK_DIR_HINTS)}, lambda h: contains(low, h))) > 0 THEN 'mask'
  WHEN len(list_filter({_hints(names.IMAGE_DIR_HINTS)}, lambda h: contains(low, h))) > 0 THEN 'image' END AS role
FROM (SELECT id, low, list_concat([low], list_concat(string_split(low, '_'), string_split(low, '-'))) AS tok
      FROM (SELECT id, trim(lower(name), '_- ') AS low FROM ({NAMES})))""")
def dir_role(spark, d):
    k = F.col("p_partkey") % 8
    name = (F.when(k == 0, F.concat("p_type", F.lit("_Masks"))).when(k == 1, F.concat(F.lit("IMG-"), "p_brand"))
            .when(k == 2, F.concat(F.lit("groundtruth"), "p_size")).when(k == 3, F.lit("_Data ")).when(k == 4, F.col("p_name"))
            .when(k == 5, F.lit("my-label")).when(k == 6, F.concat(F.lit("rawphotos"), "p_size")).otherwise(F.col("p_type")))
    return fixtures.table(spark, d, "part").select(F.col("p_partkey").alias("id"), names.dir_role(name).alias("role"))


@query("P02_strip_affix", "named", f"""
SELECT path, {STRIP.format(a="'_mask'", s="stem")} AS a, {STRIP.format(a="'1'", s="stem")} AS b, {STRIP.format(a="''", s="stem")} AS c FROM named""")
def strip(spark, d):
    f = pairing.describe_files(fixtures.listing(spark, d))
    return f.select("path", *[names.strip_affix(F.col("stem"), F.lit(a)).alias(n) for a, n in (("_mask", "a"), ("1", "b"), ("", "c"))])


@query("P03_parent_id", "named", """
SELECT path, CASE dataset WHEN 'src4' THEN regexp_replace(stem, '[0-9]$', '', 'g') WHEN 'src5' THEN regexp_replace(stem, '_mask', '', 'g') ELSE stem END AS parent_id FROM named""")
def parent(spark, d):
    f = pairing.describe_files(fixtures.listing(spark, d))
    return f.select("path", names.parent_id(F.col("dataset"), F.col("stem"), {"src4": "[0-9]$", "src5": "_mask"}).alias("parent_id"))


@query("X01_name_parts", "", """
SELECT page_id, name, CASE WHEN contains(substr(name, 2), '.') THEN regexp_replace(name, '\\.[^.]*$', '') ELSE name END AS stem,
  CASE WHEN contains(substr(name, 2), '.') THEN lower(regexp_extract(name, '(\\.[^.]*)$', 1)) ELSE '' END AS ext
FROM (SELECT page_id, list_last(string_split(url, '/')) AS name FROM pages)""")
def name_parts(spark, d):
    p = fixtures.table(spark, d, "pages")
    u = F.col("url")
    return p.select("page_id", names.file_name(u).alias("name"), names.stem(u).alias("stem"), names.extension(u).alias("ext"))


@query("X02_hex_match", "", "SELECT doc_id, regexp_full_match(substr(md5(text), 1, 14 + (doc_id % 3)::INTEGER), '[0-9a-f]{16}') AS hit FROM documents")
def hex_match(spark, d):
    h = F.substring(F.md5("text"), F.lit(1), (14 + F.col("doc_id") % 3).cast("int"))
    return fixtures.table(spark, d, "documents").select("doc_id", F.rlike(h, F.lit("^[0-9a-f]{16}$")).alias("hit"))


@query("P25_layout", "named", """
SELECT DISTINCT dataset, CASE WHEN bool_or(role = 'mask') THEN 'split-dirs' ELSE 'flat-affix' END AS layout,
  CASE WHEN bool_or(role = 'mask') THEN '/data/' || dataset || '/images' END AS image_dir,
  CASE WHEN bool_or(role = 'mask') THEN '/data/' || dataset || '/masks' END AS mask_dir FROM named GROUP BY dataset""")
def layout(spark, d):
    return pairing.layout(pairing.describe_files(fixtures.listing(spark, d)), F.concat(F.lit("/data/"), "dataset"))


@query("J04_infer_affix", "affixes", "SELECT * FROM affixes")
def affix(spark, d):
    return pairing.infer_affix(files_with_roles(spark, d))


@query("X03_common_suffix", "named", """
SELECT dataset, max(k) AS k FROM (SELECT dataset, k FROM named, range(1, 25) r(k) WHERE role = 'mask' GROUP BY 1, 2
  HAVING min(right(stem, k)) = max(right(stem, k)) AND min(length(stem)) >= k) GROUP BY 1""")
def common_suffix(spark, d):
    m = files_with_roles(spark, d).filter("role = 'mask'")
    ends = m.groupBy("dataset").agg(F.min(F.reverse("stem")).alias("lo"), F.max(F.reverse("stem")).alias("hi"))
    return ends.select("dataset", F.array_max(F.filter(F.sequence(F.lit(1), F.lit(24)), lambda i: (F.length("lo") >= i) & (
        F.substring("lo", F.lit(1), i) == F.substring(F.col("hi"), F.lit(1), i)))).cast("bigint").alias("k")).filter("k is not null")


@query("J01_pairing", "pairs", "SELECT * FROM pairs")
def pair(spark, d):
    return all_pairs(spark, d)


@query("J02_unmatched", "named pairs", """
SELECT dataset, mask_path AS path, 'mask' AS role FROM pairs WHERE image_path IS NULL
UNION ALL SELECT dataset, path, 'image' FROM named n WHERE role = 'image' AND path NOT IN (SELECT image_path FROM pairs WHERE image_path IS NOT NULL)""")
def unmatched(spark, d):
    f = files_with_roles(spark, d)
    return pairing.unmatched(f, pairing.discover_pairs(f))


@query("J02_pairing_counts", "named pairs", """
SELECT dataset, n_images::BIGINT AS n_images, n_masks::BIGINT AS n_masks, coalesce(np, 0) AS n_pairs,
  (n_images - coalesce(nu, 0))::BIGINT AS unmatched_images, (n_masks - coalesce(np, 0))::BIGINT AS unmatched_masks
FROM (SELECT dataset, count(*) FILTER (role = 'image') n_images, count(*) FILTER (role = 'mask') n_masks FROM named GROUP BY 1)
LEFT JOIN (SELECT dataset, count(image_path) np, count(DISTINCT image_path) nu FROM pairs GROUP BY 1) USING (dataset)""")
def pairing_counts(spark, d):
    f = files_with_roles(spark, d)
    return pairing.pairing_counts(f, pairing.discover_pairs(f))


EXCL = """SELECT dataset, name, 'listed' AS reason FROM (SELECT DISTINCT dataset, name FROM named WHERE length(stem) % 5 = 0
  UNION ALL SELECT DISTINCT dataset, 'gone.png' FROM named)"""


def exclusion_table(spark, d):
    f = pairing.describe_files(fixtures.listing(spark, d))
    listed = f.filter(F.length("stem") % 5 == 0).select("dataset", "name").distinct()
    gone = f.select("dataset", F.lit("gone.png").alias("name")).distinct()
    return listed.unionByName(gone).withColumn("reason", F.lit("listed"))


@query("P04_exclusion_filter", "named pairs", f"""
SELECT mask_path, CASE WHEN r IS NULL THEN 'ok' ELSE 'excluded' END AS status, r AS reason FROM (
  SELECT p.*, coalesce(e.reason, f.reason) AS r FROM pairs p LEFT JOIN ({EXCL}) e ON e.dataset = p.dataset AND e.name = list_last(string_split(p.image_path, '/'))
  LEFT JOIN ({EXCL}) f ON f.dataset = p.dataset AND f.name = list_last(string_split(p.mask_path, '/')))""")
def exclusion(spark, d):
    return pairing.mark_excluded(all_pairs(spark, d), exclusion_table(spark, d)).select("mask_path", "status", "reason")


@query("J03_listed_but_absent", "named", f"SELECT dataset, name FROM ({EXCL}) EXCEPT SELECT dataset, name FROM named")
def absent(spark, d):
    return pairing.listed_but_absent(exclusion_table(spark, d), pairing.describe_files(fixtures.listing(spark, d)))


@query("J03_skipped_pairs", "pairs", """
SELECT dataset, mask_path, image_path FROM pairs WHERE image_path IS NOT NULL AND length(list_last(string_split(mask_path, '/'))) % 2 = 1""")
def skipped(spark, d):
    drawn = pairing.describe_files(fixtures.listing(spark, d)).filter(F.length("name") % 2 == 0).select("dataset", F.col("path").alias("mask_path"))
    return pairing.skipped_pairs(all_pairs(spark, d), drawn)


@query("U04_listed_names_present", "named", f"SELECT dataset, name FROM ({EXCL}) INTERSECT SELECT dataset, name FROM named")
def present(spark, d):
    return exclusion_table(spark, d).select("dataset", "name").intersect(
        pairing.describe_files(fixtures.listing(spark, d)).select("dataset", "name"))


@query("S13_resolve_path", "named", """
SELECT q.path, CASE WHEN EXISTS (SELECT 1 FROM named n WHERE n.path = q.path) THEN q.path
  ELSE (SELECT min(path) FROM named n WHERE n.dataset = q.dataset AND n.name = list_last(string_split(q.path, '/'))) END AS resolved
FROM (SELECT dataset, name, CASE WHEN length(stem) % 3 = 0 THEN '/old/' || name WHEN length(stem) % 3 = 1 THEN '/old/x' || name ELSE path END AS path FROM named WHERE role = 'image') q""")
def resolve(spark, d):
    f = files_with_roles(spark, d)
    k = F.length("stem") % 3
    moved = f.filter("role = 'image'").select("dataset", F.when(k == 0, F.concat(F.lit("/old/"), "name")).when(
        k == 1, F.concat(F.lit("/old/x"), "name")).otherwise(F.col("path")).alias("path"))
    return pairing.resolve_paths(moved, f).select("path", "resolved")


view("crops", "SELECT p_partkey AS image, p_brand AS dataset, (p_partkey % 3)::INTEGER AS l, (p_size % 2)::INTEGER AS t, (200 + p_partkey % 900)::INTEGER AS w, (200 + p_size * 17)::INTEGER AS h FROM part")


@query("S06_crop_lookup", "crops", "SELECT dataset, image, l AS \"left\", t AS top, w AS width, h AS height FROM crops")
def crop_lookup(spark, d):
    from gridmark.sources.reports import crop_lookup as run
    return run(_crop_report(spark, d))


def _crop_report(spark, d):
    """Crops nested per dataset, the shape an extraction report has."""
    p = fixtures.table(spark, d, "part")
    crop = F.struct((F.col("p_partkey") % 3).cast("int").alias("left"), (F.col("p_size") % 2).cast("int").alias("top"),
                    (200 + F.col("p_partkey") % 900).cast("int").alias("width"), (200 + F.col("p_size") * 17).cast("int").alias("height"))
    return p.groupBy(F.col("p_brand").alias("dataset")).agg(
        F.collect_list(F.struct(F.col("p_partkey").alias("image"), crop.alias("image_crop"))).alias("reconciled"))


@query("J06_crop_agreement", "crops", """
SELECT dataset, image, l AS want_left, ((image % 4) % 3)::INTEGER AS "left" FROM crops WHERE l <> (image % 4) % 3""")
def crop_agreement(spark, d):
    from gridmark.sources.reports import crop_lookup as run
    want = run(_crop_report(spark, d))
    have = want.withColumn("left", ((F.col("image") % 4) % 3).cast("int"))
    return pairing.crop_disagreement(have, want).select("dataset", "image", "want_left", "left")


@query("J13_weight_lookup", "tiles", """
SELECT t.tile_id, w.weight, CASE WHEN w.weight IS NULL THEN 'missing' WHEN w.weight <= 0 THEN 'not positive' END AS problem
FROM tiles t LEFT JOIN (VALUES ('1-URGENT', 0.5::DOUBLE), ('2-HIGH', 2.0::DOUBLE), ('3-MEDIUM', 0.0::DOUBLE)) w(dataset, weight) USING (dataset)""")
def weight_lookup(spark, d):
    w = spark.createDataFrame([("f", "1-URGENT", 0.5), ("f", "2-HIGH", 2.0), ("f", "3-MEDIUM", 0.0)], "fold string, dataset string, weight double")
    return pairing.lookup_weight(fixtures.tiles(spark, d).withColumn("fold", F.lit("f")), w).select("tile_id", "weight", "problem")


@query("S14_fold_stat_problems", "tiles", """
SELECT dataset, count(*) AS n FROM tiles LEFT JOIN (VALUES ('1-URGENT', 0.5::DOUBLE), ('2-HIGH', 2.0::DOUBLE), ('3-MEDIUM', 0.0::DOUBLE)) w(dataset, weight) USING (dataset)
WHERE weight IS NULL OR weight <= 0 GROUP BY 1""")
def stat_problems(spark, d):
    w = spark.createDataFrame([("f", "1-URGENT", 0.5), ("f", "2-HIGH", 2.0), ("f", "3-MEDIUM", 0.0)], "fold string, dataset string, weight double")
    t = pairing.lookup_weight(fixtures.tiles(spark, d).withColumn("fold", F.lit("f")), w)
    return t.filter("problem is not null").groupBy("dataset").agg(F.count("*").alias("n"))


# ---- colours ----
RGB = "(SELECT *, p100 AS r, label * 25 AS g, y AS b FROM px)"


def rgb_px(spark, d):
    return fixtures.px(spark, d).withColumns({"r": F.col("p100"), "g": F.col("label") * 25, "b": F.col("y")})


HSV = """SELECT image_id, y, x, hi, CASE WHEN hi = lo THEN 0.0::DOUBLE ELSE (CASE WHEN hi = r THEN CASE WHEN g < b THEN 360 + 60 * (g - b) / (hi - lo)::DOUBLE ELSE 60 * (g - b) / (hi - lo)::DOUBLE END
  WHEN hi = g THEN 120 + 60 * (b - r) / (hi - lo)::DOUBLE ELSE 240 + 60 * (r - g) / (hi - lo)::DOUBLE END) END AS h,
  CASE WHEN hi = 0 THEN 0.0::DOUBLE ELSE (hi - lo) / hi::DOUBLE END AS s FROM (SELECT *, greatest(r, g, b) AS hi, least(r, g, b) AS lo FROM """ + RGB + ")"
view("hsv", HSV, "px")
view("hsvb", """
SELECT image_id, dataset, y, x, CASE WHEN hi = lo THEN 0 ELSE ((CASE WHEN hi = r THEN CAST(floor((60 * (g - b) + (hi - lo)) / (2.0 * (hi - lo))) AS INTEGER)
  WHEN hi = g THEN CAST(floor((60 * (b - r) + (hi - lo)) / (2.0 * (hi - lo))) AS INTEGER) + 60 ELSE CAST(floor((60 * (r - g) + (hi - lo)) / (2.0 * (hi - lo))) AS INTEGER) + 120 END) + 180) % 180 END AS h,
  CASE WHEN hi = 0 THEN 0 ELSE CAST(floor((510 * (hi - lo) + hi) / (2.0 * hi)) AS INTEGER) END AS s, CAST(hi AS INTEGER) AS v
FROM (SELECT *, greatest(r, g, b) AS hi, least(r, g, b) AS lo FROM """ + RGB + ")", "px")


@query("P07_rgb_to_hsv", "hsv", "SELECT image_id, y, x, round(h, 4) AS h, round(s, 4) AS s, round(hi / 255.0::DOUBLE, 4) AS v FROM hsv")
def to_hsv(spark, d):
    t = rgb_px(spark, d)
    c = colour.hsv(F.col("r"), F.col("g"), F.col("b"))
    return t.select("image_id", "y", "x", *[F.round(v, 4).alias(k) for k, v in c.items()])


@query("P07_rgb_to_hsv_bytes", "hsvb", "SELECT image_id, y, x, h, s, v FROM hsvb")
def to_hsv_bytes(spark, d):
    t = rgb_px(spark, d)
    c = colour.hsv_bytes(F.col("r"), F.col("g"), F.col("b"))
    return t.select("image_id", "y", "x", *[v.alias(k) for k, v in c.items()])


@query("P09_in_hsv_window", "hsvb", """
SELECT image_id, count(*) FILTER ((h >= 150 OR h <= 60) AND s BETWEEN 30 AND 250 AND v BETWEEN 40 AND 230) AS wrapped,
       count(*) FILTER (h BETWEEN 20 AND 100 AND s BETWEEN 30 AND 250 AND v BETWEEN 40 AND 230) AS plain FROM hsvb GROUP BY 1""")
def hsv_window(spark, d):
    t = rgb_px(spark, d)
    c = colour.hsv_bytes(F.col("r"), F.col("g"), F.col("b"))

    def hit(lo, hi):
        return F.count_if(colour.in_window(c["h"], c["s"], c["v"], F.array(*map(F.lit, lo)), F.array(*map(F.lit, hi))))

    return t.groupBy("image_id").agg(hit((150.0, 30.0, 40.0), (60.0, 250.0, 230.0)).alias("wrapped"),
                                     hit((20.0, 30.0, 40.0), (100.0, 250.0, 230.0)).alias("plain"))


@query("P09_scale_window", "", """
SELECT id, round(greatest(0, least(179, (a + b) / 2 - (b - a) / 2 * 1.5)), 6) AS lo_h, round(greatest(0, least(255, (a + b + 100) / 2 + (b + 100 - a) / 2 * 1.5)), 6) AS hi_s
FROM (SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS a, CAST(p_size + p_partkey % 130 AS DOUBLE) AS b FROM part)""")
def scale(spark, d):
    p = fixtures.table(spark, d, "part")
    a, b = F.col("p_size").cast("double"), (F.col("p_size") + F.col("p_partkey") % 130).cast("double")
    w = colour.scale_window(F.array(a, a, a), F.array(b, b + 100, b), 1.5)
    return p.select(F.col("p_partkey").alias("id"), F.round(F.get(w["lower"], F.lit(0)), 6).alias("lo_h"),
                    F.round(F.get(w["upper"], F.lit(1)), 6).alias("hi_s"))


@query("P08_as_rgb", "px", """SELECT image_id, y, x, CASE WHEN label % 2 = 0 THEN p100 ELSE p100 END AS r, CASE WHEN label % 2 = 0 THEN p100 ELSE label END AS g, CASE WHEN label % 2 = 0 THEN p100 ELSE y END AS b FROM px""")
def as_rgb(spark, d):
    t = fixtures.px(spark, d)
    ch = F.when(F.col("label") % 2 == 0, F.array("p100")).otherwise(F.array("p100", "label", "y", F.lit(255)))
    c = colour.as_rgb(ch)
    return t.select("image_id", "y", "x", *[F.get(c, F.lit(i)).alias(n) for i, n in enumerate("rgb")])


@query("P10_threshold_labels", "px", "SELECT image_id, cut, count(*) FILTER (p100 < cut) AS dark FROM px, (VALUES (30), (50), (70)) c(cut) GROUP BY 1, 2")
def threshold_labels(spark, d):
    t = fixtures.px(spark, d)
    cuts = F.explode(F.array(*[F.struct(F.lit(c).alias("cut"), colour.dark(F.col("p100"), c).alias("dark")) for c in (30, 50, 70)]))
    return t.select("image_id", cuts.alias("c")).groupBy("image_id", "c.cut").agg(F.sum("c.dark").alias("dark"))


@query("P11_luminance", "px", f"SELECT image_id, y, x, CAST((r * 19595 + g * 38470 + b * 7471 + 32768) >> 16 AS INTEGER) AS grey, round((r + g + b) / 3.0::DOUBLE, 6) AS mean FROM {RGB}")
def luminance(spark, d):
    t = rgb_px(spark, d)
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    return t.select("image_id", "y", "x", colour.luminance(r, g, b).alias("grey"), F.round(colour.channel_mean(r, g, b), 6).alias("mean"))


view("cc", "SELECT image_id, dataset, rgb, count(*) AS n FROM mask_px GROUP BY ALL", "mask_px")


@query("A01_colour_counts", "cc", "SELECT image_id, rgb, n FROM cc")
def colour_counts(spark, d):
    return palette.colour_counts(fixtures.mask_px(spark, d))


@query("A01_colour_counts_rich", "px", f"SELECT image_id, CAST(r * 65536 + g * 256 + b AS INTEGER) AS rgb, count(*) AS n FROM {RGB} GROUP BY 1, 2")
def colour_counts_rich(spark, d):
    return palette.colour_counts(rgb_px(spark, d).withColumn("rgb", colour.pack(F.col("r"), F.col("g"), F.col("b"))))


@query("A02_palette_report", "px", f"""
SELECT image_id, n_unique, pixels::BIGINT AS pixels, round(head / pixels, 6) AS coverage, n_unique <= 32 OR (head / pixels >= 0.995 AND n_unique <= 512) AS quantized
FROM (SELECT image_id, count(*) AS n_unique, sum(n) AS pixels, sum(CASE WHEN k <= 32 THEN n ELSE 0 END)::DOUBLE AS head FROM (
  SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, rgb) AS k FROM (
   SELECT image_id, r * 65536 + g * 256 + b AS rgb, count(*) AS n FROM (SELECT * REPLACE (y // (1 + image_id % 32) AS b, p100 // (1 + image_id % 40) AS r) FROM {RGB}) GROUP BY 1, 2)) GROUP BY 1)""")
def palette_report(spark, d):
    t = rgb_px(spark, d)
    i = F.col("image_id")
    rgb = colour.pack(F.floor(F.col("r") / (1 + i % 40)), F.col("g"), F.floor(F.col("b") / (1 + i % 32)))
    out = palette.palette_report(palette.colour_counts(t.withColumn("rgb", rgb)))
    return out.withColumn("coverage", F.round("coverage", 6))


view("pooledshare", "SELECT dataset, rgb, sum(n)::BIGINT AS n, sum(n) / sum(sum(n)) OVER (PARTITION BY dataset)::DOUBLE AS share FROM cc GROUP BY 1, 2", "cc")


def _counts(spark, d):
    return palette.colour_counts(fixtures.mask_px(spark, d), ("image_id", "dataset"))


@query("A05_pooled_palette", "cc", """
SELECT dataset, rgb, n, round(n / tot, 6) AS share FROM (SELECT dataset, rgb, sum(n)::BIGINT AS n, sum(sum(n)) OVER (PARTITION BY dataset)::DOUBLE AS tot FROM (
   SELECT * FROM cc QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY n DESC, rgb) <= 20) GROUP BY 1, 2)
QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY n DESC, rgb) <= 20""")
def pooled_palette(spark, d):
    return palette.pooled_palette(_counts(spark, d), ("dataset",), ("image_id", "dataset")).withColumn("share", F.round("share", 6))


@query("A08_value_histogram", "pooledshare", "SELECT dataset, rgb, n, round(share, 6) AS share FROM pooledshare")
def value_histogram(spark, d):
    return palette.pooled_shares(_counts(spark, d)).withColumn("share", F.round("share", 6))


@query("K01_top_colours", "cc", "SELECT image_id, rgb, n FROM cc QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY n DESC, rgb) <= 5")
def top_colours(spark, d):
    return palette.top_colours(palette.colour_counts(fixtures.mask_px(spark, d)), 5)


view("walk", "SELECT dataset, rgb, share, row_number() OVER (PARTITION BY dataset ORDER BY share DESC, rgb) AS i FROM pooledshare WHERE share >= 0.002", "pooledshare")
view("kept", """(dataset, i, peaks) AS (
  SELECT DISTINCT dataset, 0::BIGINT, []::INTEGER[] FROM walk
  UNION ALL
  SELECT k.dataset, w.i, CASE WHEN len(list_filter(k.peaks, lambda p: power((p >> 16) - (w.rgb >> 16), 2) + power(((p >> 8) & 255) - ((w.rgb >> 8) & 255), 2) + power((p & 255) - (w.rgb & 255), 2) <= 2304)) = 0
    THEN list_append(k.peaks, w.rgb) ELSE k.peaks END FROM kept k JOIN walk w ON w.dataset = k.dataset AND w.i = k.i + 1)""", "walk")
view("palette", """
SELECT dataset, unnest(peaks) AS rgb, CAST(unnest(range(len(peaks))) AS INTEGER) AS idx FROM kept
QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY i DESC) = 1""", "kept")


def _palette(spark, d):
    return palette.derive_palette(palette.pooled_shares(_counts(spark, d)))


@query("A09_derive_palette", "palette pooledshare", "SELECT p.dataset, p.idx, p.rgb, round(s.share, 6) AS share FROM palette p JOIN pooledshare s USING (dataset, rgb)")
def derive_palette(spark, d):
    return _palette(spark, d).withColumn("share", F.round("share", 6))


D2 = "(power((p.rgb >> 16) - (m.rgb >> 16), 2) + power(((p.rgb >> 8) & 255) - ((m.rgb >> 8) & 255), 2) + power((p.rgb & 255) - (m.rgb & 255), 2))"
view("snapped", f"""SELECT m.*, q.idx AS label2, q.d2 FROM mask_px m JOIN (
  SELECT m.dataset, m.rgb, CAST(arg_min(p.idx, ({D2}) * 1000 + p.idx) AS INTEGER) AS idx, CAST(min({D2}) AS INTEGER) AS d2
  FROM (SELECT DISTINCT dataset, rgb FROM mask_px) m JOIN palette p ON p.dataset = m.dataset GROUP BY 1, 2) q
  ON q.dataset = m.dataset AND q.rgb = m.rgb""", "mask_px palette")


@query("J05_nearest_colour", "snapped", "SELECT image_id, y, x, label2 AS label, d2 FROM snapped")
def nearest(spark, d):
    px = fixtures.mask_px(spark, d).drop("label")
    return palette.snap_to_palette(px, _palette(spark, d)).select("image_id", "y", "x", "label", "d2")


@query("J05_unsnapped_share", "snapped palette", """
SELECT image_id, round(count(*) FILTER (d2 * 4 > gap) / count(*)::DOUBLE, 6) AS unsnapped FROM snapped JOIN (
  SELECT p.dataset, min(power((p.rgb >> 16) - (m.rgb >> 16), 2) + power(((p.rgb >> 8) & 255) - ((m.rgb >> 8) & 255), 2) + power((p.rgb & 255) - (m.rgb & 255), 2)) AS gap
  FROM palette p JOIN palette m ON m.dataset = p.dataset AND m.idx <> p.idx GROUP BY 1) USING (dataset) GROUP BY 1""")
def unsnapped(spark, d):
    pal = _palette(spark, d)
    s = palette.snap_to_palette(fixtures.mask_px(spark, d).drop("label"), pal)
    return palette.unsnapped_share(s, pal).select("image_id", F.round("unsnapped", 6).alias("unsnapped"))


@query("J05_label_map", "cc mask_px", """
SELECT m.image_id, m.y, m.x, t.idx AS label FROM mask_px m JOIN (
  SELECT c.image_id, c.rgb, arg_min(k.idx, power((k.rgb >> 16) - (c.rgb >> 16), 2) * 1000000 + power(((k.rgb >> 8) & 255) - ((c.rgb >> 8) & 255), 2) * 1000000 + power((k.rgb & 255) - (c.rgb & 255), 2) * 1000000 + k.idx) AS idx
  FROM cc c JOIN (SELECT image_id, rgb, CAST(row_number() OVER (PARTITION BY image_id ORDER BY n DESC, rgb) - 1 AS INTEGER) AS idx FROM cc QUALIFY idx < 6) k USING (image_id) GROUP BY 1, 2) t USING (image_id, rgb)""")
def label_map(spark, d):
    return palette.label_map(fixtures.mask_px(spark, d).drop("label"), max_labels=6).select("image_id", "y", "x", "label")


@query("W09_colour_test_order", "cc", """
SELECT image_id, rgb, n, CASE WHEN k = 1 THEN 'majority' WHEN n < 64 THEN 'too small' WHEN k > 65 THEN 'past cap' ELSE 'tested' END AS status
FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, rgb) AS k FROM cc)""")
def colour_order(spark, d):
    return palette.test_order(palette.colour_counts(fixtures.mask_px(spark, d)))


@query("A06_votes", "px", """
SELECT dataset, majority, votes FROM (SELECT dataset, arg_min(label, -n * 1000 + label) AS majority, string_agg(label || ':' || n, ',' ORDER BY label) AS votes
 FROM (SELECT dataset, label, count(*) AS n FROM px GROUP BY 1, 2) GROUP BY 1)""")
def votes(spark, d):
    v = palette.votes(fixtures.px(spark, d), "label")
    flat = F.array_join(F.transform(F.array_sort(F.map_entries("votes")), lambda e: F.concat(
        e.getField("key").cast("string"), F.lit(":"), e.getField("value").cast("string"))), ",")
    return v.select("dataset", "majority", flat.alias("votes"))


@query("A40_hsv_window", "hsvb", """
SELECT dataset, n, wraps, round(CASE WHEN wraps THEN (tl + 90) % 180 ELSE hl END, 6) AS h_lo, round(CASE WHEN wraps THEN (th + 90) % 180 ELSE hh END, 6) AS h_hi,
  round(sl, 6) AS s_lo, round(vh, 6) AS v_hi FROM (SELECT *, hh - hl > 90 AS wraps FROM (
    SELECT dataset, count(*) AS n, quantile_cont(h, 0.02) hl, quantile_cont(h, 0.98) hh, quantile_cont((h + 90) % 180, 0.02) tl,
      quantile_cont((h + 90) % 180, 0.98) th, quantile_cont(s, 0.02) sl, quantile_cont(v, 0.98) vh FROM hsvb GROUP BY 1))""")
def derive_window(spark, d):
    px = rgb_px(spark, d).withColumn("rgb", colour.pack(F.col("r"), F.col("g"), F.col("b")))
    w = palette.hsv_window(px)
    return w.select("dataset", F.col("n_pixels").alias("n"), F.col("wraps_hue").alias("wraps"),
                    F.round(F.get("lower", F.lit(0)), 6).alias("h_lo"), F.round(F.get("upper", F.lit(0)), 6).alias("h_hi"),
                    F.round(F.get("lower", F.lit(1)), 6).alias("s_lo"), F.round(F.get("upper", F.lit(2)), 6).alias("v_hi"))


@query("P23_folded_colours", "snapped palette", """
SELECT s.image_id, s.y, s.x, CASE WHEN s.label2 <> 0 AND w.rgb IS NOT NULL THEN 0 ELSE s.label2 END AS label FROM snapped s
JOIN palette p ON p.dataset = s.dataset AND p.idx = s.label2 LEFT JOIN (SELECT dataset, max(rgb) AS rgb FROM palette GROUP BY 1) w ON w.dataset = s.dataset AND w.rgb = p.rgb""")
def folded(spark, d):
    pal = _palette(spark, d)
    watched = pal.groupBy("dataset").agg(F.max("rgb").alias("rgb"))
    s = palette.snap_to_palette(fixtures.mask_px(spark, d).drop("label"), pal).drop("d2")
    return palette.fold_colours(s, pal, watched, True).select("image_id", "y", "x", "label")


@query("P24_domain_assertion", "px", "SELECT p100 AS value, count(*) AS n FROM px WHERE p100 NOT IN (50, 60, 70) GROUP BY 1")
def domain(spark, d):
    return checks.outside_domain(fixtures.px(spark, d).select(F.col("p100").alias("value")), "value", (50, 60, 70))
