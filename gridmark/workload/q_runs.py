"""Run histories, comparisons, scalar rules, merges and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridmark.functions import scalars
from gridmark.operators import history
from gridmark.plans import tiling
from gridmark.session import cut, shared_folder
from gridmark.sources import reports, store
from gridmark.streaming import accumulate, arrivals
from gridmark.workload import fixtures
from gridmark.workload.q_sweep import GRID, RATIOS, rounded
from gridmark.workload.registry import query
from gridmark.workload.views import view

view("runs", """SELECT *, score > coalesce(max(score) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS is_best FROM history""", "history")
view("since", "SELECT *, epoch - max(CASE WHEN is_best THEN epoch END) OVER (PARTITION BY run ORDER BY epoch) AS since FROM runs", "runs")


@query("W02_running_best", "runs", "SELECT run, epoch::BIGINT AS epoch, is_best FROM runs")
def running_best(spark, d):
    return history.running_best(fixtures.history(spark, d)).select("run", F.col("epoch").cast("bigint").alias("epoch"), "is_best")


@query("W03_since_improvement", "since", "SELECT run, epoch::BIGINT AS epoch, since::BIGINT AS since FROM since")
def since(spark, d):
    return history.since_improvement(fixtures.history(spark, d)).select("run", F.col("epoch").cast("bigint").alias("epoch"), F.col("since").cast("bigint").alias("since"))


@query("W04_early_stop", "since", """SELECT run, min(epoch) FILTER (since >= 20)::BIGINT AS stop_epoch, max(epoch)::BIGINT AS last_epoch,
  max(epoch) >= 99 OR min(epoch) FILTER (since >= 20) IS NOT NULL AS complete FROM since GROUP BY 1""")
def early_stop(spark, d):
    out = history.early_stop(fixtures.history(spark, d), 20, 100)
    return out.withColumns({c: F.col(c).cast("bigint") for c in ("stop_epoch", "last_epoch")})


@query("W05_best_epoch", "history", "SELECT run, epoch::BIGINT AS epoch, score, event_type FROM history QUALIFY row_number() OVER (PARTITION BY run ORDER BY score DESC, epoch) = 1")
def best_epoch(spark, d):
    return history.best_epoch(fixtures.history(spark, d), ["event_type"]).withColumn("epoch", F.col("epoch").cast("bigint"))


@query("W13_score_key", "history", """SELECT run, (epoch // 5)::BIGINT AS epoch, coalesce(max(score) FILTER (event_type = 'click'), max(score) FILTER (event_type = 'view')) AS score FROM history GROUP BY 1, 2""")
def score_key(spark, d):
    h = fixtures.history(spark, d).select("run", F.expr("cast(epoch div 5 as bigint)").alias("epoch"), F.col("event_type").alias("dataset"), "score")
    return history.score_key(h, "click", "view")


@query("F11_compare_runs", "history", """
SELECT h.run, h.event_type AS dataset, h.epoch::BIGINT AS epoch, h.score AS dice, h.run % 3 AS tiles, count(*) OVER (PARTITION BY h.event_type) AS runs,
  min(h.run % 3) OVER (PARTITION BY h.event_type) = max(h.run % 3) OVER (PARTITION BY h.event_type) AS comparable
FROM history h JOIN (SELECT run, epoch FROM history QUALIFY row_number() OVER (PARTITION BY run ORDER BY score DESC, epoch) = 1) b USING (run, epoch)""")
def compare(spark, d):
    h = fixtures.history(spark, d).select("run", F.col("epoch").cast("bigint").alias("epoch"), "score", F.col("score").alias("dice"), F.col("event_type").alias("dataset"), (F.col("run") % 3).alias("tiles"))
    return history.compare_runs(h)


@query("J11_metric_delta", "history", """
SELECT coalesce(a.run, b.run) AS run, a.score AS old, b.score AS new, round(b.score - a.score, 6) AS delta FROM (SELECT run, score FROM history WHERE epoch = 5 AND run % 3 <> 0) a
FULL OUTER JOIN (SELECT run, score FROM history WHERE epoch = 9 AND run % 4 <> 0) b ON a.run = b.run""")
def delta(spark, d):
    h = fixtures.history(spark, d)
    out = history.metric_delta(h.filter("epoch = 5 and run % 3 <> 0"), h.filter("epoch = 9 and run % 4 <> 0"), ["run"], "score")
    return out.withColumn("delta", F.round("delta", 6))


def settings(spark, d, salt):
    n = fixtures.table(spark, d, "customer")
    return n.filter(F.col("c_custkey") % 10 != salt).select(F.col("c_name").alias("key"), F.when(F.col("c_custkey") % 7 == salt, "x").otherwise(F.col("c_mktsegment")).alias("value"))


SETTINGS = "(SELECT c_name AS key, CASE WHEN c_custkey % 7 = {s} THEN 'x' ELSE c_mktsegment END AS value FROM customer WHERE c_custkey % 10 <> {s})"


@query("J11_config_diff", "", f"""SELECT coalesce(a.key, b.key) AS key, coalesce(a.value, '<absent>') AS old, coalesce(b.value, '<absent>') AS new
FROM {SETTINGS.format(s=1)} a FULL OUTER JOIN {SETTINGS.format(s=2)} b ON a.key = b.key WHERE a.value IS DISTINCT FROM b.value""")
def config_diff(spark, d):
    return history.config_diff(settings(spark, d, 1), settings(spark, d, 2))


@query("S11_settings_drift", "", f"""SELECT coalesce(a.key, b.key) AS key, a.value AS old, b.value AS new
FROM {SETTINGS.format(s=1)} a FULL OUTER JOIN {SETTINGS.format(s=2)} b ON a.key = b.key WHERE a.value IS DISTINCT FROM b.value""")
def drift(spark, d):
    return reports.settings_drift(settings(spark, d, 1), settings(spark, d, 2))


FOLD_STATS = """SELECT o_custkey % 400 AS fold, 256 AS patch, 128 AS stride, 0.005::DOUBLE AS min_frac, 7 AS seed, count(*) AS n_tiles, max(o_orderkey) AS last FROM orders WHERE {where} GROUP BY 1"""


@query("S10_merge_fold_stats", "", f"""
WITH a AS ({FOLD_STATS.format(where="o_orderkey % 2 = 0 AND o_custkey % 400 < 300")}), b AS ({FOLD_STATS.format(where="o_orderkey % 3 = 0 AND o_custkey % 400 >= 100")})
SELECT fold, 'untouched' AS action, n_tiles, last FROM a ANTI JOIN b USING (fold)
UNION ALL SELECT b.fold, CASE WHEN a.fold IS NULL THEN 'added' ELSE 'replaced' END, b.n_tiles, b.last FROM b LEFT JOIN a ON a.fold = b.fold""")
def merge_stats(spark, d):
    """The merged table as it is on disk after both writes, beside what became of each fold."""
    stats = (fixtures.table(spark, d, "orders").withColumn("fold", F.col("o_custkey") % 400).groupBy("fold", F.col("o_orderkey") % 2 == 0, F.col("o_orderkey") % 3 == 0)
             .agg(F.count("*").alias("n_tiles"), F.max("o_orderkey").alias("last")).toDF("fold", "even", "third", "n_tiles", "last"))

    def made(where):
        sums = stats.filter(where).groupBy("fold").agg(F.sum("n_tiles").alias("n_tiles"), F.max("last").alias("last"))
        return sums.select("fold", F.lit(256).alias("patch"), F.lit(128).alias("stride"), F.lit(0.005).alias("min_frac"), F.lit(7).alias("seed"), "n_tiles", "last")

    old, new = made("even and fold < 300"), made("third and fold >= 100")
    path = f"{shared_folder(spark, 'fold-stats')}/stats"
    store.write_fold_stats(old, path)
    merged = store.merge_fold_stats(spark.read.parquet(path), new)
    store.write_fold_stats(cut(merged), path)
    return spark.read.parquet(path).select(F.col("fold").cast("long").alias("fold"), "n_tiles", "last").join(reports.merge_status(old, new, "fold"), "fold")


@query("S10_refused_fold_stats", "", """
SELECT DISTINCT patch, stride, min_frac, seed FROM (SELECT 128 + 64 * (o_orderkey % 3) AS patch, 128 AS stride, 0.005::DOUBLE AS min_frac, 7 AS seed FROM orders) WHERE patch <> 256""")
def refused_stats(spark, d):
    """Settings for which the merge is refused."""
    o = fixtures.table(spark, d, "orders")
    with_patch = lambda p, rows: rows.select(F.col("o_custkey").alias("fold"), p.cast("long").alias("patch"), F.lit(128).alias("stride"), F.lit(0.005).alias("min_frac"),
                                             F.lit(7).alias("seed")).distinct()
    return store.other_settings(with_patch(F.lit(256), o), with_patch(128 + F.col("o_orderkey") % 3 * 64, o)).select("patch", "stride", "min_frac", "seed")


@query("S11_merge_extraction", "", """
SELECT p_brand AS dataset, n, src FROM (SELECT p_brand, count(*) AS n, 'new' AS src FROM part WHERE p_size > 48 GROUP BY 1
 UNION ALL SELECT p_brand, count(*), 'old' FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size > 48) GROUP BY 1)""")
def merge_extraction(spark, d):
    p = fixtures.table(spark, d, "part").select(F.col("p_brand").alias("dataset"), "p_size")
    old = p.groupBy("dataset").agg(F.count("*").alias("n"), F.lit("old").alias("src"))
    new = p.filter("p_size > 48").groupBy("dataset").agg(F.count("*").alias("n"), F.lit("new").alias("src"))
    return reports.merge_by_key(old, new, ["dataset"])


@query("X04_safe_div", "", "SELECT l_orderkey, l_linenumber, round(CASE WHEN l_discount * 100 > 2 THEN l_tax / (l_discount * 100 - 2) ELSE 0.0 END, 6) AS r FROM lineitem")
def safe_div(spark, d):
    li = fixtures.table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", F.round(scalars.safe_div(F.col("l_tax"), F.col("l_discount") * 100 - 2), 6).alias("r"))


@query("X05_threshold_snapping", "", """SELECT event_id, CAST(CAST((event_id % 997) / 1000.0::DOUBLE AS FLOAT) AS DOUBLE) AS snapped FROM events""")
def snapping(spark, d):
    g = scalars.snapped_grid(F.array((F.col("event_id") % 997) / F.lit(1000.0)))
    return fixtures.table(spark, d, "events").select("event_id", F.get(g, F.lit(0)).alias("snapped"))


@query("X06_math", "", """SELECT p_partkey, (p_size * (p_size - 1) / 2)::DOUBLE AS pairs, round(sqrt(p_size::DOUBLE * p_size + 9), 6) AS hyp, CAST(ceil((p_size + 2) / sqrt(2)) AS BIGINT) AS rounds, round(1 / (1 + exp(-p_size / 10.0::DOUBLE)), 6) AS sig FROM part""")
def math(spark, d):
    from gridmark.operators.losses import sigmoid
    s = F.col("p_size")
    return fixtures.table(spark, d, "part").select("p_partkey", scalars.choose_two(s).alias("pairs"), F.round(F.hypot(s.cast("double"), F.lit(3.0)), 6).alias("hyp"),
                                                   F.ceil((s + 2) / F.sqrt(F.lit(2.0))).alias("rounds"), F.round(sigmoid(s / F.lit(10.0)), 6).alias("sig"))


@query("X07_circular_mod", "", "SELECT p_partkey, ((p_size * 3 - 90) % 180 + 180) % 180 AS h FROM part")
def circular(spark, d):
    return fixtures.table(spark, d, "part").select("p_partkey", F.pmod(F.col("p_size") * 3 - 90, F.lit(180)).alias("h"))


@query("X10_group_fingerprint", "", """
SELECT dataset, substr(sha256(count(*) || '|' || sum(a)::BIGINT || '|' || sum(b)::BIGINT || '|' || sum(c)::BIGINT || '|' || sum(e)::BIGINT), 1, 16) AS fingerprint FROM (
 SELECT dataset, CAST(concat('0x', substr(h, 1, 8)) AS BIGINT) AS a, CAST(concat('0x', substr(h, 9, 8)) AS BIGINT) AS b, CAST(concat('0x', substr(h, 17, 8)) AS BIGINT) AS c, CAST(concat('0x', substr(h, 25, 8)) AS BIGINT) AS e
 FROM (SELECT p_brand AS dataset, md5(p_partkey || '|' || p_name) AS h FROM part)) GROUP BY 1""")
def fingerprint(spark, d):
    p = fixtures.table(spark, d, "part").withColumnRenamed("p_brand", "dataset")
    return store.group_fingerprints(p, ["dataset"], ["p_partkey", "p_name"])


@query("X12_iso_utc", "", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events")
def iso(spark, d):
    return fixtures.table(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"))


@query("F05_tile_index", "mtiles", """
SELECT dataset, images, excluded, planned, kept, dropped, parents, lost AS images_lost, parents = images - excluded AS parents_ok,
       CASE WHEN dataset IN ('d0', 'd1') THEN most <= 1 END AS single_ok
FROM (SELECT dataset, count(*) AS images, count(*) FILTER (out) AS excluded, sum(n)::BIGINT AS planned, sum(k)::BIGINT AS kept, sum(n - k)::BIGINT AS dropped,
             count(*) FILTER (k > 0) AS parents, count(*) FILTER (n = 1 AND k = 0) AS lost, max(CASE WHEN NOT out THEN n END) AS most
      FROM (SELECT dataset, image_id, image_id % 5 = 2 AS out, CASE WHEN image_id % 5 = 2 THEN 0 ELSE count(*) END AS n,
                   CASE WHEN image_id % 5 = 2 THEN 0 ELSE count(*) FILTER (outline_fraction >= 0.3) END AS k FROM mtiles GROUP BY 1, 2) GROUP BY 1)""")
def tile_index(spark, d):
    from gridmark.workload.q_tiling import mosaic_images
    pairs = mosaic_images(spark, d).withColumn("image_path", F.format_string("/data/%s/im%d.png", "dataset", "image_id"))
    excluded = pairs.filter("image_id % 5 = 2").select("dataset", F.format_string("im%d.png", "image_id").alias("source_image"))
    index = cut(tiling.build_index(pairs, fixtures.truth(spark, d), 14, 7, minimum=0.3, excluded=excluded))
    expected = pairs.filter("image_id % 5 <> 2").groupBy("dataset").agg(F.count("*").alias("parents"))
    return tiling.index_report(pairs, index, expected, ["d0", "d1"])


@query("T01_streaming_sweep", "metrics", "SELECT * FROM metrics")
def streaming_sweep(spark, d):
    folder = shared_folder(spark, "sweep")
    # every file holds every fourth row of all images and arrives as its own micro-batch, so no batch has a whole tile;
    # the last mosaic need not fill its rectangle, so a pixel says how many its tile has
    has = F.count("*").over(Window.partitionBy("image_id")).alias("pixels")
    pixels = cut(fixtures.prob_px(spark, d).select("image_id", "dataset", "height", "width", "y", "x", "prob", "true", has))
    for i in range(4):
        pixels.filter(F.col("y") % 4 == i).coalesce(1).write.mode("append").parquet(f"{folder}/arriving")
    stream = spark.readStream.schema(pixels.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/arriving")
    q = accumulate.accumulate_stream(stream, folder, GRID, pixels="pixels")
    q.awaitTermination()
    out = accumulate.result(spark, folder, GRID)
    return rounded(out.select("dataset", "threshold", "tp", "n_pred", *RATIOS), *RATIOS)


@query("T02_arrivals", "", """
SELECT source AS dataset, path, regexp_extract(path, '([^/]+)[.][^./]+$', 1) AS stem FROM (
  SELECT DISTINCT source, '/data/' || source || '/images/' || doc_id || CASE WHEN doc_id % 10 = 0 THEN '.txt' ELSE '.png' END AS path FROM documents) WHERE path LIKE '%.png'""")
def arrivals_recorded(spark, d):
    """A listing that is delivered in three parts which overlap."""
    folder = shared_folder(spark, "arrivals")
    docs = fixtures.table(spark, d, "documents")
    listing = docs.select(F.col("source").alias("dataset"), "doc_id", F.concat(F.lit("/data/"), "source", F.lit("/images/"), F.col("doc_id").cast("string"),
                                                                               F.when(F.col("doc_id") % 10 == 0, ".txt").otherwise(".png")).alias("path"))
    for part in ("doc_id % 3 = 0", "doc_id % 3 < 2", "doc_id % 3 > 0"):
        listing.filter(part).select("dataset", "path").coalesce(1).write.mode("append").parquet(f"{folder}/arriving")
    stream = spark.readStream.schema("dataset string, path string").option("maxFilesPerTrigger", 1).parquet(f"{folder}/arriving")
    arrivals.record_arrivals(stream, folder).awaitTermination()
    return spark.read.parquet(f"{folder}/files").select("dataset", "path", "stem")
