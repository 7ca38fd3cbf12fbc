"""Views of the driver's tables as rasters, tiles, file listings, scores and histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: columns that are constant per image; as keys they cost nothing in a hash aggregate, whereas
#: max() of a string would force a sort
IMAGE = ("image_id", "dataset", "parent_id", "split")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mosaic raster: 16 vectors of 64 values form a 4 x 4 mosaic of 8 x 8 blocks.

    The last image is shorter when the vectors run out; no vector is dropped.
    """
    return px_of(table(spark, sf_dir, "embeddings"))


def px_of(embeddings: DataFrame) -> DataFrame:
    slots = F.count("*").over(W.partitionBy("image_id"))  # at most 16 rows by construction
    vectors = (embeddings
               .select(F.expr("vec_id div 16").alias("image_id"), (F.col("vec_id") % 16).cast("int").alias("slot"),
                       "label", "embedding")
               .withColumn("n", slots.cast("int")))
    parent = F.expr("image_id div 4")
    flat = vectors.select(
        "image_id", F.concat(F.lit("d"), (F.col("image_id") % 3).cast("string")).alias("dataset"),
        parent.alias("parent_id"),
        F.when(parent % 5 == 0, "val").when(parent % 5 == 1, "test").otherwise("train").alias("split"),
        F.expr("8 * ((n + 3) div 4)").cast("int").alias("height"), (F.least(F.col("n"), F.lit(4)) * 8).alias("width"),
        "slot", "label", F.posexplode("embedding").alias("pos", "v"))
    p100 = F.greatest(F.lit(0), F.least(F.lit(99), F.floor((F.col("v").cast("double") + F.lit(0.6)) * 100)))
    out = flat.select(
        "image_id", "dataset", "parent_id", "split", "height", "width",
        F.expr("(slot div 4) * 8 + pos div 8").cast("int").alias("y"),
        ((F.col("slot") % 4) * 8 + F.col("pos") % 8).cast("int").alias("x"),
        "label", p100.cast("int").alias("p100"))
    return out.withColumn("prob", (F.col("p100") / F.lit(100.0)).cast("float"))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thick label outline of the mosaic, as a mask."""
    from gridmark.operators.raster import find_outlines

    return find_outlines(px(spark, sf_dir))


def prob_px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mosaic pixels with probability and outline truth.

    Truth comes from the same neighbourhood pass that carries the pixel, so no join is needed.
    """
    return prob_px_of(table(spark, sf_dir, "embeddings"))


def prob_px_of(embeddings: DataFrame) -> DataFrame:
    from gridmark.operators.raster import PLUS, centre, focal

    carry = ["label", "p100", "prob"]
    spread = focal(px_of(embeddings), PLUS,
                   [F.min("label").alias("lo"), F.max("label").alias("hi"),
                    *[centre(F.col(c)).alias(c) for c in carry]], carry, IMAGE)
    return spread.withColumn("true", F.col("lo") < F.col("hi")).drop("lo", "hi")


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("tile_id"), F.col("o_orderpriority").alias("dataset"),
                    (F.col("o_custkey") % 97).alias("parent_id"),
                    ((F.col("o_orderkey") % 1000).cast("double") / F.lit(10000.0)).alias("outline_fraction"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image and mask listing: one image per document, one mask per label row."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    labels = table(spark, sf_dir, "labels").select("doc_id").distinct()
    images = docs.select(F.col("source").alias("dataset"),
                         F.concat(F.lit("/data/"), "source", F.lit("/images/"), "doc_id", F.lit(".png")).alias("path"))
    masks = docs.join(labels, "doc_id").select(
        F.col("source").alias("dataset"),
        F.concat(F.lit("/data/"), "source", F.lit("/masks/"), "doc_id", F.lit("_mask.png")).alias("path"))
    return images.unionByName(masks)


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, la = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    p100 = (F.col("n_chars") % 100).cast("int")
    return (d.select("doc_id", F.col("lang").alias("dataset"), p100.alias("p100"))
            .join(la.select("doc_id", (F.col("quality") == 1).alias("true")), "doc_id")
            .withColumn("prob", (F.col("p100") / F.lit(100.0)).cast("float")))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    epoch = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select(F.col("user_id").alias("run"), epoch.alias("epoch"), F.col("value").alias("score"), "event_type")


def image_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image dimensions for tile planning."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("image_id"), F.concat(F.lit("img"), "p_partkey").alias("stem"),
                    F.col("p_brand").alias("dataset"),
                    (200 + F.col("p_partkey") % 900).cast("int").alias("width"),
                    (200 + F.col("p_size") * 17).cast("int").alias("height"))


def mask_px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mosaic as an RGB mask: one colour per label, a brighter variant on a tenth of the pixels."""
    from gridmark.functions.colour import pack

    blue = 100 + F.when(F.col("p100") >= 90, 8).otherwise(0)
    return px(spark, sf_dir).withColumn("rgb", pack(F.col("label") * 25, 250 - F.col("label") * 25, blue))


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file listing with other mask naming in some datasets (bare, odd suffix, upper case)."""
    src, p = F.col("dataset"), F.col("path")
    renamed = (F.when(src == "src1", F.replace(p, F.lit("_mask.png"), F.lit("_zz9.png")))
               .when(src == "src2", F.replace(p, F.lit("_mask.png"), F.lit(".png")))
               .when(src == "src3", F.regexp_replace(p, "/([0-9]+)_mask.png$", "/IMG$1_mask.PNG"))
               .otherwise(p))
    images = F.when((src == "src3") & F.contains(p, F.lit("/images/")), F.regexp_replace(p, "/([0-9]+).png$", "/img$1.png"))
    return files(spark, sf_dir).withColumn("path", F.coalesce(images, renamed))
