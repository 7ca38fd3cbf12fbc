"""Matching images to masks by name, and everything that fails to match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmark.functions import names
from gridmark.session import cut


def describe_files(listing: DataFrame) -> DataFrame:
    """``(dataset, path, dir, name, stem, ext)`` of the image files of a listing."""
    p = F.col("path")
    return (listing.filter(names.is_image(p))
            .withColumns({"dir": names.directory(p), "name": names.file_name(p), "stem": names.stem(p),
                          "ext": names.extension(p)}))


def layout(files: DataFrame, root: Column) -> DataFrame:
    """Layout of every dataset: its image and mask directory, or flat files told apart by affix.

    ``root`` is the dataset's own folder; only directories below it count.  Directories are few
    even where files are many: files collapse to directories first.
    """
    dirs = files.select("dataset", F.substring(F.col("dir"), F.length(root) + 2, F.length("dir")).alias("below"),
                        root.alias("root")).distinct().filter("below <> ''")
    parts = F.split("below", "/")
    each = dirs.select("dataset", "root", parts.alias("parts"),
                       F.explode(F.sequence(F.lit(1), F.size(parts))).alias("depth"))
    ancestors = each.select(
        "dataset", "depth", F.concat("root", F.lit("/"), F.array_join(F.slice("parts", F.lit(1), F.col("depth")), "/")).alias("dir"),
        names.dir_role(F.element_at("parts", F.col("depth"))).alias("role")).distinct()
    picked = ancestors.groupBy("dataset").agg(
        F.min_by(F.when(F.col("role") == "image", F.col("dir")),
                 F.when(F.col("role") == "image", F.struct("depth", "dir"))).alias("image_dir"),
        F.min_by(F.when(F.col("role") == "mask", F.col("dir")),
                 F.when(F.col("role") == "mask", F.struct("depth", "dir"))).alias("mask_dir"))
    both = F.col("image_dir").isNotNull() & F.col("mask_dir").isNotNull()
    every = files.select("dataset").distinct().join(picked, "dataset", "left")
    return every.select("dataset", F.when(both, "split-dirs").otherwise("flat-affix").alias("layout"),
                        F.when(both, F.col("image_dir")).alias("image_dir"),
                        F.when(both, F.col("mask_dir")).alias("mask_dir"))


def with_roles(files: DataFrame, layouts: DataFrame) -> DataFrame:
    """Files with role image or mask; files of neither directory are dropped."""
    f = files.join(layouts, "dataset")
    under = {r: F.startswith(F.col("path"), F.concat(F.col(f"{r}_dir"), F.lit("/"))) for r in ("image", "mask")}
    role = (F.when(F.col("layout") == "flat-affix", F.when(names.has_affix(F.col("stem")), "mask").otherwise("image"))
            .when(under["image"], "image").when(under["mask"], "mask"))
    return f.withColumn("role", role).filter("role is not null").drop("layout", "image_dir", "mask_dir")


def discover(listing: DataFrame, root: Column) -> DataFrame:
    """Files with their roles, materialised once: pairing reads this listing several times."""
    described = cut(describe_files(listing))
    return cut(with_roles(described, layout(described, root)))


def discover_pairs(files: DataFrame) -> DataFrame:
    """Pairs under the inferred affix of every dataset."""
    return pair(files, cut(infer_affix(files)))


def infer_affix(files: DataFrame) -> DataFrame:
    """``(dataset, affix)`` that turns mask stems into image stems, by counting matches.

    Every mask stem is exploded over the short candidate list and matched by equality.  Where no
    known affix reaches half of the masks, every tail of the masks' common suffix competes too.
    """
    images = files.filter("role = 'image'").select("dataset", F.col("stem").alias("key")).distinct()
    masks = files.filter("role = 'mask'").select("dataset", "stem")
    known = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(a).alias("affix"))
                      for i, a in enumerate(("", *names.AFFIXES))])
    sizes = masks.groupBy("dataset").agg(F.count("*").alias("n_masks"), F.min(F.reverse("stem")).alias("lo"),
                                         F.max(F.reverse("stem")).alias("hi"))
    common = F.aggregate(F.sequence(F.lit(1), F.lit(24)), F.lit(0), lambda k, i: F.when(
        (F.length("lo") >= i) & (F.substring("lo", F.lit(1), i) == F.substring(F.col("hi"), F.lit(1), i)), i).otherwise(k))
    tails = sizes.withColumn("common", common).select("dataset", F.transform(
        F.when(F.col("common") > 0, F.sequence(F.col("common"), F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>")),
        lambda k: F.struct((F.lit(100) - k).alias("place"), F.reverse(F.substring(F.col("lo"), F.lit(1), k)).alias("affix"))).alias("tails"))

    def scored(candidates: DataFrame) -> DataFrame:
        key = names.strip_affix(F.col("stem"), F.col("c.affix"))
        rows = candidates.select("dataset", F.col("c.place").alias("place"), F.col("c.affix").alias("affix"), key.alias("key"))
        return (rows.join(images, ["dataset", "key"], "left_semi").groupBy("dataset", "place", "affix")
                .agg(F.count("*").alias("score")))

    best = F.max_by(F.struct("affix", "score"), F.struct("score", -F.col("place")))
    listed = scored(masks.withColumn("c", F.explode(known))).groupBy("dataset").agg(best.alias("b"))
    status = sizes.select("dataset", "n_masks").join(listed, "dataset", "left").select(
        "dataset", "n_masks", F.coalesce("b.affix", F.lit("")).alias("affix"), F.coalesce("b.score", F.lit(0)).alias("score"))
    weak = status.filter(F.col("score") < F.col("n_masks") * 0.5).select("dataset")
    retry = (masks.join(weak, "dataset", "left_semi").join(tails, "dataset")
             .select("dataset", "stem", F.explode("tails").alias("c")))
    fallback = scored(retry).groupBy("dataset").agg(best.alias("f"))
    better = F.col("f.score") > F.col("score")
    return status.join(fallback, "dataset", "left").select(
        "dataset", F.when(better, F.col("f.affix")).otherwise(F.col("affix")).alias("affix"))


def pair(files: DataFrame, affixes: DataFrame) -> DataFrame:
    """Every mask with its image path (null where none): exact stem first, lower-cased stem second.

    Among images of one stem the first by path wins, chosen by a partial-aggregated minimum.
    """
    images = files.filter("role = 'image'")
    exact = images.groupBy("dataset", F.col("stem").alias("key")).agg(F.min("path").alias("by_stem"))
    lower = images.groupBy("dataset", F.lower("stem").alias("low")).agg(F.min("path").alias("by_lower"))
    masks = (files.filter("role = 'mask'").join(affixes, "dataset")
             .select("dataset", F.col("path").alias("mask_path"), names.strip_affix(F.col("stem"), F.col("affix")).alias("key"))
             .withColumn("low", F.lower("key")))
    return (masks.join(exact, ["dataset", "key"], "left").join(lower, ["dataset", "low"], "left")
            .select("dataset", "mask_path", F.coalesce("by_stem", "by_lower").alias("image_path")))


def unmatched(files: DataFrame, pairs: DataFrame) -> DataFrame:
    """Masks without image and images without mask: ``(dataset, path, role)``."""
    masks = pairs.filter("image_path is null").select("dataset", F.col("mask_path").alias("path"), F.lit("mask").alias("role"))
    used = pairs.filter("image_path is not null").select("dataset", F.col("image_path").alias("path"))
    images = (files.filter("role = 'image'").select("dataset", "path").join(used, ["dataset", "path"], "left_anti")
              .withColumn("role", F.lit("image")))
    return masks.unionByName(images)


def skipped_pairs(pairs: DataFrame, outlines: DataFrame) -> DataFrame:
    """Complete pairs whose mask has no outline: ``(dataset, mask_path, image_path)``; ``outlines(dataset, mask_path)``."""
    return (pairs.filter("image_path is not null").select("dataset", "mask_path", "image_path")
            .join(outlines.select("dataset", "mask_path"), ["dataset", "mask_path"], "left_anti"))


def pairing_counts(files: DataFrame, pairs: DataFrame) -> DataFrame:
    sizes = files.groupBy("dataset").agg(F.sum((F.col("role") == "image").cast("bigint")).alias("n_images"),
                                         F.sum((F.col("role") == "mask").cast("bigint")).alias("n_masks"))
    matched = pairs.groupBy("dataset").agg(F.count("image_path").alias("n_pairs"),
                                           F.count_distinct("image_path").alias("n_used"))
    return (sizes.join(matched, "dataset", "left").na.fill(0, ["n_pairs", "n_used"])
            .select("dataset", "n_images", "n_masks", "n_pairs", (F.col("n_images") - F.col("n_used")).alias("unmatched_images"),
                    (F.col("n_masks") - F.col("n_pairs")).alias("unmatched_masks")))


def mark_excluded(pairs: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Status column: 'excluded' with the reason where the image or the mask name is listed.

    ``exclusions(dataset, name, reason)``; one row per name is kept so the join never multiplies.
    """
    listed = exclusions.groupBy("dataset", "name").agg(F.min("reason").alias("reason"))
    img = listed.withColumnsRenamed({"name": "image_name", "reason": "r1"})
    msk = listed.withColumnsRenamed({"name": "mask_name", "reason": "r2"})
    named = pairs.withColumns({"image_name": names.file_name(F.col("image_path")),
                               "mask_name": names.file_name(F.col("mask_path"))})
    both = named.join(img, ["dataset", "image_name"], "left").join(msk, ["dataset", "mask_name"], "left")
    return both.withColumn("reason", F.coalesce("r1", "r2")).withColumn(
        "status", F.when(F.col("reason").isNotNull(), "excluded").otherwise("ok")).drop("r1", "r2")


def listed_but_absent(exclusions: DataFrame, files: DataFrame) -> DataFrame:
    """Exclusions that name no file."""
    return exclusions.select("dataset", "name").subtract(files.select("dataset", "name"))


def resolve_paths(rows: DataFrame, files: DataFrame, column: str = "path") -> DataFrame:
    """The recorded path if it exists, else the dataset's file of that name, else null."""
    exact = files.select(F.col("path").alias(column)).distinct().withColumn("exists", F.lit(True))
    by_name = files.groupBy("dataset", "name").agg(F.min("path").alias("moved"))
    named = rows.withColumn("name", names.file_name(F.col(column)))
    out = named.join(exact, column, "left").join(by_name, ["dataset", "name"], "left")
    return out.withColumn("resolved", F.when(F.col("exists"), F.col(column)).otherwise(F.col("moved"))).drop(
        "exists", "moved", "name")


def crop_disagreement(tiles: DataFrame, crops: DataFrame) -> DataFrame:
    """Tiles whose recorded crop differs from the reconciled crop of their image, with both values."""
    want = crops.select("dataset", "image", *[F.col(c).alias(f"want_{c}") for c in ("left", "top", "width", "height")])
    j = tiles.join(want, ["dataset", "image"])
    bad = F.lit(False)
    for c in ("left", "top", "width", "height"):
        bad = bad | ~F.col(c).eqNullSafe(F.col(f"want_{c}"))
    return j.filter(bad)


def lookup_weight(tiles: DataFrame, weights: DataFrame, column: str = "weight") -> DataFrame:
    """Tile weight by (fold, dataset); a missing or non-positive weight is kept as a problem text."""
    # written first: the few (fold, dataset) keys are hot, and a measured small side is broadcast
    j = tiles.join(cut(weights.select("fold", "dataset", column)), ["fold", "dataset"], "left")
    return j.withColumn("problem", F.when(F.col(column).isNull(), "missing").when(F.col(column) <= 0, "not positive"))

