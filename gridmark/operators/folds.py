"""Leakage-free folds, pooled splits, sampling weights and fold statistics.

Tiles are the big table; parents (scenes) are what is chosen and assigned.  Choices are md5
orders, so a rerun, another partitioning or another engine makes the same choice.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridmark.functions.scalars import hash_order
from gridmark.operators.summaries import describe
from gridmark.session import cut, shared_folder

SPLITS = ("train", "val", "test")
CHUNK = 2048


def composition(tiles: DataFrame) -> DataFrame:
    """Tiles, images and parents per dataset; counted per parent first so a big dataset does not skew."""
    per = tiles.groupBy("dataset", "parent_id").agg(F.count("*").alias("tiles"),
                                                    F.count_distinct("source_image").alias("images"))
    return per.groupBy("dataset").agg(F.sum("tiles").alias("tiles"), F.sum("images").alias("images"),
                                      F.count("*").alias("parents"))


def parent_map(tiles: DataFrame) -> DataFrame:
    """One row per parent with its tile and image counts."""
    return tiles.groupBy("dataset", "parent_id").agg(F.count("*").alias("tiles"),
                                                     F.count_distinct("source_image").alias("images"))


def split_parents(tiles: DataFrame, n_val: Mapping[str, int], seed: int) -> DataFrame:
    """Side of every parent of the named datasets: the first ``n_val`` in seeded order validate.

    The rank filter becomes a per-partition group limit, so no dataset's parents gather whole.
    """
    wanted = F.create_map(*[x for ds, n in n_val.items() for x in (F.lit(ds), F.lit(n))])
    parents = tiles.filter(F.col("dataset").isin(*n_val)).select("dataset", "parent_id").distinct()
    order = W.partitionBy("dataset").orderBy(hash_order(seed, F.col("parent_id")), "parent_id")
    most = max(n_val.values())
    val = (parents.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= most)
           .filter(F.col("k") <= wanted[F.col("dataset")]).select("dataset", "parent_id", F.lit("val").alias("side")))
    return (parents.join(val, ["dataset", "parent_id"], "left")
            .withColumn("side", F.coalesce("side", F.lit("train"))))


def too_few_parents(tiles: DataFrame, n_val: Mapping[str, int]) -> DataFrame:
    """Datasets that would keep no training parent (must be empty)."""
    wanted = F.create_map(*[x for ds, n in n_val.items() for x in (F.lit(ds), F.lit(n))])
    return (tiles.filter(F.col("dataset").isin(*n_val)).select("dataset", "parent_id").distinct()
            .groupBy("dataset").agg(F.count("*").alias("parents"))
            .filter(F.col("parents") <= wanted[F.col("dataset")]))


def build_folds(tiles: DataFrame, lodo: Sequence[str], n_val: Mapping[str, int], test_only: Sequence[str],
                seed: int) -> DataFrame:
    """Leave-one-dataset-out folds: every tile once per fold with its split.

    The fold list is a short literal that each tile is exploded over; parent sides join once,
    before the explosion.
    """
    if not lodo:
        raise ValueError("no datasets to hold out")
    pool = tiles.filter(~F.col("dataset").isin(*test_only)) if test_only else tiles
    if n_val:
        pool = pool.join(split_parents(pool, n_val, seed), ["dataset", "parent_id"], "left")
    else:
        pool = pool.withColumn("side", F.lit(None).cast("string"))
    held = pool.withColumn("held_out", F.explode(F.array(*[F.lit(d) for d in lodo])))
    own = F.when(F.col("dataset") == F.col("held_out"), "val").otherwise("train")
    return (held.withColumn("split", F.coalesce("side", own))
            .withColumn("fold", F.concat(F.lit("fold_"), "held_out")).drop("side"))


def with_dev_alias(folds: DataFrame) -> DataFrame:
    """Adds ``dev``: the fold with the fewest validation rows (first by name on a tie)."""
    sizes = folds.groupBy("fold").agg(F.sum((F.col("split") == "val").cast("int")).alias("n_val"))
    smallest = sizes.agg(F.min_by("fold", F.struct("n_val", "fold")).alias("fold"))
    return folds.unionByName(folds.join(F.broadcast(smallest), "fold", "left_semi").withColumn("fold", F.lit("dev")))


def check_fractions(fractions: Mapping[str, float]) -> None:
    missing = sorted(set(SPLITS) - set(fractions))
    if missing:
        raise ValueError(f"fractions miss {missing}")
    if abs(sum(fractions[s] for s in SPLITS) - 1.0) > 1e-6:
        raise ValueError(f"fractions must sum to 1.0, got {fractions}")


def allocate_by_tile_ratio(tiles: DataFrame, fractions: Mapping[str, float], seed: int,
                           minimum: int = 1) -> DataFrame:
    """``(dataset, parent_id, split)``: parents assigned so that tile counts approach the ratio.

    First ``minimum`` parents per split and dataset, then every other parent in seeded order to
    the split furthest below its target.  That greedy is sequential by definition, so it runs as
    an ordered fold over the *parent* counts (never the tiles), a bounded chunk of the seeded
    order at a time with three running totals carried between chunks.
    """
    check_fractions(fractions)
    counts = tiles.groupBy("dataset", "parent_id").agg(F.count("*").alias("n"))
    key = hash_order(seed, F.col("dataset"), F.col("parent_id"))
    counts = cut(counts.withColumn("h", key))  # the tiles are read once; from here on there are parents only
    order = W.partitionBy("dataset").orderBy("h", "parent_id")
    head = counts.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= 3 * minimum)
    side = F.element_at(F.array(*[F.lit(s) for s in SPLITS]), (F.floor((F.col("k") - 1) / max(minimum, 1)) + 1).cast("int"))
    guaranteed = head.select("dataset", "parent_id", "n", side.alias("split"))
    short = counts.groupBy("dataset").agg(F.count("*").alias("p")).filter(F.col("p") < 3 * minimum)
    if not short.isEmpty():
        raise ValueError(f"too few parents to give every split {minimum}")
    rest = counts.join(guaranteed.select("dataset", "parent_id"), ["dataset", "parent_id"], "left_anti")
    totals = {r["split"]: r["n"] for r in guaranteed.groupBy("split").agg(F.sum("n").alias("n")).collect()}
    grand, left = counts.agg(F.sum("n")).first()[0], rest.count()
    digits = 0
    while left > CHUNK * 16 ** digits:
        digits += 1
    chunks = [format(i, f"0{digits}x") for i in range(16 ** digits)] if digits else [""]
    carry = [totals.get(s, 0) for s in SPLITS]
    want = [fractions[s] * grand for s in SPLITS]
    if digits:  # in seeded order, so that a chunk reads its own row groups; every chunk's placement is written and the folder read once
        rest = cut(rest.repartitionByRange("h").sortWithinPartitions("h"))
        spark, folder = tiles.sparkSession, shared_folder(tiles.sparkSession, "placed")
        for prefix in chunks:
            part = f"{folder}/chunk=h{prefix}"
            _fold_chunk(rest.filter(F.startswith("h", F.lit(prefix))), want, carry).write.parquet(part)
            last = spark.read.parquet(part).select("totals").first()
            carry = list(last[0]) if last and last[0] else carry
        folded = spark.read.parquet(folder)
    else:
        folded = _fold_chunk(rest, want, carry)
    greedy = folded.select(F.explode("placed").alias("p")).select("p.dataset", "p.parent_id", "p.split")
    return guaranteed.select("dataset", "parent_id", "split").unionByName(greedy)


def _fold_chunk(part: DataFrame, want: Sequence[float], carry: Sequence[int]) -> DataFrame:
    """Greedy fold over one chunk's parents (at most about CHUNK of them) inside one row."""
    items = F.array_sort(F.collect_list(F.struct("h", "dataset", "parent_id", "n"))).alias("items")
    start = F.struct(F.array(*[F.lit(c).cast("bigint") for c in carry]).alias("totals"),
                     F.lit("").alias("codes"))

    def place(acc: Column, item: Column) -> Column:
        t = acc.getField("totals")
        gaps = [F.lit(w) - F.get(t, F.lit(i)).cast("double") for i, w in enumerate(want)]
        best = (F.when((gaps[0] >= gaps[1]) & (gaps[0] >= gaps[2]), 0).when(gaps[1] >= gaps[2], 1).otherwise(2))
        new = F.transform(t, lambda v, i: v + F.when(i == best, item.getField("n")).otherwise(0))
        return F.struct(new.alias("totals"), F.concat(acc.getField("codes"), best.cast("string")).alias("codes"))

    rows = part.agg(items).select("items", F.aggregate("items", start, place).alias("end"))
    names = F.array(*[F.lit(s) for s in SPLITS])
    placed = F.transform("items", lambda it, i: F.struct(
        it.getField("dataset").alias("dataset"), it.getField("parent_id").alias("parent_id"),
        F.get(names, F.substring(F.col("end.codes"), i + 1, F.lit(1)).cast("int")).alias("split")))
    return rows.select(placed.alias("placed"), F.col("end.totals").alias("totals"))


def pooled_fold(tiles: DataFrame, name: str, datasets: Sequence[str], fractions: Mapping[str, float],
                seed: int) -> DataFrame:
    """A fold over a subset of datasets with its own parent-level test slice."""
    pool = tiles.filter(F.col("dataset").isin(*datasets))
    return (pool.join(allocate_by_tile_ratio(pool, fractions, seed), ["dataset", "parent_id"])
            .withColumn("fold", F.lit(name)))


def leaking_parents(folds: DataFrame) -> DataFrame:
    """Parents on more than one side of a fold (must be empty)."""
    return (folds.groupBy("fold", "dataset", "parent_id")
            .agg(F.min("split").alias("lo"), F.max("split").alias("hi"))
            .filter(F.col("lo") != F.col("hi")).select("fold", "dataset", "parent_id"))


def pos_weight(mean_fraction: Column) -> Column:
    return F.when(mean_fraction > 0, (1 - mean_fraction) / mean_fraction)


def sampling_weights(rows: DataFrame, mode: str, group: Sequence[str] = ("fold",)) -> DataFrame:
    """Per-dataset tile weight so that an epoch follows the target share, scaled to mean 1."""
    if mode not in ("parents", "dataset", "none"):
        raise ValueError(f"weight mode must be parents, dataset or none, got {mode!r}")
    per = rows.groupBy(*group, "dataset", "parent_id").agg(F.count("*").alias("n"))
    per = per.groupBy(*group, "dataset").agg(F.sum("n").alias("raw_count"), F.count("*").alias("n_parents"))
    whole = per.groupBy(*group).agg(F.sum("raw_count").alias("all_tiles"), F.sum("n_parents").alias("all_parents"),
                                    F.count("*").alias("all_datasets"))
    t = per.join(whole, list(group))
    target = {"none": F.col("raw_count") / F.col("all_tiles"), "dataset": 1 / F.col("all_datasets"),
              "parents": F.col("n_parents") / F.col("all_parents")}[mode].cast("double")
    # the unscaled weights target/count sum to 1 over all tiles, so the scale is the tile count
    return t.select(*group, "dataset", "raw_count", "n_parents",
                    F.round(target * F.col("all_tiles") / F.col("raw_count"), 6).alias("weight"),
                    F.round(target, 4).alias("target_share"),
                    F.round(target * F.col("all_tiles"), 0).cast("bigint").alias("effective_count"))


def fold_statistics(folds: DataFrame) -> DataFrame:
    """One row per fold and split: sizes, parents, datasets, fraction statistics and class weight."""
    stats = describe(folds, F.col("outline_fraction"), ["fold", "split"])
    parents = (folds.groupBy("fold", "split", "dataset", "parent_id").agg(F.count("*").alias("n"))
               .groupBy("fold", "split").agg(F.sum("n").alias("n_tiles"), F.count("*").alias("n_parents"),
                                             F.array_sort(F.collect_set("dataset")).alias("datasets")))
    means = folds.groupBy("fold", "split").agg(F.avg("outline_fraction").alias("m"))
    return (parents.join(stats, ["fold", "split"]).join(means, ["fold", "split"])
            .withColumn("pos_weight", F.when(F.col("split") == "train", F.round(pos_weight(F.col("m")), 3)))
            .drop("n", "m"))


def pos_weight_drift(folds: DataFrame, recorded: DataFrame) -> DataFrame:
    """Recorded class weight against the one the current training rows imply."""
    now = (folds.filter("split = 'train'").groupBy("fold").agg(F.avg("outline_fraction").alias("m"))
           .select("fold", pos_weight(F.col("m")).alias("implied")))
    return recorded.join(now, "fold").withColumn("ratio", F.when(F.col("implied") > 0,
                                                                 F.col("recorded") / F.col("implied")))


def membership_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Tiles that a split gained or lost: ``(split, tile_id, side)``."""
    a, b = old.select("split", "tile_id"), new.select("split", "tile_id")
    return (a.exceptAll(b).withColumn("side", F.lit("only_old"))
            .unionByName(b.exceptAll(a).withColumn("side", F.lit("only_new"))))
