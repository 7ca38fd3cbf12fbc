"""Turning probability pixels into outline masks, plain or with gaps closed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmark.operators import components
from gridmark.operators.raster import KEYS, dilate, dilate_to_width, disk, endpoints, frame
from gridmark.operators.thinning import skeletonize
from gridmark.session import cut

MODES = ("none", "skeleton_redilate", "morph_close", "skeleton_bridge")


def check_mode(mode: str, width: int | None = None, radius: float | None = None, bridge: float | None = None,
               partition: str = "binary_outline") -> None:
    """Each mode's own required parameter, and no post-processing under the watershed partition."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, got {mode!r}")
    if partition not in ("binary_outline", "watershed_prob"):
        raise ValueError(f"unknown partition {partition!r}")
    if partition == "watershed_prob" and mode != "none":
        raise ValueError("the watershed partition does not use a post-processed outline")
    if mode != "none" and (width is None or round(float(width)) < 1):
        raise ValueError(f"{mode} needs a target width of at least 1, got {width}")
    if mode == "morph_close" and (radius is None or round(float(radius)) < 1):
        raise ValueError(f"morph_close needs a closing radius of at least 1, got {radius}")
    if mode == "skeleton_bridge" and (bridge is None or float(bridge) <= 0):
        raise ValueError(f"skeleton_bridge needs a positive bridge distance, got {bridge}")


def binarize(prob_px: DataFrame, limits: DataFrame, on: Sequence[str] = ("dataset",),
             keys: Sequence[str] = KEYS) -> DataFrame:
    """Pixels with ``prob >= threshold`` of their dataset, compared at float32."""
    kept = prob_px.join(limits.select(*on, F.col("threshold").cast("float").alias("t")), list(on))
    return kept.filter(F.col("prob") >= F.col("t")).select(*frame(keys))


def endpoint_pairs(ends: DataFrame, distance: float, keys: Sequence[str] = KEYS) -> DataFrame:
    """Pairs of endpoints of different fragments within ``distance``, each once with p before q.

    Points meet through a grid of cells as wide as the distance: an equality join on nine cells.
    """
    k, cell = list(keys), max(1, int(-(-distance // 1)))
    p = ends.select(*k, F.col("y").alias("py"), F.col("x").alias("px"), F.col("fragment").alias("pf"))
    reach = F.sequence(F.lit(-1), F.lit(1))
    spread = p.withColumn("cy", F.explode(F.transform(reach, lambda o: F.floor(F.col("py") / cell) + o)))
    spread = spread.withColumn("cx", F.explode(F.transform(reach, lambda o: F.floor(F.col("px") / cell) + o)))
    q = ends.select(*k, F.col("y").alias("qy"), F.col("x").alias("qx"), F.col("fragment").alias("qf"),
                    F.floor(F.col("y") / cell).alias("cy"), F.floor(F.col("x") / cell).alias("cx"))
    d2 = (F.pow(F.col("py") - F.col("qy"), 2) + F.pow(F.col("px") - F.col("qx"), 2)).cast("bigint")
    first = (F.col("py") < F.col("qy")) | ((F.col("py") == F.col("qy")) & (F.col("px") < F.col("qx")))
    return (spread.join(q, [*k, "cy", "cx"]).withColumn("d2", d2)
            .filter(first & (F.col("pf") != F.col("qf")) & (F.col("d2") <= float(distance) ** 2)).drop("cy", "cx"))


def spanning_bridges(pairs: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The bridges a shortest-first greedy accepts, by Boruvka rounds.

    The order (distance, p, q) is total, so taking every fragment's cheapest outgoing pair per
    round ends in the same forest as accepting pairs one after the other.
    """
    k = list(keys)
    rank = F.struct("d2", "py", "px", "qy", "qx")
    live = cut(pairs.withColumns({"a": F.col("pf"), "b": F.col("qf")}))
    accepted = None
    while not live.isEmpty():
        ends = live.withColumn("f", F.explode(F.array("a", "b")))
        picks = ends.groupBy(*k, "f").agg(F.min_by(F.struct("py", "px", "qy", "qx", "d2", "a", "b"), rank).alias("e"))
        picks = cut(picks.select(*k, "e.*").distinct())
        accepted = picks if accepted is None else accepted.unionByName(picks)
        arcs = picks.select(*k, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        roots = components.resolve(arcs, keys)
        for side in ("a", "b"):
            home = roots.select(*k, F.col("node").alias(side), F.col("root").alias("r"))
            live = live.join(home, [*k, side], "left").withColumn(side, F.coalesce("r", side)).drop("r")
        live = cut(live.filter("a <> b"))
    columns = [*k, "py", "px", "qy", "qx"]
    return (pairs if accepted is None else accepted).select(*columns)


def draw_lines(bridges: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Pixels of the straight line of every bridge: midpoint steps along the longer axis."""
    dy, dx = F.col("qy") - F.col("py"), F.col("qx") - F.col("px")
    n = F.greatest(F.abs(dy), F.abs(dx))
    rows = bridges.withColumn("i", F.explode(F.sequence(F.lit(0), n)))

    def step(start: str, delta):
        moved = F.floor((F.abs(delta) * F.col("i") * 2 + n) / (n * 2)).cast("int")
        return F.col(start) + F.signum(delta).cast("int") * moved

    return rows.select(*keys, step("py", dy).alias("y"), step("px", dx).alias("x")).distinct()


def bridge(skeleton: DataFrame, distance: float, keys: Sequence[str] = KEYS) -> DataFrame:
    """Skeleton plus straight bridges between loose ends of different fragments."""
    k = list(keys)
    if distance <= 0:
        return skeleton
    skeleton = cut(skeleton.select(*frame(keys)))
    fragments = components.connected_components(skeleton, 8, keys=keys).withColumnRenamed("component", "fragment")
    ends = cut(endpoints(skeleton, keys).join(fragments, [*k, "y", "x"]).select(*frame(keys), "fragment"))
    drawn = draw_lines(spanning_bridges(endpoint_pairs(ends, distance, keys), keys), keys)
    dims = ends.select(*k, "height", "width").distinct()
    return skeleton.unionByName(drawn.join(dims, k).select(*frame(keys))).distinct()


def postprocess(binary: DataFrame, mode: str, width: int | None = None, radius: int | None = None,
                bridge_px: float | None = None, keys: Sequence[str] = KEYS, within: DataFrame | None = None) -> DataFrame:
    """One mode applied to a binarized mask; images without foreground stay without; ``within`` as in ``raster.dilate``."""
    check_mode(mode, width, radius, bridge_px)
    if mode == "none":
        return binary.select(*frame(keys))
    if mode == "skeleton_redilate":
        return dilate_to_width(skeletonize(binary, keys), round(float(width)), keys, within)
    if mode == "morph_close":
        fat = dilate(binary, disk(round(float(radius))), keys, within)
        sealed = dilate_to_width(skeletonize(fat, keys), round(float(width)), keys, within)
        return sealed.unionByName(binary.select(*frame(keys))).distinct()
    return dilate_to_width(bridge(skeletonize(binary, keys), float(bridge_px), keys), round(float(width)), keys, within)
