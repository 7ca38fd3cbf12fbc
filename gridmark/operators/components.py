"""Connected components of masks and label maps.

Pixels become horizontal runs, touching runs on neighbouring rows become graph edges, edges
inside an image block are contracted in place, and only the much smaller graph between blocks
is contracted iteratively by alternating star steps.  Work after the first shuffle is per run
and not per pixel; the graph steps are ``groupBy`` minima and joins on run ids, so a component
that holds a third of all runs is a hot *key* of a join (which adaptive execution splits),
never a group that one task has to hold.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridmark.operators.raster import KEYS
from gridmark.session import cut, discard, store

ROUNDS_PER_CUT = 2
MAX_ROUNDS = 200
BLOCK_ROWS = 512
BLOCK_COLUMNS = 2048


def pixel_id(y: Column, x: Column) -> Column:
    """Raster-ordered id of a pixel, from 1 up (0 means "no region"): row high, column low."""
    return F.shiftleft(y.cast("bigint"), 32) + x.cast("bigint") + 1


def _block(ident: Column) -> Column:
    """Block of a run id: block row in the high half, block column in the low half."""
    y, x = F.shiftright(ident - 1, 32), (ident - 1).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.shiftleft(F.floor(y / BLOCK_ROWS), 32) + F.floor(x / BLOCK_COLUMNS)


def runs(px: DataFrame, label: str | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """Maximal horizontal runs ``(keys, label, y, x0, x1, run)``; one shuffle on the image row.

    Runs end at block columns, so a run and the window that finds it are bounded for any width.
    """
    group = [*keys, "y"] + ([label] if label else [])
    px = px.select(*group, "x").withColumn("bx", F.floor(F.col("x") / BLOCK_COLUMNS))
    rank = F.row_number().over(W.partitionBy(*group, "bx").orderBy("x"))
    return (px.withColumn("island", F.col("x") - rank)
            .groupBy(*group, "bx", "island").agg(F.min("x").alias("x0"), F.max("x").alias("x1"))
            .withColumn("run", pixel_id(F.col("y"), F.col("x0"))).drop("island", "bx"))


def _continued(run_table: DataFrame, group: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Edges between the halves of a run that a block column cut."""
    left = run_table.filter(F.col("x1") % BLOCK_COLUMNS == BLOCK_COLUMNS - 1).select(
        *group, "y", (F.col("x1") + 1).alias("x0"), F.col("run").alias("b"))
    right = run_table.filter((F.col("x0") % BLOCK_COLUMNS == 0) & (F.col("x0") > 0)).select(
        *group, "y", "x0", F.col("run").alias("a"))
    return left.join(right, [*group, "y", "x0"]).select(*keys, "a", "b")


def touching(run_table: DataFrame, connectivity: int, label: str | None = None,
             keys: Sequence[str] = KEYS) -> DataFrame:
    """Edges ``(keys, a, b)`` between runs of equal label on adjacent rows.

    Runs of one row are disjoint, so of the other row only the last run that starts at or before
    a run's own start can reach it.  Each touching pair is therefore found once, at whichever run
    starts later, by a running ``last`` over the two rows: linear, with no pair enumeration.
    """
    if connectivity not in (4, 8):
        raise ValueError("connectivity is 4 or 8")
    group = list(keys) + ([label] if label else [])
    sides = F.explode(F.array(F.struct(F.col("y").alias("pair"), F.lit(0).alias("side")),
                              F.struct((F.col("y") - 1).alias("pair"), F.lit(1).alias("side"))))
    both = run_table.select(*group, "x0", "x1", "run", F.col("y"), sides.alias("s")).select(
        *group, "x0", "x1", "run", "s.pair", "s.side")
    order = W.partitionBy(*group, "pair").orderBy("x0", "side").rowsBetween(W.unboundedPreceding, W.currentRow)
    here = F.struct("x1", "run")
    both = (both.withColumn("upper", F.last(F.when(F.col("side") == 0, here), ignorenulls=True).over(order))
            .withColumn("lower", F.last(F.when(F.col("side") == 1, here), ignorenulls=True).over(order)))
    other = F.when(F.col("side") == 0, F.col("lower")).otherwise(F.col("upper"))
    slack = 0 if connectivity == 4 else 1
    edges = (both.withColumn("other", other)
             .filter(F.col("other.x1") >= F.col("x0") - slack)
             .select(*keys, F.greatest("run", "other.run").alias("a"), F.least("run", "other.run").alias("b")))
    return edges.unionByName(_continued(run_table, group, keys))


def _star(edges: DataFrame, keys: Sequence[str], larger: bool) -> DataFrame:
    """One star step on directed edges (a > b): re-hang neighbours on the smallest neighbour."""
    k = list(keys)
    if larger:
        arcs = edges.unionByName(edges.select(*k, F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        arcs = edges
    low = arcs.groupBy(*k, "a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
    linked = arcs.join(low, [*k, "a"])
    if larger:
        moved = linked.filter(F.col("b") > F.col("a")).select(*k, F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = linked.select(*k, F.explode(F.array(F.col("a"), F.col("b"))).alias("a"), F.col("m").alias("b"))
    moved = moved.filter(F.col("a") > F.col("b"))
    return moved if larger else moved.distinct()


def _local_roots(edges: pd.DataFrame) -> pd.DataFrame:
    """Smallest reachable id of every node of one block's edges (nodes that are no root)."""
    nodes, place = np.unique(np.concatenate([edges["a"], edges["b"]]), return_inverse=True)
    a, b = place[:len(edges)], place[len(edges):]
    low = np.arange(len(nodes))
    while True:
        new, m = low.copy(), np.minimum(low[a], low[b])
        for side in (a, b, low[a], low[b]):
            np.minimum.at(new, side, m)
        new = new[new]
        if (new == low).all():
            break
        low = new
    keys = {c: edges[c].iloc[0] for c in edges.columns if c not in ("a", "b", "block")}
    out = pd.DataFrame({"node": nodes, "root": nodes[low]}).assign(**keys)
    return out[out["node"] != out["root"]]


def resolve(edges: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """``(keys, node, root)`` for every node that is no root; root is the smallest id it reaches.

    Edges inside one block of the image are contracted in place: a block holds a bounded number
    of runs whatever the image, so this is one shuffle and a short array loop per block.  Only
    edges that cross block borders, already between block roots, go through the iterative
    contraction; collections of images no larger than a block never iterate.
    """
    k = list(keys)
    edges = cut(edges.select(*k, "a", "b", _block(F.col("a")).alias("block"), _block(F.col("b")).alias("other")))
    schema = T.StructType([f for f in edges.schema.fields if f.name in k]
                          + [T.StructField(c, T.LongType()) for c in ("node", "root")])
    inner = edges.filter("block = other").drop("other")
    local = inner.groupBy(*k, "block").applyInPandas(_local_roots, schema).select(*k, "node", "root")
    across = edges.filter("block <> other")
    if across.isEmpty():
        return local
    local = cut(local)
    side = {c: local.select(*k, F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in ("a", "b")}
    lifted = across.select(*k, "a", "b").join(side["a"], [*k, "a"], "left").join(side["b"], [*k, "b"], "left")
    ra, rb = F.coalesce("ra", "a"), F.coalesce("rb", "b")
    far = contract(lifted.select(*k, F.greatest(ra, rb).alias("a"), F.least(ra, rb).alias("b")).filter("a > b"), k)
    far = cut(far)
    onward = far.select(*k, F.col("node").alias("root"), F.col("root").alias("far"))
    lifted = local.join(onward, [*k, "root"], "left").select(*k, "node", F.coalesce("far", "root").alias("root"))
    return lifted.unionByName(far)


def contract(edges: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """``(keys, node, root)`` of directed edges a > b by alternating star contraction.

    The edge set ends as one star per component.  A round leaves a finished set unchanged, so the
    loop stops when count and xor-fingerprint repeat.
    """
    k = list(keys)

    def mark(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64(*k, "a", "b"))).first())

    state = store(edges.distinct())
    before = mark(state)
    for _ in range(0, MAX_ROUNDS, ROUNDS_PER_CUT):
        if before[0] == 0:
            break
        last = state
        for _ in range(ROUNDS_PER_CUT):
            state = _star(_star(state, k, larger=True), k, larger=False)
        state = store(state)
        discard(last)
        after = mark(state)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return state.select(*k, F.col("a").alias("node"), F.col("b").alias("root"))


def label_runs(px: DataFrame, connectivity: int, label: str | None = None,
               keys: Sequence[str] = KEYS) -> DataFrame:
    """Runs with their component: ``(keys, label, y, x0, x1, run, component)``."""
    table = cut(runs(px, label, keys))
    roots = resolve(touching(table, connectivity, label, keys), keys)
    joined = table.join(roots.withColumnRenamed("node", "run"), [*keys, "run"], "left")
    return joined.withColumn("component", F.coalesce("root", "run")).drop("root")


def connected_components(px: DataFrame, connectivity: int, label: str | None = None,
                         keys: Sequence[str] = KEYS) -> DataFrame:
    """Pixels with the id of their component: the raster id of its first pixel."""
    table = label_runs(px, connectivity, label, keys)
    return table.select(*keys, *([label] if label else []), "y",
                        F.explode(F.sequence("x0", "x1")).alias("x"), "component")


def component_sizes(run_table: DataFrame, label: str | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """Area of every component, straight from the runs."""
    return (run_table.groupBy(*keys, *([label] if label else []), "component")
            .agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("area")))


def expand_runs(run_table: DataFrame, *columns: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Back to one row per pixel."""
    return run_table.select(*keys, *columns, "y", F.explode(F.sequence("x0", "x1")).alias("x"))


def despeckle(mask: DataFrame, kernel: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Drop 8-connected components smaller than ``kernel`` squared; ``kernel <= 1`` keeps all."""
    from gridmark.operators.raster import frame

    if kernel <= 1:
        return mask
    table = label_runs(mask, 8, keys=keys)
    small = component_sizes(table, keys=keys).filter(F.col("area") < kernel * kernel)
    gone = expand_runs(table.join(small.select(*keys, "component"), [*keys, "component"], "left_semi"), keys=keys)
    return mask.join(gone, [*keys, "y", "x"], "left_anti").select(*frame(keys))
