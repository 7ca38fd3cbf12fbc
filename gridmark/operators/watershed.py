"""Seeded region growth on probability: flooding by lowest pass, then by steps, then by seed.

Seeds are 8-connected components of pixels below the marker.  Every other pixel joins the seed
reached over the path whose highest probability is lowest; on a plateau the nearest entry wins;
remaining ties go to the lowest seed.  A pixel's value is (pass height, steps since the height was
entered, seed), the least that its 4-neighbours offer.  An offer is always larger than the value it
comes from, so a block is solved at once by taking pixels in the order of their values; the values
next to the block are given, and blocks whose border values changed make their neighbours look again.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridmark.operators import components
from gridmark.operators.blocks import BLOCK, Block, pixel_schema, settled
from gridmark.operators.raster import KEYS, frame

_STATE = {"level": T.DoubleType(), "seed": T.LongType(), "high": T.DoubleType(), "steps": T.IntegerType(), "region": T.LongType()}
#: No region yet; seeds and regions are 1 and up.
_NONE = 0


def _flooded(block: Block) -> pa.Table:
    """Values of the block's pixels from its seeds and from the values around it; active if a border value is new."""
    h, w = block.shape
    levels, seed = block.array("level", np.inf, float), block.array("seed", _NONE, np.int64)
    level = levels.ravel().tolist()
    before = [block.array("high", np.inf, float), block.array("steps", 0, np.int64), block.array("region", _NONE, np.int64)]
    own = np.zeros(block.shape, bool)
    own[block.core] = True
    own &= block.present
    given = (~own & (seed == _NONE) & (before[2] != _NONE)).ravel()
    heap = [(-1.0, 0, r, p) for p, r in enumerate(seed.ravel().tolist()) if r]
    heap += [(float(before[0].flat[p]), int(before[1].flat[p]), int(before[2].flat[p]), p) for p in np.flatnonzero(given).tolist()]
    heapq.heapify(heap)
    source = (given | (seed != _NONE).ravel()).tolist()
    free = (own & (seed == _NONE)).ravel().tolist()  # pixels that still take offers
    high, steps, region = [np.inf] * (h * w), [0] * (h * w), seed.ravel().tolist()
    pop, push = heapq.heappop, heapq.heappush
    while heap:
        z, s, r, p = pop(heap)
        if free[p]:
            free[p] = False
            high[p], steps[p], region[p] = z, s, r
        elif source[p]:
            source[p] = False
        else:
            continue  # an offer that came too late
        x = p % w
        for q, inside in ((p - w, p >= w), (p + w, p + w < h * w), (p - 1, x > 0), (p + 1, x + 1 < w)):
            if inside and free[q]:
                push(heap, (level[q], 1, r, q) if z < level[q] else (z, s + 1, r, q))
    found = [np.array(v).reshape(h, w) for v in (high, steps, region)]
    found[0] = np.where(seed > 0, -1.0, found[0])
    edge = np.zeros(block.shape, bool)
    edge[block.core] = True
    edge[block.core][1:-1, 1:-1] = False
    new = any((f[edge] != b[edge]).any() for f, b in zip(found, before))
    keep = block.inner(block.present)
    z, n, r = (block.inner(f)[keep] for f in found)
    own_seed = block.inner(seed)[keep]
    return block.pixels(keep, level=block.inner(levels), seed=pa.array(own_seed, mask=own_seed == _NONE), high=pa.array(z, mask=r == _NONE),
                        steps=pa.array(n.astype(np.int32), mask=r == _NONE), region=pa.array(r, mask=r == _NONE),
                        active=np.full(keep.shape, bool(new)))


def watershed_regions(px: DataFrame, marker: float | str, prob: str = "prob", keys: Sequence[str] = KEYS,
                      block: int = BLOCK) -> DataFrame:
    """Partition of every image of ``px`` grown from pixels below ``marker`` (a value or a column).

    An image without any seed is one region.  Images of one block are done in one round; else the rounds
    follow the number of blocks that a path of growth crosses, and a round takes part of the image only
    where values at block borders changed.
    """
    if not isinstance(marker, str) and not 0.0 < float(marker) < 1.0:
        raise ValueError(f"marker must be in (0, 1), got {marker}")
    limit = (F.col(marker) if isinstance(marker, str) else F.lit(float(marker))).cast("float")
    k = list(keys)
    level = px.select(*frame(keys), F.col(prob).cast("double").alias("level"), (F.col(prob) < limit).alias("low"))
    runs = components.label_runs(level.filter("low"), 8, keys=keys)
    seeds = components.expand_runs(runs, "component", keys=keys)
    state = (level.join(seeds, [*k, "y", "x"], "left")
             .select(*frame(keys), "level", F.col("component").alias("seed"), F.lit(None).cast("double").alias("high"),
                     F.lit(None).cast("int").alias("steps"), F.lit(None).cast("long").alias("region")))
    schema = pixel_schema(px, keys, **_STATE, active=T.BooleanType())
    done = settled(state, list(_STATE), 1, _flooded, schema, keys, block)
    return done.select(*frame(keys), F.coalesce("region", F.lit(1).cast("bigint")).alias("region"))
