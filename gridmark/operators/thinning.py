"""One-pixel thinning (Zhang and Suen, CACM 27(3), 1984), several passes at once in blocks with a halo."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gridmark.operators.blocks import BLOCK, Block, pixel_schema, settled
from gridmark.operators.raster import KEYS, frame

#: neighbours clockwise from north; bit i of the neighbourhood code is CLOCKWISE[i]
CLOCKWISE = ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))
#: Full passes of a block between two exchanges with its neighbours.
PASSES = 8


def _removable(code: int, second: bool) -> bool:
    """The published deletion rule for one neighbourhood code."""
    ring = [code >> i & 1 for i in range(8)]
    rises = sum(ring[i] == 0 and ring[(i + 1) % 8] == 1 for i in range(8))
    if not (2 <= sum(ring) <= 6 and rises == 1):
        return False
    n, e, s, w = ring[0], ring[2], ring[4], ring[6]
    return not (n and e and w) and not (n and s and w) if second else not (n and e and s) and not (e and s and w)


def _rule(second: bool) -> str:
    return "".join("1" if _removable(code, second) else "0" for code in range(256))


def _half_pass(mask: np.ndarray, rule: np.ndarray) -> np.ndarray:
    """``mask`` without the pixels whose neighbourhood code the rule deletes; outside counts as background."""
    h, w = mask.shape
    padded = np.pad(mask, 1).view(np.uint8)
    code = np.zeros((h, w), np.uint8)
    for i, (dy, dx) in enumerate(CLOCKWISE):
        code |= padded[1 + dy:1 + dy + h, 1 + dx:1 + dx + w] << np.uint8(i)
    return mask & ~rule[code]


def _thinned(block: Block) -> pa.Table:
    """Up to :data:`PASSES` passes, all of them if the block is the image; active if the last still changed the block or what is next to it."""
    rules = [np.array([_removable(code, second) for code in range(256)]) for second in (False, True)]
    mask = block.present
    changed = mask & False
    whole = block.shape == (block.height, block.width)
    for _ in range(block.height + block.width if whole else PASSES):
        before = mask
        for rule in rules:
            mask = _half_pass(mask, rule)
        changed = before & ~mask
        if not changed.any():
            break
    rows, columns = (slice(max(c.start - 2, 0), c.stop + 2) for c in block.core)
    keep = block.inner(mask)
    return block.pixels(keep, active=np.full(keep.shape, bool(changed[rows, columns].any())))


def skeletonize(mask: DataFrame, keys: Sequence[str] = KEYS, block: int = BLOCK) -> DataFrame:
    """Thin until a full pass deletes nothing.

    A block runs :data:`PASSES` passes at once, as its halo is as wide as their effects reach, and only
    blocks whose last pass still deleted something, and their neighbours, go on.
    """
    schema = pixel_schema(mask, keys, active=T.BooleanType())
    return settled(mask.select(*frame(keys)), [], 2 * PASSES + 2, _thinned, schema, keys, block).select(*frame(keys))
