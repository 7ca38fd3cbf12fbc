"""Pixel tables in blocks: every pixel is shuffled once, to the block it stands in and, near a border, to the blocks whose halo holds it.

A neighbourhood operator of reach ``halo`` then sees, for each block of an image, plain arrays that
hold all it needs, whatever the image's size.  Work whose effects travel further goes block by block
too: a block that changed near its border makes its neighbours look again, and only those are read
and written in the next round.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridmark.operators.raster import KEYS, Offset, frame
from gridmark.session import cut, discard

BLOCK = 256
#: Rounds after which the rounds' tables are written as one.
ROUNDS_PER_TABLE = 8


class Block:
    """Arrays of one block with its halo; ``core`` are the slices of the block itself."""

    def __init__(self, table: pa.Table, keys: Sequence[str], size: int, halo: int):
        self.table, self.keys = table, keys
        at = {c: table.column(c)[0].as_py() for c in ("by", "bx", "height", "width")}
        self.height, self.width, self.by, self.bx = at["height"], at["width"], at["by"], at["bx"]
        self.top, self.left = max(self.by * size - halo, 0), max(self.bx * size - halo, 0)
        self.shape = min((self.by + 1) * size + halo, self.height) - self.top, min((self.bx + 1) * size + halo, self.width) - self.left
        self.core = (slice(self.by * size - self.top, min((self.by + 1) * size, self.height) - self.top),
                     slice(self.bx * size - self.left, min((self.bx + 1) * size, self.width) - self.left))
        self.y, self.x = table.column("y").to_numpy() - self.top, table.column("x").to_numpy() - self.left
        self.present = np.zeros(self.shape, bool)
        self.present[self.y, self.x] = True

    def array(self, name: str, fill, kind=None) -> np.ndarray:
        """A column as an array; ``fill`` where there is no pixel or a null."""
        column = self.table.column(name).combine_chunks()
        out = np.full(self.shape, fill, kind)
        if column.null_count:
            some = column.is_valid().to_numpy(zero_copy_only=False)
            out[self.y[some], self.x[some]] = column.drop_null().to_numpy(zero_copy_only=False)
        else:
            out[self.y, self.x] = column.to_numpy(zero_copy_only=False)
        return out

    def constant(self, name: str):
        """The value of a column that is the same, or null, in all rows."""
        found = self.table.column(name).drop_null()
        return found[0].as_py() if len(found) else None

    def inner(self, values: np.ndarray) -> np.ndarray:
        return values[self.core]

    def made(self, n: int, columns: dict[str, pa.Array]) -> pa.Table:
        """``n`` rows of the image's keys and ``columns``."""
        own = {k: pa.repeat(self.table.column(k)[0], n) for k in self.keys}
        return pa.table(own | columns)

    def pixels(self, keep: np.ndarray, **values: np.ndarray) -> pa.Table:
        """A row per core pixel in ``keep``, with the arrays' values there; all arrays are of the core."""
        y, x = np.nonzero(keep)
        columns = {"height": pa.array(np.full(len(y), self.height, np.int32)), "width": pa.array(np.full(len(y), self.width, np.int32)),
                   "y": pa.array((y + self.top + self.core[0].start).astype(np.int32)), "x": pa.array((x + self.left + self.core[1].start).astype(np.int32))}
        for name, v in values.items():
            columns[name] = v if isinstance(v, pa.Array) else pa.array(v[y, x])
        return self.made(len(y), columns)


def shifted(values: np.ndarray, dy: int, dx: int, fill) -> np.ndarray:
    """``values`` of the pixel at (y + dy, x + dx), ``fill`` outside."""
    out = np.full_like(values, fill)
    h, w = values.shape
    if abs(dy) < h and abs(dx) < w:
        out[max(-dy, 0):h - max(dy, 0), max(-dx, 0):w - max(dx, 0)] = values[max(dy, 0):h - max(-dy, 0), max(dx, 0):w - max(-dx, 0)]
    return out


def extreme(values: np.ndarray, offsets: Sequence[Offset], fill, lower: bool = False) -> np.ndarray:
    """Maximum (or minimum) over the offsets, row by row: each row of offsets is one run of shifts."""
    pick = np.minimum if lower else np.maximum
    out = np.full_like(values, fill)
    for dy, dx in offsets:
        pick(out, shifted(values, dy, dx, fill), out=out)
    return out


def block_of(c: Column, size: int = BLOCK) -> Column:
    return F.floor(c / size).cast("int")


def _homes(c: str, size: int, extent: str, halo: int) -> Column:
    """Blocks along one axis that a pixel belongs to: its own and those whose halo it stands in."""
    own, at = block_of(F.col(c), size), F.col(c) % size
    if not halo:
        return F.array(own)
    low = F.when((at < halo) & (own > 0), own - 1)
    high = F.when((at >= size - halo) & ((own + 1) * size < F.col(extent)), own + 1)
    return F.array_compact(F.array(own, low, high))


def over_blocks(px: DataFrame, values: Sequence[str], halo: int, fn: Callable[[Block], pa.Table], schema: T.StructType,
                keys: Sequence[str] = KEYS, size: int = BLOCK, only: DataFrame | None = None) -> DataFrame:
    """``fn`` of every block that holds a pixel of ``px`` or has one in its halo; ``only (keys, by, bx)`` picks blocks.

    ``halo`` is at most ``size``.
    """
    if halo > size:
        raise ValueError(f"a halo of {halo} is wider than a block of {size}")
    rows = px.select(*frame(keys), *values, F.explode(_homes("y", size, "height", halo)).alias("by"))
    rows = rows.select("*", F.explode(_homes("x", size, "width", halo)).alias("bx"))
    if only is not None:
        rows = rows.join(F.broadcast(only) if only.count() <= 100_000 else only, [*keys, "by", "bx"], "left_semi")
    names = schema.names

    def run(table: pa.Table) -> pa.Table:
        return fn(Block(table, keys, size, halo)).select(names)

    return rows.groupBy(*keys, "by", "bx").applyInArrow(run, schema)


def pixel_schema(px: DataFrame, keys: Sequence[str], **values: T.DataType) -> T.StructType:
    fields = [T.StructField(k, px.schema[k].dataType) for k in keys] + [T.StructField(c, T.IntegerType()) for c in ("height", "width", "y", "x")]
    return T.StructType(fields + [T.StructField(k, t) for k, t in values.items()])


def settled(px: DataFrame, values: Sequence[str], halo: int, fn: Callable[[Block], pa.Table], schema: T.StructType,
            keys: Sequence[str] = KEYS, size: int = BLOCK) -> DataFrame:
    """``fn`` of every block, then again of each block that is, or touches, an active one, until none is.

    ``fn`` returns pixel rows with a boolean column ``active``, the same in all rows of a block: whether
    what it did may change what its neighbours do.  ``values`` are columns of its result as well as
    of ``px``.  A round reads and writes the blocks it works on and their halos, nothing else.
    """
    k = list(keys)
    own = [block_of(F.col("y"), size).alias("by"), block_of(F.col("x"), size).alias("bx")]
    rounds: list[tuple[DataFrame, DataFrame | None]] = []  # rows of a round and the blocks it worked on

    def current() -> DataFrame:
        out = None
        for i, (rows, _) in enumerate(rounds):
            rows = rows.select("*", *own)
            for _, later in rounds[i + 1:]:
                rows = rows.join(later, [*k, "by", "bx"], "left_anti")
            out = rows if out is None else out.unionByName(rows)
        return out

    rounds.append((cut(over_blocks(px, values, halo, fn, schema, keys, size)), None))
    while True:
        # an image of one block has no neighbour to ask
        several = (F.col("height") > size) | (F.col("width") > size)
        active = rounds[-1][0].filter(F.col("active") & several)
        if active.isEmpty():
            return current().drop("by", "bx", "active")
        near = active.select(*k, "height", "width", *own).distinct()
        for c in ("by", "bx"):
            near = near.withColumn(c, F.explode(F.array(F.col(c) - 1, F.col(c), F.col(c) + 1)))
        inside = (F.col("by") >= 0) & (F.col("bx") >= 0) & (F.col("by") * size < F.col("height")) & (F.col("bx") * size < F.col("width"))
        work = cut(near.filter(inside).select(*k, "by", "bx").distinct())
        now = current().drop("by", "bx", "active")
        rounds.append((cut(over_blocks(now, values, halo, fn, schema, keys, size, work)), work))
        if len(rounds) > ROUNDS_PER_TABLE:
            last, old = rounds.pop(), list(rounds)
            rounds[:] = [(cut(current().drop("by", "bx")), None), last]
            for rows, _ in old:
                discard(rows)
