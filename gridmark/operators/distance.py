"""Exact Euclidean nearest-site search on pixel tables, one pass per axis.

Step one finds, inside each image column, the nearest site above or below (two running windows
over one column).  Step two takes each image row as one array of column distances and evaluates their
lower envelope: the best column of a pixel never moves left as the pixel moves right, so halving the
row settles all pixels with a work of row length times its logarithm, for many rows at once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridmark.operators.blocks import BLOCK, Block, over_blocks, pixel_schema, shifted
from gridmark.operators.raster import KEYS, frame


def column_nearest(px: DataFrame, site: Column, payload: Column | None, keys: Sequence[str],
                   name: str = "near") -> DataFrame:
    """Adds struct(d2, payload) of the nearest site in the same image column (null if none)."""
    up, down = (W.partitionBy(*keys, "x").orderBy(o).rowsBetween(W.unboundedPreceding, W.currentRow) for o in (F.col("y").asc(), F.col("y").desc()))
    mark = F.when(site, F.struct(F.col("y").alias("sy"), (payload if payload is not None else F.lit(0)).alias("p")))

    def gap(side: Column) -> Column:
        d = (F.col("y") - side.getField("sy")).cast("bigint")
        return F.when(side.isNotNull(), F.struct((d * d).alias("d2"), side.getField("p").alias("p")))

    return px.withColumn(name, F.least(*[gap(F.last(mark, ignorenulls=True).over(w)) for w in (up, down)]))


def envelope(row: np.ndarray, x: np.ndarray, d2: np.ndarray, payload: np.ndarray, asked_row: np.ndarray, asked_x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least (d2[i] + (asked_x - x[i])^2, payload[i]) over the entries i of the same row, for every asked pixel.

    Entries and asked pixels are sorted by (row, x); every asked row has entries.
    """
    n = len(asked_x)
    best, who = np.empty(n, np.int64), np.empty(n, payload.dtype)
    # halves of runs of asked pixels (a, b) with the entries (lo, hi) that can serve them
    a = np.flatnonzero(np.diff(asked_row, prepend=-1)) if n else np.zeros(0, np.int64)
    b = np.append(a[1:], n) if n else a
    lo, hi = np.searchsorted(row, asked_row[a], "left"), np.searchsorted(row, asked_row[a], "right")
    while len(a):
        m, size = (a + b) // 2, hi - lo
        head = np.cumsum(size) - size
        at = np.arange(int(size.sum())) + np.repeat(lo - head, size)
        own = np.repeat(m, size)
        cost = d2[at] + (asked_x[own] - x[at]) ** 2
        least = np.minimum.reduceat(cost, head)
        tie = cost == np.repeat(least, size)
        best[m] = least
        who[m] = np.minimum.reduceat(np.where(tie, payload[at], np.iinfo(payload.dtype).max), head)
        place = np.where(tie, at, -1)
        last = np.maximum.reduceat(place, head)
        first = np.minimum.reduceat(np.where(tie, at, len(x)), head)
        # left of m nothing behind its last tie is better, right of it nothing before its first
        a, b, lo, hi = (np.concatenate(p) for p in zip((a, m, lo, last + 1), (m + 1, b, first, hi)))
        some = b > a
        a, b, lo, hi = a[some], b[some], lo[some], hi[some]
    return best, who


def nearest_site(px: DataFrame, site: str, payload: str | None = None, asked: Column | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """For every ``asked`` pixel (all non-sites): squared distance to the nearest site and that site's payload.

    ``px`` holds every pixel of every image with boolean column ``site``; the payload is an integer.
    Ties go to the lowest payload.  One shuffle on the image column, one on the image row, whatever the
    distances; a task holds some rows at a time.  Pixels of images without any site are absent.
    """
    table = column_nearest(px, F.col(site), F.col(payload) if payload else None, keys)
    wanted = F.coalesce(asked if asked is not None else ~F.col(site), F.lit(False))
    reach = F.col("near").isNotNull()
    rows = (table.filter(reach | wanted).select(*frame(keys), "near.d2", F.col("near.p").cast("bigint").alias("p"), wanted.alias("asked"))
            .repartition(*keys, "y").sortWithinPartitions(*keys, "y", "x"))
    kind = px.schema[payload].dataType if payload else T.IntegerType()
    schema = pixel_schema(px, keys, d2=T.LongType(), payload=T.LongType())

    def solved(part: pa.Table) -> pa.RecordBatch:
        part = part.combine_chunks()
        new = np.zeros(len(part), bool)
        for c in (*keys, "y"):
            v = part.column(c).combine_chunks()
            new[1:] |= np.asarray(pa.compute.not_equal(v.slice(1), v.slice(0, len(v) - 1)).fill_null(True).to_numpy(zero_copy_only=False))
        row = np.cumsum(new)
        x, ask = part.column("x").to_numpy().astype(np.int64), part.column("asked").to_numpy(zero_copy_only=False)
        has = part.column("d2").combine_chunks().is_valid().to_numpy(zero_copy_only=False)
        d2, p = (part.column(c).fill_null(0).to_numpy()[has] for c in ("d2", "p"))
        ask = ask & np.isin(row, row[has])
        best, who = envelope(row[has], x[has], d2, p, row[ask], x[ask])
        out = part.filter(pa.array(ask)).select([*keys, "height", "width", "y", "x"])
        return pa.table({**{c: out.column(c) for c in out.column_names}, "d2": pa.array(best), "payload": pa.array(who)}).combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            part = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            # the last image row may go on in the next batch
            same = np.ones(len(part), bool)
            for c in (*keys, "y"):
                v = part.column(c)
                same &= pa.compute.equal(v, v[-1]).fill_null(False).to_numpy().astype(bool) if v[-1].is_valid else v.is_null().to_numpy().astype(bool)
            cut = int(np.argmax(same))
            rest = part.slice(cut)
            if cut:
                yield from solved(part.slice(0, cut)).to_batches()
        if rest is not None:
            yield from solved(rest).to_batches()

    found = rows.mapInArrow(run, schema)
    return found if kind == T.LongType() else found.withColumn("payload", F.col("payload").cast(kind))


def proximity(px: DataFrame, masks: Sequence[str], reach: int, carry: Sequence[str] = (),
              keys: Sequence[str] = KEYS, block: int = BLOCK) -> DataFrame:
    """Every pixel with ``d2_<mask>``: squared distance to each boolean mask, null beyond ``reach``.

    All masks and all radii up to ``reach`` come out of one pass over blocks with a halo of ``reach``,
    instead of one dilation per mask and radius.
    """
    kinds = {c: px.schema[c].dataType for c in (*masks, *carry)}
    schema = pixel_schema(px, keys, **kinds, **{f"d2_{m}": T.LongType() for m in masks})

    def run(block: Block) -> pa.Table:
        keep = block.inner(block.present)
        out, far = {}, reach * reach + 1
        for m in masks:
            own = block.array(m, False, bool)
            # down the columns, then along the rows
            column = np.full(block.shape, far, np.int64)
            for d in range(-reach, reach + 1):
                np.minimum(column, np.where(shifted(own, d, 0, False), d * d, far), out=column)
            near = np.full(block.shape, far, np.int64)
            for d in range(-reach, reach + 1):
                np.minimum(near, shifted(column, 0, d, far) + d * d, out=near)
            found = block.inner(near)[keep]
            out[f"d2_{m}"] = pa.array(found, mask=found >= far)
        own_row = np.full(block.shape, -1, np.int64)
        own_row[block.y, block.x] = np.arange(len(block.table))
        at = pa.array(block.inner(own_row)[keep])
        return block.pixels(keep, **{c: block.table.column(c).combine_chunks().take(at) for c in kinds}, **out)

    return over_blocks(px, list(kinds), reach, run, schema, keys, max(block, reach))


def skeleton_widths(px: DataFrame, mask: str, skeleton: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """``(keys, y, x, d2)`` at skeleton pixels: squared distance to the nearest background pixel."""
    k = [*keys, "y", "x"]
    marked = px.select(*frame(keys), (~F.col(mask)).alias("ground")).join(skeleton.select(*k, F.lit(True).alias("bone")), k, "left")
    return nearest_site(marked, "ground", asked=F.col("bone") & ~F.col("ground"), keys=keys).select(*k, "d2")


def line_width(widths: DataFrame, even_hint: bool = False, keys: Sequence[str] = KEYS) -> DataFrame:
    """Median line width per group: median(2d) less one pixel unless the hint says even.

    Distances are tallied first, so the median works on the few distinct values of a group.
    """
    offset = 0.0 if even_hint else 1.0
    tally = widths.groupBy(*keys, "d2").agg(F.count("*").alias("n"))
    value = F.sqrt(F.col("d2").cast("double")) * 2
    return tally.groupBy(*keys).agg(
        (F.percentile(value, 0.5, F.col("n")) - offset).alias("width_px"), F.sum("n").alias("n_skeleton_px"))
