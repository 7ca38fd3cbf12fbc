"""Vectorised word handling for Arrow batches: whole texts as one byte buffer, words as offsets into it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one step of a batch handles at once; a longer document is a step of its own.
STEP_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: ASCII capitals to small letters, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def steps(texts: pa.Array, step_bytes: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Split a string column into runs of rows of about ``step_bytes``.

    Yields ``(first row, last row + 1, bytes, offsets)``; a null text is an empty one.
    """
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    n = len(texts)
    if n == 0:
        return
    _, raw_offsets, raw = texts.buffers()
    offsets = np.frombuffer(raw_offsets, np.int64)[texts.offset:texts.offset + n + 1]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + step_bytes, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        lo = hi


class Words:
    """Words ``[^ \\t-\\r]+`` of the texts in ``data``.

    ``first[d]:first[d + 1]`` are document d's words; ``text(i, j)`` is words i to j joined by one
    space, a slice of ``joined``.  ``start`` and ``end`` point into the original bytes.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(data)
        solid = ~_SPACE[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0], before[1:] = False, solid[:-1]
            after[-1], after[:-1] = False, solid[1:]
        self.start = np.flatnonzero(solid & (~before | edge[:-1]))
        self.end = np.flatnonzero(solid & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        keep = solid | before
        place = np.cumsum(keep) - keep
        joined = np.where(solid, data, np.uint8(0x20))[keep]
        self.bytes = joined
        self.joined = joined.tobytes()
        self.at = place[self.start]
        self.to = place[self.end - 1] + 1
        #: document of every word
        self.doc = np.repeat(np.arange(len(self.count)), self.count)

    def text(self, i: int, j: int) -> bytes:
        return self.joined[self.at[i]:self.to[j]]


def windows(data: np.ndarray, inner: np.ndarray, size: int = STEP_BYTES) -> list[int]:
    """Bounds of pieces of one text that have about ``size`` bytes and end behind a byte that is not ``inner`` (a table of 256), or at the end.

    A run of inner bytes is never cut, so a text without other bytes is one piece.
    """
    bounds, n = [0], len(data)
    while n - bounds[-1] > size:
        at, look = bounds[-1] + size, 1 << 12
        while at < n:
            free = np.flatnonzero(~inner[data[at:at + look]])
            if len(free):
                at += int(free[0]) + 1
                break
            at, look = at + look, 2 * look
        bounds.append(min(at, n))
    if bounds[-1] < n or n == 0:
        bounds.append(n)
    return bounds


def overlapping(data: np.ndarray, n: int, size: int = STEP_BYTES) -> Iterator[Words]:
    """Pieces of one text so that every ``n`` neighbouring words stand whole in exactly one; a piece of fewer words holds none of them."""
    at, marks = 0, windows(data, ~_SPACE, size)
    for end in marks[1:]:
        w = Words(data[at:end], np.array([0, end - at]))
        yield w
        if n == 1 or len(w.start) >= n - 1:
            at = end if n == 1 else at + int(w.start[len(w.start) - n + 1])
