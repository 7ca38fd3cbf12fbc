"""Colour rasters as uncompressed bitmap files, an image a file, written by the tasks."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame


def bitmap(rgb: np.ndarray) -> bytes:
    """A 24-bit bitmap of ``rgb`` (height, width, 3): rows from the bottom up, blue first, padded to four bytes."""
    h, w, _ = rgb.shape
    row = np.zeros((h, (3 * w + 3) // 4 * 4), np.uint8)
    row[:, :3 * w] = rgb[::-1, :, ::-1].reshape(h, 3 * w)
    head = struct.pack("<2sIHHI", b"BM", 54 + row.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, row.size, 2835, 2835, 0, 0)
    return head + row.tobytes()


def write_bitmaps(px: DataFrame, folder: str) -> DataFrame:
    """Writes ``folder/<dataset>/images/<stem>.bmp`` for every image of ``px(dataset, stem, height, width, y, x, rgb)``; ``(path, bytes)`` of each.

    ``rgb`` is packed red, green, blue; pixels that are not there are black.  A task holds one image.
    """
    def run(table: pa.Table) -> pa.Table:
        dataset, stem, h, w = (table.column(c)[0].as_py() for c in ("dataset", "stem", "height", "width"))
        packed = np.zeros((h, w), np.int64)
        packed[table.column("y").to_numpy(), table.column("x").to_numpy()] = table.column("rgb").to_numpy()
        raw = bitmap(np.stack([packed >> 16 & 255, packed >> 8 & 255, packed & 255], axis=2).astype(np.uint8))
        place = folder if "://" in folder else "file://" + folder.removeprefix("file:")
        fs, base = FileSystem.from_uri(place)
        fs.create_dir(f"{base}/{dataset}/images", recursive=True)
        with fs.open_output_stream(f"{base}/{dataset}/images/{stem}.bmp") as out:
            out.write(raw)
        return pa.table({"path": [f"{folder}/{dataset}/images/{stem}.bmp"], "bytes": pa.array([len(raw)], pa.int64())})

    rows = px.select("dataset", "stem", "height", "width", "y", "x", "rgb")
    return rows.groupBy("dataset", "stem").applyInArrow(run, "path string, bytes long")
