"""Image folders: listings without reading content, and decoded pixels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmark.functions.names import is_image
from gridmark.operators.pairing import describe_files
from gridmark.session import store

PIXEL_SCHEMA = "path string, height int, width int, channels int, y int, x int, r int, g int, b int"
ROWS_PER_BATCH = 1 << 20


def scan_files(spark: SparkSession, root: str) -> DataFrame:
    """Image files under ``root`` with dataset (first folder), dir, name, stem and extension.

    Only file metadata is read: the content column is pruned from the scan.  Here and in all readers
    below a file of zero bytes has no row, as Spark's file sources do not list such files.
    """
    listing = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
               .select("path", "length", "modificationTime"))
    base = root.rstrip("/") + "/"
    below = F.substring_index(F.col("path"), base, -1)
    return describe_files(listing.withColumn("dataset", F.element_at(F.split(below, "/"), 1)))


def _byte(at: Column) -> Column:
    """Byte number ``at`` (from 1) of the file; 0 beyond its end."""
    return F.coalesce(F.conv(F.hex(F.substring(F.col("content"), at, F.lit(1))), 16, 10).cast("int"), F.lit(0))


def _number(at: Column, n: int, little: Column) -> Column:
    """An ``n``-byte unsigned number at ``at`` in either byte order."""
    big = sum((_byte(at + i) * (1 << 8 * (n - 1 - i)) for i in range(1, n)), _byte(at) * (1 << 8 * (n - 1)))
    small = sum((_byte(at + i) * (1 << 8 * i) for i in range(1, n)), _byte(at))
    return F.when(little, small).otherwise(big)


def _tiff_bits() -> Column:
    """Bits of the first sample from the first directory of a TIFF file (tag 258; 1 where it is absent)."""
    little = F.hex(F.substring("content", 1, 1)) == "49"
    directory = _number(F.lit(5), 4, little) + 1
    entries = F.sequence(F.lit(1), F.greatest(_number(directory, 2, little), F.lit(1)))
    found = F.filter(F.transform(entries, lambda i: directory + 2 + (i - 1) * 12), lambda e: _number(e, 2, little) == 258)
    entry = F.get(found, F.lit(0))
    place = F.when(_number(entry + 4, 4, little) <= 2, entry + 8).otherwise(_number(entry + 8, 4, little) + 1)
    return F.when(entry.isNull(), F.lit(1)).otherwise(_number(place, 2, little))


def file_headers(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``(path, format, bit_depth)`` of every image file, from its first bytes: nothing is decoded.

    ``format`` is null for content of no known kind; ``bit_depth`` is 16 where a sample is stored in
    more than 8 bits, else 8, as smaller samples are widened when read.
    """
    raw = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
           .filter(is_image(F.col("path"))).select("path", "content"))
    lead = F.hex(F.substring("content", 1, 8))
    kind = (F.when(lead == "89504E470D0A1A0A", "PNG").when(lead.startswith("FFD8FF"), "JPEG").when(lead.startswith("424D"), "BMP")
            .when(lead.startswith("49492A00") | lead.startswith("4D4D002A"), "TIFF").when(lead.startswith("5035") | lead.startswith("5032"), "PGM"))
    # a PGM header: magic, width, height, largest value, with comment lines in between
    head = F.regexp_replace(F.decode(F.substring("content", 1, 1024), "ISO-8859-1"), r"#[^\n]*\n", " ")
    largest = F.regexp_extract(head, r"^P[25]\s+\d+\s+\d+\s+(\d+)\s", 1).try_cast("int")
    bits = F.when(kind == "PNG", _byte(F.lit(25))).when(kind == "TIFF", _tiff_bits()).when((kind == "PGM") & (largest > 255), 16).otherwise(8)
    return raw.select(one_form(F.col("path")).alias("path"), kind.alias("format"), F.when(kind.isNotNull(), F.when(bits > 8, 16).otherwise(8)).alias("bit_depth"))


def one_form(path: Column) -> Column:
    """One spelling of local paths, which the file sources write with one or three slashes."""
    return F.regexp_replace(path, "^file:/+", "file:///")


def _attempted(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Every image file, decoded; height is negative where that failed."""
    rows = spark.read.format("image").option("dropInvalid", "false").option("recursiveFileLookup", "true").load(paths)
    rows = rows.select(one_form(F.col("image.origin")).alias("path"), F.col("image.height").alias("height"), F.col("image.width").alias("width"),
                       F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))
    return rows.filter(is_image(F.col("path")))


def _deep(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Paths of images that pixels of 8 bits cannot hold; written, so that joins know how few they are."""
    return store(file_headers(spark, paths).filter("bit_depth > 8").select("path"), "deep")


def read_images(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Decoded images ``(path, height, width, channels, data)``; :func:`image_problems` lists the files that are not among them."""
    return _attempted(spark, paths).filter("height > 0").join(_deep(spark, paths), "path", "left_anti")


def image_problems(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``(path, problem)`` of every image file that has no pixels: it cannot be decoded, or holds more than 8 bits a sample."""
    broken = _attempted(spark, paths).filter("height <= 0").select("path", F.lit("cannot be decoded").alias("problem"))
    deep = _deep(spark, paths).join(broken, "path", "left_anti")
    return broken.unionByName(deep.select("path", F.lit("more than 8 bits a sample").alias("problem")))


def _raw(batch: pa.RecordBatch, row: int) -> tuple[str, np.ndarray]:
    """Path and bytes (height, width, channels) of one image; the bytes are not copied."""
    path, h, w, c = (batch.column(n)[row].as_py() for n in ("path", "height", "width", "channels"))
    return path, np.frombuffer(batch.column("data")[row].as_buffer(), np.uint8).reshape(h, w, c)


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Image bytes (blue, green, red order) to one row per pixel, a bounded band of rows at a time."""
    for batch in batches:
        for row in range(batch.num_rows):
            path, raw = _raw(batch, row)
            h, w, c = raw.shape
            step = max(1, ROWS_PER_BATCH // max(1, w))
            for top in range(0, h, step):
                band = raw[top:top + step].astype(np.int32)
                n = band.shape[0] * w
                b, g, r = (band[..., i if c >= 3 else 0].ravel() for i in range(3))
                same = {"height": h, "width": w, "channels": c}
                yield pa.RecordBatch.from_pydict({
                    "path": pa.array([path] * n), **{k: pa.array(np.full(n, v, np.int32)) for k, v in same.items()},
                    "y": pa.array(np.repeat(np.arange(top, top + band.shape[0], dtype=np.int32), w)),
                    "x": pa.array(np.tile(np.arange(w, dtype=np.int32), band.shape[0])), "r": pa.array(r), "g": pa.array(g), "b": pa.array(b)})


def scan_pixels(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row per pixel of every readable image: never resized, palettes expanded, alpha dropped."""
    return read_images(spark, paths).mapInArrow(_unpack, PIXEL_SCHEMA)


def _grey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whether all channels of an image are equal everywhere, one row per image."""
    for batch in batches:
        equal = []
        for row in range(batch.num_rows):
            raw = _raw(batch, row)[1]
            equal.append(bool((raw[..., :3] == raw[..., :1]).all()))
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("path", "height", "width", "channels")), pa.array(equal, pa.bool_())],
                                         ["path", "height", "width", "channels", "equal"])


def image_meta(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``(path, format, height, width, channels, bit_depth, colour_mode)`` of every image file.

    A file that cannot be decoded keeps its row, without size, channels and mode.  'rgb-but-gray' is
    three equal channels in every pixel; deep images are judged on the 8 bits that were read.
    """
    seen = _attempted(spark, paths).filter("height > 0").mapInArrow(_grey, "path string, height int, width int, channels int, equal boolean")
    mode = (F.when(F.col("channels") == 1, "grayscale").when(F.col("channels") >= 3, F.when(F.col("equal"), "rgb-but-gray").otherwise("rgb"))
            .when(F.col("channels").isNotNull(), F.concat("channels", F.lit("-channel"))))
    return (file_headers(spark, paths).join(seen, "path", "left")
            .select("path", "format", "height", "width", "channels", "bit_depth", mode.alias("colour_mode")))
