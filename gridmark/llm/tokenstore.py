"""Token ids on disk in patched frame-of-reference blocks, with an index of block starts.

A file holds the ids of a run of documents, one after the other, in blocks of :data:`BLOCK` ids.  A
block stores ids less the block's minimum, packed at the width that holds a percentile of them; what
is wider is an exception: its low bits stay in the packed part, its place and high bits are listed.
Behind the blocks come the documents (key, number of ids), the byte offset of every block and a
footer of fixed size, so that any run of ids is read from the blocks that hold it and nothing else.

Layout, little endian: ``PFR1``; blocks; keys int64; key-is-null uint8; counts uint64; block offsets
uint64; footer ``<ids Q> <documents Q> <blocks Q> <offset of the keys Q> PFR1``.  A block: ``<minimum
I> <ids I> <exceptions I> <width B>``, packed ids, exception places uint32, exception high bits uint32.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmark.llm.packing import _Coder as Coder
from gridmark.llm.tokens import encoded
from gridmark.llm.warc import _open
from gridmark.session import store

MAGIC = b"PFR1"
BLOCK = 4096
#: Percentile of a block's values that its packed width holds; the rest are exceptions.
PERCENTILE = 95
#: A file is closed at the first document end from this many ids on; ranges that one row of a reading task covers.
FILE_IDS, READ_IDS = 1 << 26, 1 << 19
END_ID = 2
_HEAD, _FOOT = "<IIIB", "<QQQQ4s"


# --- blocks ----------------------------------------------------------------------------------

def pack_block(ids: np.ndarray) -> bytes:
    """One block of 1 to :data:`BLOCK` unsigned 32-bit ids."""
    low = int(ids.min())
    rest = (ids - np.uint32(low)).astype("<u4")
    at = (len(rest) * PERCENTILE + 99) // 100 - 1
    width = int(np.partition(rest, at)[at]).bit_length()
    bits = np.unpackbits(rest.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
    high = rest >> np.uint32(width) if width < 32 else np.zeros_like(rest)
    odd = np.flatnonzero(high)
    return b"".join((struct.pack(_HEAD, low, len(ids), len(odd), width), np.packbits(bits.ravel(), bitorder="little").tobytes(),
                     odd.astype("<u4").tobytes(), high[odd].astype("<u4").tobytes()))


def unpack_block(raw: memoryview, at: int = 0) -> tuple[np.ndarray, int]:
    """The ids of the block at ``at`` and where it ends."""
    low, n, odd, width = struct.unpack_from(_HEAD, raw, at)
    at += struct.calcsize(_HEAD)
    size = (n * width + 7) // 8
    bits = np.zeros((n, 32), np.uint8)
    bits[:, :width] = np.unpackbits(np.frombuffer(raw, np.uint8, size, at), bitorder="little")[:n * width].reshape(n, width)
    ids = np.packbits(bits, axis=1, bitorder="little").view("<u4").reshape(-1)
    at += size
    if odd:
        place = np.frombuffer(raw, "<u4", odd, at)
        ids[place] |= np.frombuffer(raw, "<u4", odd, at + 4 * odd) << np.uint32(width)
    return ids + np.uint32(low), at + 8 * odd


# --- files -----------------------------------------------------------------------------------

class Writer:
    """Writes one file as a stream; only an unfinished block, the block offsets and the documents' counts are held."""

    def __init__(self, sink):
        self.sink, self.at, self.rest = sink, 0, np.zeros(0, np.uint32)
        self.starts, self.keys, self.counts, self.ids = [], [], [], 0
        self._put(MAGIC)

    def _put(self, raw: bytes) -> None:
        self.sink.write(raw)
        self.at += len(raw)

    def _block(self, ids: np.ndarray) -> None:
        self.starts.append(self.at)
        self._put(pack_block(ids))

    def add(self, pieces: list[np.ndarray]) -> None:
        """Ids of the document at hand or of several, in order; whole blocks are written at once."""
        ids = np.concatenate([self.rest, *pieces])
        whole = len(ids) - len(ids) % BLOCK
        for s in range(0, whole, BLOCK):
            self._block(ids[s:s + BLOCK])
        self.ids += len(ids) - len(self.rest)
        self.rest = ids[whole:].copy()

    def document(self, key: int | None, count: int) -> None:
        self.keys.append(key)
        self.counts.append(count)

    def close(self) -> None:
        if len(self.rest):
            self._block(self.rest)
        table = self.at
        null = np.array([k is None for k in self.keys], np.uint8)
        for part in (np.array([k or 0 for k in self.keys], "<i8"), null, np.array(self.counts, "<u8"), np.array(self.starts, "<u8")):
            self._put(part.tobytes())
        self._put(struct.pack(_FOOT, self.ids, len(self.keys), len(self.starts), table, MAGIC))


class Footer(NamedTuple):
    ids: int
    documents: int
    blocks: int
    table: int  # offset of the keys; counts and block offsets follow

    def counts_at(self) -> int:
        return self.table + 9 * self.documents

    def starts_at(self) -> int:
        return self.table + 17 * self.documents


def footer(source) -> Footer:
    size, own = source.size(), struct.calcsize(_FOOT)
    *fields, magic = struct.unpack(_FOOT, source.read_at(own, size - own)) if size >= own else (b"",)
    if magic != MAGIC:
        raise ValueError("not a token file, or cut short")
    return Footer(*fields)


def read_ids(source, start: int, stop: int, foot: Footer | None = None) -> Iterator[np.ndarray]:
    """Ids ``start`` to ``stop`` of a file, block by block: the index gives the bytes, blocks before and behind are not read."""
    foot = foot or footer(source)
    if not 0 <= start <= stop <= foot.ids:
        raise ValueError(f"no ids {start} to {stop} in a file of {foot.ids}")
    if start == stop:
        return
    first, last = start // BLOCK, (stop - 1) // BLOCK
    group = 256  # blocks fetched at once
    for lo in range(first, last + 1, group):
        hi = min(lo + group, last + 1)
        ends = np.frombuffer(source.read_at(8 * (min(hi + 1, foot.blocks) - lo), foot.starts_at() + 8 * lo), "<u8").tolist()
        end = ends[hi - lo] if hi < foot.blocks else foot.table
        raw, at = memoryview(source.read_at(end - ends[0], ends[0])), 0
        for b in range(lo, hi):
            ids, at = unpack_block(raw, at)
            yield ids[max(start - b * BLOCK, 0):stop - b * BLOCK]


# --- Spark -----------------------------------------------------------------------------------

def write_tokens(docs: DataFrame, folder: str, definition: str, ranks: str | None = None, pattern: str = "", key: str = "doc_id", text: str = "text",
                 end_id: int = END_ID, added: bool = True) -> DataFrame:
    """Writes the ids of all documents in ascending key order and returns ``(file, base, ids, documents, bytes)``, a row a file.

    ``base`` is the number of ids in the files before.  A document is the ids of its text and
    ``end_id``; null and empty texts are the end id alone.  Null keys come first, equal keys follow
    their texts' hash, so one key may fill many files.  A text is encoded in pieces cut before a
    space, where the vocabulary's pattern always cuts, so a very long one needs no more memory than
    its pieces.  A task that runs twice leaves files that no row names.
    """
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("body"), F.xxhash64(F.col(text)).alias("tie"), F.monotonically_increasing_id().alias("row"))
    rows = rows.repartitionByRange(tasks, "key", "tie", "row").sortWithinPartitions("key", "tie", "row").select("key", "body", F.spark_partition_id().alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, place = _open(folder)
        fs.create_dir(place, recursive=True)
        coder, attempt, done, before, part = Coder(definition, ranks, pattern, added), uuid.uuid4().hex, 0, 0, 0
        writer = sink = name = None

        def close() -> pa.RecordBatch:
            nonlocal writer, sink, done, before
            writer.close()
            sink.close()
            made = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([f"{folder}/{name}"]),
                                               *[pa.array([x], pa.int64()) for x in (before, writer.ids, len(writer.keys), writer.at)]], _FILES)
            before += writer.ids
            writer, done = None, done + 1
            return made

        end = np.array([end_id], np.uint32)
        held, size = [], 0
        for batch in batches:
            for r in range(batch.num_rows):
                if writer is None:
                    part = batch.column(2)[r].as_py()
                    name = f"part-{part:06d}-{done:05d}-{attempt}.pfor"
                    sink = fs.open_output_stream(f"{place}/{name}")
                    writer = Writer(sink)
                count = 1
                for ids in encoded(coder, batch.column(1)[r].as_py() or ""):
                    held.append(ids)
                    count += len(ids)
                    size += len(ids)
                    if size >= READ_IDS:
                        writer.add(held)
                        held, size = [], 0
                held.append(end)
                writer.document(batch.column(0)[r].as_py(), count)
                if writer.ids + size >= FILE_IDS:
                    writer.add(held)
                    held, size = [], 0
                    yield close()
        if writer is not None:
            writer.add(held)
            yield close()

    files = store(rows.mapInArrow(run, "part int, file string, before long, ids long, documents long, bytes long"), "token-files")
    # one number a task, summed up on the driver
    parts = sorted((r.part, r.ids) for r in files.groupBy("part").agg(F.sum("ids").alias("ids")).collect())
    bases, at = [], 0
    for part, ids in parts:
        bases.append((part, at))
        at += ids
    known = spark.createDataFrame(bases, "part int, base long")
    return files.join(F.broadcast(known), "part").select("file", (F.col("base") + F.col("before")).alias("base"), "ids", "documents", "bytes")


_FILES = ["part", "file", "before", "ids", "documents", "bytes"]


def list_documents(files: DataFrame) -> DataFrame:
    """``(file, base, first, last, id)``: runs of a file's documents of about :data:`READ_IDS` ids, and where the first one's ids begin in the file."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, path = _open(name)
                with fs.open_input_file(path) as source:
                    foot = footer(source)
                    counts = np.frombuffer(source.read_at(8 * foot.documents, foot.counts_at()), "<u8").astype(np.int64)
                begin = np.cumsum(counts) - counts
                first = np.flatnonzero(np.diff(begin // READ_IDS, prepend=-1))
                last = np.append(first[1:], foot.documents)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(first), pa.string()), *[pa.array(np.asarray(x, np.int64)) for x in (
                    np.full(len(first), base), first, last, begin[first])]], ["file", "base", "first", "last", "id"])

    return files.select("file", "base").mapInArrow(run, "file string, base long, first long, last long, id long")


def read_tokens(files: DataFrame, key: str = "doc_id", ids: bool = False) -> DataFrame:
    """``(key, start, n_tokens, ids_crc32)`` of every document of the files and, with ``ids``, its ids as an array.

    The runs of documents are dealt out anew, so tasks share files; without ``ids`` a task holds some
    blocks at a time, however long a document is.
    """
    kind = f"{key} long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if ids else "")
    names = [x.split()[0] for x in kind.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base, first, last, at in zip(*(c.to_pylist() for c in batch.columns)):
                fs, path = _open(name)
                with fs.open_input_file(path) as source:
                    foot = footer(source)
                    many = last - first
                    keys = np.frombuffer(source.read_at(8 * many, foot.table + 8 * first), "<i8")
                    null = np.frombuffer(source.read_at(many, foot.table + 8 * foot.documents + first), np.uint8).astype(bool)
                    counts = np.frombuffer(source.read_at(8 * many, foot.counts_at() + 8 * first), "<u8").astype(np.int64)
                    crcs, lists, doc, left, crc, own = [], [], 0, int(counts[0]), 0, []
                    for block in read_ids(source, at, at + int(counts.sum()), foot):
                        while len(block):
                            take, block = block[:left], block[left:]
                            crc = zlib.crc32(take.astype("<u4").tobytes(), crc)
                            left -= len(take)
                            if ids:
                                own.append(take)
                            if not left:
                                crcs.append(crc)
                                if ids:
                                    lists.append(np.concatenate(own).astype(np.int64))
                                doc, crc, own = doc + 1, 0, []
                                left = int(counts[doc]) if doc < many else 0
                columns = [pa.array(keys, mask=null), pa.array(base + at + np.cumsum(counts) - counts), pa.array(counts), pa.array(crcs, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(lists, pa.list_(pa.int64()))] if ids else []), names)

    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given as a number, so that the small rows are not drawn together
    return list_documents(files).repartition(tasks, "file", "first").mapInArrow(run, kind)
