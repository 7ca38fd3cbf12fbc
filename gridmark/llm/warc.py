"""WARC records in ZIP packages: writing, and reading by ranges without extraction.

A package is a ZIP file whose members are stored, not deflated: ``archive/data.warc.gz`` (one gzip
member per record) and ``indexes/index.cdxj`` (one JSON line per record).  Reading never unpacks a
package: the end-of-directory record (ZIP64 where present) gives the central directory, that gives
the stored members, the index gives every record's range, and records are read by range, in tasks
that share the ranges and not the packages.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmark.llm.frames import narrow
from gridmark.session import store

#: Payloads below this size are never replaced by a revisit.
REVISIT_BYTES = 100
#: A package is closed at this many bytes or records.
PACKAGE_BYTES, PACKAGE_RECORDS = 32 << 20, 8192
#: Neighbouring ranges are read together up to this many bytes.
READ_BYTES = 1 << 20
WARC_MEMBER, INDEX_MEMBER = "archive/data.warc.gz", "indexes/index.cdxj"
_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "1970-01-01T00:00:00Z"
_RECORD = ("archive string, offset long, length long, record_id string, record_type string, url string, refers_to string, "
           "payload_bytes long, payload_digest string, payload string")


def _open(place: str) -> tuple[FileSystem, str]:
    if place.startswith("file:/") and not place.startswith("file://"):
        place = "file://" + place[5:]
    return FileSystem.from_uri(place)


# --- writing ---------------------------------------------------------------------------------

def _record(ident: str, url: str | None, payload: bytes, digest: str, refers: str | None) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http if refers is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{ident}>", f"WARC-Date: {_DATE}",
            f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    if url is not None:
        head.append("WARC-Target-URI: " + json.dumps(url, ensure_ascii=False)[1:-1])
    if refers is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers}>", f"WARC-Profile: {_REVISIT_PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def build_package(records: list[bytes]) -> bytes:
    """A package of records, each a gzip member of its own."""
    data, lines = io.BytesIO(), []
    for r in records:
        packed = gzip.compress(r, 6, mtime=0)
        lines.append(json.dumps({"filename": WARC_MEMBER, "offset": data.tell(), "length": len(packed)}))
        data.write(packed)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.writestr(WARC_MEMBER, data.getvalue())
        z.writestr(INDEX_MEMBER, "\n".join(lines))
    return out.getvalue()


def write_packages(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html",
                   least: int = REVISIT_BYTES) -> DataFrame:
    """Writes a record per row and returns ``(archive, records, bytes)`` of the packages written.

    A null html is an empty payload.  Of equal payloads of at least ``least`` bytes the row with the
    smallest key is a response (rows that repeat that key with it) and the others revisit it; rows
    without a key revisit too, unless no copy has one.  A task that runs twice leaves a package that
    no row names.
    """
    body = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(key).cast("string").alias("ident"), F.col(key).alias("key"), F.col(url).cast("string").alias("url"), body.alias("html"),
                        F.sha2(body.cast("binary"), 256).alias("digest"), F.octet_length(body).alias("size"))
    copies = rows.filter(F.col("size") >= least).groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null")
    rows = rows.join(narrow(store(copies.drop("n"), "copies")), "digest", "left")
    revisit = (F.col("size") >= least) & F.col("first").isNotNull() & (F.col("key").isNull() | (F.col("key") > F.col("first")))
    rows = rows.select("ident", "url", "html", "digest", F.when(revisit, F.col("first").cast("string")).alias("refers"), F.spark_partition_id().alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(folder)
        fs.create_dir(base, recursive=True)
        held, size, attempt, done = [], 0, uuid.uuid4().hex, 0

        def close(part: int) -> pa.RecordBatch:
            nonlocal held, size, done
            package = build_package(held)
            name = f"part-{part:06d}-{attempt}-{done:05d}.wacz"
            with fs.open_output_stream(f"{base}/{name}") as out:
                out.write(package)
            made = pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([len(held)], pa.int64()), pa.array([len(package)], pa.int64())],
                                              ["archive", "records", "bytes"])
            held, size, done = [], 0, done + 1
            return made

        part = 0
        for batch in batches:
            for r in range(batch.num_rows):
                ident, link, text, digest, refers, part = (c[r].as_py() for c in batch.columns)
                record = _record(ident or "", link, text.encode(), digest, refers)
                held.append(record)
                size += len(record)
                if size >= PACKAGE_BYTES or len(held) >= PACKAGE_RECORDS:
                    yield close(part)
        if held:
            yield close(part)

    return store(rows.mapInArrow(run, "archive string, records long, bytes long"), "packages")


# --- reading ---------------------------------------------------------------------------------

class Member(NamedTuple):
    name: str
    offset: int  # of the member's first byte in the package
    size: int


def _directory(source) -> tuple[int, int, int]:
    """(offset, bytes, entries) of the central directory, from the last 64 KB and, where present, the ZIP64 records."""
    size = source.size()
    tail_size = min(size, 65535 + 22 + 20)
    tail = source.read_at(tail_size, size - tail_size)
    at = tail.rfind(b"PK\x05\x06", 0, max(tail_size - 18, 0))
    while at >= 0 and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != tail_size:
        at = tail.rfind(b"PK\x05\x06", 0, at)  # the signature may also occur in a comment
    if at < 0:
        raise ValueError("no end of central directory: not a ZIP file, or cut short")
    entries, length, offset = struct.unpack_from("<HII", tail, at + 10)
    if at >= 20 and tail[at - 20:at - 16] == b"PK\x06\x07":
        place = struct.unpack_from("<Q", tail, at - 12)[0]
        record = source.read_at(56, place)
        if record[:4] != b"PK\x06\x06":
            raise ValueError("ZIP64 end of central directory is not where its locator says")
        entries, length, offset = struct.unpack_from("<QQQ", record, 32)
    return offset, length, entries


def stored_members(source) -> list[Member]:
    """Members of a package that are stored, in directory order; deflated or encrypted members are refused."""
    offset, length, entries = _directory(source)
    raw, at, out = source.read_at(length, offset), 0, []
    for _ in range(entries):
        if raw[at:at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        flags, method = struct.unpack_from("<HH", raw, at + 8)
        packed, size, names, extras, comments = struct.unpack_from("<IIHHH", raw, at + 20)
        local = struct.unpack_from("<I", raw, at + 42)[0]
        name = raw[at + 46:at + 46 + names].decode("utf-8" if flags & 0x800 else "cp437")
        extra = raw[at + 46 + names:at + 46 + names + extras]
        while len(extra) >= 4:
            kind, n = struct.unpack_from("<HH", extra)
            if kind == 1:  # ZIP64: only the fields that overflow are there, in this order
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                size = next(wide) if size == 0xFFFFFFFF else size
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                local = next(wide) if local == 0xFFFFFFFF else local
            extra = extra[4 + n:]
        at += 46 + names + extras + comments
        if name.endswith("/"):
            continue
        if method != 0 or flags & 1:
            raise ValueError(f"member {name} is not stored plainly")
        out.append(Member(name, local, packed))
    found = []
    for m in out:
        head = source.read_at(30, m.offset)
        if head[:4] != b"PK\x03\x04":
            raise ValueError(f"no local header for {m.name}")
        found.append(m._replace(offset=m.offset + 30 + sum(struct.unpack_from("<HH", head, 26))))
    return found


def _scan(source, member: Member) -> Iterator[tuple[int, int]]:
    """Ranges of the gzip members of a WARC member without an index, read piece by piece."""
    begin = at = member.offset
    end, gunzip = member.offset + member.size, zlib.decompressobj(31)
    while at < end:
        piece = source.read_at(min(READ_BYTES, end - at), at)
        at += len(piece)
        while piece:
            gunzip.decompress(piece)
            piece = gunzip.unused_data
            if gunzip.eof:
                yield begin, at - len(piece) - begin
                begin, gunzip = at - len(piece), zlib.decompressobj(31)


def record_ranges(source) -> Iterator[tuple[int, int]]:
    """(offset, length) of every record, by the package's indexes; members no index names are scanned."""
    members = {m.name: m for m in stored_members(source)}
    named = set()
    for m in members.values():
        if m.name.endswith(".cdxj"):
            for line in source.read_at(m.size, m.offset).decode().splitlines():
                entry = json.loads(line[line.index("{"):])
                if entry["filename"] not in members:
                    raise ValueError(f"index names {entry['filename']}, which the package lacks")
                named.add(entry["filename"])
                yield members[entry["filename"]].offset + int(entry["offset"]), int(entry["length"])
    for m in members.values():
        if m.name.endswith(".warc.gz") and m.name not in named:
            yield from _scan(source, m)


def parse_record(raw: bytes) -> dict:
    """Fields and payload of one WARC record; a response's payload is checked against its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    http, _, payload = rest[:int(fields["Content-Length"])].partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields["WARC-Type"]
    if kind == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its header")
    inner = lambda name: fields[name].removeprefix("<urn:page:").removesuffix(">") if name in fields else None
    url = fields.get("WARC-Target-URI")
    return {"record_id": inner("WARC-Record-ID"), "record_type": kind, "url": None if url is None else json.loads(f'"{url}"'),
            "refers_to": inner("WARC-Refers-To"), "payload_bytes": length, "payload_digest": digest,
            "payload": payload.decode() if kind == "response" else None}


def list_records(archives: DataFrame) -> DataFrame:
    """``(archive, offset, length)`` of all records of the packages named in column ``archive``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                fs, path = _open(name)
                with fs.open_input_file(path) as source:
                    ranges = list(record_ranges(source))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(ranges), pa.string()), pa.array([r[0] for r in ranges], pa.int64()),
                                                  pa.array([r[1] for r in ranges], pa.int64())], ["archive", "offset", "length"])

    return archives.select("archive").mapInArrow(run, "archive string, offset long, length long")


def read_records(archives: DataFrame, text: bool = True) -> DataFrame:
    """All records of the packages: where they are, their WARC fields and, with ``text``, a response's payload.

    The ranges are dealt out anew before they are read, so one large package is read by many tasks.
    """
    names = [x.split()[0] for x in _RECORD.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch]).sort_by([("archive", "ascending"), ("offset", "ascending")])
            rows = list(zip(*(c.to_pylist() for c in table.columns)))
            i, out, held = 0, [], 0
            while i < len(rows):
                name, begin, end = rows[i][0], rows[i][1], rows[i][1] + rows[i][2]
                j = i + 1
                while j < len(rows) and rows[j][0] == name and rows[j][1] == end and end + rows[j][2] - begin <= READ_BYTES:
                    end += rows[j][2]
                    j += 1
                fs, path = _open(name)
                with fs.open_input_file(path) as source:
                    data = source.read_at(end - begin, begin)
                for _, offset, length in rows[i:j]:
                    found = parse_record(gzip.decompress(data[offset - begin:offset - begin + length]))
                    out.append({"archive": name, "offset": offset, "length": length, **found, "payload": found["payload"] if text else None})
                held += end - begin
                i = j
                if held >= READ_BYTES:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out, held = [], 0
            yield pa.RecordBatch.from_pylist(out, schema)

    kinds = {"string": pa.string(), "long": pa.int64()}
    schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in _RECORD.split(", ")])
    tasks = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given as a number, so that the small rows are not drawn together
    block = F.floor(F.col("offset") / READ_BYTES)
    return list_records(archives).repartition(tasks, "archive", block).mapInArrow(run, _RECORD).select(*names)
