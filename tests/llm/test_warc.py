"""WARC packages: exact round trip, ZIP64, packages without an index."""

import hashlib
import io
import zipfile

import pyarrow as pa
import pytest

from gridmark.llm import warc


def rows():
    long = "<p>" + "é" * 80
    out = [(i, f"http://h/{i}", f"<html>page {i}</html>" + "x" * i) for i in range(150)]
    out += [(200, "u", long), (199, "u\r\nInjected: 1", long), (201, None, long), (199, "again", long), (None, "u", long)]
    out += [(300, "u", None), (301, "u", ""), (302, "u", "a\r\n\r\nb"), (303, "u", "short"), (304, "u", "short"), (None, "n", "z" * 200), (None, "n", "z" * 200)]
    return out


def test_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "PACKAGE_RECORDS", 11)
    monkeypatch.setattr(warc, "READ_BYTES", 300)
    df = spark.createDataFrame([(*r, "clash") for r in rows()], "page_id long, url string, html string, digest string").repartition(4)
    made = warc.write_packages(df, str(tmp_path / "out"))
    assert made.count() > 10
    got = warc.read_records(made).collect()
    first = {}
    for i, _, h in rows():
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(first.get(h, i), i)
    want = []
    for i, u, h in rows():
        raw = (h or "").encode()
        ref = first.get(h) if h in first and (i is None or i > first[h]) else None
        want.append((str(i), str(u), len(raw), hashlib.sha256(raw).hexdigest(), "response" if ref is None else "revisit", str(ref), (h or "") if ref is None else None))
    seen = [(r.record_id or "None", str(r.url), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to), r.payload) for r in got]
    assert sorted(map(str, seen)) == sorted(map(str, want))


def source(data):
    return pa.BufferReader(data)


def test_zip64_and_missing_index():
    records = [warc._record(str(i), "u", b"x" * i, hashlib.sha256(b"x" * i).hexdigest(), None) for i in range(5)]
    package = warc.build_package(records)
    with zipfile.ZipFile(io.BytesIO(package)) as z:
        data = z.read(warc.WARC_MEMBER)
    many = io.BytesIO()
    with zipfile.ZipFile(many, "w", zipfile.ZIP_STORED) as z:
        for i in range(66_000):  # more members than the short end record can count
            z.writestr(f"pages/{i}.txt", b"")
        with z.open(warc.WARC_MEMBER, "w", force_zip64=True) as out:
            out.write(data)
        z.comment = b"PK\x05\x06 in a comment"
    raw = many.getvalue()
    assert b"PK\x06\x06" in raw
    found = [warc.parse_record(warc.gzip.decompress(raw[o:o + n])) for o, n in warc.record_ranges(source(raw))]
    assert [f["payload_bytes"] for f in found] == list(range(5))
    assert [n for _, n in warc.record_ranges(source(package))] == [n for _, n in warc.record_ranges(source(raw))]


def test_refusals():
    with pytest.raises(ValueError):
        warc.stored_members(source(b"not a zip at all"))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(warc.WARC_MEMBER, b"x" * 1000)
    with pytest.raises(ValueError):
        warc.stored_members(source(out.getvalue()))
    bad = warc._record("1", "u", b"abc", "0" * 64, None)
    with pytest.raises(ValueError):
        warc.parse_record(bad)


def test_empty_table(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_records(warc.write_packages(none, str(tmp_path / "none"))).count() == 0
