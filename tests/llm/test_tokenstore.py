"""Blocks and files by exact round trips; the stored tokens against the defining tokenizer."""

import io
import random
import zlib

import numpy as np
import pytest
import public_tokenizers as public
from pyarrow import BufferReader
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridmark.llm import packing, queries, tokens, tokenstore
from gridmark.session import shared_folder

FILES = public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN


DEFINING = Tokenizer.from_file(FILES[0])


def plain(text):
    return [*DEFINING.encode(text or "", add_special_tokens=False).ids, 2]


def test_blocks():
    rng = np.random.default_rng(4)
    top = 2**32 - 1
    for ids in ([0], [top], [7] * 4096, [0, top] * 9, list(range(4096)), [3] * 100 + [top], rng.integers(0, 50_000, 4096).tolist(), (rng.pareto(0.3, 999) % top).astype(int).tolist()):
        raw = tokenstore.pack_block(np.array(ids, np.uint32))
        got, end = tokenstore.unpack_block(memoryview(b"xy" + raw + b"z"), 2)
        assert got.tolist() == ids and end == 2 + len(raw)
    # the width follows the percentile, outliers are exceptions: 12 bits for most of 4096 values
    ids = np.append(rng.integers(1000, 5000, 4000), [4_000_000_000] * 96).astype(np.uint32)
    assert len(tokenstore.pack_block(ids)) < 4096 * 12 / 8 + 8 * 96 + 14


def test_any_range_of_a_file():
    rng = np.random.default_rng(5)
    ids, out = rng.integers(0, 50_257, 3 * tokenstore.BLOCK + 77).astype(np.uint32), io.BytesIO()
    w = tokenstore.Writer(out)
    for s in range(0, len(ids), 1500):
        w.add([ids[s:s + 700], ids[s + 700:s + 1500]])
    w.document(9, len(ids))
    w.close()
    source = BufferReader(out.getvalue())
    for start, stop in [(0, len(ids)), (0, 0), (5, 6), (4095, 4097), (4096, 8192), (8191, len(ids)), (len(ids), len(ids))]:
        got = list(tokenstore.read_ids(source, start, stop))
        assert (np.concatenate(got) if got else ids[:0]).tolist() == ids[start:stop].tolist()
    with pytest.raises(ValueError):
        list(tokenstore.read_ids(source, 0, len(ids) + 1))
    with pytest.raises(ValueError):
        tokenstore.footer(BufferReader(out.getvalue()[:-1]))


def test_pieces_have_the_ids_of_the_text():
    rng = random.Random(6)
    coder = packing._Coder(*FILES, True)
    for _ in range(300):
        text = "".join(rng.choice(["a", "B'", "s", "'ll", " ", "  ", "\n", " ", "1", "?!", "é", "日", "\x1c", "<|endoftext|>", " "]) for _ in range(rng.randint(0, 60)))
        cut = list(tokens.encoded(coder, text, 3))
        assert np.concatenate(cut).tolist() == plain(text)[:-1]


def test_documents_round_trip(spark, monkeypatch):
    monkeypatch.setattr(tokenstore, "FILE_IDS", 3000)
    monkeypatch.setattr(tokenstore, "READ_IDS", 500)
    monkeypatch.setattr(tokenstore, "BLOCK", 64)
    rng = random.Random(7)
    texts = [None, "", " ", "<|endoftext|> plain", "héé ça\n\n", "日本語 текст", "x" * 3000, "a b " * 4000] + [
        " ".join(rng.choice(["Ab.", "ce", "12", "éê!", "\n"]) for _ in range(rng.randint(0, 300))) for _ in range(60)]
    rows = [((i * 37) % 71 - 5 if i % 13 else None, t, i, 0) for i, t in enumerate(texts)] + [(5, "same key", 0, 0)] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string, start long, key int").repartition(3)
    files = tokenstore.write_tokens(df, shared_folder(spark, "tokens"), *FILES)
    got = tokenstore.read_tokens(files, ids=True).collect()
    assert sorted((str(r.doc_id), list(r.ids)) for r in got) == sorted((str(r[0]), plain(r[1])) for r in rows)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes()))
        at += r.n_tokens
    keys = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert keys == sorted(keys, key=lambda k: (k is not None, k))
    assert files.count() > 5 and files.agg(F.sum("ids")).first()[0] == at
    short = tokenstore.read_tokens(files)
    assert short.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and short.count() == len(rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert tokenstore.read_tokens(tokenstore.write_tokens(df, shared_folder(spark, "tokens"), *FILES)).count() == 0


def test_query_against_plain(spark):
    got = {r.doc_id: r for r in queries.QUERIES["op12_token_store"](spark, "/root/testdata/sf0.001").collect()}
    at = 0
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect():
        ids = plain(r.text)
        assert tuple(got[r.doc_id]) == (r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert len(got) == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
