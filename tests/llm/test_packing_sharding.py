"""Packing by exact round trip and brute-force cuts; jump hashing against the published loop."""

import random
import zlib

import numpy as np
import public_tokenizers as public
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridmark.llm import packing, queries, sharding


def cost(cuts, ends, prices, limit):
    total, at = 0.0, 0
    for c in cuts:
        if c - at > limit:
            return float("inf")
        total += limit - (c - at) + prices[ends.index(c)]
        at = c
    return total if ends[-1] - at <= limit else float("inf")


def test_cuts_are_optimal():
    rng = random.Random(5)
    for _ in range(200):
        n, limit = rng.randint(1, 9), rng.randint(4, 12)
        ends = np.cumsum([rng.randint(1, 4) for _ in range(n)])
        prices = np.array([rng.choice([0.0, 1.0, 5.0]) for _ in range(n)])
        got = packing.choose_cuts(ends, prices, limit)
        e = ends.tolist()
        want = min(cost([e[i] for i in range(n - 1) if m >> i & 1], e, prices, limit) for m in range(1 << (n - 1)))
        assert cost(got, e, prices, limit) == want


def test_every_token_is_in_one_piece(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_TOKENS", 5000)
    rng = random.Random(2)
    odd = [None, "", " ", "<|endoftext|> plain", "héé ça\n\n", "日本語 текст", "x" * 9000, "퟿ ok", "a.b! c?\n" * 900, "é    "]
    texts = odd + [" ".join(rng.choice(["Ab.", "ce", "12", "éê!", "\n"]) for _ in range(rng.randint(0, 700))) for _ in range(120)]
    rows = [(i if i % 11 else None, t, i) for i, t in enumerate(texts)] + [(5, texts[5], 1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start long").repartition(3)
    t = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    want = {r[2]: [*t.encode(r[1] or "", add_special_tokens=False).ids, 1] for r in rows}
    pieces = packing.pack(df.drop("doc_id").withColumnRenamed("start", "n"), public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"),
                          public.PATTERN, key="n").collect()
    at = {}
    for p in sorted(pieces, key=lambda p: (p.n, p.start)):
        ids = want[p.n][p.start:p.start + p.length]
        assert p.start == at.get(p.n, 0) and len(ids) == p.length > 0 and p.doc_tokens == len(want[p.n])
        assert p.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at[p.n] = p.start + p.length
    assert at == {k: len(v) for k, v in want.items()}
    sizes = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == sizes.get(p.sequence_id, 0)
        sizes[p.sequence_id] = p.offset + p.length
    assert max(sizes.values()) <= 2048
    padding = sum(2048 - s for s in sizes.values() if s & (s - 1))
    assert padding < 0.01 * sum(sizes.values())
    assert queries.pack_documents(df.limit(0)).count() == 0


def test_added_tokens_of_the_definition_are_recognised(spark):
    texts = ["plain text", "one<|endoftext|>two", "<|endoftext|>", "é <|endoftext|> ÿ", "日本 <|endoftext|>", "<|endoftex|>"]
    t = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    want = [[*t.encode(x, add_special_tokens=False).ids, 1] for x in texts]
    assert 50256 in want[1]
    pieces = queries.pack_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)).collect()
    assert {p.doc_id: p.doc_tokens for p in pieces} == {i: len(w) for i, w in enumerate(want)}
    for p in pieces:
        assert p.ids_crc32 == zlib.crc32(np.array(want[p.doc_id][p.start:p.start + p.length], "<u4").tobytes())


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash_matches_the_published_loop(spark):
    keys = [0, 1, -1, 7, 2**63 - 1, -2**63, *[random.Random(3).randrange(-2**63, 2**63) for _ in range(300)]]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 16, 17):
        got = [(r.k, r.s) for r in df.select("k", sharding.jump_hash(F.col("k"), n).alias("s")).collect()]
        assert got == [(k, jump(k % 2**64, n)) for k in keys]


def test_shards_cover_all_rows(spark, tmp_path):
    rows = [(i, f"text é {i % 7}", "a") for i in range(400)] + [(5, None, "b")] * 200 + [(None, "", "c")] * 30
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string").repartition(5)
    out = sharding.assign(df).collect()
    assert len(out) == len(rows)
    slots = {}
    for r in out:
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 16)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert len({r.shard for r in out if r.doc_id == 5}) == 1
    assert sorted((r.size, r.text_crc32) for r in out) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t, _ in rows)
    assert sharding.assign(df.limit(0)).count() == 0
    sharding.write_shards(df, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(rows)
