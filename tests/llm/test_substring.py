"""Repeated-span removal against a brute-force version."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gridmark.llm import frames, substring
from gridmark.session import discard, scratch, settings, store


def brute(texts, length):
    words = [re.findall(r"[^\x20\x09-\x0d]+", t or "") for t in texts]
    seen = Counter(tuple(w[i:i + length]) for w in words for i in range(len(w) - length + 1))
    out = []
    for w in words:
        gone = {p for i in range(len(w) - length + 1) if seen[tuple(w[i:i + length])] > 1 for p in range(i, i + length)}
        out.append((len(w), len(gone), hashlib.sha256(" ".join(x for p, x in enumerate(w) if p not in gone).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_matches_brute_force(spark, seed):
    rng = random.Random(seed)
    word = lambda n: [rng.choice("abcdefgé") * rng.randint(1, 2) for _ in range(n)]
    shared = [word(rng.randint(8, 30)) for _ in range(5)]
    texts = [None, "", " \n", "a", "loop " * 60, "x " * 14, "b " * 13 + "c " * 14 + "d " * 11, "ab cd " * 40, " lead " + " ".join(shared[0]) + " trail "]
    for _ in range(80):
        parts = []
        for _ in range(rng.randint(1, 4)):
            parts += rng.choice(shared)[rng.randint(0, 3):] if rng.random() < 0.6 else word(rng.randint(1, 25))
        texts.append(rng.choice([" ", "\n", "  "]).join(parts))
    texts += texts[-6:]
    rows = [(i if i % 9 else None, t, i, "x") for i, t in enumerate(texts)] + [(1, texts[1], -1, "x"), (10, texts[10], -2, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, row int, d string").repartition(3)
    out = {r.row: r for r in substring.remove_repeats(df, length=12, anchor=4).collect()}
    want = brute([r[1] for r in rows], 12)
    assert len(out) == len(rows)
    for r, (n, gone, sha) in zip(rows, want):
        o = out[r[2]]
        assert (o.repeats.n_words, o.repeats.n_removed, o.repeats.kept_sha256) == (n, gone, sha), (r, o)
        assert hashlib.sha256(" ".join(re.findall(r"[^\x20\x09-\x0d]+", o.text or "")).encode()).hexdigest() == sha
        assert (o.text == r[1]) or gone
        assert sum(b - a for a, b in o.repeats.spans) == gone


def test_empty_table(spark):
    out = substring.remove_repeats(spark.createDataFrame([], "doc_id long, text string, source string"))
    assert out.columns == ["doc_id", "text", "source", "repeats"] and out.count() == 0


def shuffled(spark):
    """Bytes that the session has written to shuffles so far."""
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


def test_texts_without_repeats_are_not_shuffled(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=60))
    passage = " ".join(word() for _ in range(50))
    texts = [" ".join(word() for _ in range(150)) + (f" {passage}" if i < 6 else "") for i in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    # as with tables whose joins are not broadcast
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}), scratch(spark) as keep:
        docs = keep(store(df, "documents"))
        before = shuffled(spark)
        out = {r.doc_id: (r.repeats.n_words, r.repeats.n_removed, r.repeats.kept_sha256) for r in substring.remove_repeats(docs).collect()}
        written = shuffled(spark) - before
        discard(docs)
    assert [out[i] for i in range(len(texts))] == brute(texts, 35)
    assert sum(gone for _, gone, _ in out.values()) == 300
    assert 0 < written < sum(map(len, texts)) / 4


@pytest.mark.parametrize("rows, words", [(1, 1), (3, 2)])
def test_a_full_sieve_changes_no_result(spark, monkeypatch, rows, words):
    monkeypatch.setattr(frames, "SIEVE_ROWS", rows)
    monkeypatch.setattr(frames, "SIEVE_WORDS", words)
    test_matches_brute_force(spark, 5)


def test_sieve_flags_all_keys(spark):
    hashes = spark.range(20_000).select(F.xxhash64("id").alias("h"), "id", (F.col("id") * 0).alias("sieve"))
    out = frames.sieve(hashes, hashes.filter("id % 10 = 0"), "h")
    assert out.columns == ["h", "id", "sieve", "maybe"]
    assert out.count() == 20_000 and out.filter("id % 10 = 0 and not maybe").count() == 0
    assert out.filter("id % 10 != 0 and maybe").count() < 20
    edges = spark.createDataFrame([(x,) for x in (0, -1, 63, 64, 2**63 - 1, -2**63)], "h long")
    assert frames.sieve(edges, edges, "h").filter("maybe").count() == 6
    assert frames.sieve(edges, edges.limit(0), "h").filter("maybe").count() == 0
