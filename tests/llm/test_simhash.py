"""SimHash groups against a brute-force version."""

import random
import re

import xxhash
from pyspark.sql import functions as F

from gridmark.llm import simhash


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    n = max(1, len(words) - 2)
    ones = [0] * 64
    for i in range(n):
        h = xxhash.xxh64_intdigest(" ".join(words[i:i + 3]).encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > n)


def components(fps, keys):
    low = dict(zip(range(len(fps)), keys))
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                parent[find(i)] = find(j)
    out = {}
    for i in range(len(fps)):
        if low[i] is not None:
            out[find(i)] = min(out.get(find(i), low[i]), low[i])
    return [out.get(find(i)) for i in range(len(fps))]


def near_texts(seed, n):
    rng = random.Random(seed)
    base = [" ".join(rng.choice("aa Bb ÉÉ cé dd\teee ff\ngg hh ii".split(" ")) + str(rng.randrange(40)) for _ in range(60)) for _ in range(4)]
    out = []
    for _ in range(n):
        words = rng.choice(base).split(" ")
        words[rng.randrange(len(words))] = rng.choice("xyz")
        out.append(" ".join(words))
    return out


def test_fingerprints_and_components_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 7)
    texts = near_texts(1, 120) + [None, "", "  ", "One", "one", "one two", "A b C", "a  b\nc", " end ", *near_texts(1, 3)]
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, "One"), (None, "lonely text of null key")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash")).repartition(3)
    got = {}
    found = simhash.near_duplicates(df).collect()
    assert len(found) == len(rows)
    fps = [brute(t) for _, t in rows]
    want = sorted(zip([str(k) for k, _ in rows], fps, [str(c) for c in components(fps, [k for k, _ in rows])]))
    got = sorted((str(r.doc_id), r.fp % 2**64, str(r.component_id)) for r in found)
    assert got == want


def test_very_long_text_is_counted_in_pieces(spark, monkeypatch):
    rng = random.Random(12)
    texts = [" ".join(rng.choice("Aa bb\tcc dd é".split(" ")) for _ in range(rng.choice([0, 1, 2, 3, 50, 400]))) for _ in range(60)] + ["word" * 200, " " * 300, "two " + "w" * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {i: brute(t) for i, t in enumerate(texts)}
    monkeypatch.setattr(simhash, "STEP_BYTES", 20)
    monkeypatch.setattr(simhash.steps, "__defaults__", (20,))
    monkeypatch.setattr(simhash.overlapping, "__defaults__", (20,))
    assert {r.doc_id: r.fp % (1 << 64) for r in simhash.fingerprints(df).collect()} == want


def test_memory_of_a_50_mb_text():
    """Peak of the process while one text of 50 MB gets its fingerprint, its shingle set and its language sums."""
    import subprocess
    import sys
    from pathlib import Path

    code = """
import resource, numpy as np
from gridmark.llm import language, similar, simhash
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
data = np.frombuffer((b"some words of a long text %d " * 1_700_000)[:50_000_000], np.uint8)
offsets = np.array([0, len(data)])
simhash._fingerprints(data, offsets, 3, 42); similar._sets(data, offsets, 5)
language._class_sums(data, offsets, np.ones((1 << 15, 4), np.float32))
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=Path(__file__).parents[2], check=True)
    assert int(out.stdout) < 1000
