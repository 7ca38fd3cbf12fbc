"""Near-duplicate groups against brute-force similarity of five-word shingles."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridmark.llm import similar


def shingles(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def alike(x, y):
    return 5 * len(x & y) >= 4 * len(x | y)


def survivors(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            if alike(sets[i], sets[j]):
                root[find(i)] = find(j)
    low = {}
    for i, (k, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), k), k)
    return sorted(low.values())


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    texts = []
    for _ in range(60):
        base = [word() for _ in range(rng.choice([4, 60, 150, 400]))]
        texts.append(base)
        for edits in (1, 2, 3, 4, 6):
            copy = list(base)
            for _ in range(max(1, edits * len(base) // 150)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(copy)
    chain = [word() for _ in range(200)]
    for _ in range(40):  # neighbours are alike, ends are not
        chain = chain[3:] + [word() for _ in range(3)]
        texts.append(chain)
    rng.shuffle(texts)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("chunk", [1024, 7])
def test_stage_matches_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(similar, "CHUNK", chunk)
    rows = corpus(chunk)
    df = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, source string").repartition(3)
    out = corpus_pipeline.near_duplicates(spark, df, "")
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == survivors(rows)


def test_rows_are_chosen_not_keys(spark):
    a, b, c = ("alpha beta gamma delta epsilon zeta", "one two three four five six", "red green blue white black pink")
    rows = [(1, a), (2, a), (2, b), (3, b), (3, b), (None, c), (None, c), (None, a), (None, None), (4, "")]
    out = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(map(str, out.collect())) == sorted(map(str, spark.createDataFrame([(1, a), (2, b), (None, c), (4, "")], "doc_id long, text string").collect()))
    assert corpus_pipeline.near_duplicates(spark, out.filter(F.lit(False)), "").count() == 0


def test_fingerprints_alone_find_close_copies(spark, monkeypatch):
    rng = random.Random(5)
    rows, close = [], []
    for i in range(0, 40, 2):  # a word less at the end: one shingle of some hundreds
        base = [f"w{rng.randrange(3000)}" for _ in range(600)]
        pair = [" ".join(base), " ".join(base[:-1])]
        rows += [(i, pair[0]), (i + 1, pair[1])]
        data = np.frombuffer("".join(pair).encode(), np.uint8)
        x, y = similar._fingerprints(similar._sets(data, np.array([0, len(pair[0]), len(data)]), 5)).tolist()
        close.append(((x ^ y) & (1 << 64) - 1).bit_count() <= 3)
    assert sum(close) > 15
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    # no two sets share a band
    monkeypatch.setattr(similar, "_bands", lambda sets: np.array([[hash((x.tobytes(), i)) for i in range(similar.BANDS)] for x in sets], np.int64))
    out = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect())
    assert out == [i for i in range(40) if i % 2 == 0 or not close[i // 2]]


def test_close_fingerprints_are_checked_on_the_shingles(spark, monkeypatch):
    monkeypatch.setattr(similar, "_fingerprints", lambda sets: np.zeros(len(sets), np.int64))
    rows = corpus(3)
    out = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in out.collect()) == survivors(rows)


def test_fingerprint_is_the_majority_of_bits(monkeypatch):
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 1 << 32, n, np.uint64)).astype(np.uint32) for n in (1, 2, 300, 5, 40)]
    whole = similar._fingerprints(sets)
    single = [[int(similar._fingerprints([s[i:i + 1]])[0]) for i in range(len(s))] for s in sets]
    for fp, parts in zip(whole.tolist(), single):
        assert all((fp >> b & 1) == (2 * sum(x >> b & 1 for x in parts) > len(parts)) for b in range(64))
    monkeypatch.setattr(similar, "PIECE", 7)
    assert (similar._fingerprints(sets) == whole).all()
