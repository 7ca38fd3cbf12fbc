"""Ranked search against a plain version; bounds never below exact scores."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from gridmark.llm import ranked

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(LOW))


def plain(docs, items, k):
    bags = [(key, Counter(terms(t))) for key, t in docs]
    n_all, l_all = sum(1 for _, b in bags if b), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        found = []
        for key, bag in bags:
            if bag:
                m = 25 + 75 * sum(bag.values()) * n_all // l_all
                score = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * (1_000_000_000 * bag[t] // (1000 * bag[t] + 8 * m)) for t in terms(text) if t in bag)
                if score > 0:
                    found.append((-score, key is None, key, score))
        out += [(item, i + 1, key, score) for i, (*_, key, score) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(map(str, out))


def corpus(rng, n):
    words = [f"w{i}" for i in range(60)] + ["é", "日本", "A1", "x_y", "It's"]
    weights = [1 / (i + 1) for i in range(len(words))]
    return [" ".join(rng.choices(words, weights, k=rng.choice([1, 3, 20, 60, 300]))) for _ in range(n)]


def test_against_plain(spark, monkeypatch):
    monkeypatch.setattr(ranked, "BLOCK_DOCS", 16)
    rng = random.Random(8)
    texts = corpus(rng, 200)
    docs = [(i if i % 17 else None, t) for i, t in enumerate(texts)] + [(500, None), (501, ""), (502, " .;"), (7, texts[7]), (7, texts[7]), (None, texts[9]), (8, "again w3 w40")]
    items = [(1, "w50 w51 w50 W3"), (2, None), (3, "-"), (4, "none of these"), (5, texts[5]), (None, "w0 w1"), (6, texts[20] + " w59"), (7, "x y it s")]
    d = spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id long, text string, row int, score int").repartition(5)
    q = spark.createDataFrame([(*r, 1, 2) for r in items], "item_id long, text string, row int, item int")
    want = plain(docs, items, 5)
    assert sorted(str(tuple(r)) for r in ranked.search(d, q, 5).collect()) == want
    monkeypatch.setattr(ranked, "GROUP_TERMS", 10)  # several groups of items
    assert sorted(str(tuple(r)) for r in ranked.search(d, q, 5, index=ranked.build_index(d)).collect()) == want
    assert ranked.search(d.limit(0), q).count() == 0 and ranked.search(d, q.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]
    # of rows that share an item id, the one of smallest text is asked
    twice = spark.createDataFrame([(1, "w50"), (1, "w3"), (1, "w3")], "item_id long, text string")
    assert sorted(str(tuple(r)) for r in ranked.search(d, twice, 5).collect()) == plain(docs, [(1, "w3")], 5)


def test_very_long_document_is_read_in_windows(monkeypatch):
    rng = random.Random(9)
    text = " ".join(corpus(rng, 300)) + " end"
    hasher = ranked._Hasher()
    whole = list(ranked.term_counts(pa.array([text]), hasher))
    monkeypatch.setattr(ranked.windows, "__defaults__", (500,))
    (lo, cuts, h, n), = ranked.term_counts(pa.array([text]), hasher)
    assert [x.tolist() for x in (cuts, h, n)] == [x.tolist() for x in whole[0][1:]]
    bag = Counter(terms(text))
    assert sorted(n.tolist()) == sorted(bag.values()) and len(h) == len(bag)


def test_hashes_do_not_depend_on_place():
    data = np.frombuffer(b"ab abc ab c abc", np.uint8)
    h = ranked._Hasher()(data, np.array([0, 3, 7, 10, 12]), np.array([2, 6, 9, 11, 15]))
    assert h[0] == h[2] and h[1] == h[4] and len(set(h.tolist())) == 3


def test_bounds_hold_and_exclude(spark):
    rng = random.Random(10)
    texts = corpus(rng, 300)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    index = ranked.build_index(d)
    asked = ranked._Asked([type("R", (), {"row": 1, "word": w.encode(), "n": 1}) for w in ("w1", "w30", "w59", "日本")])
    asked.count(index, 300, sum(len(terms(t)) for t in texts))
    pairs = ranked._search(index, asked, 10, np.ones(1, np.int64))
    bound = {r.row: r.bound for r in pairs.collect()}
    rows = {r.row: r.doc_id for r in d.select(ranked._row("doc_id", "text").alias("row"), "doc_id").collect()}
    exact = {r.id: r.score for r in ranked._scored(d, asked, pairs, 300, "text", "doc_id").collect()}
    assert all(exact[rows[r]] <= b for r, b in bound.items())
    held = {i for i, t in enumerate(texts) if {"w1", "w30", "w59", "日本"} & set(terms(t))}
    assert held <= {rows[r] for r in bound} and len(bound) <= len(held) + 15
