"""Benchmark leaks against a brute-force version."""

import hashlib
import random
import re

import pytest

from gridmark.llm import decontaminate


def split(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute(texts, items, window):
    wins = {}
    for item, text in items:
        w = split(text)
        m = min(window, len(w))
        for i in range(len(w) - m + 1 if w else 0):
            wins.setdefault(tuple(w[i:i + m]), set()).add(item)
    out = []
    for t in texts:
        w, hit, ids = split(t), set(), set()
        for m in {len(k) for k in wins}:
            for i in range(len(w) - m + 1):
                found = wins.get(tuple(w[i:i + m]))
                if found:
                    hit |= set(range(i, i + m))
                    ids |= found
        names = sorted(str(i) for i in ids if i is not None)
        out.append((len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest()))
    return out


@pytest.mark.parametrize(("window", "gram"), [(10, 8), (5, 3), (4, 4)])
def test_matches_brute_force(spark, window, gram):
    rng = random.Random(window)
    word = lambda n: [rng.choice(["Aa", "b", "c1", "É", "d-e", "f"]) + str(rng.randrange(3)) for _ in range(n)]
    items = [(i, " ".join(word(rng.randint(window - 2, window + 12)))) for i in range(12)]
    items += [(12, None), (13, ""), (14, "."), (None, " ".join(word(window + 1))), (3, items[3][1]), (15, "short one"), (15, "b"), (16, items[2][1])]
    texts = [None, "", "...", "short ONE here", "b b b"]
    for _ in range(60):
        parts = word(rng.randint(0, 12))
        if rng.random() < 0.7:
            w = (rng.choice(items)[1] or "").split(" ")
            parts += w[rng.randint(0, 2):rng.randint(len(w) // 2, len(w))] + word(rng.randint(0, 5))
        texts.append(rng.choice([" ", ", ", "\n"]).join(parts))
    texts += texts[5:9]
    rows = [(i if i % 7 else None, t, "x", i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k1 string, row long").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.report(docs.drop("k1").withColumnRenamed("doc_id", "k0"), bench, key="row", window=window, gram=gram)
    got = {r.row: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in out.collect()}
    want = brute(texts, items, window)
    assert [got[i] for i in range(len(texts))] == want
    clean = decontaminate.clean_documents(docs, bench, window=window, gram=gram)
    assert clean.columns == docs.columns
    assert sorted(r.row for r in clean.collect()) == [i for i, w in enumerate(want) if not w[1]]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    row = decontaminate.report(docs, none).first()
    assert (row.n_words, row.n_hit, row.contaminated, row.item_ids) == (2, 0, False, [])
    assert decontaminate.clean_documents(docs, none).count() == 1
    assert decontaminate.report(docs.limit(0), spark.createDataFrame([(1, "x y")], "item_id long, text string")).count() == 0
