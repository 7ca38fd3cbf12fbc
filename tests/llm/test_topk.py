"""Top-k search against brute force."""

import math
import random

from pyspark.sql import functions as F

from gridmark.llm import topk


def test_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 7)
    rng = random.Random(1)
    rows = [(i, [rng.choice([0.0, rng.uniform(-1, 1)]) for _ in range(6)]) for i in range(150)]
    rows += [(200 + i, rows[3][1]) for i in range(60)]  # many ties
    rows += [(300, None), (350, [1.0, None]), (400, [math.nan, 1.0]), (450, [math.inf]), (None, [1.0]), (500, []), (550, [1.0, 2.0]), (7, rows[8][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash")).repartition(4)
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, a in good:
        if q % 50 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), c) for c, b in good if c != q)[:5]
            want += [(q, r, c, -s) for r, (s, c) in enumerate(scored, 1)]
    got = [tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0).collect()]
    assert sorted(got) == sorted(want)


def test_few_candidates_and_empty_table(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(df, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 256 * 512)]
    assert topk.top_k(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_groups_of_queries_meet_every_candidate_without_a_join(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 2)
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 3)
    monkeypatch.setattr(topk, "GROUP_WEIGHTS", 8, raising=False)
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(60)]
    found = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), F.col("vec_id") % 5 == 0, k=3, lanes=4)
    # a broadcast would hold every lane's copy of the queries on the driver
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    weights = {i: [math.floor(256 * x) for x in v] for i, v in rows}
    want = []
    for q in range(0, 60, 5):
        scored = sorted((-sum(x * y for x, y in zip(weights[q], w)), c) for c, w in weights.items() if c != q)[:3]
        want += [(q, r, c, -s) for r, (s, c) in enumerate(scored, 1)]
    assert sorted(map(tuple, found.collect())) == want
