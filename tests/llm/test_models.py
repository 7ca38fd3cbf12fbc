"""Language and quality models: held-out accuracy, rejection, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridmark.llm import language, quality, queries

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_held_out_language_accuracy(spark, documents):
    found = queries.QUERIES["op2_language"](spark, SF).join(documents, "doc_id").filter("held_out")
    right, n, low = found.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int")), F.count("*"), F.min("score")).first()
    assert n > 200 and right >= 0.97 and 0 <= low


def test_language_of_odd_rows(spark, documents):
    model = language.train(documents, sample=60)
    assert model.languages == ["de", "en", "es", "fr"]
    rows = [(None, None), (1, ""), (2, "123 !? \n"), (3, "the and of thing"), (3, "the and of thing"), (4, "日本語"), (5, "der die und ein " * 40_000), (None, "le la que")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = language.predict(df, model).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.text): r for r in got}
    for key in ((None, None), (1, ""), (2, "123 !? \n")):
        assert by[key].lang_pred == "und" and by[key].score == 0 and not by[key].accepted
    assert by[3, "the and of thing"].lang_pred == "en" and by[5, rows[6][1]].lang_pred == "de"
    assert by[4, "日本語"].lang_pred in model.languages
    assert all(0 <= r.score <= 1 for r in got)
    assert language.predict(df.limit(0), model).count() == 0


def test_language_without_training_rows(spark):
    df = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert language.train(df) is None
    assert [tuple(r) for r in language.learn_and_predict(df, F.lit(False)).select("lang_pred", "score").collect()] == [("und", 0.0)]


def test_language_sample_is_of_different_texts(spark):
    words = {"de": "der die und ein", "en": "the and of thing", "es": "el los que una", "fr": "le la est dans"}
    rows = [(f"{w} {'abcdef'[i] * 4}", lang) for lang, w in words.items() for i in range(6)]
    df = spark.createDataFrame(rows, "text string, lang string").crossJoin(spark.range(5000).select())
    assert language.train(df).languages == sorted(words)


def test_quality_sample_weighs_texts_by_rows(spark):
    df = spark.createDataFrame([(f"text {i} word",) for i in range(8)], "text string").crossJoin(spark.range(9000).select())
    x, rows = quality._sample(df, "text", 6)
    assert len(x) == 6 and rows.tolist() == [9000.0] * 6


def test_held_out_quality(spark, documents):
    found = queries.QUERIES["op5_quality"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("held_out")
    rows = found.select("quality", "score", "predicted").collect()
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.98
    assert np.mean([r.quality == r.predicted for r in rows]) > 0.95


def test_quality_of_odd_rows(spark, documents):
    model = quality.train(documents, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = [(None, None), (1, ""), (2, " "), (3, "word"), (3, "word"), (4, "a b " * 100_000)]
    got = quality.score(spark.createDataFrame(rows, "doc_id long, text string").withColumn("predicted", F.lit("x")), model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    none = spark.createDataFrame([], "doc_id long, text string, quality int")
    assert quality.train(none, none) is None
    assert quality.learn_and_score(none, none, F.lit(False)).count() == 0


def test_risk_stays_non_negative_on_separable_data():
    rng = np.random.default_rng(1)
    good, bad = rng.normal(2, 1, (500, 3)), rng.normal(-2, 1, (500, 3))
    web = np.concatenate([rng.normal(2, 1, (700, 3)), rng.normal(-2, 1, (300, 3))])
    m = quality.fit(good, web, 0.7)
    s = lambda x: quality._logistic((x - m.center) / m.spread @ m.weights + m.bias)
    assert (s(good) > 0.5).mean() > 0.95 and (s(bad) < 0.5).mean() > 0.95


def plain_language(model, text):
    """One document at a time: every gram hashed by itself, its class scores summed, softmax of the mean."""
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    fold = [b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in text.encode()]
    total, n = np.zeros(len(model.languages)), 0
    for size in language.GRAMS:
        for i in range(len(fold) - size + 1):
            gram = fold[i:i + size]
            if any(b != 0x20 for b in gram):
                h = size
                for b in gram:
                    h = ((h ^ b) * 0x01000193) & 0xFFFFFFFF
                h ^= h >> 15
                total += model.scores[((h * 0x9E3779B1 & 0xFFFFFFFF) >> 16) % len(model.scores)]
                n += 1
    z = (total / max(n, 1) + model.bias) / model.temperature
    p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    return model.languages[int(p.argmax())], float(p.max())


def test_language_against_plain(spark, documents, monkeypatch):
    model = language.train(documents, sample=40)
    texts = [r.text for r in documents.limit(30).collect()] + ["Ünïcode ÀB", "a", "A1b", "12", "", None, "é", "的 的"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = [plain_language(model, t) for t in texts]
    for step in (1 << 20, 50):  # the second cuts every text into pieces
        monkeypatch.setattr(language, "STEP_BYTES", step)
        monkeypatch.setattr(language.steps, "__defaults__", (step,))
        got = {r.doc_id: r for r in language.predict(df, model).collect()}
        assert [got[i].lang_pred for i in range(len(texts))] == [w for w, _ in want]
        assert np.allclose([got[i].score for i in range(len(texts))], [s for _, s in want], atol=1e-5)


def test_languages_are_bounded(spark):
    rows = [(f"text {i} {lang}", lang) for lang, n in (("a", 9), ("b", 8), ("c", 8), ("d", 2)) for i in range(n)]
    df = spark.createDataFrame(rows, "text string, lang string")
    assert language.train(df, languages=2).languages == ["a", "b"]


def test_quality_is_the_logistic_of_the_measures(spark, documents):
    """Measures by plain loops over one text at a time, then the model's formula."""
    import re
    import zlib

    def measures(text):
        data = (text or "").encode()
        words, size = re.findall(rb"[^\x20\x09-\x0d]+", data), max(len(data), 1)
        kinds = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!?", b"#$%&*+/<=>@\\^_`{|}~", b"|", b".,;:")
        share = [sum(b in k for b in data) / size for k in kinds]
        n = max(len(words), 1)
        mean = sum(map(len, words)) / n
        odd = sum((len(w) - mean) ** 2 for w in words) / n
        form = [(sum(b * (b + 77) for b in w), len(w)) for w in words]
        repeat = sum(a == b for a, b in zip(form, form[1:])) / n
        ends = sum(w[-1:] in (b".", b",", b";", b":") for w in words) / n
        x = np.array([*share, mean, odd ** 0.5, repeat, ends, len(zlib.compress(data, 1)) / (size + 20), np.log1p(len(words))])
        return np.concatenate([x, np.sqrt(x), np.log1p(100 * x[:6])])

    model = quality.train(documents, spark.read.parquet(f"{SF}/labels.parquet"))
    texts = [r.text for r in documents.limit(40).collect()] + [None, "", " ", "a a a. B! 7 | x", "é é"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in quality.score(df, model).collect()}
    for i, t in enumerate(texts):
        z = float(np.clip((measures(t) - model.center) / model.spread, -6, 6) @ model.weights + model.bias)
        assert abs(got[i] - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) < 1e-9


def test_quality_fit_minimises_the_stated_risk():
    """At the fitted point no finite difference of the non-negative risk falls noticeably; from a shifted point one does."""
    rng = np.random.default_rng(2)
    good, web = rng.normal(1, 1, (300, 2)), np.concatenate([rng.normal(1, 1, (300, 2)), rng.normal(-1, 1, (300, 2))])
    m = quality.fit(good, web, 0.5)

    def risk(theta):
        a, b = (1 / (1 + np.exp(-(np.clip((x - m.center) / m.spread, -6, 6) @ theta[:-1] + theta[-1]))) for x in (good, web))
        return -0.5 * np.log(a).mean() + max(0.0, -np.log(1 - b).mean() + 0.5 * np.log(1 - a).mean()) + quality.DECAY / 2 * (theta[:-1] ** 2).sum()

    at = np.append(m.weights, m.bias)
    steps = [s * e for e in np.eye(len(at)) for s in (0.05, -0.05)]
    assert all(risk(at + d) > risk(at) - 1e-6 for d in steps)
    assert min(risk(at + 0.5 + d) for d in steps) < risk(at + 0.5) - 1e-3
