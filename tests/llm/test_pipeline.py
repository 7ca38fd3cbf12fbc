"""The pipeline's stages, each on its predecessor's rows, against brute-force versions on a small fixture."""

import os
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridmark.session import shared_folder

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", text or "")


def groups(rows):
    """Smallest id of every row's group connected by five-word shingle similarity 0.8 or more, by all pairs."""
    sets = [frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset() for w in ((r.text or "").lower().split() for r in rows)]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                old, new = root[i], root[j]
                root = [new if x == old else x for x in root]
    return [min((r.doc_id for r, y in zip(rows, root) if y == x and r.doc_id is not None), default=None) for x in root]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(4)
    vocabulary = {"en": "the and of with thing house water under".split(), "fr": "le la que dans école où très même".split()}
    text = lambda lang, n: " ".join(rng.choice(vocabulary[lang]) + rng.choice("abcdefgh") for _ in range(n))
    passage, leak = text("en", 60), text("en", 14)
    rows = []
    for i in range(120):
        lang = rng.choice(["en", "fr"])
        body = text(lang, rng.randint(20, 90))
        if i % 10 == 3:
            body += "\n" + passage + "\n" + text("en", 5)
        if i % 17 == 5:
            body += " " + leak
        rows.append((i, body, lang, "s"))
    near = rows[1][1].split(" ")
    rows += [(210 + i, " ".join([*near, *near[:i]]), "en", "s") for i in range(1, 4)]  # near copies, also of each other
    rows += [(200, rows[0][1], "en", "s"), (201, rows[0][1], "en", "s"), (200, rows[0][1], "en", "s"), (None, text("en", 40), "en", "s"), (202, None, None, "s"),
             (203, "", "en", None), (204, "12 34", "en", "s")]
    place = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], COLUMNS).write.parquet(f"{place}/documents.parquet")
    spark.createDataFrame([(1, leak), (2, None)], "item_id long, text string").write.parquet(f"{place}/benchmark.parquet")
    return place


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        out = stage(spark, docs, folder)
        after = out.collect()
        if name != "packing":
            assert out.columns == columns
        seen[name] = (before, after)
        docs = spark.createDataFrame(after, out.schema)
    before, after = seen["language_id"]
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    assert gone == {202, 203, 204}  # no letters; every other text is in one of the two languages
    before, after = seen["near_duplicates"]
    assert sorted(map(str, (r.doc_id for r in after))) == sorted(map(str, set(groups(before))))
    assert len(after) < len(before) - 4
    before, after = seen["repeated_passages"]
    count = Counter(tuple(w[i:i + 35]) for w in map(words, (r.text for r in before)) for i in range(len(w) - 34))
    out = {r.doc_id: r for r in after}
    for r in before:
        w = words(r.text)
        cut = {p for i in range(len(w) - 34) if count[tuple(w[i:i + 35])] > 1 for p in range(i, i + 35)}
        assert words(out[r.doc_id].text) == [x for p, x in enumerate(w) if p not in cut]
        assert out[r.doc_id].n_chars == len(out[r.doc_id].text)
    before, after = seen["benchmark_leaks"]
    leak = spark.read.parquet(f"{folder}/benchmark.parquet").filter("item_id = 1").first().text.split(" ")
    grams = {" ".join(leak[i:i + 10]) for i in range(5)}
    assert sorted(str(r.doc_id) for r in after) == sorted(str(r.doc_id) for r in before if not any(g in " ".join(words(r.text)) for g in grams))
    before, after = seen["packing"]
    import public_tokenizers as public
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    tokens = {str(r.doc_id): len(t.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in before}
    at = Counter()
    for r in sorted(after, key=lambda r: (str(r.doc_id), r.start)):
        assert r.start == at[str(r.doc_id)] and r.doc_tokens == tokens[str(r.doc_id)]
        at[str(r.doc_id)] += r.length
    assert at == tokens


def folders(spark):
    shared_folder(spark, "any")
    return set(os.listdir(spark.sparkContext.getCheckpointDir().removeprefix("file:")))


def test_run_leaves_its_last_result_only(spark, folder):
    before = folders(spark)
    out = corpus_pipeline.run(spark, folder)
    assert out.filter(F.col("length") < 1).count() == 0 < out.count()
    assert [x.rsplit("-", 1)[0] for x in folders(spark) - before] == ["pipeline-packing"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_a_stage_leaves_what_its_result_reads(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for stage, left in ((corpus_pipeline.language_id, []), (corpus_pipeline.near_duplicates, ["similar-judged"]), (corpus_pipeline.repeated_passages, ["repeats"])):
        before = folders(spark)
        out = stage(spark, docs, folder)
        assert sorted(x.rsplit("-", 1)[0] for x in folders(spark) - before) == left
        assert out.count()


def test_empty_documents(spark, folder, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_language_stage_keeps_columns_of_the_model_s_names(spark):
    rows = [(i, f"the house and water {i % 7}", "en", f"own {i}", i % 2, "mine") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string, accepted int, lang_pred string")
    out = corpus_pipeline.language_id(spark, df, "")
    assert out.schema == df.schema and sorted(map(tuple, out.collect())) == rows
