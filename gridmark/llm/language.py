"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text is the mean of the embeddings of its subwords, hashed grams of 2 to 4 bytes inside and across
word edges, and a linear softmax over that mean gives the language.  The model is trained here by
stochastic gradient descent in numpy on a bounded sample; it is applied to whole texts inside Arrow
tasks.  As the softmax is linear in the mean, a trained model is one small table: the class scores
of every bucket.  Probabilities are calibrated by one temperature on documents the training did not
see; a prediction is rejected where the calibrated probability stays below ``reject_below``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmark.llm.frames import carried, narrow
from gridmark.llm.words import LOWER, STEP_BYTES, steps
from gridmark.session import scratch, store

#: Languages that are learned: those of most different texts, ties to the smaller name.
MOST_LANGUAGES = 256
#: Documents per language that the model is trained and calibrated on, chosen by hash; the rest of the corpus is not learned from.
SAMPLE_PER_LANGUAGE = 400
#: Bytes of the training snippets cut from each of them, besides the whole text.
SNIPPETS = (16, 32, 64, 128, 256)
BUCKETS, DIMENSIONS, GRAMS = 1 << 15, 16, (2, 3, 4)
EPOCHS, BATCH, RATE, SEED = 12, 32, 0.5, 7
#: Below even odds the calibrated model is likelier wrong than right.
REJECT_BELOW = 0.5
UNDETERMINED = "und"

#: Bytes as subwords see them: small letters and bytes of other scripts as they are, all else one edge mark.
_FOLD = np.where((np.arange(256) >= 0x80) | ((LOWER >= 0x61) & (LOWER <= 0x7A)), LOWER, 0x20).astype(np.uint32)


class Model(NamedTuple):
    languages: list[str]
    scores: np.ndarray  # (buckets, languages): class scores of a text that is one subword of the bucket
    bias: np.ndarray
    temperature: float


def _subwords(data: np.ndarray, offsets: np.ndarray, buckets: int, begins: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all subwords of the texts and the document of each; grams of edge marks alone are none.

    With ``begins`` only subwords that begin in so many first bytes.
    """
    folded = _FOLD[data]
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    found, owner = [], []
    for n in GRAMS:
        if len(folded) < n:
            continue
        m = min(len(folded) - n + 1, len(folded) if begins is None else begins)
        h, solid = np.full(m, n, np.uint32), np.zeros(m, bool)
        for i in range(n):
            h = (h ^ folded[i:i + m]) * np.uint32(0x01000193)
            solid |= folded[i:i + m] != 0x20
        h ^= h >> np.uint32(15)
        good = solid & (doc[:m] == doc[n - 1:n - 1 + m])
        found.append(((h * np.uint32(0x9E3779B1)) >> np.uint32(16))[good] & np.uint32(buckets - 1))
        owner.append(doc[:m][good])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found).astype(np.int64), np.concatenate(owner)


def _pieces(text: np.ndarray, buckets: int) -> Iterator[np.ndarray]:
    """Buckets of one text's subwords, some of its bytes at a time."""
    for s in range(0, len(text), STEP_BYTES):
        part = text[s:s + STEP_BYTES + max(GRAMS) - 1]
        yield _subwords(part, np.array([0, len(part)]), buckets, STEP_BYTES)[0]


def _tally(text: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of one text's subwords."""
    total = np.zeros(buckets, np.int64)
    for found in _pieces(text, buckets):
        total += np.bincount(found, minlength=buckets)
    some = np.flatnonzero(total)
    return some, total[some]


def _class_sums(data: np.ndarray, offsets: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every text the class scores summed over its subwords, and how many those are; a long text of its own goes piece by piece."""
    n = len(offsets) - 1
    if n == 1 and len(data) > STEP_BYTES:
        total, many = np.zeros((1, scores.shape[1])), 0
        for found in _pieces(data, len(scores)):
            total += scores[found].sum(axis=0, dtype=np.float64)
            many += len(found)
        return total, np.array([many])
    bucket, owner = _subwords(data, offsets, len(scores))
    return np.stack([np.bincount(owner, scores[bucket, c], minlength=n) for c in range(scores.shape[1])], axis=1), np.bincount(owner, minlength=n)


def _training_rows(buckets: int):
    """Per sampled text: subword shares of the whole and of a few snippets, cut at places its own bytes decide."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, data, offsets in steps(batch.column(0)):
                for i in range(len(offsets) - 1):
                    text = data[offsets[i]:offsets[i + 1]]
                    place = np.random.default_rng(int(text[:64].sum()) + len(text))
                    parts = [text]
                    for n in SNIPPETS:
                        if len(text) > n:
                            s = int(place.integers(0, len(text) - n))
                            parts.append(text[s:s + n])
                    rows = [_tally(p, buckets) for p in parts]
                    rows = [(b.astype("<i4").tobytes(), (n / n.sum()).astype("<f4").tobytes()) for b, n in rows if len(b)]
                    if rows:
                        same = pa.array([lo + i] * len(rows), pa.int64())
                        yield pa.RecordBatch.from_arrays([batch.column(1).take(same), batch.column(2).take(same), pa.array(range(len(rows)), pa.int32()),
                                                          pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())],
                                                         ["lang", "place", "part", "ids", "shares"])
    return run


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _fit(rows: pa.Table) -> Model | None:
    """The model of a bounded table of training rows; its last fifth, by hash of the text, sets the temperature."""
    rows = rows.sort_by([("lang", "ascending"), ("place", "ascending"), ("part", "ascending")])
    names = sorted(set(rows.column("lang").to_pylist()))
    texts, held = [], []
    for name, place, ids, shares in zip(rows.column("lang").to_pylist(), rows.column("place").to_pylist(), rows.column("ids"), rows.column("shares")):
        row = (np.frombuffer(ids.as_buffer(), "<i4"), np.frombuffer(shares.as_buffer(), "<f4"), names.index(name))
        (held if place % 5 == 0 else texts).append(row)
    texts, held = texts or held, held or texts
    if not texts:
        return None
    rng = np.random.default_rng(SEED)
    table = rng.normal(0, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    weights, bias = np.zeros((DIMENSIONS, len(names)), np.float32), np.zeros(len(names), np.float32)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = rng.permutation(len(texts))
        for s in range(0, len(order), BATCH):
            part = [texts[i] for i in order[s:s + BATCH]]
            mean = np.stack([share @ table[ids] for ids, share, _ in part])
            slope = _softmax(mean @ weights + bias)
            slope[np.arange(len(part)), [y for _, _, y in part]] -= 1
            back = slope @ weights.T
            weights -= rate * mean.T @ slope / len(part)
            bias -= rate * slope.mean(axis=0)
            for (ids, share, _), g in zip(part, back):
                table[ids] -= (rate * 4) * share[:, None] * g
    scores = table @ weights
    logits = np.stack([share @ scores[ids] + bias for ids, share, _ in held])
    target = np.array([y for _, _, y in held])
    grid = np.geomspace(0.05, 4, 45)
    loss = [-np.log(_softmax(logits / t)[np.arange(len(target)), target] + 1e-12).mean() for t in grid]
    return Model(names, scores, bias, float(grid[int(np.argmin(loss))]))


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", sample: int = SAMPLE_PER_LANGUAGE,
          languages: int = MOST_LANGUAGES) -> Model | None:
    """A model of the languages in ``labelled``; None if no row has both a language and a subword.

    At most ``languages`` values of the language column are learned, those of most different texts.

    At most ``sample`` different texts of each language are learned from, the ones of smallest hash,
    each once however many copies it has; a fifth of them sets the temperature and is not trained on.
    """
    with scratch(labelled.sparkSession):
        known = (labelled.select(F.col(text).alias("body"), F.col(lang).alias("lang"), F.xxhash64(F.col(text)).alias("place"))
                 .filter("lang is not null and body is not null"))
        # copies share one hash, so places are counted and ranked as different texts; only chosen texts are moved
        places = store(known.select("lang", "place").distinct(), "language-texts")
        counts = store(places.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages), "language-counts")
        # four times the sample by hash range, so that few places are ranked, then exactly the smallest
        near = F.col("place") / F.lit(float(1 << 63)) + 1 <= F.lit(8.0 * sample) / F.col("n")
        rank = F.row_number().over(Window.partitionBy("lang").orderBy("place"))
        wanted = store(places.join(narrow(counts), "lang").filter(near).withColumn("rank", rank).filter(F.col("rank") <= sample).select("lang", "place"), "languages")
        chosen = known.join(narrow(wanted), ["lang", "place"]).select("body", "lang", "place").dropDuplicates(["lang", "place"])
        rows = chosen.mapInArrow(_training_rows(BUCKETS), "lang string, place long, part int, ids binary, shares binary")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got = list(batches)
            model = _fit(pa.Table.from_batches(got)) if got else None
            if model is not None:
                yield pa.RecordBatch.from_pylist([{"languages": model.languages, "scores": model.scores.astype("<f4").tobytes(),
                                                   "bias": model.bias.astype("<f4").tobytes(), "temperature": model.temperature}])

        # one task, as the sample is bounded; the driver receives the finished table only
        found = rows.repartition(1).mapInArrow(run, "languages array<string>, scores binary, bias binary, temperature double").first()
        if found is None:
            return None
        return Model(list(found.languages), np.frombuffer(found.scores, "<f4").reshape(BUCKETS, -1), np.frombuffer(found.bias, "<f4"), found.temperature)


def predict(docs: DataFrame, model: Model | None, text: str = "text", reject_below: float = REJECT_BELOW,
            keep: Sequence[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``lang_pred``, ``score`` (calibrated probability, 0 to 1) and ``accepted``; whole texts, other columns unchanged.

    A very long text is summed up piece by piece.  A text that is null or has no letter is ``und``, score 0, not accepted; so is every text without
    a model.  Letters without a subword the model knows get its prior.  Repeated rows and null keys
    are rows like any other; columns of the three names are replaced.
    """
    inside, body_of = carried(docs, text, ("lang_pred", "score", "accepted"), keep)
    return _predicted(inside, body_of, model, reject_below).select("row.*", "lang_pred", "score", "accepted")


def accepted_rows(docs: DataFrame, model: Model | None, text: str = "text", reject_below: float = REJECT_BELOW) -> DataFrame:
    """The rows of ``docs`` whose language is accepted, all columns as they are, also those named like columns of ``predict``."""
    return _predicted(*carried(docs, text, (), None), model, reject_below).filter("accepted").select("row.*")


def _predicted(inside: DataFrame, body_of, model: Model | None, reject_below: float) -> DataFrame:
    schema = inside.select("row").schema.add("lang_pred", "string").add("score", "double").add("accepted", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body = body_of(batch)
            letters = pc.fill_null(pc.match_substring_regex(body, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in steps(body):
                n = hi - lo
                if model is None:
                    names, best = [UNDETERMINED] * n, np.zeros(n)
                else:
                    total, many = _class_sums(data, offsets, model.scores)
                    p = _softmax((total / np.maximum(many, 1)[:, None] + model.bias) / model.temperature)
                    some = letters[lo:hi]
                    best = np.where(some, p.max(axis=1), 0.0)
                    names = [model.languages[c] if ok else UNDETERMINED for c, ok in zip(p.argmax(axis=1), some)]
                ok = (best >= reject_below) & np.array([x != UNDETERMINED for x in names], bool)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), pa.array(names, pa.string()), pa.array(best), pa.array(ok)],
                                                 ["row", "lang_pred", "score", "accepted"])

    return inside.mapInArrow(run, schema)


def learn_and_predict(docs: DataFrame, held_out: Column, text: str = "text", lang: str = "lang", **settings) -> DataFrame:
    """Trains on the rows of ``docs`` that are not ``held_out`` (null: not learned from) and predicts all rows."""
    model = train(docs.filter(~held_out), text, lang)
    return predict(docs, model, text, **settings)
