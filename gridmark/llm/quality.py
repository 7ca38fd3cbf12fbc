"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text are all it learns from.  With the share of good text (the
class prior) estimated, the risk of the missing negatives is that of the unlabelled texts less that
of the positives among them; the estimate must not fall below zero, so where it does the step turns
back (non-negative unbiased risk).  The model is logistic on a text's own measures and their bends.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmark.llm.frames import carried, narrow
from gridmark.llm.words import Words, steps
from gridmark.session import store

#: Texts that the model is fitted on, chosen by hash; the class prior is counted on all labelled rows.
POSITIVES, UNLABELLED = 4000, 12000
STEPS, RATE, DECAY = 5000, 0.05, 1e-5
#: Prior taken where labels hold no negative to count.
DEFAULT_PRIOR = 0.5
THRESHOLD = 0.3

_IS = {name: np.zeros(256, bool) for name in ("upper", "digit", "mark", "symbol", "bar", "stop")}
_IS["upper"][0x41:0x5B] = True
_IS["digit"][0x30:0x3A] = True
_IS["mark"][[ord(c) for c in "!?"]] = True
_IS["symbol"][[ord(c) for c in "#$%&*+/<=>@\\^_`{|}~"]] = True
_IS["bar"][ord("|")] = True
_IS["stop"][[ord(c) for c in ".,;:"]] = True


class Model(NamedTuple):
    center: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float


def _measures(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Measures of every text, whole: kinds of characters, word lengths, repetition of words and of all of it."""
    w, n = Words(data, offsets), len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1).astype(float)
    doc = np.repeat(np.arange(n), np.diff(offsets))
    share = [np.bincount(doc[_IS[k][data]], minlength=n) / size for k in _IS]
    words = np.maximum(w.count, 1).astype(float)
    length = (w.end - w.start).astype(float)
    mean = np.bincount(w.doc, length, minlength=n) / words
    odd = np.bincount(w.doc, (length - mean[w.doc]) ** 2, minlength=n) / words
    sums = np.zeros(len(w.bytes) + 1, np.uint64)
    np.cumsum(w.bytes.astype(np.uint64) * (w.bytes.astype(np.uint64) + np.uint64(77)), out=sums[1:])
    form = (sums[w.to] - sums[w.at]) * np.uint64(131) + (w.to - w.at).astype(np.uint64)
    again = np.zeros(len(form), bool)
    again[1:] = (form[1:] == form[:-1]) & (w.doc[1:] == w.doc[:-1])
    repeat = np.bincount(w.doc[again], minlength=n) / words
    ends = np.bincount(w.doc[_IS["stop"][data[w.end - 1]]], minlength=n) / words if len(w.end) else np.zeros(n)
    bare = data.tobytes()
    packed = np.array([len(zlib.compress(bare[a:b], 1)) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]) / (size + 20)
    out = np.stack([*share, mean, np.sqrt(odd), repeat, ends, packed, np.log1p(w.count)], axis=1)
    return np.concatenate([out, np.sqrt(out), np.log1p(100 * out[:, :len(share)])], axis=1)


def _measured(body: int, others: list[int], names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in steps(batch.column(body)):
                x = _measures(data, offsets)
                flat = pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), x.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in others), flat], names)
    return run


def _sample(docs: DataFrame, text: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Measures of the ``size`` different texts of smallest hash and how many rows each has; a hash range first, so that few texts are measured."""
    hashed = docs.select(F.col(text).alias("body"), F.xxhash64(F.col(text)).alias("place"))
    many = hashed.select("place").distinct().count()
    near = hashed.filter(F.col("place") / F.lit(float(1 << 63)) + 1 <= F.lit(8.0 * size / max(many, 1)))
    few = (near.mapInArrow(_measured(0, [1], ["place", "x"]), "place long, x array<double>").groupBy("place").agg(F.first("x").alias("x"), F.count("*").alias("n"))
           .orderBy("place").limit(size).toArrow())
    return np.array(few.column("x").to_pylist(), float).reshape(few.num_rows, -1), few.column("n").to_numpy().astype(float)


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(good: np.ndarray, web: np.ndarray, prior: float, good_rows: np.ndarray | None = None, web_rows: np.ndarray | None = None) -> Model:
    """Minimises the non-negative unbiased risk of a logistic model with Adam steps on the whole sample; a text counts as its rows do."""
    share = lambda x, rows: np.full(len(x), 1 / len(x)) if rows is None else rows / rows.sum()
    of_good, of_web = share(good, good_rows), share(web, web_rows)
    center = of_web @ web
    spread = np.sqrt(of_web @ (web - center) ** 2) + 1e-6
    p, u = (np.clip((x - center) / spread, -6, 6) for x in (good, web))
    theta = np.zeros(p.shape[1] + 1)
    theta[-1] = np.log(prior / (1 - prior))
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    one = lambda x: np.concatenate([x, np.ones((len(x), 1))], axis=1)
    p, u = one(p), one(u)
    for t in range(1, STEPS + 1):
        a, b = _logistic(p @ theta), _logistic(u @ theta)
        # logistic losses: -log s(z) of a text as good, -log s(-z) of a text as bad
        missing = -(of_web @ np.log(1 - b + 1e-12)) + prior * (of_good @ np.log(1 - a + 1e-12))
        as_bad = u.T @ (of_web * b) - prior * (p.T @ (of_good * a))
        slope = -prior * (p.T @ (of_good * (1 - a))) + as_bad if missing >= 0 else -as_bad
        slope[:-1] += DECAY * theta[:-1]
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope ** 2
        theta = theta - RATE * (first / (1 - 0.9 ** t)) / (np.sqrt(second / (1 - 0.999 ** t)) + 1e-8)
    return Model(center, spread, theta[:-1], float(theta[-1]), prior)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> Model | None:
    """A model from the trusted positives of ``labels`` and the texts of ``docs``; None without any of either.

    The prior is the share of positives among all labelled rows (a null label is none); labels are
    used for nothing else.  A positive is learned from as often as its key occurs in ``docs``.
    """
    marked = labels.select(F.col(key).alias("id"), F.col(label).cast("int").alias("y")).filter("id is not null and y is not null")
    n, good, bad = marked.agg(F.count("*"), F.coalesce(F.sum((F.col("y") == 1).cast("long")), F.lit(0)), F.coalesce(F.sum((F.col("y") == 0).cast("long")), F.lit(0))).first()
    if not good:
        return None
    prior = good / (good + bad) if bad else DEFAULT_PRIOR
    trusted = store(marked.filter("y = 1").select("id").distinct().orderBy(F.xxhash64("id")).limit(POSITIVES), "trusted")
    body = docs.select(F.col(key).alias("id"), F.col(text).alias("body"))
    positives, good_rows = _sample(body.join(narrow(trusted), "id", "left_semi"), "body", POSITIVES)
    web, web_rows = _sample(body, "body", UNLABELLED)
    if not len(positives) or not len(web):
        return None
    return fit(positives, web, prior, good_rows, web_rows)


def score(docs: DataFrame, model: Model | None, text: str = "text", threshold: float = THRESHOLD, keep: Sequence[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``score`` (0 to 1, higher is better) and ``predicted`` (1 from ``threshold`` up, else 0) of every whole text.

    Null and empty texts have measures of nothing and are scored like any text.  Without a model the
    score is the default prior.  Other columns pass through; columns of the two names are replaced.
    """
    inside, body_of = carried(docs, text, ("score", "predicted"), keep)
    schema = inside.select("row").schema.add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in steps(body_of(batch)):
                if model is None:
                    s = np.full(hi - lo, DEFAULT_PRIOR)
                else:
                    x = np.clip((_measures(data, offsets) - model.center) / model.spread, -6, 6)
                    s = _logistic(x @ model.weights + model.bias)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(s)], ["row", "score"])

    return inside.mapInArrow(run, schema).select("row.*", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def learn_and_score(docs: DataFrame, labels: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text", label: str = "quality",
                    keep: Sequence[str] | None = None) -> DataFrame:
    """Trains on the rows that are not ``held_out`` (an expression on the key; null: not learned from) and scores all rows."""
    model = train(docs.filter(~held_out), labels.filter(~held_out), key, text, label)
    return score(docs, model, text, keep=keep)
