"""Corpus pipeline over ``documents``: language, near duplicates, repeated passages, benchmark leaks, packing.

Every stage takes all rows of its predecessor and decides for all of them: rows without a keyed or
readable text are handled as the operators' docstrings say.  All stages but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmark.llm import decontaminate, language, similar, substring
from gridmark.llm.frames import table
from gridmark.llm.queries import pack_documents
from gridmark.session import bound_batches, discard, scratch, store


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is rejected: no letter, or less than even odds by the calibrated model."""
    bound_batches(spark)
    return language.accepted_rows(docs, language.train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group connected by five-word shingle similarity 0.8 or more: the one with the smallest doc_id."""
    bound_batches(spark)
    return similar.without_near_copies(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts words covered by repeated windows; ``n_chars`` follows where it was the length of the text."""
    bound_batches(spark)
    cut = substring.remove_repeats(docs, marks="repeats_cut")
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col("repeats_cut.n_removed") > 0, F.char_length("text").cast(cut.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return cut.select(docs.columns)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a benchmark window occurs."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of what is left."""
    bound_batches(spark)
    return pack_documents(docs)


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages),
          ("benchmark_leaks", benchmark_leaks), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; each result is written and read again as the next one's input.

    A stage's own files go when its result is written, and its input when the next result is.
    """
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch(spark) as keep:
            docs = keep(store(stage(spark, docs, sf_dir), f"pipeline-{name}"))
        if last is not None:
            discard(last)
        last = docs
    return docs


#: SQL can express neither the trained language model nor the tokens; the stages are tested against brute-force versions.
ORACLE_SQL = None
