"""Benchmark decontamination by winnowing, in DataFrame functions only.

A window is ``window`` consecutive words of an item (a shorter item is one window).  Every text is
hashed in grams of ``gram`` words, and of every ``window - gram + 1`` neighbouring grams the smallest
hash is its fingerprint, so two texts that share a window share a fingerprint of it.  Documents meet
the items on fingerprints; where they do, the windows under a shared fingerprint are compared word by
word, which extends the hit to all windows around it.  The work is done once per different text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmark.llm.frames import narrow, text_key
from gridmark.session import store

WINDOW = 10
GRAM = 8
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Everything but words: ASCII without digits and letters.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Lower-cased (A-Z) words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``; none for null."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _CAPITALS, _SMALL), _BETWEEN), "")


def _pairs(a: Column, b: Column, shift: int, join) -> Column:
    """join(a[i], b[i + shift]) wherever both are."""
    n = F.greatest(F.size(b) - shift, F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1 + shift), n), join)


# explode_outer throughout: a plain explode makes the optimizer test the array for emptiness below the
# projections that build it, where each test repeats the whole chain of array functions.


def _combine(x: Column, y: Column) -> Column:
    return F.xxhash64(x, y)


def _smaller(x: Column, y: Column) -> Column:
    return F.least(x, y)


def with_grams(df: DataFrame, size: int, name: str, source: str = "ws") -> DataFrame:
    """Adds ``name``: the hash of every run of ``size`` words of the array ``source``."""
    df = df.withColumn("g1", F.transform(source, lambda x: F.xxhash64(x)))
    have, done = "g1", 1
    power, reach = "g1", 1
    rest = size - 1
    # grams of 1, 2, 4 ... words, joined to the size asked for
    while rest:
        if done == reach and rest >= reach:
            df = df.withColumn(f"g{done + reach}", _pairs(F.col(have), F.col(power), done, _combine))
            done, rest = done + reach, rest - reach
            have = f"g{done}"
            power, reach = have, done
        else:
            df = df.withColumn(f"g{done + 1}", _pairs(F.col(have), F.col("g1"), done, _combine))
            done, rest = done + 1, rest - 1
            have = f"g{done}"
    return df.withColumn(name, F.col(have))


def with_fingerprints(df: DataFrame, window: int, gram: int) -> DataFrame:
    """Adds ``low``: per window of ``window`` words of ``ws`` the smallest of its gram hashes (position = window start)."""
    df = with_grams(df, gram, "grams")
    left, name, span = window - gram, "grams", 1
    while left:
        step = min(left, span)
        df = df.withColumn(f"m{span + step}", _pairs(F.col(name), F.col(name), step, _smaller))
        left, span, name = left - step, span + step, f"m{span + step}"
    return df.withColumn("low", F.col(name))


def item_windows(items: DataFrame, window: int, text: str = "text", item: str = "item_id") -> DataFrame:
    """``(m, win, item)``: every different window of every item, ``m`` words long."""
    split = items.select(F.col(item).alias("item"), words(F.col(text)).alias("ws")).filter(F.size("ws") > 0)
    m = F.least(F.size("ws"), F.lit(window))
    starts = F.sequence(F.lit(1), F.size("ws") - m + 1)
    return (split.select("item", m.alias("m"), F.explode_outer(F.transform(starts, lambda s: F.array_join(F.slice("ws", s, m), " "))).alias("win"))
            .distinct())


def contamination(docs: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text", item: str = "item_id",
                  window: int = WINDOW, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """``(texts, hits)``; ``texts`` is ``docs`` with ``k1, k2, n_words`` and ``hits`` has one row per different text with a hit.

    ``hits``: ``(k1, k2, n_hit, n_items, item_ids, spans)``: words inside any occurrence of a window,
    ids of the items met (sorted as strings, each once; an item without an id hits words but is not
    listed) and the (first word, words) windows found.
    """
    keyed = docs.select(*text_key(F.col(text)), F.col(text).alias("body"))
    windows = store(item_windows(items, window, item_text, item), "item-windows")
    lengths = [r.m for r in windows.select("m").distinct().collect()]  # at most ``window`` values
    leads = None
    for m in lengths:
        k = gram if m == window else m
        prints = with_fingerprints(windows.filter(F.col("m") == m).select(F.split("win", " ").alias("ws")), m, k).select(F.explode_outer("low").alias("fp"))
        prints = store(prints.filter(F.col("fp").isNotNull()).distinct(), "item-prints")
        marked = with_fingerprints(keyed.select("k1", "k2", words(F.col("body")).alias("ws")), m, k)
        met = (marked.select("k1", "k2", F.explode_outer(F.array_distinct("low")).alias("fp")).join(narrow(prints), "fp")
               .select("k1", "k2", F.lit(m).alias("m"), "fp").distinct())
        leads = met if leads is None else leads.unionByName(met)
    if leads is None:  # no item has a word
        leads = keyed.limit(0).select("k1", "k2", F.lit(0).alias("m"), F.lit(0).cast("long").alias("fp"))
    leads = store(leads.groupBy("k1", "k2", "m").agg(F.collect_set("fp").alias("fps")), "leads")
    texts = keyed.join(narrow(leads.select("k1", "k2").distinct()), ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.first("body").alias("body"))
    found = texts.join(leads, ["k1", "k2"]).withColumn("ws", words(F.col("body")))
    rows = None
    for m in lengths:
        k = gram if m == window else m
        some = with_fingerprints(found.filter(F.col("m") == m).select("k1", "k2", "m", "fps", "ws"), m, k)
        near = F.filter(F.transform("low", lambda x, i: F.when(F.array_contains("fps", x), i)), lambda i: i.isNotNull())
        some = some.select("k1", "k2", "m", "ws", near.alias("near"))
        spots = F.transform("near", lambda i: F.struct(i.alias("at"), F.array_join(F.slice("ws", i + 1, F.lit(m)), " ").alias("win")))
        some = some.select("k1", "k2", "m", F.explode_outer(spots).alias("s")).select("k1", "k2", "m", "s.at", "s.win")
        rows = some if rows is None else rows.unionByName(some)
    if rows is None:
        rows = leads.select("k1", "k2", "m", F.lit(0).alias("at"), F.lit("").alias("win"))
    size = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["at"], s["at"] + s["m"] - 1)))))
    hits = (rows.join(narrow(windows), ["m", "win"]).groupBy("k1", "k2")
            .agg(F.collect_set(F.struct("at", "m")).alias("spans"), F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("item_ids"))
            .select("k1", "k2", size.cast("long").alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), "item_ids", "spans"))
    return docs.select("*", *text_key(F.col(text)), F.size(words(F.col(text))).cast("long").alias("n_words")), store(hits, "hits")


def report(docs: DataFrame, items: DataFrame, key: str = "doc_id", **settings) -> DataFrame:
    """``(key, n_words, n_hit, n_items, items_sha256, contaminated, item_ids)`` per row.

    A null or empty text has no words and no hit; repeated rows are reported each.  Without items,
    or with items that have no words, nothing is hit.
    """
    text = settings.get("text", "text")
    texts, hits = contamination(docs.select(key, text), items, **settings)
    listed = F.coalesce("item_ids", F.array().cast("array<string>"))
    n = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return (texts.join(narrow(hits.drop("spans")), ["k1", "k2"], "left")
            .select(key, "n_words", n("n_hit").alias("n_hit"), n("n_items").alias("n_items"), F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"),
                    (n("n_hit") > 0).alias("contaminated"), listed.alias("item_ids")))


def clean_documents(docs: DataFrame, items: DataFrame, text: str = "text", **settings) -> DataFrame:
    """``docs`` without the rows in which a benchmark window occurs; columns and clean rows unchanged."""
    inside = docs.select(F.col(text).alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    texts, hits = contamination(inside, items, **settings)
    return texts.join(narrow(hits.select("k1", "k2")), ["k1", "k2"], "left_anti").select("row.*")
