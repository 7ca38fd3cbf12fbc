"""Shards by jump consistent hashing, in DataFrame functions only.

The shard is a function of key and shard count: no ring and no table.  With one more shard, only the
rows that move into it change place.  Slots inside a shard come from counts per (input part, shard):
no shard is ever sorted or numbered as a whole.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmark.session import store

#: Multiplier of the published 64-bit linear congruential step of jump consistent hashing (fixed value).
_LCG = Decimal(2862933555777941757)
_WRAP = Decimal(1 << 64)


def _unsigned(x: Column) -> Column:
    """A long read as 64 unsigned bits, as an exact decimal."""
    wide = x.cast("decimal(20,0)")
    return F.when(x < 0, wide + F.lit(_WRAP)).otherwise(wide)


def jump_hash(key: Column, shards: int) -> Column:
    """Jump consistent hash of a long key: bucket 0 to ``shards`` - 1.

    Jumps from bucket to bucket while they stay below ``shards``; as each jump goes forward,
    ``shards`` steps are enough for any key.
    """
    def step(s: Column, _: Column) -> Column:
        state = ((s["state"] * F.lit(_LCG) + 1) % F.lit(_WRAP)).cast("decimal(20,0)")
        draw = F.floor(state / F.lit(Decimal(1 << 33))).cast("double") + 1
        jump = F.floor((s["jump"] + 1).cast("double") * (F.lit(float(1 << 31)) / draw)).cast("long")
        on = s["jump"] < shards
        return F.struct(F.when(on, state).otherwise(s["state"]).alias("state"), F.when(on, s["jump"]).otherwise(s["bucket"]).alias("bucket"),
                        F.when(on, jump).otherwise(s["jump"]).alias("jump"))

    begin = F.struct(_unsigned(key).cast("decimal(20,0)").alias("state"), F.lit(-1).cast("long").alias("bucket"), F.lit(0).cast("long").alias("jump"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(shards)), begin, step, lambda s: s["bucket"].cast("int"))


def spread_key(key: Column) -> Column:
    """A stable 64-bit key for any column: equal values have equal keys; null is a value."""
    return F.xxhash64(F.coalesce(key.cast("string"), F.lit("\0")))


def assign(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, size, text_crc32, shard, slot, grown_shard)`` of every row.

    ``size`` is the UTF-8 bytes of the text plus 1, ``text_crc32`` its CRC-32; a null text has none
    (size 1, CRC of nothing, 0).  Equal keys share a shard, repeated rows each get a slot, null keys
    share one shard.  Slots run from 0 without gaps in every shard.
    """
    number = spread_key(F.col(key))
    body = F.coalesce(F.col(text), F.lit(""))
    marked = docs.select(F.col(key), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"),
                         jump_hash(number, shards).alias("shard"), jump_hash(number, shards + 1).alias("grown_shard"),
                         F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place"))
    marked = store(marked, "shards")  # part and place hold from here on
    counts = marked.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = F.row_number().over(Window.partitionBy("shard", "part").orderBy("place")) - 1
    return (marked.join(starts, ["shard", "part"]).withColumn("slot", F.col("first") + within)
            .select(key, "size", "text_crc32", "shard", "slot", "grown_shard"))


def write_shards(docs: DataFrame, folder: str, shards: int = 16, key: str = "doc_id") -> None:
    """The rows themselves as Parquet, one folder ``shard=N`` per shard."""
    docs.withColumn("shard", jump_hash(spread_key(F.col(key)), shards)).write.partitionBy("shard").parquet(folder)
