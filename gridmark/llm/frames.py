"""Small helpers on frames shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side of a join may be broadcast; the caller counts them first.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def narrow(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``limit`` rows of bounded width, else as it is (a shuffled join)."""
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if rows <= limit else df


#: Rows that :func:`sieve` broadcasts at most, whatever the size of the tables, and words of 64 bits in a row: 2 ** 26 bits.
SIEVE_ROWS, SIEVE_WORDS = 1 << 17, 8


def sieve(df: DataFrame, keys: DataFrame, key: str, flag: str = "maybe") -> DataFrame:
    """``df`` with a boolean ``flag`` that is false only where the hash ``key`` is not among those of ``keys``.

    One bit stands for the hashes that agree in their low bits, so true may be wrong and a join has to
    settle it; that join need not shuffle the other rows.  Once all bits are set, all rows are flagged.
    ``key`` is a bigint that spreads over its low bits and is not null.
    """
    spot, word = F.pmod(F.shiftright(key, 9), F.lit(SIEVE_ROWS)), F.pmod(F.shiftright(key, 6), F.lit(SIEVE_WORDS))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(key, F.lit(64)).cast("int"))
    place = [spot.alias("sieve_spot"), word.alias("sieve_word"), bit.alias("sieve_bit")]
    bits = keys.select(*place).groupBy("sieve_spot").agg(*[F.bit_or(F.when(F.col("sieve_word") == i, F.col("sieve_bit"))).alias(f"sieve_{i}") for i in range(SIEVE_WORDS)])
    held = [F.when(F.col("sieve_word") == i, F.col(f"sieve_{i}").bitwiseAND(F.col("sieve_bit")) != 0) for i in range(SIEVE_WORDS)]
    return (df.select("*", *place).join(F.broadcast(bits), "sieve_spot", "left")
            .select(*[F.col(f"`{c}`") for c in df.columns], F.coalesce(*held, F.lit(False)).alias(flag)))


def text_key(text: Column) -> list[Column]:
    """Two columns that name a text: 128 bits, equal for equal texts; a null text equals an empty one."""
    whole = F.coalesce(text, F.lit(""))
    return [F.xxhash64(F.lit(1), whole).alias("k1"), F.xxhash64(F.lit(2), whole).alias("k2")]


def remainder(key: Column, divisor: int) -> Column:
    """crc32 of a key written as text, modulo ``divisor``; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % divisor


def stored(flag: Column) -> Column:
    return F.coalesce(flag, F.lit(False))


def carried(docs: DataFrame, text: str, drop: Sequence[str], keep: Sequence[str] | None) -> tuple[DataFrame, Callable[[pa.RecordBatch], pa.Array]]:
    """Columns to pass by a task as one struct ``row``, the text only once, and how a task finds the text in a batch."""
    rest = [c for c in (docs.columns if keep is None else keep) if c not in drop]
    row = F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row")
    if text in rest:
        return docs.select(row), lambda batch: batch.column(0).field(text)
    return docs.select(row, F.col(text).alias("body")), lambda batch: batch.column(1)
