"""Joins that one hot key, or a wide table that is mostly not asked for, would make dear."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key with more than one in HOT rows is hot, so fewer than HOT keys are, and as many rows are broadcast.
HOT = 500
#: 64-bit words of a sieve, which bound its broadcast to about 8 MB whatever it is made from.
WORDS = 1 << 19


def join(left: DataFrame, right: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """left joined with right, which has each key once and in n the rows that left has of it.

    Hot keys' rows are joined where they are, by a broadcast of fewer than HOT rows; the others are shuffled.
    Null keys join nothing. Empty tables give no rows.
    """
    total = right.agg(F.sum(n)).first()[0] or 0
    few = F.broadcast(right.where(F.col(n) > total / HOT))
    rest = left.join(few.select(*keys), keys, "left_anti").join(right.hint("merge"), keys)
    return left.join(few, keys).unionByName(rest)


def _place(key: Column) -> tuple[Column, Column]:
    h = F.xxhash64(key)
    return F.pmod(h, F.lit(WORDS)), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(h, 32), F.lit(64)).cast("int"))


def sieved(df: DataFrame, on: Column, keys: DataFrame, key: str) -> DataFrame:
    """df with _maybe: false where the value of on is surely not in keys' column key.

    A bit for each key, in at most WORDS words, is broadcast; when keys are so many that all bits are set, all
    rows are taken for possible. Null is a value like any other.
    """
    word, mask = _place(F.col(key))
    bits = keys.select(word.alias("_word"), mask.alias("_mask")).groupBy("_word").agg(F.bit_or("_mask").alias("_bits"))
    word, mask = _place(on)
    marked = df.withColumn("_at", word).withColumn("_bit", mask).join(F.broadcast(bits), F.col("_at") == F.col("_word"), "left")
    return marked.select(*[F.col(f"`{c}`") for c in df.columns], F.coalesce(F.col("_bits").bitwiseAND(F.col("_bit")) != 0, F.lit(False)).alias("_maybe"))
