"""A blocked Bloom filter as a table of 64-bit words: one lookup a row, built by one aggregation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that are broadcast at most (16 MB as rows of two longs); larger filters are joined by shuffle.
BROADCAST_WORDS = 1 << 20
#: Bits that each value sets within its word.
BITS_PER_VALUE = 4


def sizing(n: int, p: float) -> tuple[int, int]:
    """Bits and hash functions of a plain Bloom filter for n values and a false-positive rate of p."""
    if n < 1 or not 0 < p < 1:
        raise ValueError("n must be positive and p between 0 and 1")
    m = max(64, math.ceil(-n * math.log(p) / math.log(2) ** 2))
    return m, min(30, max(1, round(m / n * math.log(2))))


def _place(value: Column, words: int) -> tuple[Column, Column]:
    h, g = F.xxhash64(value), F.xxhash64(value, F.lit(1))
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(g, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(BITS_PER_VALUE)]
    mask = bits[0]
    for b in bits[1:]:
        mask = mask.bitwiseOR(b)
    return F.pmod(h, F.lit(words)), mask


def build(df: DataFrame, value: Column, words: int) -> DataFrame:
    """The filter: (word, mask), at most `words` rows; masks are or-ed in each task before the shuffle."""
    word, mask = _place(value, words)
    return df.where(value.isNotNull()).select(word.alias("word"), mask.alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("mask"))


def annotate(df: DataFrame, value: Column, filter_: DataFrame, words: int, name: str = "maybe") -> DataFrame:
    """Adds the boolean `name`: false only for values that surely weren't added."""
    word, mask = _place(value, words)
    side = filter_.select(F.col("word").alias("_word"), F.col("mask").alias("_held"))
    side = F.broadcast(side) if words <= BROADCAST_WORDS else side
    rows = df.withColumn("_at", word).withColumn("_mask", mask).join(side, F.col("_at") == F.col("_word"), "left")
    return rows.withColumn(name, F.coalesce(F.col("_held").bitwiseAND(F.col("_mask")) == F.col("_mask"), F.lit(False))).drop("_at", "_mask", "_word", "_held")
