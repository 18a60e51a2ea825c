"""A Bloom filter as one array column, built and read with SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A filter never has more bits than this (16 MB). Over more keys it lets more rows pass, and loses none.
MAX_BITS = 1 << 27
BITS_PER_KEY = 16


def filter_bits(keys: int) -> int:
    return 1 << max(16, min(MAX_BITS.bit_length() - 1, (keys * BITS_PER_KEY).bit_length()))


def cells(bits: int, *key: Column | str) -> list[Column]:
    """The two cells of a key."""
    return [F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(bits)) for seed in (1, 2)]


def filter_words(found: DataFrame, bits: int) -> Column:
    """The filter with the cells of ``found(cell)`` set: a scalar subquery, an array of 64-bit words."""
    words = found.groupBy(F.shiftright("cell", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, int(cell & 63))")).alias("mask")
    )
    every = found.sparkSession.range(bits // 64).withColumnRenamed("id", "word").join(words, "word", "left")
    pairs = F.array_sort(F.collect_list(F.struct("word", F.coalesce("mask", F.lit(0)).alias("mask"))))
    return every.agg(F.transform(pairs, lambda p: p["mask"]).alias("words")).scalar()


def may_hold(words: Column, bits: int, *key: Column | str) -> Column:
    """Whether both cells of a key are set."""
    hits = [
        F.getbit(F.get(words, F.shiftright(cell, 6).cast("int")), cell.bitwiseAND(63).cast("int"))
        for cell in cells(bits, *key)
    ]
    return (hits[0] == 1) & (hits[1] == 1)
