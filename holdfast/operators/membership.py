"""Bloom filters as column expressions: is a key possibly among the keys of another table?

The bits are built by a distributed aggregate and reach the scan that they thin out as a scalar subquery, so rows that
cannot match are dropped before they are shuffled. False positives remain; an exact join has to follow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASHES = 3
BITS_PER_KEY = 10
# 2 MB at most: beyond some 1.6 million keys only the share of false positives grows.
MOST_BITS = 1 << 24
LEAST_BITS = 1 << 13


def bits_for(keys: int) -> int:
    """A power of two with ten bits for every key, within the bounds."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << (max(1, keys * BITS_PER_KEY) - 1).bit_length()))


def _place(key: Column, i: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(i), key), F.lit(bits))


def bloom_words(keys: DataFrame, column: str, bits: int) -> DataFrame:
    """One row: `words`, the bits as an array of longs. NULL keys set no bit."""
    places = keys.where(F.col(column).isNotNull()).select(
        F.explode(F.array(*[_place(F.col(column), i, bits) for i in range(HASHES)])).alias("place")
    )
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place").bitwiseAND(F.lit(63)).cast("int"))
    # Every word once, so that words of the array stand at their own number.
    empty = keys.sparkSession.range(bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    filled = places.select(F.shiftright("place", 6).alias("word"), one.alias("bits")).unionByName(empty)
    words = filled.groupBy("word").agg(F.bit_or("bits").alias("bits"))
    return words.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda w: w["bits"]).alias("words"))


def may_hold(words: DataFrame, key: Column, bits: int) -> Column:
    """Whether the key can be among the keys that `words` was built from; false for sure if a bit is missing."""
    array = words.scalar()
    found = F.lit(True)
    for i in range(HASHES):
        place = _place(key, i, bits)
        found = found & (F.getbit(F.get(array, F.shiftright(place, 6).cast("int")), place.bitwiseAND(F.lit(63)).cast("int")) == 1)
    return found & key.isNotNull()


def possible(rows: DataFrame, column: str, keys: DataFrame, key: str, n_keys: int) -> DataFrame:
    """The rows whose `column` may be among `keys`; a semi join on the exact key has to follow."""
    bits = bits_for(n_keys)
    # The key in the other table's type, as hashes differ between types.
    typed = keys.select(F.col(key).cast(rows.schema[column].dataType).alias("key"))
    return rows.where(may_hold(bloom_words(typed, "key", bits), F.col(column), bits))
