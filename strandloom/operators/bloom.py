"""Bloom filters as tables of bit words, so that neither building nor asking gathers the filter in one place.

A filter is (word, bits): 32 bits each; words without a bit have no row. A key's places follow from four bytes of its MD5 each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sizes(n: int, rate: float) -> tuple[int, int]:
    """Bits and hashes (four at most, as MD5 has bytes for) with which n keys give about this rate of false answers."""
    import math

    hashes = min(4, max(1, round(-math.log2(rate))))
    bits = math.ceil(-hashes * n / math.log(1 - rate ** (1 / hashes))) if n else 32
    return -(-bits // 32) * 32, hashes


def _places(keys: DataFrame, column: str, bits: int, hashes: int) -> DataFrame:
    if not 1 <= hashes <= 4:
        raise ValueError("one to four hashes")
    digest = F.md5(F.col(column).cast("string").cast("binary"))
    numbers = [F.conv(F.substring(digest, 1 + 8 * h, 8), 16, 10).cast("long") % bits for h in range(hashes)]
    return keys.select(column, F.explode(F.array(*numbers)).alias("p")).select(column, F.floor(F.col("p") / 32).alias("word"), F.expr("shiftleft(1L, cast(p % 32 as int))").alias("bit"))


def bloom(keys: DataFrame, column: str, bits: int, hashes: int) -> DataFrame:
    """The filter of all keys that are not null."""
    return _places(keys.filter(F.col(column).isNotNull()), column, bits, hashes).groupBy("word").agg(F.bit_or("bit").alias("bits"))


def contained(keys: DataFrame, column: str, filter_: DataFrame, bits: int, hashes: int) -> DataFrame:
    """Distinct keys that the filter may hold: all that were put in, and few others."""
    asked = _places(keys.filter(F.col(column).isNotNull()).select(column).distinct(), column, bits, hashes)
    found = asked.join(filter_, "word", "left")
    hit = F.coalesce(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.lit(False))
    return found.groupBy(column).agg(F.bool_and(hit).alias("all")).filter("all").select(column)


def combined(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """Filters of the same sizes joined bit by bit: ``or`` (the union of the keys), ``and``, ``xor``."""
    x, y = F.coalesce("bits", F.lit(0).cast("long")), F.coalesce("other", F.lit(0).cast("long"))
    bits = {"or": x.bitwiseOR(y), "and": x.bitwiseAND(y), "xor": x.bitwiseXOR(y)}[how]
    return a.join(b.withColumnRenamed("bits", "other"), "word", "full").select("word", bits.alias("bits")).filter("bits <> 0")


def false_rate(filter_: DataFrame, bits: int, hashes: int) -> DataFrame:
    """(rate): the share of keys never put in that the filter answers for, from the share of its bits that are set."""
    return filter_.agg(F.pow(F.coalesce(F.sum(F.bit_count("bits")), F.lit(0)) / bits, hashes).alias("rate"))
