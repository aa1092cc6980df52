"""Sets of items as rows of (key, word, bits): up to WIDTH items of a key in one number.

Items are numbered in their order; ``word`` and ``bit`` are a number's two parts.
Unions, and questions of whether two sets meet, work on whole words, so that a
group's rows are joined with a few numbers instead of all items of another one.
A set has never more rows than items, and no list is held in one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.sources.store import cut

WIDTH = 62


def _one() -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))


def union(bits: str) -> Column:
    return F.bit_or(bits).alias(bits)


def holds(bits: str) -> Column:
    """Whether ``bits`` has the bit of the row; false for null."""
    return F.coalesce(F.col(bits).bitwiseAND(_one()) != 0, F.lit(False))


def places(items: DataFrame, item: str) -> DataFrame:
    """item, word, bit of every distinct item that isn't null; written, as numbers go by partition."""
    n = F.col("_n")
    numbered = items.select(item).filter(F.col(item).isNotNull()).distinct().repartitionByRange(item).sortWithinPartitions(item).withColumn("_n", F.monotonically_increasing_id())
    return cut(numbered.select(item, F.floor(n / WIDTH).alias("word"), (n % WIDTH).cast("int").alias("bit")))


def packed(pairs: DataFrame, key: str, item: str, at: DataFrame) -> DataFrame:
    """key, word, bits: the items of each key that have a place."""
    return pairs.select(key, item).join(at, item).groupBy(key, "word").agg(F.bit_or(_one()).alias("bits"))


def rows(sets: DataFrame, at: DataFrame, bits: str = "bits") -> DataFrame:
    """The sets' columns and the item, a row for each item of ``bits``."""
    return sets.join(at, "word").filter(holds(bits))


def once(pairs: DataFrame, key: str, item: str) -> DataFrame:
    """The distinct pairs of (key, item) without null items, written as sets; rows of a word come together, so that another ``packed`` by the key moves little."""
    at = places(pairs, item)
    return rows(cut(packed(pairs, key, item, at)), at).select(key, item)
