"""Joining sealed pieces and cutting key space into ranges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from multirun.operators.resolve import resolve


def merge_pieces(pieces: list[DataFrame]) -> DataFrame:
    """Resolves the union of pieces; operations keep their commit numbers, so piece order does not matter."""
    return resolve(reduce(DataFrame.unionByName, pieces))


def fences(keys: DataFrame, cuts: list) -> DataFrame:
    """Assigns each key the index of its half-open range between ascending cuts."""
    part = reduce(lambda acc, c: acc + F.when(F.col("key") >= F.lit(c), 1).otherwise(0), cuts, F.lit(0))
    return keys.withColumn("part", part)


def range_stats(keys: DataFrame, cuts: list) -> DataFrame:
    """Rows and bounds of every range that holds a key."""
    return fences(keys, cuts).groupBy("part").agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi"))


def sorted_ranges(df: DataFrame, n: int, *order: str) -> DataFrame:
    """Range-partitioned by key and sorted inside: the layout of a compacted store."""
    return df.repartitionByRange(n, "key").sortWithinPartitions("key", *order)
