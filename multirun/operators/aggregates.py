"""Counts and sizes per key; none of them needs the run in one place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from multirun.functions.bytesfn import width, stored_length


def scan_counts(runs: DataFrame, start=None, limit: int | None = None) -> DataFrame:
    """Values per key in key order; the limit counts keys."""
    if start is not None:
        runs = runs.where(F.col("key") >= F.lit(start))
    out = runs.groupBy("key").agg(F.count("*").alias("n"))
    return out if limit is None else out.orderBy("key").limit(limit)


def count_key(runs: DataFrame, key) -> DataFrame:
    """Number of values of a key, 0 if absent."""
    return runs.where(F.col("key") == F.lit(key)).agg(F.count("*").alias("n"))


def fixed_count(w: int, value: str = "value") -> Column:
    """The count when every value has width ``w``, else null."""
    b = width(value)
    return F.when((F.min(b) == w) & (F.max(b) == w), F.count("*"))


def scan_counts_fixed(runs: DataFrame, w: int, start=None, limit: int | None = None) -> DataFrame:
    if start is not None:
        runs = runs.where(F.col("key") >= F.lit(start))
    out = runs.groupBy("key").agg(fixed_count(w).alias("n_fixed"))
    return out if limit is None else out.orderBy("key").limit(limit)


def count_fixed(runs: DataFrame, key, w: int) -> DataFrame:
    """As scan_counts_fixed for one key; an absent key counts 0."""
    one = runs.where(F.col("key") == F.lit(key))
    return one.agg(F.when(F.count("*") == 0, F.lit(0).cast("bigint")).otherwise(fixed_count(w)).alias("n_fixed"))


def stored_bytes(runs: DataFrame) -> DataFrame:
    """Bytes of each key's run in its encoding: values back to back if all have one non-zero width, else each with a length prefix."""
    b = width("value")
    return runs.groupBy("key").agg(
        F.when((F.min(b) == F.max(b)) & (F.min(b) > 0), F.sum(b)).otherwise(F.sum(stored_length(b))).cast("bigint").alias("stored_bytes")
    )


def payload_bytes(runs: DataFrame) -> DataFrame:
    """Bytes of all keys, each once, and of all values."""
    per_key = runs.groupBy("key").agg(F.sum(width("value")).alias("v"))
    return per_key.agg(F.coalesce(F.sum(F.col("v") + width("key")), F.lit(0)).cast("bigint").alias("payload_bytes"))


def keys(runs: DataFrame) -> DataFrame:
    return runs.agg(F.countDistinct("key").alias("keys"))


def dictionary(runs: DataFrame, *by: str) -> DataFrame:
    """The dictionary table: what counting queries read instead of values. ``by`` keeps further columns that a key has one value of."""
    b = width("value")
    return runs.groupBy("key", *by).agg(
        F.count("*").alias("n"),
        F.when((F.min(b) == F.max(b)) & (F.min(b) > 0), F.sum(b)).otherwise(F.sum(stored_length(b))).cast("bigint").alias("stored_bytes"),
        F.when(F.min(b) == F.max(b), F.min(b)).alias("width"), F.coalesce(F.sum(b), F.lit(0)).cast("bigint").alias("value_bytes"),
    )


def top_n(counts: DataFrame, n: int) -> DataFrame:
    """The ``n`` keys with most values, ties by key."""
    return counts.orderBy(F.desc("n"), "key").limit(n)


def newest_value(live: DataFrame) -> DataFrame:
    return live.groupBy("key").agg(F.max_by("value", F.struct("seq", "idx")).alias("newest"))
