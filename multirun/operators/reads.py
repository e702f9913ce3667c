"""Point, batched, ordered and range reads over live runs.

Inputs have a ``key`` and an order column; every limit counts keys, never values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A batch of keys is inlined into the scan's filter up to this many, and joined beyond it.
INLINE_KEYS = 1000


def point_read(runs: DataFrame, key) -> DataFrame:
    """All values of one key; an absent key gives no rows."""
    return runs.where(F.col("key") == F.lit(key))


def multi_get(runs: DataFrame, keys: list) -> DataFrame:
    """Values of many keys, each key once. Small batches become an IN filter that reaches the scan."""
    keys = sorted(set(keys))
    if len(keys) <= INLINE_KEYS:
        return runs.where(F.col("key").isin(keys))
    kind = runs.schema["key"].dataType
    wanted = runs.sparkSession.createDataFrame([(k,) for k in keys], f"key {kind.simpleString()}")
    return runs.join(wanted, "key", "left_semi")


def read_concat(runs: DataFrame, order: list[str], sep: str = "") -> DataFrame:
    """Values back to back in append order, with their number."""
    run = F.array_sort(F.collect_list(F.struct(*order, F.col("value").cast("string").alias("value"))))
    return runs.groupBy("key").agg(F.count("*").alias("n"), run.alias("_r")).select(
        "key", "n", F.array_join(F.transform("_r", lambda x: x["value"]), sep).alias("concat")
    )


def framed(runs: DataFrame, order: list[str]) -> DataFrame:
    """The run as an array in append order."""
    run = F.array_sort(F.collect_list(F.struct(*order, "value")))
    return runs.groupBy("key").agg(F.transform(run, lambda x: x["value"]).alias("values"))


def seek_rank(runs: DataFrame, key) -> DataFrame:
    """Rank of the first key at or above ``key``: the number of distinct keys below it."""
    return runs.where(F.col("key") < F.lit(key)).agg(F.countDistinct("key").alias("rank"))


#: Keys up to which a list of them is sent to every task; longer lists are joined.
BROADCAST_KEYS = 100_000


def first_keys(runs: DataFrame, limit: int, start=None, skip: int = 0) -> DataFrame:
    """``limit`` distinct keys from ``start``, after ``skip`` of them: distinct, then a top-k that each task cuts first."""
    if start is not None:
        runs = runs.where(F.col("key") >= F.lit(start))
    keys = runs.select("key").distinct().orderBy("key")
    return (keys.offset(skip) if skip else keys).limit(limit)


def among(runs: DataFrame, keys: DataFrame, limit: int, how: str = "left_semi") -> DataFrame:
    """Runs of a limited list of keys; the list is broadcast only where its limit is small."""
    return runs.join(F.broadcast(keys) if limit <= BROADCAST_KEYS else keys, "key", how)


def key_at(runs: DataFrame, rank: int) -> DataFrame:
    """The key at an ordinal, empty past the end. One pass; for deep ordinals of a store, ``Store.record_at`` orders one range only."""
    return first_keys(runs, 1, skip=rank).select("key", F.lit(rank).cast("bigint").alias("rank"))


def record_at(dictionary: DataFrame, rank: int) -> DataFrame:
    """The record at an ordinal of a dictionary: its key, number of values and sizes, empty past the end."""
    keys = dictionary.orderBy("key")
    return (keys.offset(rank) if rank else keys).limit(1)


def values_at(runs: DataFrame, rank: int) -> DataFrame:
    return among(runs, key_at(runs, rank), 1, "inner")


def scan(runs: DataFrame, limit: int, start=None) -> DataFrame:
    """Values of the first ``limit`` keys from ``start`` in key order. The limited keys come first, so no rank over all rows is made."""
    return among(runs, first_keys(runs, limit, start), limit)


def scan_at(runs: DataFrame, rank: int, limit: int) -> DataFrame:
    """As scan, from an ordinal; past the end gives nothing."""
    return among(runs, first_keys(runs, limit, skip=rank), limit)


def scan_visited(live: DataFrame, touched: DataFrame, limit: int, start=None) -> DataFrame:
    """Scan whose limit also counts keys that were deleted but not yet flushed away.

    Returns every visited key with its number of live values, 0 for a deleted key.
    """
    visited = live.select("key").unionByName(touched.select("key"))
    keys = first_keys(visited, limit, start)
    counts = among(live, keys, limit).groupBy("key").agg(F.count("*").alias("n"))
    return keys.join(counts, "key", "left").select("key", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def in_range(lo, hi=None, key: str = "key") -> Column:
    """Half-open ``[lo, hi)``; ``hi`` None is open; an inverted range holds nothing."""
    c = F.col(key) >= F.lit(lo)
    return c if hi is None else c & (F.col(key) < F.lit(hi))


def dict_range(runs: DataFrame, lo, hi=None) -> DataFrame:
    return runs.where(in_range(lo, hi))


def bump(prefix: bytes) -> bytes | None:
    """The least byte string above every one that starts with ``prefix``; None if there is none."""
    p = prefix.rstrip(b"\xff")
    return p[:-1] + bytes([p[-1] + 1]) if p else None


def dict_prefix(runs: DataFrame, prefix: str | bytes) -> DataFrame:
    """Keys that start with a prefix, as a range, so the scan can prune by statistics."""
    if isinstance(prefix, str):
        hi = bump(prefix.encode())
        try:
            return runs.where(in_range(prefix, hi.decode() if hi else None))
        except UnicodeDecodeError:
            return runs.where(F.col("key").startswith(prefix))
    return runs.where(in_range(prefix, bump(prefix)))


def debug_key(log: DataFrame, key) -> DataFrame:
    """Every operation that names a key."""
    return log.where(F.col("key") == F.lit(key))
