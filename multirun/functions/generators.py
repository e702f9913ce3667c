"""Workload generators: key distributions, a keyed permutation and payloads."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def uniform_keys(spark: SparkSession, ops: int, keys: int, seed: int = 1) -> DataFrame:
    return spark.range(ops).select(F.col("id").alias("op"), F.floor(F.rand(seed) * keys).cast("bigint").alias("k"))


def sequential_keys(spark: SparkSession, ops: int, keys: int) -> DataFrame:
    return spark.range(ops).select(F.col("id").alias("op"), (F.col("id") % keys).alias("k"))


def zipf_keys(spark: SparkSession, ops: int, keys: int, theta: float = 0.99, seed: int = 1) -> DataFrame:
    """Zipf-like ranks by inverting the continuous density: no table of ``keys`` weights."""
    a = 1.0 - theta
    u = F.rand(seed)
    rank = F.pow(u * (float(keys + 1) ** a - 1.0) + 1.0, F.lit(1.0 / a)) - 1.0
    return spark.range(ops).select(F.col("id").alias("op"), F.least(F.floor(rank), F.lit(keys - 1)).cast("bigint").alias("k"))


def permute(n: Column, size: int, seed: int = 7, rounds: int = 4) -> Column:
    """A bijection of ``[0, size)``: a balanced Feistel network over the least even bit width, walked until it falls inside."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [np.uint64((seed * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) & (1 << 64) - 1) for r in range(rounds)]

    def once(x):
        l, r = x >> np.uint64(half), x & mask
        for k in keys:
            with np.errstate(over="ignore"):
                h = (r + k) * np.uint64(0xBF58476D1CE4E5B9)
            l, r = r, l ^ (h ^ h >> np.uint64(31)) & mask
        return l << np.uint64(half) | r

    @F.pandas_udf("bigint")
    def f(s: pd.Series) -> pd.Series:
        x = once(s.to_numpy(np.uint64))
        while (out := x >= size).any():
            x[out] = once(x[out])
        return pd.Series(x.astype(np.int64))

    return f(n)


def payload(n: Column, size: int = 100, compressible: float = 0.5, seed: int = 3) -> Column:
    """``size`` bytes per row: the given share is a repeated motif, the rest is noise seeded by ``n``."""
    motif = int(size * compressible)

    @F.pandas_udf("binary")
    def f(s: pd.Series) -> pd.Series:
        return s.map(lambda k: (b"motif-" * (motif // 6 + 1))[:motif] + np.random.default_rng([seed, int(k)]).bytes(size - motif))

    return f(n)
