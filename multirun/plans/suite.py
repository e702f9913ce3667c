"""Statistics and verdicts over benchmark rows."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Verdict rules: rows looked back on, and rows needed before a verdict is given.
LOOK_BACK, LEAST_ROWS = 10, 3
#: Words in a quantity's name that say which direction is better (fixed values).
HIGHER = ("per_s",)
LOWER = ("_us", "_ns", "bytes_per_byte", "bytes_on_disk_per_byte", "seconds")


def quantile(c: str, q: float) -> Column:
    """Linear interpolation between order statistics at ``q * (n - 1)``; null on no rows."""
    return F.percentile(c, F.lit(q))


def summary(df: DataFrame, c: str, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(
        F.min(c).alias("min"), quantile(c, 0.25).alias("q25"), quantile(c, 0.5).alias("median"), quantile(c, 0.75).alias("q75"), F.max(c).alias("max")
    )


def rel_iqr(df: DataFrame, c: str, *by: str) -> DataFrame:
    """Interquartile range over the median; null where the median is 0."""
    s = summary(df, c, *by)
    return s.select(*by, F.when(F.col("median") != 0, (F.col("q75") - F.col("q25")) / F.col("median")).alias("rel_iqr"))


def median_ci(df: DataFrame, c: str, *by: str, resamples: int = 2000, level: float = 0.95) -> DataFrame:
    """Bootstrap interval of the median, seeded by the group's sorted values. A group's samples are one benchmark row's repetitions, so they fit a task."""
    import numpy as np

    kinds = ", ".join(f"{b} {df.schema[b].dataType.simpleString()}" for b in by)

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.sort(pdf[c].dropna().to_numpy(float))
        if len(v) == 0:
            lo = hi = m = math.nan
        elif len(v) == 1:
            lo = hi = m = float(v[0])
        else:
            m = float(np.median(v))
            rng = np.random.default_rng(np.frombuffer(v.tobytes(), np.uint32))
            meds = np.concatenate([np.median(v[rng.integers(0, len(v), (min(200, resamples - i), len(v)))], axis=1) for i in range(0, resamples, 200)])
            lo, hi = (float(x) for x in np.quantile(meds, [(1 - level) / 2, (1 + level) / 2]))
        return pd.DataFrame([{**{b: pdf[b].iloc[0] for b in by}, "median": m, "lo": lo, "hi": hi}])

    return df.select(*by, c).groupBy(*by).applyInPandas(f, f"{kinds}, median double, lo double, hi double")


def histogram(df: DataFrame, c: str, *by: str, sub: int = 128) -> DataFrame:
    """Counts in log-linear buckets: ``sub`` equal steps inside each power of two. Mergeable by summing counts."""
    v = F.col(c).cast("double")
    exp = F.when(v < sub, F.lit(0.0)).otherwise(F.floor(F.log2(F.greatest(v, F.lit(1.0)) / sub)) + 1)
    step = F.pow(F.lit(2.0), F.greatest(exp - 1, F.lit(0.0)))
    return df.where(v >= 0).groupBy(*by, (F.floor(v / step) * step).alias("bucket"), step.alias("step")).agg(F.count("*").alias("n"))


def hist_percentiles(hist: DataFrame, qs: list[float], *by: str) -> DataFrame:
    """The highest value of the bucket that holds each percentile; buckets are few whatever the input."""
    w = Window.partitionBy(*by)
    cum = F.sum("n").over(w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    h = hist.withColumn("_c", cum).withColumn("_t", F.sum("n").over(w))
    aggs = [
        F.min(F.when(F.col("_c") >= F.greatest(F.ceil(F.col("_t") * q / 100), F.lit(1)), F.col("bucket") + F.col("step") - 1)).alias(f"p{q:g}".replace(".", "_"))
        for q in qs
    ]
    return h.groupBy(*by).agg(*aggs)


def higher_is_better(quantity: Column) -> Column:
    """The direction of a quantity; an unknown one is an error, not a guess."""
    hi = quantity.rlike("|".join(HIGHER))
    return F.when(hi, True).when(quantity.rlike("|".join(LOWER)), False).otherwise(
        F.raise_error(F.concat(F.lit("no direction for quantity "), quantity)).cast("boolean")
    )


def gate(rows: DataFrame, *key: str, order: str = "utc") -> DataFrame:
    """Judges the newest row of each key against the ones before it, at most ``LOOK_BACK``.

    Rows carry ``lo`` and ``hi`` of their interval and a boolean ``higher``. Worse than every prior
    interval: regressed; better than every one: improved; under ``LEAST_ROWS`` rows: insufficient.
    """
    w = Window.partitionBy(*key).orderBy(F.desc(order))
    r = rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= LOOK_BACK)
    now, old = F.col("_r") == 1, F.col("_r") > 1
    g = r.groupBy(*key).agg(
        F.count("*").alias("n_rows"), F.max(F.when(now, F.col("lo"))).alias("_lo"), F.max(F.when(now, F.col("hi"))).alias("_hi"),
        F.min(F.when(old, F.col("lo"))).alias("_minlo"), F.max(F.when(old, F.col("hi"))).alias("_maxhi"), F.max("higher").alias("_up"),
    )
    below, above = F.col("_hi") < F.col("_minlo"), F.col("_lo") > F.col("_maxhi")
    worse, better = F.when(F.col("_up"), below).otherwise(above), F.when(F.col("_up"), above).otherwise(below)
    return g.select(
        *key, "n_rows",
        F.when(F.col("n_rows") < LEAST_ROWS, "insufficient").when(worse, "regressed").when(better, "improved").otherwise("level").alias("verdict"),
    )


def floor_verdict(rows: DataFrame, *key: str, order: str = "utc", median: str = "median") -> DataFrame:
    """As gate, for machine floors: medians against medians, with at least three prior rows."""
    w = Window.partitionBy(*key).orderBy(F.desc(order))
    r = rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= LOOK_BACK)
    now, old = F.col("_r") == 1, F.col("_r") > 1
    g = r.groupBy(*key).agg(
        F.sum(old.cast("int")).cast("bigint").alias("n_prior"), F.max(F.when(now, F.col(median))).alias("_m"),
        F.min(F.when(old, F.col(median))).alias("_lo"), F.max(F.when(old, F.col(median))).alias("_hi"), F.max("higher").alias("_up"),
    )
    below, above = F.col("_m") < F.col("_lo"), F.col("_m") > F.col("_hi")
    worse, better = F.when(F.col("_up"), below).otherwise(above), F.when(F.col("_up"), above).otherwise(below)
    return g.select(*key, "n_prior", F.when(F.col("n_prior") < LEAST_ROWS, "insufficient").when(worse, "worse").when(better, "better").otherwise("in_band").alias("verdict"))


def withhold(verdicts: DataFrame, comparators: DataFrame, on: list[str]) -> DataFrame:
    """Withholds a regression where a comparator regressed at the same place: the machine moved, not the code."""
    moved = comparators.where("verdict = 'regressed'").select(*on).distinct().withColumn("_m", F.lit(True))
    out = F.when((F.col("verdict") == "regressed") & F.col("_m").isNotNull(), "withheld").otherwise(F.col("verdict"))
    return verdicts.join(moved, on, "left").withColumn("verdict", out).drop("_m")


def paired(rows: DataFrame, pair: str, arm: str, value: str, a: str, b: str, *by: str) -> DataFrame:
    """Wins of arm ``a`` over arm ``b`` in pairs taken together; ties count for neither."""
    p = rows.groupBy(*by, pair).agg(F.max(F.when(F.col(arm) == a, F.col(value))).alias("_a"), F.max(F.when(F.col(arm) == b, F.col(value))).alias("_b"))
    p = p.where("_a is not null and _b is not null")
    return p.groupBy(*by).agg(
        F.sum((F.col("_a") > F.col("_b")).cast("bigint")).alias("wins"), F.sum((F.col("_a") < F.col("_b")).cast("bigint")).alias("losses")
    )


def sign_p(up: Column, n: Column) -> Column:
    """Two-sided exact sign test, at most 1; 1 where there are no pairs. The terms are built up one from another, so no factorial overflows."""
    k = F.least(up, n - up).cast("int")
    half = F.pow(F.lit(0.5), n)
    step = lambda s, i: F.struct(
        (s["t"] * (n - i + 1) / i).alias("t"), (s["sum"] + s["t"] * (n - i + 1) / i).alias("sum")
    )
    tail = F.aggregate(
        F.when(k >= 1, F.sequence(F.lit(1), k)).otherwise(F.array().cast("array<int>")), F.struct(half.alias("t"), half.alias("sum")), step
    )["sum"]
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * tail))


def holm(df: DataFrame, p: str, family: str, alpha: float = 0.05) -> DataFrame:
    """Step-down rejection inside each family: stops at the first p above ``alpha / (m - k)``."""
    w = Window.partitionBy(family).orderBy(p)
    rank, m = F.row_number().over(w), F.count("*").over(Window.partitionBy(family))
    fails = F.when(F.col(p) > alpha / (F.col("_m") - F.col("_k") + 1), 1).otherwise(0)
    run = F.max("_f").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return (
        df.withColumn("_k", rank).withColumn("_m", m).withColumn("_f", fails).withColumn("_any", run)
        .withColumn("rejected", F.col("_any") == 0).drop("_k", "_m", "_f", "_any")
    )


def factors(rows: DataFrame, arm: str, comparator: str, *by: str, size: str = "size", value: str = "median") -> DataFrame:
    """How many times the comparator's value an arm reaches at the largest size both have."""
    top = rows.groupBy(*by, "arm").agg(F.max_by(value, size).alias("v"))
    p = top.groupBy(*by).agg(F.max(F.when(F.col("arm") == arm, F.col("v"))).alias("_a"), F.max(F.when(F.col("arm") == comparator, F.col("v"))).alias("_b"))
    return p.select(*by, (F.col("_a") / F.col("_b")).alias("factor"))
