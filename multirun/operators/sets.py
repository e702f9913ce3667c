"""Posting lists and their intersection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(key, value)``: each lower-cased word with the ids of the documents that hold it, once each."""
    words = F.array_distinct(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[^\p{L}\p{N}]+"))
    return docs.select(F.explode(words).alias("key"), F.col(id_col).alias("value")).where("key <> ''")


def intersect(runs: DataFrame, a, b) -> DataFrame:
    """Values two keys share, as a multiset: a value pairs off as often as the rarer side has it.

    Counts per value meet in one aggregate, so no list is joined with another.
    """
    side = runs.where(F.col("key").isin([a, b])).groupBy("value").agg(
        F.sum(F.when(F.col("key") == F.lit(a), 1).otherwise(0)).alias("_a"), F.sum(F.when(F.col("key") == F.lit(b), 1).otherwise(0)).alias("_b")
    )
    return side.select("value", F.least("_a", "_b").cast("bigint").alias("times")).where("times > 0")


def intersect_count(runs: DataFrame, a, b) -> DataFrame:
    return intersect(runs, a, b).agg(F.coalesce(F.sum("times"), F.lit(0)).cast("bigint").alias("n"))
