"""Benchmark rows as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ROW_SCHEMA = (
    "utc string, sha string, scale string, class string, workload string, arm string, guarantee string, "
    "size bigint, quantity string, unit string, samples array<double>"
)


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ROW_SCHEMA).json(path)


def write_rows(df: DataFrame, path: str) -> None:
    df.write.json(path)


def history(rows: DataFrame, cls: str, scale: str, before: str) -> DataFrame:
    """Rows of one machine class and scale that came before a time."""
    return rows.where((rows["class"] == cls) & (rows["scale"] == scale) & (rows["utc"] < before))
