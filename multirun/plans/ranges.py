"""Union of overlapping or touching byte ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge_ranges(df: DataFrame, group: str, start: str = "start", end: str = "end", gap: int = 0) -> DataFrame:
    """Gaps and islands inside each group: maximal runs of ranges no further apart than ``gap``."""
    order = Window.partitionBy(group).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col(start) > reach + gap), 1).otherwise(0)
    island = F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return (
        df.withColumn("_fresh", fresh).withColumn("_island", island).groupBy(group, "_island")
        .agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n_ranges")).drop("_island")
    )
