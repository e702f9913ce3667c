"""From an operation log to live runs.

A log row is ``(key, seq, idx, op, value)``: ``op`` is ``A`` (append) or ``D`` (delete); ``seq`` is the
commit and ``idx`` the place inside it. A replacing put is a ``D`` followed by an ``A`` in one commit.
An append is live when it stands after its key's newest delete.

The newest delete per key is a map-side-combined aggregate, and the log is joined to it: unlike a window
over the key this never holds one key's run in one task, and the join's hot partitions can be split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOG_SCHEMA = "key binary, seq bigint, idx int, op string, value binary"


def appends(df: DataFrame, key: Column, seq: Column, value: Column, idx: int = 0) -> DataFrame:
    return df.select(key.alias("key"), seq.alias("seq"), F.lit(idx).alias("idx"), F.lit("A").alias("op"), value.alias("value"))


def deletes(df: DataFrame, key: Column, seq: Column, value_type: str = "string", idx: int = 0) -> DataFrame:
    return df.select(
        key.alias("key"), seq.alias("seq"), F.lit(idx).alias("idx"), F.lit("D").alias("op"), F.lit(None).cast(value_type).alias("value")
    )


def puts(df: DataFrame, key: Column, seq: Column, value: Column, value_type: str = "string") -> DataFrame:
    """Delete and append in one commit; one pass over the input."""
    ops = F.explode(
        F.array(
            F.struct(F.lit(0).alias("idx"), F.lit("D").alias("op"), F.lit(None).cast(value_type).alias("value")),
            F.struct(F.lit(1).alias("idx"), F.lit("A").alias("op"), value.cast(value_type).alias("value")),
        )
    )
    return df.select(key.alias("key"), seq.alias("seq"), ops.alias("o")).select("key", "seq", "o.idx", "o.op", "o.value")


def as_of(log: DataFrame, seq: int | None) -> DataFrame:
    """The log as a snapshot sees it; ``None`` is the latest state."""
    return log if seq is None else log.where(F.col("seq") <= seq)


def resolve(log: DataFrame, upto: int | None = None, staged: DataFrame | None = None) -> DataFrame:
    """Live appends ``(key, seq, idx, value)``; ``staged`` adds an uncommitted batch (dirty reads)."""
    log = as_of(log, upto)
    if staged is not None:
        log = log.unionByName(staged)
    newest = log.where("op = 'D'").groupBy("key").agg(F.max(F.struct("seq", "idx")).alias("_d"))
    live = log.where("op = 'A'").join(newest, "key", "left")
    keep = F.col("_d").isNull() | (F.struct("seq", "idx") > F.col("_d"))
    return live.where(keep).select("key", "seq", "idx", "value")


def positions(live: DataFrame) -> DataFrame:
    """Numbers each run's values from 0 in append order."""
    w = Window.partitionBy("key").orderBy("seq", "idx")
    return live.withColumn("pos", F.row_number().over(w) - 1)


def touched_keys(log: DataFrame, after: int | None = None) -> DataFrame:
    """Distinct keys named by operations after the last flush."""
    log = log if after is None else log.where(F.col("seq") > after)
    return log.select("key").distinct()
