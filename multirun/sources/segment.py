"""Immutable key-sorted segments as single Parquet folders."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from multirun.operators.merge import sorted_ranges


class OrderError(ValueError):
    """Keys given to an ordered writer were repeated or not ascending."""


class SegmentWriter:
    """Streaming writer: begin, value..., end, finish. Keys must ascend strictly.

    Rows go out as sorted files of a bounded number of bytes, so the caller's process never holds the segment;
    ``finish`` names the folder, and one that is not finished is not there for readers.
    """

    def __init__(self, spark: SparkSession, path: str, batch_bytes: int = 16 << 20):
        self.spark, self.path, self.rows, self.key, self.last, self.n = spark, path, [], None, None, 0
        self.batch_bytes, self.held, self.begun = batch_bytes, 0, f"{path.rstrip('/')}.{uuid.uuid4().hex[:8]}.begun"

    def begin(self, key: bytes) -> None:
        if self.key is not None:
            raise OrderError("begin inside a record")
        if self.last is not None and key <= self.last:
            raise OrderError("keys must ascend strictly")
        self.key, self.n = bytes(key), 0

    def value(self, v: bytes) -> None:
        if self.key is None:
            raise OrderError("value outside a record")
        self.rows.append((self.key, self.n, bytes(v)))
        self.n += 1
        self.held += len(self.key) + len(v) + 64
        if self.held >= self.batch_bytes:
            self._spill()

    def _spill(self) -> None:
        df = self.spark.createDataFrame(self.rows, "key binary, pos int, value binary")
        df.coalesce(1).sortWithinPartitions("key", "pos").write.mode("append").parquet(self.begun)
        self.rows, self.held = [], 0

    def end(self) -> None:
        """Closes the record; a key without values stays in the dictionary with count 0."""
        if self.n == 0:
            self.rows.append((self.key, None, None))
        self.last, self.key = self.key, None

    def put_one(self, key: bytes, v: bytes) -> None:
        self.begin(key)
        self.value(v)
        self.end()

    def finish(self) -> None:
        if self.key is not None:
            raise OrderError("finish inside a record")
        self._spill()
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        fs = path(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.rename(path(self.begun), path(self.path)):
            raise OSError(f"{self.path} exists")


def write_sorted(df: DataFrame, path: str, ranges: int | None = None, codec: str = "zstd") -> None:
    """Batch writer for ``(key, pos, value)`` rows of any order: range partitions, sorted inside.

    A position given twice for a key is refused before anything is written. Without ``ranges``, adaptive execution
    sizes them by their bytes.
    """
    if not check_sorted(df).isEmpty():
        raise OrderError("a position is given twice for a key")
    if ranges is None:
        df.repartitionByRange("key").sortWithinPartitions("key", "pos").write.option("compression", codec).parquet(path)
    else:
        sorted_ranges(df, ranges, "pos").write.option("compression", codec).parquet(path)


def check_sorted(df: DataFrame) -> DataFrame:
    """Positions given twice for a key: the rows an ordered writer would have refused."""
    return df.groupBy("key", "pos").agg(F.count("*").alias("times")).where("times > 1")


def read_segment(spark: SparkSession, path: str) -> DataFrame:
    """Rows with values; keys without values are in ``segment_keys`` only."""
    return spark.read.parquet(path).where("pos is not null")


def segment_keys(spark: SparkSession, path: str) -> DataFrame:
    """Every key with its count, 0 included."""
    return spark.read.parquet(path).groupBy("key").agg(F.count("pos").alias("n"))


def first_values(df: DataFrame) -> DataFrame:
    w = Window.partitionBy("key").orderBy("pos")
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
