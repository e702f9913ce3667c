"""What the operators share: Arrow text buffers, bounded groups of rows, word hashes and the shared folder."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python task works on at once, but for a single longer document.
GROUP_BYTES = 1 << 20

#: Bytes that belong to words: letters and digits of ASCII and every byte of a longer UTF-8 sequence.
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[48:58] = WORD_BYTE[65:91] = WORD_BYTE[97:123] = WORD_BYTE[128:] = True
#: A-Z to a-z, all else unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


#: What a worker keeps between tasks, by the kind of work that uses it.
_KEPT: dict[str, Callable[[], None]] = {}
_LAST: dict = {}


def keep(kind: str, clear: Callable[[], None]) -> None:
    """Registers how to drop what a worker keeps for one kind of work."""
    _KEPT[kind] = clear


def fresh(kind: str) -> None:
    """At a task's begin and end: drops what other kinds of work have kept, and gives free memory back.

    Workers are reused from stage to stage; without this each holds the largest stage's memory for good.
    Inside one kind of work it is done every few seconds at most.
    """
    now = time.monotonic()
    if _LAST.get("kind") == kind and now - _LAST["at"] < 5:
        return
    _LAST.update(kind=kind, at=now)
    for other, clear in _KEPT.items():
        if other != kind:
            clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not glibc
        ctypes.CDLL(None).malloc_trim(0)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder that driver and executors share; a local one only where all run on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        base = tempfile.mkdtemp(prefix="multirun-")
    return f"{base.rstrip('/')}/multirun/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes a table to the shared folder and reads it again: lineage ends there, and a lost executor loses nothing."""
    path = shared_dir(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, limit: str = "2m") -> None:
    """Arrow batches of a few MB instead of Spark's default of 64: a task holds one beside its working arrays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, "67108864b") in ("67108864b", "64m", "64MB"):
        spark.conf.set(name, limit)


def hash_share(column: Column) -> Column:
    """A value's place below a million, by its hash."""
    return F.pmod(F.xxhash64(column), F.lit(1_000_000))


def bounded_sample(df: DataFrame, column: str, rows: int) -> tuple[DataFrame, int]:
    """At most ``rows`` distinct rows for fitting a model, drawn over the whole table by the hash of a column, and the share drawn of a million.

    The share comes from a count, so tasks send what is drawn and no more. Repeated rows are drawn together and
    count once, so copies do not crowd out the rest; the limit stands for the rare draw of more than its share.
    """
    n = df.count()
    share = int(900_000 * rows / n) if n > rows else 1_000_000
    return df.where(hash_share(F.col(column)) < share).distinct().limit(rows), share


def own_columns(df: DataFrame, *besides: str) -> list:
    """All columns of a frame but those an operator is about to add; names are compared as Spark does, whatever they hold."""
    taken = {c.lower() for c in besides}
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns if c.lower() not in taken]


def odd_ids(df: DataFrame, id_col: str = "doc_id") -> bool:
    """Whether ids fail to name rows: one is null or repeats."""
    return not df.groupBy(id_col).agg(F.count("*").alias("n")).where((F.col("n") > 1) | F.col(id_col).isNull()).isEmpty()


def row_keys(df: DataFrame, name: str, id_col: str | None = "doc_id") -> tuple[DataFrame, bool]:
    """The frame with a unique long per row: the id itself, or where there is none or ids do not name rows, a number that is stored with it."""
    if id_col is not None and not odd_ids(df, id_col):
        return df.withColumn(name, F.col(id_col).cast("bigint")), False
    return stored(df.withColumn(name, F.monotonically_increasing_id()), "rows"), True


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; nulls are empty texts."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def groups(offsets: np.ndarray, limit: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive rows ``[i, j)`` of at most ``limit`` bytes together; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def text_groups(batches, column: str = "text", limit: int = GROUP_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of Arrow batches with their bytes and offsets, bounded by ``limit``."""
    fresh("text")
    for b in batches:
        data, off = text_bytes(b.column(b.schema.get_field_index(column)))
        for i, j in groups(off, limit):
            yield b.slice(i, j - i), data[off[i] : off[j]], off[i : j + 1] - off[i]
    fresh("text")


def token_spans(low: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and words before each row; a word never crosses rows."""
    if len(low) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    w = WORD_BYTE[low]
    first = w.copy()
    first[1:] &= ~w[:-1]
    last = w.copy()
    last[:-1] &= ~w[1:]
    cuts = off[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(low))]
    first[cuts] = w[cuts]
    last[cuts - 1] = w[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off, "left")


_RNG = np.random.default_rng(20)
#: A random number per byte value, and an odd multiplier with its inverse modulo 2**64, for hashes of byte strings.
BYTE_MIX = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
STEP = 0x9E3779B97F4A7C15
STEP_INVERSE = pow(STEP, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}
keep("text", _POWERS.clear)


def powers(base: int, n: int) -> np.ndarray:
    """``base**i`` modulo 2**64 for i below n, kept between calls."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        out = np.ones(max(n, 1 << 16), np.uint64)
        out[1] = base & (1 << 64) - 1
        k = 2
        while k < len(out):
            m = min(k, len(out) - k)
            with np.errstate(over="ignore"):
                out[k : k + m] = out[:m] * (out[k - 1] * out[1])
            k += m
        if len(out) <= 1 << 23:
            _POWERS[base] = out
        have = out
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers."""
    h = (h ^ h >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(29)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(32)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Sums of mixed bytes times powers of STEP: differences are hashes of substrings."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_MIX[data] * powers(STEP, len(data)), out=out[1:])
    return out


def span_hash(pre: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte spans, the same wherever a span stands."""
    inverse = powers(STEP_INVERSE, len(pre))
    return mix((pre[ends] - pre[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
