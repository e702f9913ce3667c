"""Packs documents into sequences of a fixed capacity: large-item matching, then best fit.

A length is a small integer, so the packing is planned on the histogram of lengths, which has at most
``capacity`` entries however many documents there are. Pieces above a third of the capacity are matched
greedily: from the longest down each takes the longest other one that still fits, so at most two share a
bin. Smaller pieces then go, longest first, into the smallest gap that holds them. The plan is a set of
patterns with a count; pieces meet it through their rank among pieces of the same length, which comes from
counts per task and length. No piece is moved but for that lookup.

Cases: a null or empty text is one piece holding the end id; only documents longer than the capacity are
cut, into full pieces and a last one; repeated rows are packed separately; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from multirun.llm.common import small_batches, stored
from multirun.llm.tokens import encoder

CAPACITY = 2048
PIECES = "part int, doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, local bigint"


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Patterns ``(lengths in a bin, how many such bins)`` that hold every piece once."""
    left = Counter({k: v for k, v in counts.items() if v})
    if any(not 0 < k <= capacity for k in left):
        raise ValueError("a piece must have 1 to capacity tokens")
    third = capacity / 3
    bins: dict[int, list[list]] = defaultdict(list)  # by gap: [pattern, count]
    large = sorted((k for k in left if k > third), reverse=True)
    for k in large:
        while left[k]:
            mate = next((m for m in large if m <= capacity - k and left[m] - (m == k) > 0), None)
            if mate is None:
                bins[capacity - k].append([[k], left[k]])
                left[k] = 0
            else:
                n = left[k] // 2 if mate == k else min(left[k], left[mate])
                bins[capacity - k - mate].append([[k, mate], n])
                left[k] -= n
                left[mate] -= n
    for k in sorted((k for k in left if k <= third), reverse=True):
        n = left[k]
        while n:
            gap = min((g for g in bins if g >= k and bins[g]), default=None)
            if gap is None:
                each = capacity // k
                if full := n // each:
                    bins[capacity - each * k].append([[k] * each, full])
                if n % each:
                    bins[capacity - n % each * k].append([[k] * (n % each), 1])
                break
            pattern, count = bins[gap].pop()
            each = gap // k
            full = min(count, n // each)
            if full:
                bins[gap - each * k].append([pattern + [k] * each, full])
                n -= full * each
            rest = count - full
            if rest and 0 < n < each:
                bins[gap - n * k].append([pattern + [k] * n, 1])
                n, rest = 0, rest - 1
            if rest:
                bins[gap].append([pattern, rest])
    return [(p, c) for group in bins.values() for p, c in group]


def slots(patterns: list[tuple[list[int], int]]) -> dict[int, np.ndarray]:
    """By length: rows ``(first rank, first sequence, offset)``; ranks from one row to the next take consecutive sequences."""
    out, used, base = defaultdict(list), Counter(), 0
    for lengths, count in patterns:
        at = 0
        for k in lengths:
            out[k].append((used[k], base, at))
            used[k] += count
            at += k
        base += count
    return {k: np.asarray(v, np.int64) for k, v in out.items()}


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """One row per piece, with its rank among its task's pieces of that length; texts are not shuffled."""
    names = [x.split()[0] for x in PIECES.split(", ")]
    types = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]

    def f(batches):
        from pyspark import TaskContext

        part, enc, seen = TaskContext.get().partitionId(), encoder(tokenizer, drops_space=True), Counter()
        end = np.asarray([end_id], "<u4").tobytes()
        for b in batches:
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = enc.encode(t.as_py()) + end
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    own = raw[at : at + 4 * capacity]
                    n = len(own) // 4
                    rows.append((part, i, k, at // 4, n, zlib.crc32(own), seen[n]))
                    seen[n] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types], names=names)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(f, PIECES)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """Rows ``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)``."""
    small_batches(docs.sparkSession)
    p = stored(pieces(docs, tokenizer, end_id, capacity), "pieces")
    counts = p.groupBy("part", "length").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "length", F.coalesce(F.sum("_n").over(before), F.lit(0)).cast("bigint").alias("_base"))
    # at most `capacity` rows: one per length
    histogram = {r["length"]: r["n"] for r in p.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = slots(plan(histogram, capacity))

    def place(batches):
        for b in batches:
            col = lambda c: b.column(b.schema.get_field_index(c))  # noqa: E731, B023
            length = col("length").to_numpy()
            rank = col("local").to_numpy() + col("_base").to_numpy()
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for k in np.unique(length):
                at, rows = np.flatnonzero(length == k), table[int(k)]
                s = rows[np.searchsorted(rows[:, 0], rank[at], "right") - 1]
                seq[at], off[at] = s[:, 1] + rank[at] - s[:, 0], s[:, 2]
            yield pa.RecordBatch.from_arrays(
                [col(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")] + [pa.array(seq), pa.array(off)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    out = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    return p.join(base, ["part", "length"]).mapInArrow(place, out)
