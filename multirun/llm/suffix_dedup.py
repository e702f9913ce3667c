"""Removes repeated strings of 100 bytes, keeping each one's first occurrence, by blockwise suffix sorting.

Two 100-byte strings are equal only if they hold the same anchor: the least hashed 32-byte gram of the 69
in them, leftmost on ties. So suffixes (positions) are dealt to buckets by their anchor, and consecutive
positions with one anchor travel as one segment.

1. Where the text is read, segments are reduced to the first of each content; later ones in that task are
   marked at once, so a passage that everyone shares costs a row per task.
2. Segments meet by anchor, sorted. Equal contents: all but the first are marked. An anchor with several
   contents is a boundary of a repeat: only those segments ask for their bytes.
3. Their windows go to suffix buckets named by the bytes all suffixes of the window share. One block of
   buckets at a time is sorted: windows are laid out with their anchors on multiples of V = 13, the
   suffixes at a difference cover's positions are ranked once by doubling (13, 26, 52, 104 bytes), and every
   suffix is then ordered by its first 8 bytes and the rank of the cover position that follows it, however
   long the tie. Neighbours that agree in 100 bytes, compared as bytes, are repeats of the first of them.
4. Marks are joined to the documents, whose texts travel compressed.

Memory is bounded by a block, a document and the segments of one task; the working arrays of step 1 by a piece of a
document, however long it is. Segments cut where pieces meet have contents of their own and are settled in step 3.

Cases: a null or empty text, or one under 100 bytes, loses nothing; ids that are null or repeat are ordered
by id (null first), then text, and equal rows are one document, judged once, with one row out for each;
periodic text is handled like any other; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from multirun.llm.common import STEP_INVERSE, mix, odd_ids, powers, prefix_hash, small_batches, span_hash, stored, text_groups

LENGTH, GRAM = 100, 32
#: Grams in a string of LENGTH bytes.
SPAN = LENGTH - GRAM + 1
#: A perfect difference cover: every residue is a difference of two of its members (fixed values).
V, COVER = 13, (0, 1, 3, 9)
#: Distance from each residue to the next covered one.
SHIFT = np.asarray([min(d for d in range(V) if (r + d) % V in COVER) for r in range(V)])
#: Offsets from the anchor that share a suffix bucket: from 0, and from this one on.
HALF = 35
#: Bytes of windows sorted at once, but for a larger bucket, and segments reduced at once in a task.
BLOCK_BYTES, TASK_SEGMENTS = 1 << 20, 1_000_000
#: Starts of strings in a longer document that are worked on at once; places of a piece must fit ``_POS``.
PIECE_BYTES = 1 << 22
_POS = np.uint64((1 << 28) - 1)


def segments(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """``row, s, a, e, anchor, content``: positions ``s..e`` of a row share the anchor at ``a``; places are in ``data``."""
    none = tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),) * 2
    if len(data) < LENGTH:
        return none
    pre = prefix_hash(data)
    n = len(data) - GRAM + 1
    h = mix((pre[GRAM:] - pre[:n]) * powers(STEP_INVERSE, n))
    key = (h & ~_POS) | np.arange(n, dtype=np.uint64)
    low, w = key, 1
    while w * 2 <= SPAN:
        low = np.minimum(low[:-w], low[w:])
        w *= 2
    if w < SPAN:
        low = np.minimum(low[: len(low) - (SPAN - w)], low[SPAN - w :])
    ok = np.zeros(len(low), bool)
    for i, j in zip(off[:-1], off[1:], strict=True):
        if j - i >= LENGTH:
            ok[i : j - LENGTH + 1] = True
    p = np.flatnonzero(ok)
    if not len(p):
        return none
    a = (low[p] & _POS).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (p[1:] != p[:-1] + 1)]))
    last = np.concatenate([first[1:] - 1, [len(p) - 1]])
    s, e, a = p[first], p[last], a[first]
    content = mix(span_hash(pre, s, e + LENGTH) + (a - s).astype(np.uint64))
    return np.searchsorted(off, s, "right") - 1, s, a, e, h[a], content


def runs(doc: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals sorted and joined where they overlap or touch."""
    if not len(doc):
        return doc, s, e
    order = np.lexsort((s, doc))
    doc, s, e = doc[order], s[order], e[order]
    new = np.concatenate([[True], doc[1:] != doc[:-1]])
    # the furthest end so far inside a document: documents are kept apart by an offset above every place
    rank = np.cumsum(new) - 1
    width = int(e.max()) + 1
    reach = np.maximum.accumulate(e + rank * width) - rank * width
    new[1:] |= s[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return doc[at], s[at], reach[np.concatenate([at[1:] - 1, [len(doc) - 1]])]


#: A segment is ``key, content, doc, s << 16 | (a - s) << 8 | (e - s) << 1``; a mark ``null, end, doc, s << 1 | 1``.
ROWS = "key bigint, content bigint, doc bigint, at bigint"
OUT = "bucket bigint, doc bigint, s bigint, a bigint, e bigint"


def _rows(key, content, doc, at) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([key, *(pa.array(x, pa.int64()) for x in (content, doc, at))], names=["key", "content", "doc", "at"])


def _reduce(parts: list[tuple[np.ndarray, ...]]):
    """The first segment of each content of a task as rows to be sent, and the others as marks."""
    doc, s, a, e, key, content = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.lexsort((s, doc, content, key))
    doc, s, a, e, key, content = (c[order] for c in (doc, s, a, e, key, content))
    again = np.concatenate([[False], (key[1:] == key[:-1]) & (content[1:] == content[:-1])])
    f = ~again
    yield _rows(pa.array(key[f].view(np.int64)), content[f].view(np.int64), doc[f], s[f] << 16 | a[f] - s[f] << 8 | e[f] - s[f] << 1)
    d, x, z = runs(doc[again], s[again], e[again] + LENGTH)
    yield _rows(pa.nulls(len(d), pa.int64()), z, d, x << 1 | 1)


def _segment_rows(batches):
    parts, held = [], 0
    for b, data, off in text_groups(batches):
        ids = b.column(0).to_numpy()
        # a document that stands alone is cut; pieces overlap, so that each string starts in one of them and ends there
        for begin in range(0, max(len(data) - LENGTH + 1, 1), PIECE_BYTES) if len(off) == 2 else (0,):
            piece, cut = data, off
            if len(off) == 2:
                piece = data[begin : begin + PIECE_BYTES + LENGTH - 1]
                cut = np.asarray([0, len(piece)])
            row, s, a, e, key, content = segments(piece, cut)
            base = cut[row] - begin
            parts.append((ids[row], s - base, a - base, e - base, key, content))
            held += len(s)
            if held >= TASK_SEGMENTS:
                yield from _reduce(parts)
                parts, held = [], 0
    if parts:
        yield from _reduce(parts)


def _meet(batches):
    """Rows sorted by key, content and place to marks (bucket null) and requests for bytes."""
    last = None  # key and content of the row before
    held = None  # the newest first-of-content, and whether another of its key came before it

    def out(bucket, doc, s, a, e):
        return pa.RecordBatch.from_arrays([bucket, *(pa.array(x, pa.int64()) for x in (doc, s, a, e))], names=["bucket", "doc", "s", "a", "e"])

    for b in batches:
        null = b.column(0).is_null().to_numpy(zero_copy_only=False)
        content, doc, at = (b.column(i).to_numpy() for i in (1, 2, 3))
        m = null
        if m.any():
            yield out(pa.nulls(int(m.sum()), pa.int64()), doc[m], at[m] >> 1, np.zeros(int(m.sum()), np.int64), content[m])
        key = b.column(0).fill_null(0).to_numpy()[~m]
        content, doc, at = content[~m], doc[~m], at[~m]
        if not len(key):
            continue
        s = at >> 16
        a, e = s + (at >> 8 & 255), s + (at >> 1 & 127)
        same = np.empty(len(key), bool)
        same[1:] = (key[1:] == key[:-1]) & (content[1:] == content[:-1])
        same[0] = last == (int(key[0]), int(content[0]))
        last = (int(key[-1]), int(content[-1]))
        if same.any():
            d, x, z = runs(doc[same], s[same], e[same] + LENGTH)
            yield out(pa.nulls(len(d), pa.int64()), d, x, np.zeros(len(d), np.int64), z)
        f = np.flatnonzero(~same)
        if not len(f):
            continue
        cols = [c[f] for c in (key, doc, s, a, e)]
        shared = False
        if held is not None:
            cols = [np.concatenate([[h], c]) for h, c in zip(held[0], cols, strict=True)]
            shared = held[1]
        k = cols[0]
        near = np.zeros(len(k), bool)
        near[1:] = k[1:] == k[:-1]
        ask = near.copy()
        ask[:-1] |= near[1:]
        ask[0] |= shared
        yield out(pa.array(k[:-1][ask[:-1]]), *(c[:-1][ask[:-1]] for c in cols[1:]))
        held = ([int(c[-1]) for c in cols], bool(ask[-1]))
    if held is not None and held[1]:
        yield out(*(pa.array([x], pa.int64()) for x in held[0]))


def _packed(batches):
    z = zstandard.ZstdCompressor(level=1)
    for b, data, off in text_groups(batches):
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([z.compress(data[i:j].tobytes()) for i, j in zip(off[:-1], off[1:], strict=True)], pa.binary())], names=["doc", "z"])


WINDOWS = "bucket bigint, doc bigint, p bigint, j bigint, bytes binary"


def _windows(batches):
    """Documents with their requests to windows: for each half of the offsets, the bytes of its suffixes."""
    unzip = zstandard.ZstdDecompressor()
    names = [x.split()[0] for x in WINDOWS.split(", ")]
    for b in batches:
        rows = []
        for doc, z, asks in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            text = unzip.decompress(z)
            for r in asks:
                s, a, e = r["s"], r["a"], r["e"]
                for lo, hi in ((0, HALF - 1), (HALF, SPAN - 1)):
                    p, q = max(s, a - hi), min(e, a - lo)
                    if p <= q:
                        common = text[a - lo : a - hi + LENGTH]
                        name = int.from_bytes(hashlib.blake2b(common, digest_size=8, salt=b"%d" % lo).digest(), "little", signed=True)
                        rows.append((name, doc, p, a - p, text[p : q + LENGTH]))
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "bytes" else pa.int64()) for c, n in zip(cols, names, strict=True)], names=names)


def sort_block(bucket: np.ndarray, j: np.ndarray, windows: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix-sorts the windows of some buckets.

    Returns ``window, offset, group`` of every suffix that has LENGTH bytes, in sorted order; suffixes of a
    group agree in LENGTH bytes.
    """
    size = np.asarray([len(w) for w in windows], np.int64)
    # an anchor, ``j`` after its window's start, lies on a multiple of V
    start = np.zeros(len(windows), np.int64)
    at = 0
    for i, n in enumerate(size.tolist()):
        at += (-int(j[i]) - at) % V
        start[i] = at
        at += n + 2 * V
    text = np.zeros(at + LENGTH + 2 * V, np.uint8)
    for i, w in zip(start.tolist(), windows, strict=True):
        text[i : i + len(w)] = np.frombuffer(w, np.uint8)
    word = np.ndarray(len(text) - 7, ">u8", text, strides=(1,))
    # ranks of the cover's positions by doubling
    n = len(text) - LENGTH
    q = np.flatnonzero(np.isin(np.arange(n) % V, COVER))
    rank = np.zeros(len(text) + LENGTH, np.int64)

    def dense(*keys) -> np.ndarray:
        order = np.lexsort(keys[::-1])
        new = np.zeros(len(order), np.int64)
        if len(order):
            diff = np.zeros(len(order), bool)
            for k in keys:
                diff[1:] |= k[order][1:] != k[order][:-1]
            new[order] = np.cumsum(diff) + 1
        return new

    rank[q] = dense(word[q].astype(np.uint64), word[q + V - 8].astype(np.uint64))
    reach = V
    while reach < LENGTH:
        rank[q] = dense(rank[q], rank[q + reach])
        reach *= 2
    count = np.maximum(size - LENGTH + 1, 0)
    window = np.repeat(np.arange(len(windows)), count)
    offset = np.arange(len(window)) - np.repeat(np.cumsum(count) - count, count)
    p = start[window] + offset
    residue = p % V
    head, tail = word[p].astype(np.uint64), rank[p + SHIFT[residue]]
    order = np.lexsort((tail, head, residue, bucket[window]))
    p, window, offset, residue = p[order], window[order], offset[order], residue[order]
    head = head[order]
    equal = np.zeros(len(p), bool)
    equal[1:] = (bucket[window][1:] == bucket[window][:-1]) & (residue[1:] == residue[:-1]) & (head[1:] == head[:-1])
    for i in range(0, len(p), 1 << 14):
        k = np.flatnonzero(equal[i : i + (1 << 14)]) + i
        if len(k):
            span = np.arange(LENGTH)
            equal[k] = (text[p[k][:, None] + span] == text[p[k - 1][:, None] + span]).all(axis=1)
    return window, offset, np.cumsum(~equal)


MARKS = "doc bigint, s bigint, e bigint"


def _sorted_buckets(batches):
    """Windows sorted by bucket to marks, a block of whole buckets at a time."""
    held: list[tuple] = []
    size = 0

    def work(rows):
        bucket, doc, p, j = (np.asarray(c, np.int64) for c in list(zip(*rows, strict=True))[:4])
        count = np.unique(bucket, return_counts=True)
        keep = np.flatnonzero(np.isin(bucket, count[0][count[1] > 1]))
        if len(keep) < 2:
            return None
        window, offset, group = sort_block(bucket[keep], j[keep], [rows[i][4] for i in keep])
        d, at = doc[keep][window], p[keep][window] + offset
        order = np.lexsort((at, d, group))
        later = order[1:][group[order][1:] == group[order][:-1]]
        d, s, e = runs(d[later], at[later], at[later] + LENGTH)
        return pa.RecordBatch.from_arrays([pa.array(d), pa.array(s), pa.array(e)], names=["doc", "s", "e"])

    for b in batches:
        for r in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            if size >= BLOCK_BYTES and r[0] != held[-1][0]:
                if (out := work(held)) is not None:
                    yield out
                held, size = [], 0
            held.append(r)
            size += len(r[4])
    if held and (out := work(held)) is not None:
        yield out


def marks(docs: DataFrame) -> DataFrame:
    """``(doc, s, e)`` byte intervals to be removed, possibly overlapping; ``docs`` has distinct longs ``doc`` and ``text``."""
    spark = docs.sparkSession
    small_batches(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc", "text").mapInArrow(_segment_rows, ROWS)
    # marks made on the way have no key: they are spread by their document
    rows = rows.repartition(n, F.coalesce("key", F.xxhash64("doc"))).sortWithinPartitions("key", "content", "doc", "at")
    met = stored(rows.mapInArrow(_meet, OUT), "met")
    asks = met.where("bucket is not null").groupBy("doc").agg(F.collect_list(F.struct("s", "a", "e")).alias("asks"))
    packed = docs.select("doc", "text").mapInArrow(_packed, "doc bigint, z binary")
    windows = packed.join(asks, "doc").select("doc", "z", "asks").mapInArrow(_windows, WINDOWS)
    found = windows.repartition(n, "bucket").sortWithinPartitions("bucket", "doc", "p").mapInArrow(_sorted_buckets, MARKS)
    return met.where("bucket is null").select("doc", "s", "e").unionByName(found)


KEPT = "doc bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"


def _kept(batches):
    unzip = zstandard.ZstdDecompressor()
    for b in batches:
        rows = []
        for doc, z, m in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            text = unzip.decompress(z)
            s, e = (np.asarray([x[k] for x in m or []], np.int64) for k in ("s", "e"))
            _, s, e = runs(np.zeros(len(s), np.int64), s, e)
            cut = [0, *np.stack([s, e], 1).ravel().tolist(), len(text)]
            kept = b"".join(text[cut[i] : cut[i + 1]] for i in range(0, len(cut), 2))
            rows.append((doc, len(text), len(text) - len(kept), len(s), kept))
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.binary())], names=["doc", "n_bytes", "n_removed", "n_spans", "kept"])


def dedup(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` for every row."""
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    names = None
    if not odd_ids(d):
        d = d.withColumnRenamed("doc_id", "doc")
    else:
        # ids that do not name a row: distinct documents are numbered in order of id and text; numbers grow with the range partition
        n = int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        once = d.withColumn("h", F.sha2("text", 256)).groupBy("doc_id", "h").agg(F.first("text").alias("text"), F.count("*").alias("times"))
        once = once.repartitionByRange(n, "doc_id", "text").sortWithinPartitions("doc_id", "text").withColumn("doc", F.monotonically_increasing_id())
        numbered = stored(once, "numbered")
        names, d = numbered.select("doc", "doc_id", "times"), numbered.select("doc", "text")
    small_batches(docs.sparkSession)
    m = marks(d).groupBy("doc").agg(F.collect_list(F.struct("s", "e")).alias("m"))
    packed = d.select("doc", "text").mapInArrow(_packed, "doc bigint, z binary")
    out = packed.join(m, "doc", "left").select("doc", "z", "m").mapInArrow(_kept, KEPT)
    if names is None:
        return out.withColumnRenamed("doc", "doc_id")
    out = out.join(names, "doc").withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns."""
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
