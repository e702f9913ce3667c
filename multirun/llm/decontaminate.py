"""Benchmark decontamination through a distributed positional inverted index.

The index is a table of shards. A shard covers consecutive documents of one task, a bounded number of text
bytes, and stores for every term of its documents the ascending token positions, as deltas; documents in a
shard stand ``GAP`` positions apart, so no phrase crosses them. Shards are made where the text is read and
are never shuffled: a term's list is spread over shards, which splits frequent terms by itself.

Windows of the items are made in tasks and searched in blocks of a bounded number of item words. A block is
joined with the index by terms: the corpus counts of its terms come from the index first, and each window is
filed under its rarest term in the corpus. A shard looks up its terms among those; a window whose rarest term
it does not have costs it nothing, and one whose rarest term no shard has is dropped before the search.

A window is then searched from its rarest term in the shard: that list, less the term's offset, gives
candidate starts, and the other terms' lists are intersected with it from rare to frequent until none is
left. A proximity match begins at any of its words and has all of them within its reach, in one document;
the rarest term only says where to look, so matches do not depend on what else a shard holds.

Cases: texts without words have no hits; an item of fewer words than a window is one window, one without
words none; an item longer than a block is cut into parts that share a window less a word, so every window is
in one part; null item ids are ignored; items with equal ids are one item; repeated documents are judged
separately; an empty table gives no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from multirun.llm.common import LOWER, fresh, small_batches, stored, text_groups, token_spans

WINDOW = 10
#: Positions between two documents of a shard, so that no phrase runs over their border.
GAP = 64
#: Bytes of text in a shard, but for a longer document.
SHARD_BYTES = 2 << 20
#: Item words whose windows are sent to tasks at once, and words in a part of an item.
BLOCK_WORDS, PART_WORDS = 1 << 20, 1 << 16

INDEX = "shard bigint, doc_ids array<bigint>, doc_words binary, terms array<binary>, sizes binary, positions binary"


def _pack(a: np.ndarray) -> bytes:
    """Little-endian 32-bit numbers, bytes of equal weight together, compressed."""
    planes = np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(b: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of whole texts; nothing is shuffled."""
    small_batches(docs.sparkSession)

    def f(batches):
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId() << 32
        for b, data, off in text_groups(batches, limit=SHARD_BYTES):
            low = LOWER[data]
            starts, ends, cut = token_spans(low, off)
            words = np.diff(cut)
            size = ends - starts
            inside = np.zeros(len(low) + 1, np.int32)
            inside[starts], closing = 1, np.bincount(ends, minlength=len(low) + 1)
            kept = low[np.cumsum(inside - closing)[: len(low)] > 0] if len(starts) else low[:0]
            offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
            tokens = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(kept)])
            coded = tokens.dictionary_encode()
            code = coded.indices.to_numpy() if len(starts) else np.zeros(0, np.int64)
            place = np.arange(len(starts)) + np.repeat(np.arange(len(words)) * GAP, words)
            order = np.argsort(code, kind="stable")
            counts = np.bincount(code, minlength=len(coded.dictionary))
            sorted_places = place[order]
            delta = np.diff(sorted_places, prepend=0)
            first = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64) if len(counts) else np.zeros(0, np.int64)
            delta[first] = sorted_places[first]
            row = [shard, b.column(b.schema.get_field_index("doc_id")).to_pylist(), _pack(words), coded.dictionary.cast(pa.binary()).to_pylist(), _pack(counts), _pack(delta)]
            types = [pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.binary()), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names=["shard", "doc_ids", "doc_words", "terms", "sizes", "positions"])
            shard += 1

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(f, INDEX)


class Shard:
    """One index row, opened."""

    def __init__(self, row: dict):
        self.shard, self.doc_ids = row["shard"], row["doc_ids"]
        self.words = _unpack(row["doc_words"])
        #: First position of each document.
        self.first = np.concatenate([[0], np.cumsum(self.words + GAP)[:-1]]).astype(np.int64) if len(self.words) else np.zeros(0, np.int64)
        sizes = _unpack(row["sizes"])
        self.end = np.cumsum(sizes)
        self.begin = self.end - sizes
        self.delta = _unpack(row["positions"])
        self.term = {t: i for i, t in enumerate(row["terms"])}
        self.open: dict[int, np.ndarray] = {}

    def listed(self, i: int) -> np.ndarray:
        """Ascending positions of the i-th term."""
        if i not in self.open:
            self.open[i] = np.cumsum(self.delta[self.begin[i] : self.end[i]])
        return self.open[i]

    def postings(self, term: bytes) -> np.ndarray | None:
        """Ascending positions of a term."""
        i = self.term.get(term)
        return None if i is None else self.listed(i)

    def size(self, term: bytes) -> int:
        i = self.term.get(term)
        return 0 if i is None else int(self.end[i] - self.begin[i])

    def run(self, terms: list[int]) -> np.ndarray:
        """Start positions of an exact phrase, given by the places of its terms."""
        size = self.end[terms] - self.begin[terms]
        order = np.argsort(size, kind="stable").tolist()
        at = self.listed(terms[order[0]]) - order[0]
        for k in order[1:]:
            p = self.listed(terms[k])
            i = np.searchsorted(p, at + k)
            at = at[p[np.minimum(i, len(p) - 1)] == at + k]
            if not len(at):
                break
        return at

    def near(self, words: tuple[bytes, ...], reach: int) -> np.ndarray:
        """Ascending positions of any of the words from which all of them stand within ``reach`` positions, in one document."""
        words = tuple(sorted(set(words), key=self.size))
        if not words or reach < 0 or self.size(words[0]) == 0:
            return np.zeros(0, np.int64)
        # the rarest word only says where to look: a match begins at most ``reach`` before it, or at it
        rare, starts = self.postings(words[0]), []
        for w in words:
            p = self.postings(w)
            i = np.searchsorted(rare, p)
            starts.append(p[rare[np.minimum(i, len(rare) - 1)] - p <= reach] if w != words[0] else p)
        at = np.sort(np.concatenate(starts))
        d = self.doc_of(at)
        last = np.minimum(at + reach, self.first[d] + self.words[d] - 1)
        for w in words:
            p = self.postings(w)
            i = np.searchsorted(p, at)
            kept = (i < len(p)) & (p[np.minimum(i, len(p) - 1)] <= last)
            at, last = at[kept], last[kept]
        return at

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, at, "right") - 1


def words_of(text: str | None) -> list[bytes]:
    low = LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    s, e, _ = token_spans(low, np.asarray([0, len(low)]))
    raw = low.tobytes()
    return [raw[a:b] for a, b in zip(s, e, strict=True)]


PARTS = "item string, n bigint, words binary"


def item_parts(items: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = WINDOW, limit: int = PART_WORDS) -> DataFrame:
    """Items cut into parts of at most ``limit`` words (or ``size``), back to back with a space between; parts share a window less a word."""
    limit = max(limit, size)

    def f(batches):
        for b in batches:
            for k in range(b.num_rows):
                w = words_of(b.column(1)[k].as_py())
                at = [i for i in range(0, len(w), limit - size + 1) if i == 0 or i + size <= len(w)]
                for i in at:
                    part = w[i : i + limit]
                    cols = [[b.column(0)[k].as_py()], [len(part)], [b" ".join(part)]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.binary()), strict=True)], names=["item", "n", "words"])

    own = items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text")).where("item is not null")
    return own.mapInArrow(f, PARTS)


class Block:
    """Windows of some parts of items, as rows of places in their vocabulary (-1 where a window is shorter)."""

    def __init__(self, parts: list[tuple[str, bytes]], size: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.items = sorted({i for i, _ in parts})
        number = {x: k for k, x in enumerate(self.items)}
        rows, whose = [np.zeros((0, size), np.int32)], [np.zeros(0, np.int32)]
        for item, raw in parts:
            ids = np.asarray([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in raw.split(b" ")], np.int32)
            if len(ids) < size:
                ids = np.concatenate([ids, np.full(size - len(ids), -1, np.int32)])
            rows.append(np.lib.stride_tricks.sliding_window_view(ids, size))
            whose.append(np.full(len(rows[-1]), number[item], np.int32))
        flat = np.ascontiguousarray(np.concatenate(rows)).view(np.dtype((np.void, 4 * size))).ravel()
        found, inverse = np.unique(flat, return_inverse=True)
        self.rows = found.view(np.int32).reshape(-1, size)
        # (window, item) pairs, once each; the items of window r are whose[first[r] : first[r + 1]]
        pairs = np.unique(inverse.astype(np.int64) * max(1, len(self.items)) + np.concatenate(whose))
        self.whose = (pairs % max(1, len(self.items))).astype(np.int32)
        self.first = np.searchsorted(pairs // max(1, len(self.items)), np.arange(len(self.rows) + 1))
        self.order = self.begin = np.zeros(0, np.int64)

    def file(self, counts: np.ndarray) -> None:
        """Files each window under its term that is rarest in the corpus; windows with a term that it does not have are left out."""
        size = np.where(self.rows < 0, np.iinfo(np.int64).max, counts[self.rows]) if len(self.rows) else np.zeros((0, 1), np.int64)
        kept = np.flatnonzero(size.min(axis=1) > 0)
        anchor = self.rows[kept, size[kept].argmin(axis=1)]
        order = np.argsort(anchor, kind="stable")
        self.order, self.begin = kept[order], np.searchsorted(anchor[order], np.arange(len(self.vocabulary) + 1))

    def shared(self, terms: dict[bytes, int]) -> list[tuple[int, int]]:
        """``(place here, place there)`` of the terms that a shard has too, by way of the smaller of both."""
        if len(terms) < len(self.vocabulary):
            return [(self.vocabulary[t], i) for t, i in terms.items() if t in self.vocabulary]
        return [(k, terms[t]) for t, k in self.vocabulary.items() if t in terms]

    def candidates(self, terms: dict[bytes, int]) -> tuple[list[int], list[list[int]]]:
        """Windows that have their rarest term and all others in a shard, with their terms' places there."""
        both = np.asarray(self.shared(terms), np.int64).reshape(-1, 2)
        filed = both[self.begin[both[:, 0] + 1] > self.begin[both[:, 0]]][:, 0] if len(self.order) else both[:0, 0]
        if not len(filed):
            return [], []
        rows = np.concatenate([self.order[self.begin[k] : self.begin[k + 1]] for k in filed])
        place = np.full(len(self.vocabulary) + 1, -1, np.int64)  # the last one stands for the -1 of short windows
        place[both[:, 0]] = both[:, 1]
        at = place[self.rows[rows]]
        whole = ((at >= 0) | (self.rows[rows] < 0)).all(axis=1)
        length = (self.rows[rows] >= 0).sum(axis=1)
        return rows[whole].tolist(), [x[:n].tolist() for x, n in zip(at[whole], length[whole], strict=True)]


def blocks(parts: DataFrame, size: int = WINDOW, limit: int = BLOCK_WORDS):
    """Blocks of at most ``limit`` item words, but for one part; read one after another."""
    held, n = [], 0
    for r in parts.toLocalIterator():
        if held and n + r["n"] > limit:
            yield Block(held, size)
            held, n = [], 0
        held.append((r["item"], bytes(r["words"])))
        n += r["n"]
    yield Block(held, size)


def corpus_counts(index: DataFrame, vocabulary: dict[bytes, int]) -> np.ndarray:
    """Occurrences in the corpus of each term of a vocabulary; reads terms and list sizes only."""
    if not vocabulary:
        return np.zeros(0, np.int64)
    shared = index.sparkSession.sparkContext.broadcast(vocabulary)

    def f(batches):
        fresh("index")
        get, out = shared.value.get, np.zeros(len(shared.value), np.int64)
        for b in batches:
            for terms, sizes in zip(b.column(0), b.column(1), strict=True):
                at = [(k, i) for i, k in enumerate(map(get, terms.as_py())) if k is not None]
                if at:
                    k, i = np.asarray(at).T
                    out[k] += _unpack(sizes.as_py())[i]
        seen = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(out[seen], pa.int64())], names=["k", "n"])

    found = index.select("terms", "sizes").mapInArrow(f, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    shared.destroy()
    counts = np.zeros(len(vocabulary), np.int64)
    counts[found["k"].to_numpy()] = found["n"].to_numpy()
    return counts


HITS = "doc_id bigint, n_words bigint, n_hit bigint, items array<string>"
SPANS = "shard bigint, nth bigint, spans array<bigint>, items array<string>"


def _hits(shard: Shard, block: Block) -> tuple[list[list[tuple]], list[set]]:
    """Covered positions and places of items by document of a shard."""
    n = len(shard.words)
    spans, items = [[] for _ in range(n)], [set() for _ in range(n)]
    for r, terms in zip(*block.candidates(shard.term), strict=True):
        at = shard.run(terms)
        if len(at):
            own = block.whose[block.first[r] : block.first[r + 1]].tolist()
            for p, d in zip(at.tolist(), shard.doc_of(at).tolist(), strict=True):
                spans[d].append((p, p + len(terms)))
                items[d].update(own)
    return spans, items


def _covered(spans: list[tuple[int, int]]) -> int:
    total, reach = 0, -1
    for a, z in sorted(spans):
        total += max(0, z - max(a, reach))
        reach = max(reach, z)
    return total


def _shards(batches):
    fresh("index")
    for b in batches:
        for k in range(b.num_rows):
            yield Shard(b.slice(k, 1).to_pylist()[0])


def contaminated(docs: DataFrame, items: DataFrame, size: int = WINDOW, limit: int = BLOCK_WORDS, index: DataFrame | None = None) -> DataFrame:
    """One row per document: its words, words inside any occurrence of a window, and the items whose windows occur.

    An ``index`` that is given must be stored: it is read once for the terms' counts and once for each block.
    """
    spark = docs.sparkSession
    index = stored(build(docs), "index") if index is None else index
    found = blocks(stored(item_parts(items, size=size, limit=min(limit, PART_WORDS)), "items"), size, limit)
    block, second = next(found), next(found, None)

    def search(block: Block, schema: str, rows) -> tuple[DataFrame, object]:
        block.file(corpus_counts(index, block.vocabulary))
        shared = spark.sparkContext.broadcast(block)
        names, types = zip(*(x.split() for x in schema.split(", ")), strict=True)
        arrow = [{"bigint": pa.int64(), "array<string>": pa.list_(pa.string()), "array<bigint>": pa.list_(pa.int64())}[t] for t in types]

        def f(batches):
            for s in _shards(batches):
                cols = list(zip(*rows(s, shared.value), strict=True)) or [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, arrow, strict=True)], names=list(names))

        return index.mapInArrow(f, schema), shared

    def named(block, found):
        return sorted(block.items[i] for i in found)

    def whole(s: Shard, block: Block):
        return [(i, n, _covered(p), named(block, x)) for i, n, p, x in zip(s.doc_ids, s.words.tolist(), *_hits(s, block), strict=True)]

    def partial(s: Shard, block: Block):
        return [(s.shard, k, [x for y in p for x in y], named(block, x)) for k, (p, x) in enumerate(zip(*_hits(s, block), strict=True)) if p]

    if second is None:
        return search(block, HITS, whole)[0]
    # more than one block: hits of each are stored and its windows let go; then one union of spans per document
    parts = []
    while block is not None:
        hits, shared = search(block, SPANS, partial)
        parts.append(stored(hits, "hits"))
        shared.destroy()
        block, second = second, next(found, None)

    @F.pandas_udf("bigint")
    def covered(spans: pd.Series) -> pd.Series:
        return spans.map(lambda s: _covered([(s[i], s[i + 1]) for i in range(0, len(s), 2)]))

    def listed(batches):
        for s in _shards(batches):
            n = len(s.words)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in ([s.shard] * n, range(n), s.doc_ids, s.words.tolist())], names=["shard", "nth", "doc_id", "n_words"])

    g = reduce(DataFrame.unionByName, parts).groupBy("shard", "nth").agg(
        F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    )
    every = index.mapInArrow(listed, "shard bigint, nth bigint, doc_id bigint, n_words bigint")
    none = F.array().cast("array<string>")
    return every.join(g.select("shard", "nth", covered("spans").alias("n_hit"), "items"), ["shard", "nth"], "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"), F.coalesce("items", none).alias("items")
    )


def near(docs: DataFrame, phrases: list[list[str]], reach: int) -> DataFrame:
    """Proximity matches ``(doc_id, phrase, position)``: places of a phrase's words from which all of its words stand within ``reach`` positions; a repeated word counts once."""
    wanted = [tuple(words_of(" ".join(p))) for p in phrases]

    def f(batches):
        for s in _shards(batches):
            out = [(s.doc_ids[d], k, int(p - s.first[d])) for k, w in enumerate(wanted) for at in [s.near(w, reach)] for p, d in zip(at, s.doc_of(at), strict=True)]
            cols = list(zip(*out, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "phrase", "position"])

    return build(docs).mapInArrow(f, "doc_id bigint, phrase bigint, position bigint")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns."""
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )
