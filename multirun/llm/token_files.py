"""Token-id files: a concatenated id array with Elias-Fano document boundaries.

A file set is a Parquet table of blocks in document order. A block holds the ids of consecutive documents
back to back as unsigned 16- or 32-bit numbers, and the documents' end positions in it as an Elias-Fano
sequence: low bits packed, high bits as a unary bit vector, and a select sample for each 64th one bit, so a
boundary is found without a table of 64-bit offsets. The documents' own ids, which ascend, are another such
sequence. ``read`` asks select for each document's boundaries; ``fetch`` finds single documents by binary
search over select in the blocks whose id range holds them. Blocks are bounded, so neither writer nor reader
holds more than one block and one document.

Cases: a null or empty text has the end id alone; rows with equal ids stand beside each other, ordered by
text; a null id comes first; an empty table gives no blocks. Other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from multirun.llm.common import shared_dir, small_batches
from multirun.llm.tokens import encoder

#: Ids a block holds before it is closed, and documents.
BLOCK_IDS, BLOCK_DOCS = 1 << 19, 1 << 13
#: One bits between two select samples.
SAMPLE = 64

#: Blocks up to which their starts are sent to every task (about 20 bytes each); more are joined.
BROADCAST_BLOCKS = 500_000

#: ``n_null`` documents without an id come first; the others' ids, less ``id_base``, are one sequence, ends of all documents the other.
BLOCKS = (
    "part int, seq int, n_docs int, n_null int, id_base bigint, id_last bigint, id_bits int, id_low binary, id_high binary, id_samples binary, "
    "n_ids bigint, wide boolean, low_bits int, low binary, high binary, samples binary, ids binary"
)
_ARROW = {"int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
SCHEMA = pa.schema([(n, _ARROW[t]) for n, t in (x.split() for x in BLOCKS.split(", "))])


class EliasFano:
    """A non-decreasing sequence below ``universe`` in about ``2 + log2(universe / n)`` bits a value."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: bytes):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @staticmethod
    def of(values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        v = np.asarray(values, np.uint64)
        bits = max(0, (max(1, universe) // max(1, n)).bit_length() - 1)
        shifts = np.arange(bits, dtype=np.uint64)
        low = np.packbits(((v[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little").tobytes() if bits else b""
        at = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        vec = np.zeros(int(at[-1]) + 1 if n else 0, np.uint8)
        vec[at] = 1
        return EliasFano(n, bits, low, np.packbits(vec, bitorder="little").tobytes(), at[::SAMPLE].astype("<u4").tobytes())

    def _low(self, i: int) -> int:
        at = i * self.low_bits
        word = int.from_bytes(self.low[at >> 3 : (at + self.low_bits + 7 >> 3) + 1], "little")
        return word >> (at & 7) & (1 << self.low_bits) - 1

    def select(self, i: int) -> int:
        """The i-th value alone: from the nearest sample, past at most 63 one bits."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = int.from_bytes(self.samples[i // SAMPLE * 4 : i // SAMPLE * 4 + 4], "little")
        left = i % SAMPLE
        if left:
            byte, past = at >> 3, (at & 7) + 1
            ones = self.high[byte] >> past << past
            while (n := ones.bit_count()) < left:
                left, byte = left - n, byte + 1
                ones = self.high[byte]
            for _ in range(left - 1):
                ones &= ones - 1
            at = (byte << 3) + (ones & -ones).bit_length() - 1
        return at - i << self.low_bits | self._low(i)

    def find(self, value: int) -> int:
        """The first place whose value is at or above this one."""
        a, z = 0, self.n
        while a < z:
            m = (a + z) // 2
            a, z = (m + 1, z) if self.select(m) < value else (a, m)
        return a

    def values(self) -> np.ndarray:
        high = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))[: self.n] - np.arange(self.n)
        if not self.low_bits:
            return high.astype(np.int64)
        bits = np.unpackbits(np.frombuffer(self.low, np.uint8), bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
        low = bits.astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))
        return (high.astype(np.int64) << self.low_bits) + low

    def size(self) -> int:
        return len(self.low) + len(self.high) + len(self.samples)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes whole texts in ascending id order and writes the block files."""
    small_batches(docs.sparkSession)
    def blocks(batches):
        from pyspark import TaskContext

        part, seq, enc = TaskContext.get().partitionId(), 0, encoder(tokenizer)
        end = np.asarray([end_id], "<u4").tobytes()
        docs, ids, ends, n = [], [], [], 0

        def close():
            nonlocal seq, docs, ids, ends, n
            ef = EliasFano.of(np.asarray(ends, np.int64), n + 1)
            known = [i for i in docs if i is not None]
            base, last = (known[0], known[-1]) if known else (0, 0)
            own = EliasFano.of(np.asarray([i - base for i in known], np.uint64), last - base + 1)
            raw = np.frombuffer(b"".join(ids), "<u4")
            wide = bool(len(raw)) and int(raw.max()) > 0xFFFF
            row = [part, seq, len(docs), len(docs) - len(known), base, last, own.low_bits, own.low, own.high, own.samples]
            row += [n, wide, ef.low_bits, ef.low, ef.high, ef.samples, raw.astype("<u4" if wide else "<u2").tobytes()]
            seq, docs, ids, ends, n = seq + 1, [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, SCHEMA, strict=True)], schema=SCHEMA)

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = enc.encode(t.as_py()) + end
                if docs and (n + len(raw) // 4 > BLOCK_IDS or len(docs) >= BLOCK_DOCS):
                    yield close()
                docs.append(i)
                ids.append(raw)
                n += len(raw) // 4
                ends.append(n)
        if docs:
            yield close()

    d = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    n = int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(blocks, BLOCKS).write.option("compression", "zstd").parquet(path)


def starts(blocks: DataFrame) -> DataFrame:
    """``(part, seq, base)``: ids before each block. Sums per part first, so no task orders all blocks."""
    per_part = blocks.groupBy("part").agg(F.sum("n_ids").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return blocks.select("part", "seq", "n_ids").join(per_part.select("part", before.alias("_b")), "part").select(
        "part", "seq", (F.col("_b") + inside).cast("bigint").alias("base")
    )


READ = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, ids binary"


class OpenBlock:
    """One row of a file set, opened; documents are found by their place in it."""

    def __init__(self, row: dict):
        self.base, self.n, self.n_null, self.id_base = row["base"], row["n_docs"], row["n_null"], row["id_base"]
        self.names = EliasFano(self.n - self.n_null, row["id_bits"], row["id_low"], row["id_high"], row["id_samples"])
        self.ends = EliasFano(self.n, row["low_bits"], row["low"], row["high"], row["samples"])
        self.raw, self.wide = row["ids"], row["wide"]

    def name(self, k: int) -> int | None:
        return None if k < self.n_null else self.id_base + self.names.select(k - self.n_null)

    def places(self, doc_id: int) -> range:
        """Places of the documents with an id."""
        return range(self.n_null + self.names.find(doc_id - self.id_base), self.n_null + self.names.find(doc_id - self.id_base + 1))

    def row(self, k: int, begin: int | None = None) -> tuple:
        """``doc_id, start, n_tokens, ids_crc32, ids`` of the k-th document; ``begin`` is where the one before it ends, if known."""
        begin = (self.ends.select(k - 1) if k else 0) if begin is None else begin
        end, width = self.ends.select(k), 4 if self.wide else 2
        ids = self.raw[width * begin : width * end]
        if not self.wide:
            ids = np.frombuffer(ids, "<u2").astype("<u4").tobytes()
        return self.name(k), self.base + begin, end - begin, zlib.crc32(ids), ids


def based(blocks: DataFrame) -> DataFrame:
    """Blocks with their starts; these are a few bytes a block, so blocks themselves stay where they are read."""
    table = starts(blocks)
    if blocks.count() <= BROADCAST_BLOCKS:
        table = F.broadcast(table)
    return blocks.join(table, ["part", "seq"])


def _read_batch(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    names, types = zip(*(x.split() for x in READ.split(", ")), strict=True)
    cols = list(zip(*rows, strict=True)) or [[]] * len(names)
    if not with_ids:
        cols[-1] = [None] * len(rows)
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[t]) for c, t in zip(cols, types, strict=True)], names=list(names))


def read(spark, path: str, with_ids: bool = True) -> DataFrame:
    """One row per document from the files: its start over all files, length, crc32 and ids as little-endian 32-bit numbers."""
    blocks = spark.read.schema(BLOCKS).parquet(path)

    def rows(batches):
        for b in batches:
            for r in range(b.num_rows):
                block, begin, out = OpenBlock(b.slice(r, 1).to_pylist()[0]), 0, []
                for k in range(block.n):
                    out.append(block.row(k, begin))
                    begin += out[-1][2]
                yield _read_batch(out, with_ids)

    return based(blocks).mapInArrow(rows, READ)


def fetch(spark, path: str, doc_ids: list[int]) -> DataFrame:
    """As read, for the documents with these ids (up to some thousands): blocks whose id range holds none are pruned by their statistics."""
    wanted = sorted(set(doc_ids))
    blocks = spark.read.schema(BLOCKS).parquet(path)
    if wanted:
        picked = blocks.where((F.col("id_last") >= wanted[0]) & (F.col("id_base") <= wanted[-1]) & (F.col("n_docs") > F.col("n_null")))
    else:
        picked = blocks.limit(0)

    def rows(batches):
        for b in batches:
            for r in range(b.num_rows):
                block = OpenBlock(b.slice(r, 1).to_pylist()[0])
                yield _read_batch([block.row(k) for i in wanted for k in block.places(i)], True)

    table = starts(blocks)
    return picked.join(F.broadcast(table) if blocks.count() <= BROADCAST_BLOCKS else table, ["part", "seq"]).mapInArrow(rows, READ)


def tokenized(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Writes a file set in the shared folder and returns its documents without their ids."""
    path = shared_dir(docs.sparkSession, "token-files")
    write(docs, path, tokenizer, end_id)
    return read(docs.sparkSession, path, with_ids=False).drop("ids")
