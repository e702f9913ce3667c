"""A directory of immutable Parquet files and a manifest that names the live ones.

The manifest is one small JSON file per version, written under a temporary name and renamed, so a crash
leaves the last version whole and files that no manifest names are never read. All file access goes
through Hadoop's FileSystem, so any path Spark can reach works. One writer at a time: on a file system whose
rename refuses an existing name a second writer is found out, on an object store it is not. Readers hold a
version and keep seeing it until its files are dropped by ``release``.

Partitions tile the key space: each has a half-open range, and may hold no key. Compaction takes the ranges
that commits have touched and leaves the others' files alone; under a byte cap it lands some ranges at a
time. A partition remembers the commit up to which its range is merged, so commits that are not yet merged
everywhere are read beside it for the ranges where they are not.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from multirun.functions.bytesfn import width
from multirun.operators import aggregates, reads
from multirun.operators.merge import sorted_ranges
from multirun.operators.resolve import LOG_SCHEMA, resolve
from multirun.sources.segment import OrderError

#: Bytes of files per sorted range that seal and compaction aim at.
RANGE_BYTES = 128 << 20
#: A range's entry in the manifest: where its files are (none if it holds no key), its bounds and the least and greatest key in it,
#: and the commit up to which it is merged. Keys are hexadecimal; an open end is null.
EMPTY = {"path": None, "dict": None, "lo": "", "hi": None, "min": None, "max": None, "keys": 0, "bytes": 0, "seq": 0}


class Fs:
    """The few Hadoop file operations the store needs."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark.sparkContext._jvm
        self.path = self.jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, p: str) -> bool:
        return self.fs.exists(self.path(p))

    def mkdirs(self, p: str) -> None:
        self.fs.mkdirs(self.path(p))

    def names(self, p: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(p))) if self.exists(p) else []

    def write(self, p: str, text: str) -> None:
        tmp = f"{p}.{uuid.uuid4().hex}.tmp"
        out = self.fs.create(self.path(tmp), True)
        out.write(bytearray(text.encode()))
        out.close()
        if not self.fs.rename(self.path(tmp), self.path(p)):
            self.fs.delete(self.path(tmp), False)
            raise OSError(f"{p} exists: another writer committed first")

    def read(self, p: str) -> str:
        stream = self.fs.open(self.path(p))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def size(self, p: str) -> int:
        return self.fs.getContentSummary(self.path(p)).getLength()

    def delete(self, p: str) -> None:
        self.fs.delete(self.path(p), True)


@dataclass
class Manifest:
    version: int = 0
    seq: int = 0
    #: The compacted log up to here: deletes older than it are gone from the data.
    flushed: int = 0
    pieces: list[dict] = field(default_factory=list)
    partitions: list[dict] = field(default_factory=list)


class Txn:
    """A batch that is committed whole or, if dropped, leaves nothing."""

    def __init__(self, store: Store):
        self.store, self.ops = store, []

    def append(self, key: bytes, value: bytes) -> None:
        self.ops.append((bytes(key), "A", bytes(value)))

    def delete(self, key: bytes) -> None:
        self.ops.append((bytes(key), "D", None))

    def put(self, key: bytes, value: bytes) -> None:
        self.delete(key)
        self.append(key, value)

    def commit(self) -> int:
        seq = self.store._commit_ops(self.ops)
        self.ops = []
        return seq


class Store:
    def __init__(self, spark: SparkSession, root: str, manifest: Manifest):
        self.spark, self.root, self.m, self.fs = spark, root, manifest, Fs(spark, root)
        self.staged: list[tuple] = []

    @staticmethod
    def create(spark: SparkSession, root: str) -> Store:
        s = Store(spark, root, Manifest())
        if s.fs.names(f"{root}/manifest"):
            raise FileExistsError(f"{root} already holds a store")
        s.fs.mkdirs(f"{root}/manifest")
        s._publish(Manifest())
        return s

    @staticmethod
    def open(spark: SparkSession, root: str) -> Store:
        """The last committed version; files of an unfinished commit are ignored."""
        s = Store(spark, root, Manifest())
        found = [n for n in s.fs.names(f"{root}/manifest") if n.endswith(".json")]
        if not found:
            raise FileNotFoundError(f"{root} holds no store")
        s.m = Manifest(**json.loads(s.fs.read(f"{root}/manifest/{found[-1]}")))
        return s

    def _publish(self, m: Manifest) -> None:
        self.fs.write(f"{self.root}/manifest/{m.version:020d}.json", json.dumps(m.__dict__))
        self.m = m

    # --- writing

    def append(self, key: bytes, value: bytes) -> None:
        self.staged.append((bytes(key), "A", bytes(value)))

    def append_batch(self, pairs: list[tuple[bytes, bytes]]) -> None:
        self.staged += [(bytes(k), "A", bytes(v)) for k, v in pairs]

    def delete(self, key: bytes) -> None:
        self.staged.append((bytes(key), "D", None))

    def put(self, key: bytes, value: bytes) -> None:
        self.delete(key)
        self.append(key, value)

    def begin(self) -> Txn:
        return Txn(self)

    def commit(self) -> int:
        """Makes the staged operations durable as one commit; returns its number. A commit that fails leaves them staged."""
        n = len(self.staged)
        seq = self._commit_ops(self.staged[:n])
        del self.staged[:n]
        return seq

    def _frame(self, ops: list[tuple], seq: int) -> DataFrame:
        return self.spark.createDataFrame([(k, seq, i, op, v) for i, (k, op, v) in enumerate(ops)], LOG_SCHEMA)

    def _commit_ops(self, ops: list[tuple]) -> int:
        return self.commit_frame(self._frame(ops, self.m.seq + 1)) if ops else self.m.seq

    def commit_frame(self, ops: DataFrame, seq: int | None = None) -> int:
        """Commits a whole DataFrame of operations ``(key, idx, op, value)`` in one step.

        With ``seq`` given, a commit that is already in the manifest is not made again: this is what
        makes a stream's micro-batches idempotent.
        """
        if seq is not None and seq <= self.m.seq:
            return self.m.seq
        seq = self.m.seq + 1 if seq is None else seq
        path = f"{self.root}/log/{seq:020d}-{uuid.uuid4().hex[:8]}"
        ops.select("key", F.lit(seq).cast("bigint").alias("seq"), F.col("idx").cast("int").alias("idx"), "op", "value").write.parquet(path)
        m = Manifest(self.m.version + 1, seq, self.m.flushed, [*self.m.pieces, {"path": path, "lo_seq": seq, "hi_seq": seq}], self.m.partitions)
        self._publish(m)
        return seq

    def close(self) -> None:
        self.commit()

    # --- upkeep

    def _ranges(self, size: int) -> int:
        return max(1, math.ceil(size / RANGE_BYTES))

    def seal(self) -> None:
        """Rewrites the commits since the last seal as one piece sorted by key, in as many ranges as its bytes ask for."""
        fresh = [p for p in self.m.pieces if not p.get("sealed")]
        if not fresh:
            return
        path = f"{self.root}/piece/{self.m.version + 1:020d}-{uuid.uuid4().hex[:8]}"
        sorted_ranges(self._read(fresh), self._ranges(sum(self.fs.size(p["path"]) for p in fresh)), "seq", "idx").write.parquet(path)
        piece = {"path": path, "lo_seq": fresh[0]["lo_seq"], "hi_seq": fresh[-1]["hi_seq"], "sealed": True}
        self._publish(Manifest(self.m.version + 1, self.m.seq, self.m.flushed, [*(p for p in self.m.pieces if p.get("sealed")), piece], self.m.partitions))

    def _tiles(self) -> list[dict]:
        return self.m.partitions or [EMPTY | {"seq": self.m.flushed}]

    def _place(self, tiles: list[dict]) -> Column:
        """The tile that a key is in."""
        return F.lit(0) if len(tiles) == 1 else reduce(lambda c, i: c.when(F.col("key") < F.lit(bytes.fromhex(tiles[i]["hi"])), i), range(1, len(tiles) - 1), F.when(F.col("key") < F.lit(bytes.fromhex(tiles[0]["hi"])), 0)).otherwise(len(tiles) - 1)

    def flush(self, ranges: int | None = None, cap: int | None = None, promote: bool = True) -> dict:
        """Compaction of what commits have touched: each touched range is resolved into new files and drops what deletes hid.

        Ranges without operations keep their files. A sealed piece that meets no file and no other piece and deletes nothing
        becomes a partition by name (``promote``). With ``cap``, ranges land in turns of at most that many bytes, or one range;
        else all side by side. ``ranges`` fixes the number of files per turn. Returns how many ranges were rewritten,
        promoted and left, and the turns taken.
        """
        done = {"rewritten": 0, "promoted": 0, "left": 0, "turns": 0}
        if not self.m.pieces:
            return done | {"left": len(self.m.partitions)}
        tiles, pieces = self._tiles(), self.m.pieces
        log = reduce(DataFrame.unionByName, [self._read([p]).withColumn("_p", F.lit(i)) for i, p in enumerate(pieces)])
        # operations per range and piece: as many rows as the manifest has entries, squared at most
        met = self._unmerged(log).groupBy(self._place(tiles).alias("tile"), "_p").agg(
            F.count("*").alias("n"), F.sum((F.col("op") == "D").cast("int")).alias("deletes"), F.coalesce(F.sum(width("value")), F.lit(0)).alias("bytes"),
            F.min("key").alias("lo"), F.max("key").alias("hi"),
        ).collect()
        by_tile, by_piece = {}, {}
        for r in met:
            by_tile.setdefault(r.tile, []).append(r)
            by_piece.setdefault(r["_p"], []).append(r)
        out, work = [], []
        for k, t in enumerate(tiles):
            ops = by_tile.get(k, [])
            if not ops:
                out.append([t | {"seq": self.m.seq}])
                done["left"] += t["path"] is not None
            elif promote and len(ops) == 1 and len(by_piece[ops[0]["_p"]]) == 1 and (new := self._promoted(t, pieces[ops[0]["_p"]], ops[0])):
                out.append(new)
                done["promoted"] += 1
            else:
                out.append([t])
                work.append((k, t["bytes"] + sum(r.bytes for r in ops)))
        turns, size = [], 0
        for k, n in work:
            if not turns or (cap is not None and size + n > cap):
                turns.append([])
                size = 0
            turns[-1].append((k, n))
            size += n
        for turn in turns or [[]]:
            if turn:
                landed = self._land(tiles, [k for k, _ in turn], ranges or self._ranges(sum(n for _, n in turn)))
                for k, _ in turn:
                    out[k] = landed[k]
            parts = [p for group in out for p in group]
            merged = min(p["seq"] for p in parts)
            self._publish(Manifest(self.m.version + 1, self.m.seq, merged, [p for p in self.m.pieces if p["hi_seq"] > merged], parts))
            done["turns"] += bool(turn)
        return done | {"rewritten": len(work)}

    def _promoted(self, tile: dict, piece: dict, met) -> list[dict] | None:
        """A range's new entries if a piece can stand in it as it is: sorted, without deletes, beside the keys that are there."""
        if not piece.get("sealed") or met.deletes:
            return None
        lo, hi = bytes(met.lo).hex(), bytes(met.hi).hex()
        if tile["path"] is not None and not (bytes.fromhex(tile["max"]) < met.lo or met.hi < bytes.fromhex(tile["min"])):
            return None
        # the piece's values are not read again; its dictionary is
        dpath = f"{self.root}/dict/{self.m.version + 1:020d}-{uuid.uuid4().hex[:8]}"
        aggregates.dictionary(self._read([piece])).sortWithinPartitions("key").write.parquet(dpath)
        keys = self.spark.read.parquet(dpath).count()
        new = EMPTY | {"path": piece["path"], "dict": dpath, "min": lo, "max": hi, "keys": keys, "bytes": met.bytes, "seq": self.m.seq}
        if tile["path"] is None:
            return [new | {"lo": tile["lo"], "hi": tile["hi"]}]
        if bytes.fromhex(tile["max"]) < met.lo:
            return [tile | {"hi": lo, "seq": self.m.seq}, new | {"lo": lo, "hi": tile["hi"]}]
        return [new | {"lo": tile["lo"], "hi": tile["min"]}, tile | {"lo": tile["min"], "seq": self.m.seq}]

    def _land(self, every: list[dict], picked: list[int], ranges: int) -> dict[int, list[dict]]:
        """Resolves ranges side by side into new files; a file stays inside its range. The dictionary table stands beside the values, so that counting reads none."""
        stem = f"{self.m.version + 1:020d}-{uuid.uuid4().hex[:8]}"
        path, dpath = f"{self.root}/part/{stem}", f"{self.root}/dict/{stem}"
        tiles = [(k, every[k]) for k in picked]
        frames = [self._unmerged(self._read(self.m.pieces))]
        if files := [t["path"] for _, t in tiles if t["path"]]:
            frames.append(self._data(files))
        inside = reduce(lambda a, b: a | b, [self._within(t) for _, t in tiles])
        live = resolve(reduce(DataFrame.unionByName, frames).where(inside)).withColumn("_r", self._place(every))
        live.repartitionByRange(ranges, "_r", "key").sortWithinPartitions("_r", "key", "seq", "idx").write.partitionBy("_r").parquet(path)
        landed: dict[int, list[dict]] = {k: [] for k, _ in tiles}
        if any(n.startswith("_r=") for n in self.fs.names(path)):
            # one more pass over what was written gives the dictionary, with the file of each key; files' facts come from it
            d = aggregates.dictionary(self.spark.read.parquet(path).withColumn("_f", F.col("_metadata.file_path")), "_r", "_f")
            d.sortWithinPartitions("key").write.parquet(dpath)
            facts = self.spark.read.parquet(dpath).groupBy("_r", "_f").agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.count("*").alias("keys"), F.sum("value_bytes").alias("bytes"))
            for r in facts.orderBy("lo").toLocalIterator():
                landed[r["_r"]].append(EMPTY | {"path": r["_f"], "dict": dpath, "min": bytes(r.lo).hex(), "max": bytes(r.hi).hex(), "keys": r.keys, "bytes": r.bytes})
        for k, t in tiles:
            # files tile the range they came from; one that lost all its keys stays as an empty range
            own = landed[k] or [dict(EMPTY)]
            for i, p in enumerate(own):
                p |= {"lo": p["min"] if i else t["lo"], "hi": own[i + 1]["min"] if i + 1 < len(own) else t["hi"], "seq": self.m.seq}
            landed[k] = own
        return landed

    def settle(self) -> dict:
        """Finishes all merging; nothing is sealed first, since that would write the same rows once more."""
        return self.flush()

    def write_ordered(self, rows: DataFrame) -> int:
        """Ordered ingest: rows ``(key, idx, value)`` above every present key go straight into a partition at the end; others are refused."""
        seq = self.m.seq + 1
        path = f"{self.root}/part/{self.m.version + 1:020d}-{uuid.uuid4().hex[:8]}"
        new = rows.select("key", F.lit(seq).cast("bigint").alias("seq"), F.col("idx").cast("int").alias("idx"), "value")
        sorted_ranges(new, max(1, self.spark.sparkContext.defaultParallelism), "seq", "idx").write.parquet(path)
        dpath = path.replace("/part/", "/dict/")
        aggregates.dictionary(self.spark.read.parquet(path)).sortWithinPartitions("key").write.parquet(dpath)
        got = self.spark.read.parquet(dpath).agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.count("*").alias("n"), F.sum("value_bytes").alias("bytes")).collect()[0]
        if not got.n:
            return self.m.seq
        tops = [bytes.fromhex(p["max"]) for p in self.m.partitions if p["max"] is not None]
        if self.m.pieces:
            top = self._read(self.m.pieces).agg(F.max("key").alias("k")).collect()[0].k
            tops += [bytes(top)] if top is not None else []
        if tops and bytes(got.lo) <= max(tops):
            self.fs.delete(path)
            self.fs.delete(dpath)
            raise OrderError("keys must stand above every present key")
        lo = bytes(got.lo).hex()
        *head, last = self._tiles()
        part = EMPTY | {"path": path, "dict": dpath, "lo": lo, "min": lo, "max": bytes(got.hi).hex(), "keys": got.n, "bytes": got.bytes, "seq": seq}
        # an open range in front may have commits to merge; it keeps its own mark
        parts = [*head, last | {"hi": lo}, part] if last["lo"] < lo else [*head, part]
        self._publish(Manifest(self.m.version + 1, seq, self.m.flushed, self.m.pieces, parts))
        return seq

    # --- reading

    def _read(self, pieces: list[dict]) -> DataFrame:
        return self.spark.read.schema(LOG_SCHEMA).parquet(*[p["path"] for p in pieces])

    def _data(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema("key binary, seq bigint, idx int, value binary").parquet(*paths).select("key", "seq", "idx", F.lit("A").alias("op"), "value")

    @staticmethod
    def _within(tile: dict) -> Column:
        return reads.in_range(bytes.fromhex(tile["lo"]), None if tile["hi"] is None else bytes.fromhex(tile["hi"]))

    def _unmerged(self, log: DataFrame) -> DataFrame:
        """Operations that their key's partition has not taken in yet."""
        first = min((p["lo_seq"] for p in self.m.pieces), default=0)
        ahead = [p for p in self.m.partitions if p["seq"] >= first]
        return reduce(lambda df, p: df.where(~self._within(p) | (F.col("seq") > p["seq"])), ahead, log)

    def _parts(self, lo: bytes | None = None, hi: bytes | None = None) -> list[dict]:
        """Partitions whose keys' bounds meet ``[lo, hi)``: pruned before any footer is read."""
        return [
            p for p in self.m.partitions
            if p["path"] and (lo is None or bytes.fromhex(p["max"]) >= lo) and (hi is None or bytes.fromhex(p["min"]) < hi)
        ]

    def log(self, lo: bytes | None = None, hi: bytes | None = None) -> DataFrame:
        """Partitions as old appends, then what pieces hold beyond them."""
        frames = []
        if parts := self._parts(lo, hi):
            frames.append(self._data([p["path"] for p in parts]))
        if self.m.pieces:
            frames.append(self._unmerged(self._read(self.m.pieces)))
        df = reduce(DataFrame.unionByName, frames) if frames else self.spark.createDataFrame([], LOG_SCHEMA)
        return df if lo is None and hi is None else df.where(reads.in_range(lo or b"", hi))

    def live(self, snapshot: int | None = None, dirty: bool = False, lo: bytes | None = None, hi: bytes | None = None) -> DataFrame:
        """Live rows at the latest commit, at a snapshot's commit, or with the staged batch laid over."""
        staged = self._frame(self.staged, self.m.seq + 1) if dirty and self.staged else None
        if staged is not None and (lo is not None or hi is not None):
            staged = staged.where(reads.in_range(lo or b"", hi))
        return resolve(self.log(lo, hi), snapshot, staged)

    def _stored_dictionary(self, parts: list[dict]) -> DataFrame | None:
        """Dictionary rows of partitions: each table is read for the ranges that still name it."""
        by_path: dict[str, list[dict]] = {}
        for p in parts:
            if p["dict"]:
                by_path.setdefault(p["dict"], []).append(p)
        frames = [
            self.spark.read.parquet(d).where(reduce(lambda a, b: a | b, [self._within(p) for p in own])).select("key", "n", "stored_bytes", "width", "value_bytes")
            for d, own in by_path.items()
        ]
        return reduce(DataFrame.unionByName, frames) if frames else None

    def dictionary(self) -> DataFrame:
        """From the dictionary tables; only keys that unmerged commits name are counted from their values."""
        kept = self._stored_dictionary(self.m.partitions)
        if not self.m.pieces:
            return kept if kept is not None else aggregates.dictionary(self.live())
        touched = self._unmerged(self._read(self.m.pieces)).select("key").distinct()
        over = aggregates.dictionary(resolve(self.log().join(touched, "key", "left_semi")))
        return over if kept is None else kept.join(touched, "key", "left_anti").unionByName(over)

    def record_at(self, rank: int) -> DataFrame:
        """The dictionary's row at an ordinal of key order, empty past the end.

        Once all is merged, counts in the manifest say which range holds it, and only that range's dictionary is ordered.
        """
        if self.m.pieces:
            return reads.record_at(self.dictionary(), rank)
        for p in self.m.partitions:
            if rank < p["keys"]:
                return reads.record_at(self._stored_dictionary([p]), rank)
            rank -= p["keys"]
        return self.dictionary().limit(0)

    def read_all(self, key: bytes, **at) -> DataFrame:
        return reads.point_read(self.live(lo=key, hi=key + b"\0", **at), key)

    def snapshot(self) -> SnapshotView:
        """Holds the present version; its files stay until it is released."""
        return SnapshotView(self)

    def facts(self) -> dict:
        """From the manifest and file listing alone: nothing is read."""
        dicts = {p["dict"] for p in self.m.partitions if p["dict"]}
        files = [p["path"] for p in self.m.partitions if p["path"]]
        return {
            "version": self.m.version, "seq": self.m.seq, "generation": self.m.flushed, "pieces": len(self.m.pieces), "partitions": len(self.m.partitions),
            "empty": sum(p["path"] is None for p in self.m.partitions), "blocks": len(files), "keys": sum(p["keys"] for p in self.m.partitions),
            "payload": sum(p["bytes"] for p in self.m.partitions), "index_bytes": sum(self.fs.size(d) for d in dicts), "file_bytes": sum(self.fs.size(f) for f in files),
        }

    def collect_garbage(self) -> list[str]:
        """Deletes data folders that neither the present manifest nor a held snapshot names."""
        held = json.dumps([self.m.__dict__, *(v.m.__dict__ for v in self._views if not v.released)])
        gone = []
        for kind in ("log", "piece", "part", "dict"):
            for n in self.fs.names(f"{self.root}/{kind}"):
                if f"/{kind}/{n}" not in held:
                    self.fs.delete(f"{self.root}/{kind}/{n}")
                    gone.append(n)
        return gone

    @property
    def _views(self) -> list[SnapshotView]:
        return self.__dict__.setdefault("views", [])


class SnapshotView:
    """A frozen view: reads through the manifest it was taken with, so later merges do not change it."""

    def __init__(self, store: Store):
        self.m, self.released = store.m, False
        self.reader = Store(store.spark, store.root, store.m)
        store._views.append(self)

    def live(self, **at) -> DataFrame:
        if self.released:
            raise ValueError("the snapshot was released")
        return self.reader.live(**at)

    def release(self) -> None:
        self.released = True
