"""N-gram Jaccard self-join through a MinHash LSH forest, with exact verification.

A document's set is its distinct runs of five words (all its words if fewer). Documents of equal sets form
one class with a representative, counted before anything is joined, so copies cost one row each.

Every tree of the forest holds each representative's label, a sequence of LABEL MinHash values, in sorted
order, so that labels with a common prefix stand together: a trie, laid out flat. Matching begins with whole
labels and shortens prefixes, one value at a time and one tree after another, until a pair at the threshold
meets in some tree with the target probability (``depths``): at 0.8 most trees stop at six values and as few
as needed at five. A representative whose label shares no such prefix with its neighbours in sorted order
leaves that tree; the others' subtries are nodes. Sets too small to have a partner of another content at the
threshold enter no tree.

A node is covered by leaders, in the order of its labels, deep matches first: a document is linked to every
leader whose sketch is near (``near_link``), and becomes one if none is very near (``NEAR_COVER``). By the
triangle inequality of the Jaccard distance two documents at the threshold then share a leader, while a node of
thousands of near copies has few leaders and as many links as documents, not pairs.

Candidate pairs, those that share a leader, are verified exactly on their sets. Links join documents into
families (connected components). A family is verified as a whole, or, where that compares fewer pairs, by the
groups of its leaders, each pair in the group of the least leader that both have; so a long chain of near
documents costs what its groups cost. Groups are cut into blocks of a bounded number of documents, a task gets
two blocks, and counts its pairs inside arrays. No pair is written as a row.

Cases: a null or empty text, or one without words, has no set, is its own class and has no links; where an
id is null or repeats, rows are numbered, every row is a document of its own and a class is named by the id
of its first row; sets are compared, so the order of shingles does not matter; an empty table gives no rows;
a threshold too low for the trees to meet the target at any depth (under 0.27), or over 1, is an error.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from multirun.llm.common import LOWER, fresh, mix, prefix_hash, row_keys, small_batches, span_hash, stored, text_groups, token_spans

WORDS, THRESHOLD = 5, 0.8
TREES, LABEL = 20, 8
#: Probability that a pair at the threshold meets in some tree.
RECALL = 0.998
#: MinHash values in a sketch, kept as a byte each; the first TREES * LABEL make the labels.
SKETCH = 128
#: Estimated similarity at which a leader covers a document, and what two estimates may err together (2.3 deviations).
NEAR_COVER, SLACK = 0.8, 0.13
#: Documents in a block of a family, and shingles, about.
BLOCK, BLOCK_SHINGLES = 512, 1 << 20

_RNG = np.random.default_rng(8)
N_HASH = max(SKETCH, TREES * LABEL)
XOR = _RNG.integers(0, 1 << 32, N_HASH, dtype=np.uint32)
MUL = _RNG.integers(0, 1 << 31, N_HASH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def depths(threshold: float = THRESHOLD, recall: float = RECALL, trees: int = TREES, label: int = LABEL) -> list[int]:
    """Length of the prefix that counts as a match in each tree.

    All begin at the whole label; prefixes are shortened by one value, tree after tree, until pairs at the
    threshold meet in some tree often enough.
    """
    if not 0 < threshold <= 1:
        raise ValueError(f"no Jaccard threshold: {threshold}")
    out = [label] * trees
    for k in range(label, 0, -1):
        for t in range(trees):
            out[t] = k
            if 1 - math.prod(1 - threshold**d for d in out) >= recall:
                return out
    raise ValueError(f"{trees} trees do not find pairs at {threshold} with probability {recall}")


def near_link(threshold: float = THRESHOLD) -> float:
    """Estimated similarity with a leader that no document falls below which is at the threshold with one it covers."""
    return threshold + NEAR_COVER - 1 - SLACK


def shingles(data: np.ndarray, off: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each row."""
    low = LOWER[data]
    starts, ends, cut = token_spans(low, off)
    h = span_hash(prefix_hash(low), starts, ends)
    run = np.zeros(len(h), np.uint64)
    for k in range(words):
        n = len(h) - k
        if n > 0:
            run[:n] += h[k:] * np.uint64(2 * k * 0x9E3779B97F4A7C15 + 1 & (1 << 64) - 1)
    run = mix(run)
    out = []
    for a, z in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        if z - a >= words:
            out.append(np.unique(run[a : z - words + 1]))
        elif z > a:
            s = np.uint64(z - a)
            with np.errstate(over="ignore"):
                for x in h[a:z]:
                    s = mix(np.asarray([s * np.uint64(0x9E3779B97F4A7C15) + x]))[0]
            out.append(np.asarray([s], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_key(s: np.ndarray) -> bytes:
    """128 bits that name a set."""
    with np.errstate(over="ignore"):
        a = mix(s).sum(dtype=np.uint64), mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
    return np.asarray([*a], "<u8").tobytes() + len(s).to_bytes(4, "little")


def minhash(sets: list[np.ndarray], n: int = N_HASH) -> np.ndarray:
    """(rows, n) minima; sets must not be empty."""
    x = np.concatenate(sets).astype(np.uint32) if sets else np.zeros(0, np.uint32)
    cut = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]]).astype(np.int64)
    out = np.empty((len(sets), n), np.uint32)
    step = np.empty(len(x), np.uint32)
    for i in range(n):
        np.bitwise_xor(x, XOR[i], out=step)
        np.multiply(step, MUL[i], out=step)
        out[:, i] = np.minimum.reduceat(step, cut) if len(sets) else 0
    return out


SETS = "doc_id bigint, key binary, n bigint, labels array<binary>, sketch binary"


def labels_of(mins: np.ndarray) -> np.ndarray:
    """(rows, trees) labels as bytes, 16 bits a value, of which byte order is the tries' order."""
    spread = (mins[:, : TREES * LABEL] * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(">u2")
    return np.ascontiguousarray(spread).view(np.dtype((np.void, 2 * LABEL))).reshape(len(mins), TREES)


def signatures(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """One row per document: the key of its set, its labels and its sketch; null and no labels where there is no set."""

    def f(batches):
        for b, data, off in text_groups(batches):
            sets = shingles(data, off, words)
            full = [i for i, s in enumerate(sets) if len(s)]
            mins = minhash([sets[i] for i in full])
            keys, sketches, sizes = ([None] * len(sets) for _ in range(3))
            sk = (mins[:, :SKETCH] * np.uint32(0x85EBCA6B) >> np.uint32(24)).astype(np.uint8)
            for r, i in enumerate(full):
                keys[i], sketches[i], sizes[i] = set_key(sets[i]), sk[r].tobytes(), len(sets[i])
            flat = pa.py_buffer(labels_of(mins).tobytes())
            values = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * LABEL), len(full) * TREES, [None, flat]).cast(pa.binary())
            ends = np.cumsum([0] + [TREES * (len(s) > 0) for s in sets]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(ends, values), pa.array(sketches, pa.binary())], names=["doc_id", "key", "n", "labels", "sketch"]
            )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(f, SETS)


def agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity of every row of one sketch matrix with every row of another; a byte agrees by chance once in 256."""
    out = np.empty((len(a), len(b)))
    for i in range(0, len(a), 64):
        out[i : i + 64] = (a[i : i + 64, None, :] == b[None, :, :]).mean(axis=2)
    return (out - 1 / 256) / (1 - 1 / 256)


def spanning(links: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """As many links as join the same ids: each id to the least one it is linked with."""
    parent: dict[int, int] = {}

    def top(k: int) -> int:
        while parent.setdefault(k, k) != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for a, b in links:
        a, b = top(a), top(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [(k, top(k)) for k in parent if top(k) != k]


class Leaders:
    """Covers one node by leaders, a chunk of rows at a time; links are (row, leader), a leader's own among them."""

    def __init__(self, threshold: float = THRESHOLD):
        self.ids, self.sketches, self.link = [], [], near_link(threshold)
        #: Rows that each leader leads, itself among them.
        self.size: Counter = Counter()

    def take(self, ids: np.ndarray, sketches: np.ndarray) -> list[tuple[int, int]]:
        links = []
        for i in range(0, len(ids), 256):
            part, own = sketches[i : i + 256], ids[i : i + 256]
            est = agree(part, np.asarray(self.sketches)) if self.ids else np.zeros((len(part), 0))
            covered = (est >= NEAR_COVER).any(axis=1)
            for r, c in zip(*np.nonzero(est >= self.link), strict=True):
                links.append((int(own[r]), self.ids[c]))
            while not covered.all():
                r = int(np.argmin(covered))
                e = agree(part, part[r : r + 1])[:, 0]
                near = e >= self.link
                near[r] = False
                links += [(int(x), int(own[r])) for x in own[near]]
                covered |= e >= NEAR_COVER
                covered[r] = True
                links.append((int(own[r]), int(own[r])))
                self.ids.append(int(own[r]))
                self.sketches.append(part[r])
        self.size.update(b for _, b in links)
        return links


MATCHED = "node bigint, label binary, rep bigint"


def _matched(batches):
    """Rows sorted by node less those that are alone in theirs."""
    held = None  # the last row so far, and whether it has company

    def out(t: pa.Table, kept: np.ndarray):
        return [pa.RecordBatch.from_arrays([c.combine_chunks() for c in p.columns], names=t.schema.names) for p in [t.filter(pa.array(kept))]]

    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        node = b.column(0).to_numpy()
        same = node[1:] == node[:-1]
        kept = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        if held is not None:
            kept[0] |= node[0] == held[0].column(0)[0].as_py()
            yield from out(held[0], np.asarray([held[1] or bool(node[0] == held[0].column(0)[0].as_py())]))
        yield from out(t.slice(0, t.num_rows - 1), kept[:-1])
        held = t.slice(t.num_rows - 1), bool(kept[-1])
    if held is not None:
        yield from out(*held[:1], np.asarray([held[1]]))


LINKS = "a bigint, b bigint, g bigint"


def forest_links(reps: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, every: bool = False) -> DataFrame:
    """What the forest's nodes say of representatives, in as many rows as these have nodes.

    Rows ``(a, b, 0)`` are links that join what shares a leader; rows ``(a, a, g)`` say that ``a`` leads ``g`` rows of a
    node, itself among them. With ``every``, all pairs of a row and a leader are given as ``(row, leader, 1)`` instead.
    """
    long = F.array(*(F.lit(2 * k) for k in depths(threshold, recall)))
    rows = reps.select("rep", F.posexplode("labels").alias("tree", "label"))
    node = F.xxhash64("tree", F.substring(F.col("label"), F.lit(1), F.element_at(long, F.col("tree") + 1)))
    n = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select(node.alias("node"), "label", "rep").repartition(n, "node").sortWithinPartitions("node", "label", "rep")
    # only rows with company carry sketches
    rows = rows.mapInArrow(_matched, MATCHED).join(reps.select("rep", "sketch"), "rep").select("rep", "sketch", "node", "label")
    rows = rows.repartition(n, "node").sortWithinPartitions("node", "label", "rep")

    def f(batches):
        fresh("text")
        node, group = None, Leaders(threshold)
        waiting: tuple[list, list] = ([], [])
        counts: list[tuple] = []

        def flush():
            ids, sk = waiting
            links = group.take(np.asarray(ids), np.asarray(sk)) if len(ids) > 1 or group.ids else []
            ids.clear()
            sk.clear()
            return links

        def out(links):
            if every:
                rows = [(a, b, 1) for a, b in set(links)]
            else:
                rows = [(a, b, 0) for a, b in spanning(links)] + counts
                counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in list(zip(*rows, strict=True)) or [[]] * 3], names=["a", "b", "g"])

        for b in batches:
            own, ids = b.column(2).to_numpy(), b.column(0).to_numpy()
            sk = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(-1, SKETCH)
            links: list = []
            cut = np.flatnonzero(np.diff(own)) + 1
            for i, j in zip(np.concatenate([[0], cut]), np.concatenate([cut, [len(own)]]), strict=True):
                if i == j:
                    continue
                if own[i] != node:
                    links += flush()
                    counts += [(b, b, n) for b, n in group.size.items()]
                    node, group = own[i], Leaders(threshold)
                waiting[0].extend(ids[i:j].tolist())
                waiting[1].extend(sk[i:j])
                if len(waiting[0]) >= 4096:
                    links += flush()
            if links or (counts and not every):
                yield out(links)
        links = flush()
        counts += [(b, b, n) for b, n in group.size.items()]
        yield out(links)

    return rows.mapInArrow(f, LINKS)


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(id, root)`` for every id in a stored table of links: the least id it can reach.

    Each round every id takes the least id known around it and then its root's root, so trees halve in
    height. Each round's table is written out; the next reads it, so a lost executor costs one round.
    """
    both = links.select(F.col("a").alias("id"), F.col("b").alias("o")).unionByName(links.select(F.col("b").alias("id"), F.col("a").alias("o")))
    state = stored(both.groupBy("id").agg(F.least("id", F.min("o")).alias("root")), "roots")
    for _ in range(max_rounds):
        # roots seen over links, sent to the id and to its present root
        near = both.join(state.select(F.col("id").alias("o"), F.col("root").alias("seen")), "o").groupBy("id").agg(F.min("seen").alias("seen"))
        s = state.join(near, "id", "left").select("id", F.col("root").alias("old"), F.least("root", "seen").alias("root"))
        hook = s.where("root < old").groupBy(F.col("old").alias("id")).agg(F.min("root").alias("hook"))
        s = s.join(hook, "id", "left").select("id", "old", F.least("root", "hook").alias("root"))
        up = s.select(F.col("id").alias("root"), F.col("root").alias("up"))
        s = stored(s.join(up, "root", "left").select("id", "old", F.least("root", "up").alias("root")), "roots")
        state = s.select("id", "root")
        if s.where("root <> old").isEmpty():
            return state
    raise RuntimeError("components did not settle")


def _pairs(a: list[np.ndarray], b: list[np.ndarray] | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs with exact Jaccard at or above the threshold: all of one block, or across two."""
    every = a + (b or [])
    sizes = np.asarray([len(s) for s in every], np.int64)
    flat = np.concatenate(every)
    row = np.repeat(np.arange(len(every)), sizes)
    values, code = np.unique(flat, return_inverse=True)
    common = np.bincount(code)[code] > 1
    row, code = row[common], code[common]
    used = np.unique(code)
    code = np.searchsorted(used, code)
    n = len(a)
    m = len(every) - n if b is not None else n
    inter = np.zeros((n, m), np.float32)
    order = np.argsort(code, kind="stable")
    row, code = row[order], code[order]
    for c in range(0, len(used), 4096):
        i, j = np.searchsorted(code, [c, c + 4096])
        x = np.zeros((len(every), min(4096, len(used) - c)), np.float32)
        x[row[i:j], code[i:j] - c] = 1
        inter += x[:n] @ (x[n:] if b is not None else x).T
    union = sizes[:n, None] + (sizes[n:] if b is not None else sizes)[None, :] - inter
    hit = inter >= threshold * union - 1e-4
    if b is None:
        hit &= np.tri(n, k=-1, dtype=bool)
    return np.nonzero(hit)


def families(reps: DataFrame, found: DataFrame, roots: DataFrame, weights: DataFrame, threshold: float) -> DataFrame:
    """Groups to be verified, ``(root, rep, weight, n, leaders)``: whole families, or a family's leaders' groups where these compare fewer pairs.

    ``leaders`` is null for a whole family; else a pair belongs to the group of the least leader that both have. Only
    families taken apart are asked for every row's leaders, by another covering of their own nodes. Which way is
    cheaper is estimated (a leader's group as twice its largest node); both give every link.
    """
    placed = roots.select(F.col("id").alias("rep"), "root").join(weights, "rep")
    sizes = placed.groupBy("root").agg(F.count("*").cast("double").alias("size"))
    stars = found.where("a = b").groupBy(F.col("a").alias("id")).agg((2 * F.max("g")).cast("double").alias("g")).join(roots, "id")
    stars = stars.groupBy("root").agg(F.sum(F.col("g") * F.col("g")).alias("star"))
    apart = stored(sizes.join(stars, "root").where((F.col("size") > BLOCK) & (F.col("star") < F.col("size") * F.col("size"))).select("root"), "apart")
    whole = placed.select("root", "rep", "weight", "n", F.lit(None).cast("array<bigint>").alias("leaders"))
    if apart.isEmpty():
        return whole
    parted = placed.join(apart, "root", "left_semi").select("rep", "weight", "n")
    own = stored(forest_links(reps.join(parted, "rep", "left_semi"), threshold, every=True), "leaders")
    lists = own.groupBy(F.col("a").alias("rep")).agg(F.sort_array(F.collect_set("b")).alias("leaders"))
    parted = parted.join(lists, "rep").select(F.explode("leaders").alias("root"), "rep", "weight", "n", "leaders")
    return whole.join(apart, "root", "left_anti").unionByName(parted)


def elsewhere(leaders: list, group: int) -> np.ndarray:
    """Which pairs of rows have a common leader below this group's: they are counted there."""
    below = sorted({x for own in leaders for x in own if x < group})
    number = {x: k for k, x in enumerate(below)}
    has = np.zeros((len(leaders), len(below)), np.float32)
    for r, own in enumerate(leaders):
        has[r, [number[x] for x in own if x < group]] = 1
    return has @ has.T > 0


def verify(family: DataFrame, docs: DataFrame, threshold: float, words: int) -> DataFrame:
    """Exact links inside groups, as ``(rep, root, links)`` sums and spanning links ``(rep, to)``.

    ``family`` is as ``families`` gives it: weight is documents in the class, n shingles.
    """
    # a row's block by its hash inside its group: bounded blocks, of which a task holds two
    n_blocks = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("volume") / BLOCK_SHINGLES)).cast("int")
    sized = family.join(family.groupBy("root").agg(F.count("*").alias("size"), F.sum("n").alias("volume")), "root")
    sized = sized.withColumn("nb", n_blocks).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int"))

    def sets(batches):
        for b, data, off in text_groups(batches):
            out = [s.view(np.int64) for s in shingles(data, off, words)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.int64()))], names=["rep", "set"])

    texts = docs.select(F.col("doc_id").alias("rep"), "text").join(family.select("rep").distinct(), "rep", "left_semi")
    held = texts.mapInArrow(sets, "rep bigint, set array<bigint>").join(sized, "rep")
    # block i meets every block j >= i: a row goes to one task per block of its group
    tiles = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda j: F.struct(F.least("block", j).alias("i"), F.greatest("block", j).alias("j")))
    held = held.select("rep", "root", "weight", "set", "leaders", "block", F.explode(tiles).alias("t")).select("rep", "root", "weight", "set", "leaders", "block", "t.i", "t.j")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        fresh("pairs")
        i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
        pdf = pdf.sort_values("rep").reset_index(drop=True)
        own = np.flatnonzero((pdf["block"] == i).to_numpy())
        other = np.flatnonzero((pdf["block"] == j).to_numpy()) if i != j else None
        arrays = [np.asarray(s, np.int64) for s in pdf["set"]]
        rep, weight = pdf["rep"].to_numpy(), pdf["weight"].to_numpy()
        links, parent = np.zeros(len(pdf), np.int64), np.arange(len(pdf))
        if len(own) and (other is None or len(other)):
            x, y = _pairs([arrays[k] for k in own], None if other is None else [arrays[k] for k in other], threshold)
            x, y = own[x], (own if other is None else other)[y]
            if pdf["leaders"].iloc[0] is not None:
                here = ~elsewhere([*pdf["leaders"]], int(pdf["root"].iloc[0]))[x, y]
                x, y = x[here], y[here]
            np.add.at(links, x, weight[y])
            np.add.at(links, y, weight[x])

            def top(k):
                while parent[k] != k:
                    parent[k] = parent[parent[k]]
                    k = parent[k]
                return k

            for k, m in zip(x.tolist(), y.tolist(), strict=True):
                k, m = top(k), top(m)
                if k != m:
                    parent[max(k, m)] = min(k, m)
            for k in range(len(parent)):
                parent[k] = top(k)
        return pd.DataFrame({"rep": rep, "links": links, "to": rep[parent]})

    return held.groupBy("root", "i", "j").applyInPandas(one, "rep bigint, links bigint, to bigint")


def join(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS) -> DataFrame:
    """One row per document: ``doc_id, class_id`` (least id of the group linked to it), ``set_id`` (least id
    with an equal set) and ``n_links`` (other documents at or above the threshold)."""
    rows, odd = row_keys(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), "_row")
    out = linked(rows.select(F.col("_row").alias("doc_id"), "text"), threshold, words)
    if not odd:
        return out
    for c in ("doc_id", "class_id", "set_id"):
        out = out.join(rows.select(F.col("_row").alias(c), F.col("doc_id").alias(f"_{c}")), c).drop(c).withColumnRenamed(f"_{c}", c)
    return out.select("doc_id", "class_id", "set_id", "n_links")


def linked(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS) -> DataFrame:
    """As join, for unique ids without nulls."""
    small_batches(docs.sparkSession)
    depths(threshold)
    sig = stored(signatures(docs, words), "signatures")
    keyed = sig.where("key is not null")
    # stored, so that a large class meets its row in a join of plain exchanges, which can be split
    classes = stored(keyed.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("weight"), F.first("n").alias("n")), "classes")
    member = stored(keyed.select("doc_id", "key").join(classes, "key").select("doc_id", "rep", "weight", "n"), "members")
    weights = classes.select("rep", "weight", "n")
    # two sets of which the smaller has n differ by one at least
    able = weights.where(F.col("n") / (F.col("n") + 1) >= threshold - 1e-9).select(F.col("rep").alias("doc_id"))
    reps = keyed.join(able, "doc_id", "left_semi").select(F.col("doc_id").alias("rep"), "labels", "sketch")
    met = stored(forest_links(reps, threshold), "met")
    links = stored(met.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    family = stored(families(reps, met, components(links), weights, threshold), "family")
    found = stored(verify(family, docs, threshold, words), "verified")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = components(stored(found.where("rep <> to").select(F.least("rep", "to").alias("a"), F.greatest("rep", "to").alias("b")).distinct(), "links"))
    # stored, so that members of a large class are joined from plain exchanges, which can be split
    info = stored(links.join(groups.select(F.col("id").alias("rep"), F.col("root").alias("g")), "rep", "left"), "info")
    out = member.join(info, "rep", "left").select(
        "doc_id", F.coalesce("g", "rep").alias("class_id"), F.col("rep").alias("set_id"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).cast("bigint").alias("n_links")
    )
    alone = sig.where("key is null").select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("set_id"), F.lit(0).cast("bigint").alias("n_links"))
    return out.unionByName(alone)
