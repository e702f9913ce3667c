"""Gradient-boosted trees: fitted on all labelled rows, applied as a column expression.

The rows are reduced in Spark to distinct vectors of small integers with their labels' counts. That table stays
in Spark: each level of a tree is grown from sums by leaf, feature and value. The result is nested CASE
expressions, so scoring is plain SQL.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from multirun.llm.common import stored

TREES, DEPTH, RATE, LEAST_WEIGHT = 16, 3, 0.4, 5.0
#: Gradients are summed as whole numbers of this part of one, up to some 10**11 rows; beyond, Spark's sums raise an error.
ONE = 1 << 26
#: Rows of a table of vectors up to which it goes to the driver (about 100 bytes each); a longer one stays in Spark, whole as well.
HELD_VECTORS = 50_000


@dataclass
class Node:
    value: float = 0.0
    feature: str | None = None
    #: Rows with ``feature <= cut`` go left.
    cut: int = 0
    left: Node | None = None
    right: Node | None = None


@dataclass
class Boosted:
    base: float
    trees: list[Node]
    #: Score at or above which a row counts as positive, by group.
    thresholds: dict = field(default_factory=dict)

    def column(self, features: dict[str, Column]) -> Column:
        """The raw score (log odds)."""

        def of(n: Node) -> Column:
            if n.feature is None:
                return F.lit(float(n.value))
            return F.when(features[n.feature] <= n.cut, of(n.left)).otherwise(of(n.right))

        total = F.lit(float(self.base))
        for t in self.trees:
            total = total + of(t)
        return total

    def score(self, rows: np.ndarray, names: list[str]) -> np.ndarray:
        def of(n: Node, at: np.ndarray) -> np.ndarray:
            if n.feature is None:
                return np.full(len(at), n.value)
            left = rows[at, names.index(n.feature)] <= n.cut
            out = np.empty(len(at))
            out[left], out[~left] = of(n.left, at[left]), of(n.right, at[~left])
            return out

        # added up in the order of column()
        return sum((of(t, np.arange(len(rows))) for t in self.trees), np.full(len(rows), self.base))


class Leaf(Node):
    """A leaf of a tree that grows, with the sums of its rows."""

    def __init__(self, sums: tuple[int, int, int] | None = None):
        super().__init__()
        self.sums = sums


def boosted(pos: int, neg: int, names: list[str], histograms, trees: int, depth: int, rate: float) -> Boosted:
    """Newton boosting of the logistic loss, level by level; ties go to the first feature and least cut, so a fit repeats exactly.

    ``histograms(model, root, open)`` gives, for each open leaf and feature, the values in order and the sums of gradients,
    second derivatives (both in units of 1 / ONE) and rows at each: whole numbers, so their order does not matter.
    """
    if not pos + neg:
        return Boosted(-10.0, [])
    share = (pos + 1) / (pos + neg + 2)
    model = Boosted(float(np.log(share / (1 - share))), [])

    def split(leaf: Leaf, found: list) -> list[Leaf]:
        """Turns a leaf into a node with two leaves where that gains something."""
        best = (1e-6, None, 0, None)
        for k, (values, gs, hs, ws) in enumerate(found):
            leaf.sums = leaf.sums or (int(gs.sum()), int(hs.sum()), int(ws.sum()))
            if len(values) < 2:
                continue
            gs, hs, ws = (np.cumsum(c)[:-1] for c in (gs, hs, ws))
            (g, h), w = (c / ONE for c in leaf.sums[:2]), leaf.sums[2]
            a, b = gs / ONE, hs / ONE
            gain = a**2 / (b + 1) + (g - a) ** 2 / (h - b + 1) - g**2 / (h + 1)
            gain[(ws < LEAST_WEIGHT) | (w - ws < LEAST_WEIGHT)] = 0
            c = int(gain.argmax())
            if gain[c] > best[0] * (1 + 1e-9):
                best = (float(gain[c]), names[k], int(values[c]), (int(gs[c]), int(hs[c]), int(ws[c])))
        if best[1] is None:
            return []
        leaf.feature, leaf.cut, leaf.left = best[1], best[2], Leaf(best[3])
        leaf.right = Leaf(tuple(x - y for x, y in zip(leaf.sums, best[3], strict=True)))
        return [leaf.left, leaf.right]

    def settle(n: Leaf) -> Node:
        if n.feature is None:
            return Node(value=round(float(-rate * (n.sums[0] / ONE) / (n.sums[1] / ONE + 1.0)), 6))
        return Node(0.0, n.feature, n.cut, settle(n.left), settle(n.right))

    for _ in range(trees):
        root = Leaf()
        grown = [root]
        for _ in range(depth):
            if grown:
                found = histograms(model, root, grown)
                grown = [x for leaf, of in zip(grown, found, strict=True) for x in split(leaf, of)]
        model.trees.append(settle(root))
    return model


def fit(x: np.ndarray, pos: np.ndarray, neg: np.ndarray, names: list[str], trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Boosted:
    """Trees of a table that the caller holds: distinct vectors and their positive and negative rows."""
    pos, neg = (np.asarray(c).astype(np.int64) for c in (pos, neg))
    weight = pos + neg

    def histograms(model: Boosted, root: Leaf, grown: list[Leaf]) -> list:
        p = 1 / (1 + np.exp(-model.score(x, names)))
        grad, hess = weight * np.floor(p * ONE + 0.5).astype(np.int64) - pos * ONE, weight * np.floor(p * (1 - p) * ONE + 0.5).astype(np.int64)

        def rows(n: Node, at: np.ndarray) -> dict:
            if n.feature is None:
                return {id(n): at}
            left = x[at, names.index(n.feature)] <= n.cut
            return rows(n.left, at[left]) | rows(n.right, at[~left])

        def of(at: np.ndarray, k: int) -> tuple:
            values, code = np.unique(x[at, k], return_inverse=True)
            sums = np.zeros((3, len(values)), np.int64)
            for c, each in zip(sums, (grad, hess, weight), strict=True):
                np.add.at(c, code, each[at])
            return values, *sums

        where = rows(root, np.arange(len(x)))
        return [[of(where[id(n)], k) for k in range(len(names))] for n in grown]

    return boosted(int(pos.sum()), int(neg.sum()), names, histograms, trees, depth, rate)


def vectors(rows: DataFrame, names: list[str], label: str) -> DataFrame:
    """All distinct feature vectors of a table with their positive (``_p``) and negative (``_n``) rows, stored."""
    positive = F.sum(F.col(label).cast("bigint"))
    return stored(rows.groupBy(*names).agg(positive.alias("_p"), (F.count("*") - positive).alias("_n")), "vectors")


def held(table: DataFrame, *names: str) -> list[np.ndarray] | None:
    """The columns of a table of at most HELD_VECTORS rows; of a longer one none."""
    if table.count() > HELD_VECTORS:
        return None
    got = table.select(*names).toArrow()
    return [c.to_numpy() for c in got.columns]


def fit_rows(table: DataFrame, names: list[str], trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Boosted:
    """The trees of ``fit`` from a table as ``vectors`` gives it, however many rows it has.

    A short table goes to the driver. Of a longer one each level of a tree is a pass over the table, and the driver gets
    a row per open leaf, feature and value, so its memory depends on the features' ranges. Both give the same trees.
    """
    short = held(table, *names, "_p", "_n")
    if short is not None:
        return fit(np.stack(short[:-2], axis=1).astype(np.int64), *short[-2:], names, trees, depth, rate)
    columns = {c: F.col(c) for c in names}

    def histograms(model: Boosted, root: Leaf, grown: list[Leaf]) -> list:
        place = {id(n): i for i, n in enumerate(grown)}

        def leaf(n: Node) -> Column:
            if n.feature is None:
                return F.lit(place.get(id(n), -1))
            return F.when(columns[n.feature] <= n.cut, leaf(n.left)).otherwise(leaf(n.right))

        weight = F.col("_p") + F.col("_n")
        rows = table.select(*names, weight.alias("_w"), "_p", leaf(root).alias("_leaf"), (1 / (1 + F.exp(-model.column(columns)))).alias("_s")).where("_leaf >= 0")
        whole = lambda c: F.floor(c * ONE + 0.5).cast("bigint")
        s, w = F.col("_s"), F.col("_w")
        each = F.inline(F.array(*(F.struct(F.lit(k).alias("_k"), columns[c].cast("bigint").alias("_v")) for k, c in enumerate(names))))
        rows = rows.select("_leaf", (w * whole(s) - F.col("_p") * ONE).alias("_g"), (w * whole(s * (1 - s))).alias("_h"), "_w", each)
        got = rows.groupBy("_leaf", "_k", "_v").agg(*(F.sum(c).alias(c) for c in ("_g", "_h", "_w"))).toArrow()
        at, k, *rest = (got[c].to_numpy() for c in ("_leaf", "_k", "_v", "_g", "_h", "_w"))
        order = np.lexsort((rest[0], k, at))
        begin = np.searchsorted(at[order] * len(names) + k[order], np.arange(len(grown) * len(names) + 1))
        cut = [tuple(c[order[a:z]] for c in rest) for a, z in zip(begin[:-1], begin[1:], strict=True)]
        return [cut[i : i + len(names)] for i in range(0, len(cut), len(names))]

    n = table.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("_p", "_n"))).first()
    return boosted(n["_p"], n["_n"], names, histograms, trees, depth, rate)


def threshold(score: np.ndarray, pos: np.ndarray, neg: np.ndarray, precision: float) -> float:
    """A score, of even odds or better, from which on the share of positives is at least ``precision``; infinite if there is none.

    It lies halfway between the least score that keeps the precision and the next lower one, or at even odds where none is lower.
    """
    order = np.argsort(-score, kind="stable")
    s, p, n = score[order], np.cumsum(pos[order]), np.cumsum(neg[order])
    last = np.append(s[1:] != s[:-1], True) if len(s) else np.zeros(0, bool)
    good = np.flatnonzero(last & (p > 0) & (p >= precision * (p + n)))
    if not len(good):
        return float("inf")
    k = int(good[-1])
    return max(0.0, float(s[k] + s[k + 1]) / 2 if k + 1 < len(s) else 0.0)


def thresholds(table: DataFrame, model: Boosted, names: list[str], group: Column, precision: float) -> dict[int, float]:
    """``threshold`` of each group of a table as ``vectors`` gives it, from all its rows; a group without rows or threshold is left out.

    Of a table that is not short, scores are summed up in ranges, in order of groups and scores; the driver gets the ranges' sums, and of each group
    the last score that keeps the precision and the one below.
    """
    short = held(table.withColumn("_of", group.cast("int")), *names, "_of", "_p", "_n")
    if short is not None:
        score, (of, pos, neg) = model.score(np.stack(short[:-3], axis=1).astype(np.int64), names), short[-3:]
        found = {int(k): threshold(score[of == k], pos[of == k], neg[of == k], precision) for k in np.unique(of)}
        return {k: t for k, t in found.items() if np.isfinite(t)}
    scored = table.select(group.cast("int").alias("_of"), model.column({c: F.col(c) for c in names}).alias("_s"), "_p", "_n")
    scored = scored.groupBy("_of", "_s").agg(F.sum("_p").alias("_p"), F.sum("_n").alias("_n")).repartitionByRange("_of", F.desc("_s"))
    scored = stored(scored.withColumn("_part", F.spark_partition_id()), "scores")
    before, base = {}, []
    for r in scored.groupBy("_of", "_part").agg(F.sum("_p").alias("_p"), F.sum("_n").alias("_n")).orderBy("_of", "_part").collect():
        p, n = before.get(r["_of"], (0, 0))
        base.append((r["_of"], r["_part"], p, n))
        before[r["_of"]] = p + r["_p"], n + r["_n"]
    base = table.sparkSession.createDataFrame(base, "_of int, _part int, _p0 bigint, _n0 bigint")
    above = Window.partitionBy("_of", "_part").orderBy(F.desc("_s")).rowsBetween(Window.unboundedPreceding, 0)
    p, n = (F.col(f"{c}0") + F.sum(c).over(above) for c in ("_p", "_n"))
    reached = scored.join(F.broadcast(base), ["_of", "_part"]).select("_of", "_s", p.alias("_p"), n.alias("_n"))
    last = {r["_of"]: r["_s"] for r in reached.where((F.col("_p") > 0) & (F.col("_p") >= precision * (F.col("_p") + F.col("_n")))).groupBy("_of").agg(F.min("_s").alias("_s")).collect()}
    if not last:
        return {}
    lower = reduce(lambda a, k: a | ((F.col("_of") == k) & (F.col("_s") < last[k])), last, F.lit(False))
    following = {r["_of"]: r["_s"] for r in scored.where(lower).groupBy("_of").agg(F.max("_s").alias("_s")).collect()}
    return {k: max(0.0, (s + following[k]) / 2 if k in following else 0.0) for k, s in last.items()}
