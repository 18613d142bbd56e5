"""Extremely randomised trees: thresholds drawn at random between the extremes of a node.

All trees of a forest grow together, a level at a time, in two passes over the table: one
for the least and largest value of every feature in every open node, and one for the
sums of both sides of each node's candidate splits. A candidate's feature and threshold
come from a seeded hash of tree, node and feature, so nothing is sorted, nothing is
put into bins and nothing is sampled by a task: extremes and counts are the same in any
order, and so are the trees for any partitioning (labels of numbers are rounded once to
fixed point). Trees whose open nodes are more than ``NODES`` grow in several turns.

A node draws features until it has ``features`` that aren't constant in it, and takes
the candidate that lowers the impurity most (Gini of two classes, or variance). Every row
is in every tree. Rows are scored in Arrow batches.

Null numbers and NaN are below all thresholds. Without rows the model says 0.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import stored
from tidemark.trees import passes
from tidemark.trees.passes import column

NODES = 20_000


def drawn(*parts: int) -> float:
    """An even number from 0 to 1 that the integers determine."""
    x = 0
    for p in parts:
        x = (x ^ p) * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019 & (1 << 64) - 1
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & (1 << 64) - 1
        x ^= x >> 31
    return (x >> 11) * 2.0**-53


def candidates(seed: int, tree: int, node: int, low: np.ndarray, high: np.ndarray, k: int) -> list[tuple[int, float]]:
    """Up to ``k`` features that aren't constant in the node, in the order drawn, each with a threshold below its largest value."""
    out = []
    for f in sorted((f for f in range(len(low)) if low[f] < high[f]), key=lambda f: drawn(seed, tree, node, f, 0))[:k]:
        at = low[f] + drawn(seed, tree, node, f, 1) * (high[f] - low[f])
        out.append((f, float(at if low[f] <= at < high[f] else low[f])))
    return out


class Extra:
    """A tree: nodes by number, children of node i at 2 i + 1 and 2 i + 2, as in a heap."""

    def __init__(self):
        self.splits: dict[int, tuple[int, float]] = {}
        self.value: dict[int, float] = {}

    def reached(self, v: np.ndarray) -> np.ndarray:
        node = np.zeros(len(v), np.int64)
        at = np.arange(len(v))
        inner = np.array(sorted(self.splits), np.int64)
        if not len(inner):
            return node
        feature = np.array([self.splits[i][0] for i in inner.tolist()])
        threshold = np.array([self.splits[i][1] for i in inner.tolist()])
        while True:
            place = np.minimum(np.searchsorted(inner, node), len(inner) - 1)
            going = inner[place] == node
            if not going.any():
                return node
            node = np.where(going, 2 * node + 1 + (v[at, feature[place]] > threshold[place]), node)

    def scored(self, v: np.ndarray) -> np.ndarray:
        leaves = np.array(sorted(self.value), np.int64)
        return np.array([self.value[i] for i in leaves.tolist()])[np.searchsorted(leaves, self.reached(v))]


def extremes(rows: DataFrame, fn, slots: int, features: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest value by slot and feature; ``fn`` gives a batch's values and, for each tree, the slots of its rows."""

    def run(batches):
        low, high = np.full((slots, features), np.inf), np.full((slots, features), -np.inf)
        for batch in batches:
            if not batch.num_rows:
                continue
            v, each = fn(passes._array(batch.column(0)))
            for slot in each:
                inside = np.flatnonzero(slot >= 0)
                order = inside[np.argsort(slot[inside], kind="stable")]
                if not len(order):
                    continue
                at = np.flatnonzero(np.append(True, slot[order][1:] != slot[order][:-1]))
                which = slot[order][at]
                low[which] = np.fmin(low[which], np.fmin.reduceat(v[order], at))
                high[which] = np.fmax(high[which], np.fmax.reduceat(v[order], at))
        place = np.flatnonzero(low.reshape(-1) <= high.reshape(-1))
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(low.reshape(-1)[place]), pa.array(high.reshape(-1)[place])], ["place", "low", "high"])

    made = rows.select("v").coalesce(rows.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, "place long, low double, high double")
    got = made.groupBy("place").agg(F.min("low").alias("low"), F.max("high").alias("high")).toArrow()  # a row for each place at most
    low, high = np.full(slots * features, np.inf), np.full(slots * features, -np.inf)
    at = got.column("place").to_numpy()
    low[at], high[at] = got.column("low").to_numpy(), got.column("high").to_numpy()
    return low.reshape(slots, features), high.reshape(slots, features)


class ExtraModel(Model):
    def __init__(self, numbers: list[str], trees: list[Extra], logistic: bool):
        super().__init__()
        self.numbers, self.trees, self.logistic = numbers, trees, logistic

    def _transform(self, df: DataFrame) -> DataFrame:
        trees = self.trees

        @F.pandas_udf("double")
        def score(v: pd.Series) -> pd.Series:
            if not len(v):
                return pd.Series([], dtype=float)
            cells = np.array(v.tolist(), float)
            return pd.Series(sum(t.scored(cells) for t in trees) / len(trees))

        v = F.array(*[F.coalesce(column(c).cast("double"), F.lit(float("nan"))) for c in self.numbers])
        out = df.withColumn("prediction", score(v) if trees and self.numbers else F.lit(0.0))
        if self.logistic:
            p = F.col("prediction")
            out = out.withColumn("probability", array_to_vector(F.array(1 - p, p))).withColumn("prediction", (p > 0.5).cast("double"))
        return out


class ExtraTrees(Estimator):
    """``gini`` for a label of 0 and 1, ``variance`` for numbers. ``features``: drawn in a node; the square root of all, or all for numbers."""

    def __init__(self, numbers: Sequence[str], label: str = "label", impurity: str = "gini", trees: int = 100, depth: int = 10, features: int | None = None, least: int = 2, seed: int = 42):
        super().__init__()
        if impurity not in ("gini", "variance"):
            raise ValueError(f"unknown impurity {impurity!r}")
        if not 0 < depth <= 20 or trees < 1 or least < 2:
            raise ValueError("depth must be 1 to 20, trees 1 or more, least 2 or more")
        self.numbers, self.label, self.impurity, self.trees, self.depth, self.least, self.seed = list(numbers), label, impurity, trees, depth, least, seed
        self.features = features or (max(1, math.isqrt(len(self.numbers))) if impurity == "gini" else len(self.numbers))

    def _fit(self, df: DataFrame) -> ExtraModel:
        loss = "logistic" if self.impurity == "gini" else "squared"
        own, n, _, largest = passes.prepared(df, self.numbers, (), self.label, loss, 0)
        if not n or not self.numbers:
            return ExtraModel(self.numbers, [], loss == "logistic")
        v = F.array(*[F.coalesce(f"n{i}", F.lit(float("nan"))) for i in range(len(self.numbers))])
        table = stored(own.select("y", v.alias("v")))
        bits = 0 if loss == "logistic" else passes.exact_bits(n, largest)
        whole = passes.totals(table, ["y"], lambda b: np.array([len(b["y"]), passes.fixed(b["y"], bits).sum()]), (2,))
        forest = [Extra() for _ in range(self.trees)]
        for t in forest:
            t.value[0] = math.ldexp(float(whole[1]), -bits) / int(whole[0])
        if n >= self.least and (loss == "squared" or 0 < whole[1] < whole[0]):
            open_ = [(t, 0) for t in range(self.trees)]
            for _ in range(self.depth):
                grown = []
                for part in _turns(open_, NODES):
                    grown += self._level(table, forest, part, bits)
                open_ = grown
                if not open_:
                    break
        return ExtraModel(self.numbers, forest, loss == "logistic")

    def _level(self, table: DataFrame, forest: list[Extra], open_: list[tuple[int, int]], bits: int) -> list[tuple[int, int]]:
        """Splits the open nodes (tree and number); the children that may be split in turn."""
        width, gini, least = len(self.numbers), self.impurity == "gini", self.least
        own = sorted({t for t, _ in open_})
        nodes = {t: np.array(sorted(x for u, x in open_ if u == t), np.int64) for t in own}
        first = {}
        for t in own:
            first[t] = sum(len(nodes[u]) for u in own if u < t)
        trees = {t: forest[t] for t in own}

        def slots(v):
            out = []
            for t in own:
                node = trees[t].reached(v)
                at = np.minimum(np.searchsorted(nodes[t], node), len(nodes[t]) - 1)
                out.append(np.where(nodes[t][at] == node, at + first[t], -1))
            return out

        low, high = extremes(table, lambda v: (v, slots(v)), len(open_), width)
        names = [(t, int(x)) for t in own for x in nodes[t]]
        asked = [candidates(self.seed, t, x, low[i], high[i], self.features) for i, (t, x) in enumerate(names)]
        k = max((len(a) for a in asked), default=0)
        if not k:
            return []
        feature, threshold = np.zeros((len(names), k), np.int64), np.full((len(names), k), np.inf)
        for i, a in enumerate(asked):
            for j, (f, at) in enumerate(a):
                feature[i, j], threshold[i, j] = f, at

        def sides(batch):
            v, y = batch["v"], passes.fixed(batch["y"], bits)
            out = np.zeros((len(names) * 2, k, 2), np.int64)
            for slot in slots(v):
                rows = np.flatnonzero(slot >= 0)
                s = slot[rows]
                for j in range(k):
                    side = 2 * s + (v[rows, feature[s, j]] > threshold[s, j])
                    out[:, j, 0] += np.bincount(side, minlength=len(out))
                    np.add.at(out[:, j, 1], side, y[rows])
            return out

        sums = passes.totals(table, ["v", "y"], sides, (len(names) * 2, k, 2)).reshape(len(names), 2, k, 2)
        grown = []
        for i, (t, x) in enumerate(names):
            n, y = sums[i, :, :, 0], np.ldexp(sums[i, :, :, 1].astype(float), -bits)
            # a lower impurity of both sides is a larger sum of squared sums by rows
            gain = [(y[0, j] ** 2 / n[0, j] + y[1, j] ** 2 / n[1, j], -j) if j < len(asked[i]) and n[0, j] and n[1, j] else (-np.inf, -j) for j in range(k)]
            best, j = max(gain)
            if best == -np.inf:
                continue
            forest[t].splits[x] = asked[i][-j]
            del forest[t].value[x]
            for side in (0, 1):
                count, total, child = int(n[side, -j]), float(y[side, -j]), 2 * x + 1 + side
                forest[t].value[child] = total / count
                if count >= least and not (gini and total in (0.0, float(count))):
                    grown.append((t, child))
        return grown


def _turns(open_: list[tuple[int, int]], limit: int):
    """Whole trees, as many as have ``limit`` open nodes together, or one."""
    part: list[tuple[int, int]] = []
    for t in sorted({t for t, _ in open_}):
        own = [x for x in open_ if x[0] == t]
        if part and len(part) + len(own) > limit:
            yield part
            part = []
        part += own
    if part:
        yield part
