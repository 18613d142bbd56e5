"""Second-order boosting with a weighted quantile sketch and learned directions for nulls.

* Borders are proposed anew for each tree: quantiles of each feature in which a row counts
  by its curvature, so that they are dense where the loss still bends. They come from a
  mergeable sketch with bounds for every rank. A map task keeps one summary for each
  doubling of its rows, and summaries of all tasks are merged by feature.
* Trees grow level by level; one pass adds up slopes and curvatures of all nodes of a level
  by feature and bin. Nulls (and NaN) have a bin of their own. The gain of a border is taken
  with the nulls on either side, and the better side is where nulls of that node go; nulls
  may also be parted from all numbers.
* Leaf values are Newton steps; ``gamma`` is the least gain of a split and
  ``least`` the least curvature of a child.

For given borders sums, and so trees, are exact for any partitioning; the sketch's choice
among borders of equal rank error depends on the order in which summaries meet.
Without rows or with one label the model is a constant.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import stored
from tidemark.trees import passes
from tidemark.trees.grown import Tree, plain
from tidemark.trees.passes import TreeModel, number

STORED = 8
HELD = 1 << 16  # rows of the lowest summary of a task
SIZE = 1 << 10  # entries of a summary; each merge of two adds a part in so many to the error of ranks


@dataclass
class Summary:
    """Values in order with their weight ``w`` and bounds: the weight of all lower values is ``lo`` or more, that up to the value ``hi`` or less."""

    v: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    w: np.ndarray

    @classmethod
    def of(cls, values: np.ndarray, weights: np.ndarray) -> Summary:
        v, at = np.unique(values, return_inverse=True)
        w = np.zeros(len(v), np.int64)
        np.add.at(w, at, weights)
        end = np.cumsum(w)
        return cls(v, end - w, end, w)

    @property
    def total(self) -> int:
        return int(self.hi[-1]) if len(self.v) else 0

    def _at(self, v: np.ndarray):
        """Bounds and weight at any values."""
        if not len(self.v):
            return (np.zeros(len(v), np.int64),) * 3
        at = np.searchsorted(self.v, v)
        here = np.minimum(at, len(self.v) - 1)
        equal = self.v[here] == v
        before = np.where(at > 0, (self.lo + self.w)[at - 1], 0)
        after = np.where(at < len(self.v), (self.hi - self.w)[here], self.total)
        return np.where(equal, self.lo[here], before), np.where(equal, self.hi[here], after), np.where(equal, self.w[here], 0)

    def merged(self, other: Summary) -> Summary:
        v = np.union1d(self.v, other.v)
        return Summary(v, *(a + b for a, b in zip(self._at(v), other._at(v), strict=True)))

    def picked(self, ranks: np.ndarray) -> np.ndarray:
        """Entries next to the given ranks."""
        middle = self.lo + self.hi
        i = np.clip(np.searchsorted(middle, 2 * ranks, "right") - 1, 0, max(0, len(self.v) - 2))
        j = np.minimum(i + 1, len(self.v) - 1)
        return np.where(2 * ranks < self.lo[i] + self.w[i] + self.hi[j] - self.w[j], i, j)

    def pruned(self, size: int) -> Summary:
        if len(self.v) <= size + 1:
            return self
        ranks = np.array([self.total * k // size for k in range(size + 1)])
        keep = np.unique(np.concatenate([[0], self.picked(ranks), [len(self.v) - 1]]))
        return Summary(self.v[keep], self.lo[keep], self.hi[keep], self.w[keep])

    def error(self) -> float:
        """The largest error of a rank, as a share of the total weight."""
        if not self.total:
            return 0.0
        own = (self.hi - self.lo - self.w).max()
        between = (self.hi[1:] - self.w[1:] - self.lo[:-1] - self.w[:-1]).max() if len(self.v) > 1 else 0
        return max(own, between) / self.total

    def arrays(self) -> list[np.ndarray]:
        return [self.v, self.lo, self.hi, self.w]


class _Levels:
    """Summaries of 1, 2, 4 .. times ``HELD`` rows, at most one of each."""

    def __init__(self, size: int):
        self.size, self.values, self.weights, self.n, self.levels = size, [], [], 0, []

    def add(self, values: np.ndarray, weights: np.ndarray) -> None:
        real = ~np.isnan(values) & (weights > 0)
        self.values.append(values[real])
        self.weights.append(weights[real])
        self.n += int(real.sum())
        if self.n >= HELD:
            self._push()

    def _push(self) -> None:
        if not self.n:
            return
        made = Summary.of(np.concatenate(self.values), np.concatenate(self.weights)).pruned(self.size)
        self.values, self.weights, self.n = [], [], 0
        for i in range(len(self.levels) + 1):
            if i == len(self.levels):
                self.levels.append(made)
            elif self.levels[i] is None:
                self.levels[i] = made
            else:
                made, self.levels[i] = self.levels[i].merged(made).pruned(self.size), None
                continue
            break

    def result(self) -> Summary:
        self._push()
        none = np.zeros(0, np.int64)
        out = Summary(np.zeros(0), none, none, none)
        for s in self.levels:
            out = out if s is None else out.merged(s)
        return out.pruned(self.size)


def sketch(rows: DataFrame, columns: Sequence[str], fn, features: int, size: int = SIZE) -> list[Summary]:
    """A summary of each feature over all rows; ``fn`` makes of a batch the values (rows by features) and the integer weights."""

    def run(batches):
        own = [_Levels(size) for _ in range(features)]
        for batch in batches:
            if batch.num_rows:
                values, weights = fn(dict(zip(columns, map(passes._array, batch.columns), strict=True)))
                for f in range(features):
                    own[f].add(values[:, f], weights)
        done = [x.result() for x in own]
        yield _batch(list(range(features)), done)

    def meet(key, table):
        found = [Summary(*(np.asarray(c.as_py(), t) for c, t in zip(row, (float, np.int64, np.int64, np.int64), strict=True))) for row in zip(*(table.column(n) for n in ("v", "lo", "hi", "w")), strict=True)]
        while len(found) > 1:  # in pairs, not cut: only the last one is
            found = [a.merged(b) for a, b in zip(found[::2], found[1::2], strict=False)] + ([found[-1]] if len(found) % 2 else [])
        return pa.Table.from_batches([_batch([key[0].as_py()], [found[0].pruned(size)])])

    schema = "feature int, v array<double>, lo array<long>, hi array<long>, w array<long>"
    made = rows.select(*columns).coalesce(rows.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, schema)
    none = np.zeros(0, np.int64)
    out = [Summary(np.zeros(0), none, none, none) for _ in range(features)]
    for r in made.groupBy("feature").applyInArrow(meet, schema).collect():  # one row a feature
        out[r["feature"]] = Summary(np.array(r["v"], float), *(np.array(r[n], np.int64) for n in ("lo", "hi", "w")))
    return out


def _batch(features: list[int], summaries: list[Summary]) -> pa.RecordBatch:
    parts = [pa.array([s.arrays()[i].tolist() for s in summaries], pa.list_(pa.float64() if i == 0 else pa.int64())) for i in range(4)]
    return pa.RecordBatch.from_arrays([pa.array(features, pa.int32()), *parts], ["feature", "v", "lo", "hi", "w"])


def proposed(s: Summary, bins: int) -> np.ndarray:
    """At most ``bins - 1`` borders, at even ranks; none at the largest value."""
    if len(s.v) < 2:
        return np.zeros(0)
    ranks = np.array([s.total * k // bins for k in range(1, bins)])
    picked = np.unique(s.v[s.picked(ranks)])
    return picked[picked < s.v[-1]]


def best_split(g: np.ndarray, h: np.ndarray, l2: float, gamma: float, least: float):
    """Gain, feature, border and side of nulls (right?) of a node's best split, from sums by feature and bin; bin 0 has the nulls."""
    total_g, total_h = g.sum(1, keepdims=True), h.sum(1, keepdims=True)
    base = total_g**2 / (total_h + l2)
    best = (-np.inf, 0, 0, False)
    for null_right in (False, True):
        gl, hl = np.cumsum(g[:, 1:], 1)[:, :-1], np.cumsum(h[:, 1:], 1)[:, :-1]
        if not null_right:
            gl, hl = gl + g[:, :1], hl + h[:, :1]
        gr, hr = total_g - gl, total_h - hl
        gain = (gl**2 / (hl + l2) + gr**2 / (hr + l2) - base) / 2 - gamma
        gain = np.where((hl < least) | (hr < least), -np.inf, gain)
        f, b = divmod(int(gain.argmax()), gain.shape[1])
        if gain[f, b] > best[0]:
            best = (float(gain[f, b]), f, b + 1, null_right)
    return best


class NewtonBoosting(Estimator):
    """``logistic`` for a label of 0 and 1, ``squared`` for numbers."""

    def __init__(self, numbers: Sequence[str], label: str = "label", loss: str = "logistic", trees: int = 100, depth: int = 6, rate: float = 0.3, l2: float = 1.0, gamma: float = 0.0, least: float = 1.0, bins: int = 64):
        super().__init__()
        if loss not in ("logistic", "squared"):
            raise ValueError(f"unknown loss {loss!r}")
        if not 0 < depth <= 12 or not 1 < bins <= SIZE // 2:
            raise ValueError(f"depth must be 1 to 12 and bins 2 to {SIZE // 2}")
        self.numbers, self.label, self.loss, self.trees, self.depth = list(numbers), label, loss, trees, depth
        self.rate, self.l2, self.gamma, self.least, self.bins = rate, l2, gamma, least, bins

    def _fit(self, df: DataFrame) -> TreeModel:
        own, n, start, largest = passes.prepared(df, self.numbers, (), self.label, self.loss, 0)
        trees: list[Tree] = []
        proposals: list[list[np.ndarray]] = []
        if n and self.numbers and own.select("y").distinct().limit(2).count() > 1:
            v = F.array(*[F.coalesce(f"n{i}", F.lit(float("nan"))) for i in range(len(self.numbers))])
            self._grow(stored(own.select("y", F.lit(start).alias("raw"), v.alias("v"))), n, largest, trees, proposals)
        names = [f"`{c}`" for c in self.numbers]
        model = TreeModel(passes.balanced([number(start), *(t.sql(names, b) for t, b in zip(trees, proposals, strict=True))]), "logistic" if self.loss == "logistic" else "identity")
        model.trees, model.borders = trees, proposals
        return model

    def _grow(self, table: DataFrame, n: int, largest: float, trees: list[Tree], proposals: list[list[np.ndarray]]) -> None:
        columns, loss, features = ["y", "raw", "v"], self.loss, len(self.numbers)
        bits = passes.exact_bits(n, largest)
        since = 0

        def cells_of(v, borders):
            out = np.zeros(v.shape, np.int64)
            for f, b in enumerate(borders):
                out[:, f] = np.where(np.isnan(v[:, f]), 0, np.searchsorted(b, v[:, f], "left") + 1)
            return out

        def scores(batch):
            raw = batch["raw"].copy()
            for t, borders in zip(trees[since:], proposals[since:], strict=True):
                raw += np.asarray(t.value)[t.reached(len(raw), plain(cells_of(batch["v"], borders)))]
            return raw

        def curved(batch):
            _, h = passes.gradients(loss, batch["y"], scores(batch), largest)
            return batch["v"], passes.fixed(h, bits)

        for _ in range(self.trees):
            borders = [proposed(s, self.bins) for s in sketch(table, columns, curved, features)]
            bins = max(len(b) for b in borders) + 2
            tree, open_ = Tree(), [0]
            for _ in range(self.depth):
                slot = np.full(len(tree.feature), -1)
                slot[open_] = np.arange(len(open_))

                def level(batch, tree=tree, slot=slot, size=len(open_), borders=borders, bins=bins):
                    cells = cells_of(batch["v"], borders)
                    g, h = passes.gradients(loss, batch["y"], scores(batch), largest)
                    return passes.histogram(slot[tree.reached(len(g), plain(cells))], cells, size, bins, [passes.fixed(g, bits), passes.fixed(h, bits)])

                sums = np.ldexp(passes.totals(table, columns, level, (len(open_), features, bins, 2)).astype(float), -bits)
                after = []
                for leaf, (g, h) in zip(open_, ((s[..., 0], s[..., 1]) for s in sums), strict=True):
                    tree.value[leaf] = float(self.rate * g[0].sum() / (h[0].sum() + self.l2))
                    gain, f, b, null_right = best_split(g, h, self.l2, self.gamma, self.least)
                    if gain <= 1e-12:
                        continue
                    left, right = tree.split(leaf, f, b, null_right)
                    gr, hr = g[f, b + 1 :].sum() + null_right * g[f, 0], h[f, b + 1 :].sum() + null_right * h[f, 0]
                    tree.value[right] = float(self.rate * gr / (hr + self.l2))
                    tree.value[left] = float(self.rate * (g[f].sum() - gr) / (h[f].sum() - hr + self.l2))
                    after += [left, right]
                open_ = after
                if not open_:
                    break
            if len(tree.feature) == 1:
                break
            trees.append(tree)
            proposals.append(borders)
            if len(trees) % STORED == 0 and len(trees) < self.trees:
                table = passes.rescored(table, columns, scores)
                since = len(trees)
