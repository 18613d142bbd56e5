"""Ordered boosting on oblivious trees, with target statistics of categories from strictly earlier rows.

Rows are in a fixed random order, a seeded hash of their key.

* A category becomes a number: the mean label of the rows before it in that order which
  have the category, with ``PRIOR`` further rows of the mean label. Sums over earlier rows
  are prefix sums over ranges of the order, so a category with a third of all rows is in
  no single task. New rows get the statistic of all training rows.
* Residuals are unbiased: with ``prefixes`` = J, the model j of 1 to J learns its leaf
  values from the first 2^(j - J) of the order, and a row's gradient is taken from the
  largest model that hasn't learned from it. All models share the trees' splits; the
  one of all rows is the result.
* A tree is oblivious: all nodes of a level have one split. A level is one pass that adds
  up gradients by leaf, feature and bin; the split with the largest sum over all leaves
  of ``G^2 / (n + l2)`` wins, ties going to the first feature and border. One more pass
  gives the leaf values of all models.

Sums are exact integers (see :mod:`tidemark.trees.passes`): for given borders the same
trees come out for any partitioning. Every ``STORED`` trees the rows are written anew
with their scores so far, so neither lineage nor the work of a pass grows without end.

Null numbers and NaN are below all others; a null category is a category. The key must
tell rows apart. Without rows or with one label the model is a constant.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.ml import Estimator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ranges import running
from tidemark.session import stored
from tidemark.trees import passes
from tidemark.trees.passes import TreeModel, column, number

PRIOR = 1.0
STORED = 8
NONE = "__MISSING__"


class OrderedModel(TreeModel):
    def __init__(self, raw, link, statistics, trees):
        super().__init__(raw, link)
        self.statistics, self.trees = statistics, trees

    def features(self, df: DataFrame) -> DataFrame:
        for c, name, table, mean in self.statistics:
            known = table.select(F.col("category").alias("__known"), F.col("mean").alias(name))
            df = df.join(known, _category(c) == F.col("__known"), "left").drop("__known").withColumn(name, F.coalesce(name, F.lit(mean)))
        return df


def _category(c: str):
    return F.coalesce(column(c).cast("string"), F.lit(NONE))


def target_statistics(df: DataFrame, categories: Sequence[str], label: str, place: str, mean: float, prior: float = PRIOR) -> DataFrame:
    """``df`` with ``__ts<i>`` for each category: the smoothed mean label of its strictly earlier rows in the order of ``place``."""
    for i, c in enumerate(categories):
        steps = df.withColumns({"__category": _category(c), "__sum": column(label).cast("double"), "__one": F.lit(1)})
        past = running(steps, ["__category"], place, ["__sum", "__one"])
        own = (F.col("c___sum") - F.col("__sum") + mean * prior) / (F.col("c___one") - F.col("__one") + prior)
        df = past.withColumn(f"__ts{i}", own).select(*df.columns, f"__ts{i}")
    return df


def split_scores(sums: np.ndarray, counts: np.ndarray, l2: float) -> np.ndarray:
    """By feature and border, the sum over leaves of ``G^2 / (n + l2)`` of both sides; sums are by leaf, feature and bin."""
    left, n_left = np.cumsum(sums, 2)[:, :, :-1], np.cumsum(counts, 2)[:, :, :-1]
    right, n_right = sums.sum(2, keepdims=True) - left, counts.sum(2, keepdims=True) - n_left
    return (left**2 / (n_left + l2) + right**2 / (n_right + l2)).sum(0)


def leaves_of(cells: np.ndarray, splits: Sequence[tuple[int, int]]) -> np.ndarray:
    """Which leaf: bit i is set where the feature of split i is above its border."""
    leaf = np.zeros(len(cells), np.int64)
    for i, (f, b) in enumerate(splits):
        leaf |= (cells[:, f] > b).astype(np.int64) << i
    return leaf


class OrderedBoosting(Estimator):
    """``logistic`` for a label of 0 and 1, ``squared`` for numbers."""

    def __init__(self, numbers: Sequence[str], categories: Sequence[str] = (), key: Sequence[str] = (), label: str = "label", loss: str = "logistic", trees: int = 100, depth: int = 6, rate: float = 0.1, l2: float = 3.0, bins: int = 64, prefixes: int = 5, seed: int = 42):
        super().__init__()
        if loss not in ("logistic", "squared"):
            raise ValueError(f"unknown loss {loss!r}")
        if not key:
            raise ValueError("a key must tell rows apart: it gives their random order")
        if not 0 < depth <= 12 or not 1 < bins <= 1024 or prefixes < 1:
            raise ValueError("depth must be 1 to 12, bins 2 to 1024, prefixes 1 or more")
        self.numbers, self.categories, self.key, self.label, self.loss = list(numbers), list(categories), list(key), label, loss
        self.trees, self.depth, self.rate, self.l2, self.bins, self.prefixes, self.seed = trees, depth, rate, l2, bins, prefixes, seed

    def _rows(self, df: DataFrame):
        """Numbers, statistics of categories, label ``y`` and block ``b`` of the order; the mean label and the number of rows."""
        place = F.xxhash64(*[column(c) for c in self.key], F.lit(self.seed))
        own = df.filter(column(self.label).isNotNull()).select(*[column(c).cast("double").alias(f"n{i}") for i, c in enumerate(self.numbers)], *[_category(c).alias(f"g{i}") for i, c in enumerate(self.categories)], column(self.label).cast("double").alias("y"), place.alias("__place"))
        own = stored(own)
        found = own.agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean"), F.max(F.abs("y")).alias("high"), F.stddev_pop("y").alias("std")).first()
        groups = [f"g{i}" for i in range(len(self.categories))]
        # the share of the order before a row, from 0 to 1; its block is the number of halvings from the end
        share = (F.col("__place").cast("double") + 2.0**63) / 2.0**64
        block = F.greatest(F.lit(0), self.prefixes - F.ceil(-F.log2(F.greatest(share, F.lit(1e-300)))).cast("int"))
        made = target_statistics(own, groups, "y", "__place", found["mean"] or 0.0).withColumn("b", F.least(block, F.lit(self.prefixes - 1)))
        return own, made, found

    def _fit(self, df: DataFrame) -> OrderedModel:
        own, rows, found = self._rows(df)
        n, mean, J = found["n"], found["mean"] or 0.0, self.prefixes
        logistic = self.loss == "logistic"
        if logistic and n and own.filter("y not in (0, 1)").limit(1).count():
            raise ValueError("labels must be 0 and 1")
        names = [f"n{i}" for i in range(len(self.numbers))] + [f"__ts{i}" for i in range(len(self.categories))]
        statistics = []
        for i, c in enumerate(self.categories):
            all_rows = own.groupBy(F.col(f"g{i}").alias("category")).agg(F.sum("y").alias("s"), F.count(F.lit(1)).alias("n"))
            table = stored(all_rows.select("category", ((F.col("s") + mean * PRIOR) / (F.col("n") + PRIOR)).alias("mean")))
            statistics.append((c, f"__ts_{i}", table, mean))
        start = 0.0 if logistic else mean
        if logistic and n and found["std"] == 0:
            start = math.log((mean + 1e-6) / (1 - mean + 1e-6))
        made, scores = [], []
        if n and names and found["std"]:
            made, scores = self._grow(rows, names, n, start, max(1.0, (found["high"] or 0.0) + abs(mean)))
        borders = self._borders if made else []
        read = [f"`{c}`" for c in self.numbers] + [f"`{s[1]}`" for s in statistics]
        terms = [number(start)]
        for splits, leaf in zip(made, scores, strict=True):
            bits = " + ".join(f"shiftleft(cast({passes.above(read[f], borders[f][b - 1] if b else None)} as int), {i})" for i, (f, b) in enumerate(splits))
            terms.append(f"element_at(array({', '.join(map(number, leaf))}), 1 + {bits})")
        named = [[(self.numbers + self.categories)[f] for f, _ in t] for t in made]
        return OrderedModel(passes.balanced(terms), "logistic" if logistic else "identity", statistics, list(zip(named, made, scores, strict=True)))

    def _grow(self, rows: DataFrame, names: list[str], n: int, start: float, largest: float):
        J, logistic, rate, l2 = self.prefixes, self.loss == "logistic", self.rate, self.l2
        self._borders = borders = passes.borders_of(rows, names, self.bins)
        bins = max(len(b) for b in borders) + 2
        table = stored(passes.binned(rows, names, borders, ["y", "b"]).withColumn("raw", F.array_repeat(F.lit(start), J)))
        bits = passes.exact_bits(n, 1.0 if logistic else 4 * largest)
        features = len(names)
        trees: list[list[tuple[int, int]]] = []
        values: list[np.ndarray] = []  # by model and leaf
        since = 0  # trees that ``raw`` has already

        def scores(batch):
            raw = batch["raw"].copy()
            for splits, v in zip(trees[since:], values[since:], strict=True):
                raw += v[:, leaves_of(batch["x"], splits)].T
            return raw

        slope = lambda y, raw: passes.gradients(self.loss, y, raw, 4 * largest)
        columns = ["y", "b", "raw", "x"]
        for _ in range(self.trees):
            splits: list[tuple[int, int]] = []

            def level(batch, splits=splits):
                raw, b = scores(batch), batch["b"]
                # model b has seen the blocks before b alone; no model has seen less than the first
                own = np.where(b > 0, raw[np.arange(len(b)), np.maximum(b - 1, 0)], start)
                g, _ = slope(batch["y"], own)
                return passes.histogram(leaves_of(batch["x"], splits), batch["x"], 1 << len(splits), bins, [passes.fixed(g, bits), np.ones(len(b), np.int64)])

            for _ in range(self.depth):
                sums = passes.totals(table, columns, level, (1 << len(splits), features, bins, 2))
                g, count = np.ldexp(sums[..., 0].astype(float), -bits), sums[..., 1].astype(float)
                gain = split_scores(g, count, l2) - (g[:, :1].sum(2) ** 2 / (count[:, :1].sum(2) + l2)).sum()
                f, b = divmod(int(gain.argmax()), bins - 1)
                if gain[f, b] <= 1e-12:
                    break
                splits.append((f, b))
            if not splits:
                break

            def leaf_sums(batch, splits=splits):
                leaf, raw = leaves_of(batch["x"], splits), scores(batch)
                out = np.zeros((J, 1 << self.depth, 2), np.int64)
                for j in range(J):
                    seen = batch["b"] <= j  # model j + 1 learns from the blocks before j + 1
                    for k, s in enumerate(slope(batch["y"], raw[:, j])):
                        np.add.at(out[j, :, k], leaf[seen], passes.fixed(s[seen], bits))
                return out

            sums = np.ldexp(passes.totals(table, columns, leaf_sums, (J, 1 << self.depth, 2)).astype(float), -bits)
            trees.append(splits)
            values.append(rate * sums[..., 0] / (sums[..., 1] + l2))
            if len(trees) % STORED == 0 and len(trees) < self.trees:
                table = passes.rescored(table, columns, scores)
                since = len(trees)
        return trees, [v[-1, : 1 << len(t)] for t, v in zip(trees, values, strict=True)]
