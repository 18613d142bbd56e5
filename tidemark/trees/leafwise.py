"""Leaf-wise histogram boosting with one-sided sampling by gradient and bundles of exclusive features.

* Growth is best-first: of all leaves the one with the largest gain is split next, until
  ``leaves`` are there. A leaf's histogram serves its split; when it is split, a pass adds
  up the smaller child alone, and the larger is the parent less the smaller, exactly, as
  sums are integers. A pass takes the children of the ``ahead`` best leaves at once, which
  are then known when their turn comes: the tree is the one that single steps would give.
* Of each tree's rows those with the largest gradients count in full, and of the others a
  seeded share with a weight that makes up for the rest. The limit between them is taken
  from a histogram of the gradients' sizes over all rows.
* Features that are hardly ever off their most frequent bin together share one column. The
  rows in which two of them are off are counted for all pairs in one pass; features
  are put into bundles, the fullest first, wherever the conflicts of a bundle stay within
  ``conflicts`` of all rows. Without conflicts the trees are those of single columns.

Null numbers and NaN are below all others. Without rows or with one label the model is a
constant. For given borders the same trees come out for any partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml import Estimator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, ShortType

from tidemark.session import stored
from tidemark.trees import passes
from tidemark.trees.grown import Tree
from tidemark.trees.passes import TreeModel, number

STORED = 8
SIZES = 1 << 12  # bins of the sizes of gradients
HELD = 32_000  # of a bundle's bins, which are 16-bit numbers


class Bundles:
    """Where each feature's bins are: column ``col``, from ``first`` on; elsewhere it is at its ``usual`` bin."""

    def __init__(self, groups: Sequence[Sequence[int]], widths: Sequence[int], usual: Sequence[int]):
        self.groups, self.widths, self.usual = [list(g) for g in groups], np.asarray(widths), np.asarray(usual)
        self.col, self.first = np.zeros(len(widths), np.int64), np.zeros(len(widths), np.int64)
        self.bins = 1
        for c, group in enumerate(self.groups):
            at = 1  # 0: all of them usual
            for f in group:
                self.col[f], self.first[f] = c, at
                at += widths[f]
            self.bins = max(self.bins, at)

    def packed(self, cells: np.ndarray) -> np.ndarray:
        """A column a bundle; of features in conflict the last one stands."""
        out = np.zeros((len(cells), len(self.groups)), np.int16)
        for f in range(len(self.widths)):
            off = cells[:, f] != self.usual[f]
            out[off, self.col[f]] = self.first[f] + cells[off, f]
        return out

    def bin_of(self, packed: np.ndarray):
        at = np.arange(len(packed))

        def of(f):
            v = packed[at, self.col[f]].astype(np.int64) - self.first[f]
            return np.where((v >= 0) & (v < self.widths[f]), v, self.usual[f])

        return of

    def unpacked(self, sums: np.ndarray, width: int) -> np.ndarray:
        """Histograms of features from those of bundles: what isn't elsewhere is in the usual bin."""
        out = np.zeros((len(self.widths), width, sums.shape[-1]), np.int64)
        for f, w in enumerate(self.widths):
            own = sums[self.col[f], self.first[f] : self.first[f] + w].copy()
            own[self.usual[f]] += sums[self.col[f]].sum(0) - own.sum(0)
            out[f, :w] = own
        return out


def bundled(off: np.ndarray, both: np.ndarray, widths: Sequence[int], allowed: int) -> list[list[int]]:
    """Greedy groups of features; ``off``: rows off the usual bin, ``both``: of pairs. A group has ``allowed`` conflicts at most."""
    groups: list[list[int]] = []
    spent: list[int] = []
    for f in sorted(range(len(off)), key=lambda f: (-off[f], f)):
        for i, g in enumerate(groups):
            more = int(sum(both[f, o] for o in g))
            if spent[i] + more <= allowed and sum(widths[o] for o in g) + widths[f] < HELD:
                g.append(f)
                spent[i] += more
                break
        else:
            groups.append([f])
            spent.append(0)
    return groups


def best_split(sums: np.ndarray, bits: int, l2: float, least: int) -> tuple[float, int, int]:
    """Gain, feature and border of the best split of a leaf, from its sums of slope, curvature and rows by feature and bin."""
    g, h, n = np.ldexp(sums[..., 0].astype(float), -bits), np.ldexp(sums[..., 1].astype(float), -bits), sums[..., 2]
    gl, hl, nl = (np.cumsum(x, 1)[:, :-1] for x in (g, h, n))
    g, h, n = (x.sum(1, keepdims=True) for x in (g, h, n))
    gain = gl**2 / (hl + l2) + (g - gl) ** 2 / (h - hl + l2) - g**2 / (h + l2)
    gain[(nl < least) | (n - nl < least)] = -np.inf
    f, b = divmod(int(gain.argmax()), gain.shape[1])
    return float(gain[f, b]), f, b


class LeafwiseBoosting(Estimator):
    """``logistic`` for a label of 0 and 1, ``squared`` for numbers. ``top`` and ``other``: shares of rows kept by gradient and by chance."""

    def __init__(self, numbers: Sequence[str], key: Sequence[str] = (), label: str = "label", loss: str = "logistic", trees: int = 100, leaves: int = 31, rate: float = 0.1, l2: float = 1.0, least: int = 20, bins: int = 64, top: float = 1.0, other: float = 0.0, conflicts: float = 0.0, ahead: int = 8, bundle: bool = True, subtract: bool = True, seed: int = 42):
        super().__init__()
        if loss not in ("logistic", "squared"):
            raise ValueError(f"unknown loss {loss!r}")
        if not 0 < top <= 1 or not 0 <= other <= 1 - top + 1e-12 or (top < 1 and not (other and key)):
            raise ValueError("shares of rows must be within 1; a share by chance needs a key")
        if not 1 < bins <= 1024 or leaves < 2 or ahead < 1:
            raise ValueError("bins must be 2 to 1024, leaves 2 or more, ahead 1 or more")
        self.numbers, self.key, self.label, self.loss, self.trees, self.leaves, self.rate, self.l2, self.least = list(numbers), list(key), label, loss, trees, leaves, rate, l2, least
        self.bins, self.top, self.other, self.conflicts, self.ahead, self.bundle, self.subtract, self.seed = bins, top, other, conflicts, ahead, bundle, subtract, seed

    def _fit(self, df: DataFrame) -> TreeModel:
        own, n, start, self._largest = passes.prepared(df, self.numbers, self.key, self.label, self.loss, self.seed)
        trees: list[Tree] = []
        names, borders = [f"n{i}" for i in range(len(self.numbers))], []
        if n and names and own.select("y").distinct().limit(2).count() > 1:
            borders = passes.borders_of(own, names, self.bins)
            table, bundles = self._packed(own, names, borders, n)
            self._grow(table.withColumn("raw", F.lit(start)), bundles, n, trees)
        model = TreeModel(passes.balanced([number(start), *(t.sql([f"`{c}`" for c in self.numbers], borders) for t in trees)]), "logistic" if self.loss == "logistic" else "identity")
        model.trees = trees
        return model

    def _packed(self, own: DataFrame, names: list[str], borders: list[np.ndarray], n: int):
        widths = [len(b) + 2 for b in borders]
        binned = stored(passes.binned(own, names, borders, ["y", "u"]))
        features, width = len(names), max(widths)
        counts = passes.totals(binned, ["x"], lambda b: passes.histogram(np.zeros(len(b["x"]), np.int64), b["x"], 1, width, [np.ones(len(b["x"]), np.int64)]), (1, features, width, 1))[0, ..., 0]
        usual = counts.argmax(1)

        def pairs(batch):
            off = (batch["x"] != usual).astype(np.float64)  # counts of a batch are exact
            return np.rint(off.T @ off).astype(np.int64)

        groups = [[f] for f in range(features)]
        if self.bundle:
            both = passes.totals(binned, ["x"], pairs, (features, features))
            groups = bundled(np.diag(both), both, widths, int(self.conflicts * n))
        bundles = Bundles(groups, widths, usual)

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                packed = bundles.packed(passes._array(batch.column(2)))
                bounds = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * packed.shape[1])
                yield batch.set_column(2, "x", pa.ListArray.from_arrays(bounds, pa.array(packed.reshape(-1))))

        own = binned.select("y", "u", "x")
        schema = own.select("y", "u").schema.add("x", ArrayType(ShortType()))
        return stored(own.mapInArrow(run, schema)), bundles

    def _weights(self, table, columns, scores, n: int, turn: int):
        """The limit of the gradients' size above which rows count in full, and the weight of the others that are drawn."""
        if self.top >= 1:
            return 0.0, 1.0, 1.0
        loss, largest = self.loss, self._largest

        def sizes(batch):
            g, _ = passes.gradients(loss, batch["y"], scores(batch), largest)
            return np.bincount(np.minimum((np.abs(g) / largest * SIZES).astype(np.int64), SIZES - 1), minlength=SIZES).astype(np.int64)

        counts = passes.totals(table, columns, sizes, (SIZES,))
        above = np.cumsum(counts[::-1])[::-1]
        at = int(np.flatnonzero(above >= self.top * n)[-1])
        rest = n - int(above[at])
        chance = min(1.0, self.other * n / rest) if rest else 1.0
        return at / SIZES * largest, chance, 1 / chance

    def _grow(self, table: DataFrame, bundles: Bundles, n: int, trees: list[Tree]) -> None:
        columns, loss, largest, rate, l2 = ["y", "u", "raw", "x"], self.loss, self._largest, self.rate, self.l2
        n_cols, width = len(bundles.groups), int(max(bundles.widths))
        since = 0

        def scores(batch):
            raw = batch["raw"].copy()
            of = bundles.bin_of(batch["x"])
            for t in trees[since:]:
                raw += np.asarray(t.value)[t.reached(len(raw), of)]
            return raw

        for turn in range(self.trees):
            limit, chance, weight = self._weights(table, columns, scores, n, turn)
            bits = passes.exact_bits(n, largest * weight)

            def stats(batch, limit=limit, chance=chance, weight=weight, turn=turn, bits=bits):
                g, h = passes.gradients(loss, batch["y"], scores(batch), largest)
                full = np.abs(g) >= limit
                # an even number from 0 to 1 of the row and the turn
                x = batch["u"].astype(np.uint64) + np.uint64((turn + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
                x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                drawn = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53 < chance
                w = np.where(full, 1.0, np.where(drawn, weight, 0.0))
                return w > 0, [passes.fixed(g * w, bits), passes.fixed(h * w, bits), np.ones(len(g), np.int64)]

            tree = Tree()

            def leaf_sums(asked, tree=tree, stats=stats):
                """Histograms of the rows of leaves that a split sends to one side: by leaf, the split and the side (None: all rows)."""
                slot = {leaf: i for i, leaf in enumerate(asked)}

                def fn(batch):
                    of = bundles.bin_of(batch["x"])
                    node = tree.reached(len(batch["y"]), of)
                    counted, own = stats(batch)
                    which = np.full(len(node), -1)
                    for leaf, want in asked.items():
                        here = node == leaf
                        if want is not None:
                            f, b, right = want
                            here &= (of(np.full(len(node), f)) > b) == right
                        which[here] = slot[leaf]
                    which[~counted] = -1
                    return passes.histogram(which, batch["x"], len(asked), bundles.bins, own)

                got = passes.totals(table, columns, fn, (len(asked), n_cols, bundles.bins, 3))
                return {leaf: bundles.unpacked(got[i], width) for leaf, i in slot.items()}

            sums = {0: leaf_sums({0: None})[0]}
            best = {0: best_split(sums[0], bits, l2, self.least)}
            known: dict[int, np.ndarray] = {}  # of a leaf's smaller child
            while len(best) < self.leaves:
                order = sorted((leaf for leaf in best if best[leaf][0] > 1e-12), key=lambda x: (-best[x][0], x))
                if not order:
                    break
                leaf = order[0]
                if leaf not in known:
                    room = min(self.ahead, self.leaves - len(best))
                    known |= leaf_sums({x: (*best[x][1:], small_side(sums[x], *best[x][1:])) for x in [x for x in order if x not in known][:room]})
                _, f, b = best.pop(leaf)
                is_right, one = small_side(sums[leaf], f, b), known.pop(leaf)
                two = sums[leaf] - one if self.subtract else leaf_sums({leaf: (f, b, not is_right)})[leaf]
                left, right = tree.split(leaf, f, b)
                del sums[leaf]
                for child, own in ((right, one if is_right else two), (left, two if is_right else one)):
                    sums[child], best[child] = own, best_split(own, bits, l2, self.least)
            if len(best) == 1:
                break
            for leaf, own in sums.items():
                g, h = (np.ldexp(float(own[0, :, k].sum()), -bits) for k in (0, 1))
                tree.value[leaf] = float(rate * g / (h + l2))
            trees.append(tree)
            if len(trees) % STORED == 0 and len(trees) < self.trees:
                table = passes.rescored(table, columns, scores)
                since = len(trees)


def small_side(sums: np.ndarray, f: int, b: int) -> bool:
    """Whether the right child of a split has no more rows than the left."""
    return bool(sums[f, b + 1 :, 2].sum() <= sums[f, : b + 1, 2].sum())
