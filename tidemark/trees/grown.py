"""Binary trees in arrays: rows go down them by bins, and they become SQL."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np

from tidemark.trees.passes import above, number


class Tree:
    """Node 0 is the root; a node without a feature (-1) is a leaf with a value.

    A row goes right if its bin of the feature is above the border. Bin 0 (null, NaN) goes where ``null_right`` says.
    """

    def __init__(self):
        self.feature, self.border, self.left, self.right, self.null_right, self.value = [-1], [0], [0], [0], [False], [0.0]

    def split(self, node: int, feature: int, border: int, null_right: bool = False) -> tuple[int, int]:
        self.feature[node], self.border[node], self.null_right[node] = feature, border, null_right
        self.left[node], self.right[node] = len(self.feature), len(self.feature) + 1
        for _ in range(2):
            for own, start in ((self.feature, -1), (self.border, 0), (self.left, 0), (self.right, 0), (self.null_right, False), (self.value, 0.0)):
                own.append(start)
        return self.left[node], self.right[node]

    def reached(self, n: int, bin_of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """The leaf of each of ``n`` rows; ``bin_of`` gives each row's bin of its own feature."""
        feature, border, left, right, null_right = (np.asarray(x) for x in (self.feature, self.border, self.left, self.right, self.null_right))
        node = np.zeros(n, np.int64)
        while True:
            f = feature[node]
            inner = f >= 0
            if not inner.any():
                return node
            cell = bin_of(np.maximum(f, 0))
            goes = np.where(cell == 0, null_right[node], cell > border[node])
            node = np.where(inner, np.where(goes, right[node], left[node]), node)

    def sql(self, names: Sequence[str], borders: Sequence[np.ndarray], node: int = 0) -> str:
        f, b = self.feature[node], self.border[node]
        if f < 0:
            return number(self.value[node])
        # past the last border no number is on the right, only what is null
        test = "false" if b > len(borders[f]) else above(names[f], borders[f][b - 1] if b else None)
        if self.null_right[node]:
            test = f"({test} or isnan(coalesce({names[f]}, double('NaN'))))"
        return f"case when {test} then {self.sql(names, borders, self.right[node])} else {self.sql(names, borders, self.left[node])} end"


def plain(cells: np.ndarray):
    """``bin_of`` of a matrix of rows by features."""
    at = np.arange(len(cells))
    return lambda f: cells[at, f]
