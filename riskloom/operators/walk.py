"""Sums of tree leaves for many rows, exact, with as little walking as the trees allow.

All trees together cut each feature at finitely many thresholds, so the sum is constant within a cell of the grid of cuts.
Where that grid is small, a cell is walked when a row first falls into it and then remembered. Where only the grid of each
single tree is small, such a tree becomes a table over its own cells. Otherwise rows walk down the trees.
"""

from __future__ import annotations

import math

import numpy as np

#: Rows led down at a time, and steps between two looks for rows that have arrived.
_ROWS, _STEPS = 8192, 4
#: Cells remembered at most; cells of one tree's table and numbers of all tables at most; rows walked before tables are made.
_CELLS, _TREE, _TABLES, _AFTER = 1 << 22, 1 << 16, 1 << 23, 20_000


class Walk:
    """Trees laid end to end. An inner node sends x[feature] <= threshold to `below`, greater values to `above`.

    A value's code is the number of its feature's thresholds below it, so x > threshold wherever the code is greater than the
    threshold's place; missing values get the code that leads them as told. A node is one whole number: its first child,
    feature and threshold's place; children are neighbours and a leaf is its own child.
    """

    def __init__(self, roots: np.ndarray, feature: np.ndarray, threshold: np.ndarray, below: np.ndarray, above: np.ndarray, value: np.ndarray, missing_above: bool):
        self.missing_above = missing_above
        self.features = int(feature.max(initial=0)) + 1
        self.cuts = [np.unique(threshold[feature == j]) for j in range(self.features)]
        cut = np.full(len(feature), len(self.cuts[0]), np.int64)  # for leaves: no code of the first feature is greater
        for j, cuts in enumerate(self.cuts):
            cut[feature == j] = np.searchsorted(cuts, threshold[feature == j])
        order = _side_by_side(roots, feature >= 0, below.astype(np.int64), above.astype(np.int64))
        places = np.empty(len(feature), np.int64)
        places[order] = np.arange(len(feature))
        first = np.where(feature >= 0, places[np.maximum(below, 0)], places)
        self.low = max(len(c) for c in self.cuts).bit_length()
        self.high = self.low + self.features.bit_length()
        self.nodes = (first << self.high | np.maximum(feature, 0).astype(np.int64) << self.low | cut)[order]
        self.roots, self.value, self.seen, self.tables = places[roots], value[order], 0, None
        sizes = [len(c) + 1 for c in self.cuts]
        self.cells = np.full(math.prod(sizes), np.nan) if math.prod(sizes) <= _CELLS else None
        self.strides = [math.prod(sizes[j + 1 :]) for j in range(self.features)]
        self.tabled = False
        if self.cells is not None:
            return
        # Places of the cuts of each tree, by feature.
        self.own = [[np.unique(cut[a:b][feature[a:b] == j]) for j in range(self.features)] for a, b in zip(roots, [*roots[1:], len(feature)], strict=True)]
        own = [math.prod(len(c) + 1 for c in cuts) for cuts in self.own]
        self.small = [n <= _TREE for n in own]
        self.tabled = any(self.small) and sum(n for n in own if n <= _TREE) <= _TABLES and len(roots) * sum(sizes) <= _TABLES

    def total(self, x: np.ndarray) -> np.ndarray:
        """The sum of the values of the leaves that each row reaches, tree by tree."""
        parts = [self._total(self._codes(x[i : i + _ROWS])) for i in range(0, len(x), _ROWS)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def _codes(self, x: np.ndarray) -> np.ndarray:
        """The codes of some rows, feature by feature."""
        out = np.empty((self.features, len(x)), np.int64)
        for j, cuts in enumerate(self.cuts):
            out[j] = np.searchsorted(cuts, x[:, j], side="left")  # missing values come after all others
            if not self.missing_above:
                out[j][np.isnan(x[:, j])] = 0
        return out

    def _total(self, codes: np.ndarray) -> np.ndarray:
        if self.cells is not None:
            return self._remembered(codes)
        self.seen += codes.shape[1]
        if self.tabled and self.seen > _AFTER:
            return self._looked_up(codes)
        return self._walked(codes)

    def _remembered(self, codes: np.ndarray) -> np.ndarray:
        cell = sum(code * stride for code, stride in zip(codes, self.strides, strict=True))
        new = np.flatnonzero(np.isnan(self.cells.take(cell)))
        if len(new):
            cells, first = np.unique(cell[new], return_index=True)
            self.cells[cells] = self._walked(codes[:, new[first]])
        return self.cells.take(cell)

    def _looked_up(self, codes: np.ndarray) -> np.ndarray:
        if self.tables is None:
            self.tables = [self._table(root, cuts) if small else None for root, cuts, small in zip(self.roots, self.own, self.small, strict=True)]
        out = np.zeros(codes.shape[1])
        for root, table in zip(self.roots, self.tables, strict=True):
            if table is None:
                out += self.value.take(self._reached(codes, root))
                continue
            steps, values = table
            at = steps[0].take(codes[0])
            for step, code in zip(steps[1:], codes[1:]):
                at += step.take(code)
            out += values.take(at)
        return out

    def _table(self, root: int, own: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
        """(for each feature: what each code adds to the cell's number; the leaf value of each cell) of one tree."""
        sizes = [len(c) + 1 for c in own]
        steps = [(np.searchsorted(c, np.arange(len(cuts) + 1)) * math.prod(sizes[j + 1 :])).astype(np.int32) for j, (c, cuts) in enumerate(zip(own, self.cuts, strict=True))]
        inside = np.meshgrid(*[np.concatenate([[0], c + 1]) for c in own], indexing="ij")  # a code of each cell
        return steps, self.value.take(self._reached(np.stack([g.ravel() for g in inside]), root))

    def _walked(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros(codes.shape[1])
        for root in self.roots:
            out += self.value.take(self._reached(codes, root))
        return out

    def _reached(self, codes: np.ndarray, root: int) -> np.ndarray:
        return reached(self.nodes, self.low, self.high, codes, root)


def reached(nodes: np.ndarray, low: int, high: int, codes: np.ndarray, root: int) -> np.ndarray:
    """The leaf of one tree that each row reaches; a node holds its cut in the bits below `low`, its feature in those below `high`."""
    n = codes.shape[1]
    codes, leaf = codes.ravel(), np.empty(n, np.int64)
    at, row = np.full(n, root), np.arange(n)
    while len(at):
        for _ in range(_STEPS):
            before, node = at, nodes.take(at)
            code = codes.take((node >> low & (1 << high - low) - 1) * n + row)
            at = (node >> high) + (code > (node & (1 << low) - 1))
        moving = at != before
        leaf[row] = at
        at, row = at[moving], row[moving]
    return leaf


def _side_by_side(roots: np.ndarray, inner: np.ndarray, below: np.ndarray, above: np.ndarray) -> np.ndarray:
    """The nodes in an order in which the children of each are neighbours."""
    if (above[inner] == below[inner] + 1).all():
        return np.arange(len(inner))
    levels, at = [roots], roots
    while len(at := at[inner[at]]):
        at = np.stack([below[at], above[at]], axis=1).ravel()
        levels.append(at)
    return np.concatenate(levels)
