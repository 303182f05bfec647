"""A multiway hyperplane tree with distance ranges between the pivots and the subtrees of every split.

A split holds some points as pivots; every other point belongs to the nearest one. For each pivot and each subtree the split keeps the least and
greatest distance between them. A query that looks for points at a distance of ``near`` to ``far`` leaves out a subtree when, for some pivot, the
subtree's range cannot meet the query's annulus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

FANOUT = 8


def distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    d2 = np.square(x).sum(axis=1)[:, None] + np.square(points).sum(axis=1) - 2 * x @ points.T
    return np.sqrt(np.maximum(d2, 0))


def spread_out(points: np.ndarray, count: int) -> np.ndarray:
    """Up to ``count`` different points, each the farthest from those before it, out of a few evenly spaced ones."""
    some = points[np.linspace(0, len(points) - 1, min(len(points), 6 * count)).astype(int)]
    taken, gap = [0], distances(some, some[:1])[:, 0]
    while len(taken) < count and gap.max() > 1e-6 * (1 + np.abs(some).max()):
        taken.append(int(gap.argmax()))
        gap = np.minimum(gap, distances(some, some[taken[-1:]])[:, 0])
    return some[taken]


class Tree:
    """Splits numbered from 0; a child is a split's number, or -1 - c for cell c."""

    def __init__(self, points: np.ndarray, cell_rows: int, depth: int, fanout: int = FANOUT):
        self.pivots: list[np.ndarray] = []
        self.child: list[list[int]] = []
        self.cells = 0
        self.root = self._grow(points, cell_rows, depth, fanout)
        self.low = [np.full((len(p), len(p)), np.inf) for p in self.pivots]
        self.high = [np.full((len(p), len(p)), -np.inf) for p in self.pivots]

    def _grow(self, points, cell_rows, depth, fanout) -> int:
        pivots = spread_out(points, fanout) if depth and len(points) > max(cell_rows, 2) else points[:0]
        if len(pivots) < 2:
            self.cells += 1
            return -self.cells
        own = distances(points, pivots).argmin(axis=1)
        at = len(self.pivots)
        self.pivots.append(pivots)
        self.child.append([])
        self.child[at] = [self._grow(points[own == j], cell_rows, depth - 1, fanout) for j in range(len(pivots))]
        return at

    def route(self, x: np.ndarray, note: bool = False) -> np.ndarray:
        """Cell of every row; with ``note`` the splits' ranges are widened by the rows."""
        cell = np.empty(len(x), np.int64)
        left = [(self.root, np.arange(len(x)))]
        while left:
            at, rows = left.pop()
            if at < 0:
                cell[rows] = -1 - at
                continue
            d = distances(x[rows], self.pivots[at])
            own = d.argmin(axis=1)
            for j, to in enumerate(self.child[at]):
                if (mine := own == j).any():
                    if note:
                        np.minimum(self.low[at][:, j], d[mine].min(axis=0), out=self.low[at][:, j])
                        np.maximum(self.high[at][:, j], d[mine].max(axis=0), out=self.high[at][:, j])
                    left.append((to, rows[mine]))
        return cell

    def search(self, q: np.ndarray, near: np.ndarray, far: Callable[[np.ndarray], np.ndarray], slack: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(cell, queries) that no range excludes. ``near`` and ``far(queries)`` have one column per window; ``far`` may shrink on the way."""
        left = [(self.root, np.arange(len(q)))]
        while left:
            at, rows = left.pop()
            if at < 0:
                yield -1 - at, rows
                continue
            d = distances(q[rows], self.pivots[at])[:, :, None]
            closest = np.maximum(d - self.high[at], self.low[at] - d).max(axis=1)
            farthest = (d + self.high[at]).min(axis=1)
            limit = far(rows)
            for j in np.argsort(-np.median(d[:, :, 0], axis=0)):  # the nearest subtree comes off the stack first
                meets = (closest[:, j, None] <= limit + slack[rows, None]) & (farthest[:, j, None] >= near[rows] - slack[rows, None])
                if (some := meets.any(axis=1)).any():
                    left.append((self.child[at][j], rows[some]))
