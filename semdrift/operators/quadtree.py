"""Sums over all points of a plane through a quad tree of cell counts.

The finest cells are squares of one size on a fixed grid; a task counts its own points, and the
sums of all tasks are merged cell by cell. Four cells make one of the next level.
For a point a cell stands for all of its points where it looks small from there: its
side is less than ``THETA`` times the distance from their centre. Other cells
are opened, level by level, down to the finest; there a point leaves itself out.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

THETA = 0.3
#: Occupied cells of the finest level above which cells become larger, and cells on a side at most.
MOST_CELLS, MOST_SIDE = 65_536, 1 << 14
CHUNK = 1024  # points whose cells are looked at together


def count_cells(x: np.ndarray, y: np.ndarray, weight: np.ndarray, side: float) -> np.ndarray:
    """Rows (ix, iy, weight, sum of x, sum of y) of the occupied cells, sorted."""
    at = np.column_stack([np.floor(x / side), np.floor(y / side)])
    cells, where = np.unique(at, axis=0, return_inverse=True)
    sums = [np.bincount(where.ravel(), v, len(cells)) for v in (weight, weight * x, weight * y)]
    return np.column_stack([cells, *sums])


def merge_cells(parts: list[np.ndarray]) -> np.ndarray:
    """The sums of several counts, cell by cell, in the order given."""
    rows = np.concatenate(parts)
    cells, where = np.unique(rows[:, :2], axis=0, return_inverse=True)
    return np.column_stack([cells, *(np.bincount(where.ravel(), rows[:, c], len(cells)) for c in (2, 3, 4))])


def coarser(cells: np.ndarray, side: float) -> tuple[np.ndarray, float]:
    """Cells of twice the side, until they are few enough."""
    while len(cells) > MOST_CELLS or len(cells) and np.ptp(cells[:, :2], axis=0).max() >= MOST_SIDE:
        cells = merge_cells([np.column_stack([np.floor(cells[:, :2] / 2), cells[:, 2:]])])
        side *= 2
    return cells, side


def _spread_bits(v: np.ndarray) -> np.ndarray:
    """The bits of numbers below 2^20 with a gap after each."""
    v = v.astype(np.int64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = (v | (v << shift)) & mask
    return v


@dataclass(frozen=True)
class Level:
    n: np.ndarray
    x: np.ndarray  # centre of the points of each cell
    y: np.ndarray
    first: np.ndarray  # the cells of the next finer level that make up cell i: first[i] to first[i + 1]


@dataclass(frozen=True)
class QuadTree:
    side: float  # of the finest cells
    origin: np.ndarray  # smallest (ix, iy)
    codes: np.ndarray  # of the finest cells, sorted
    levels: list[Level]  # finest first

    def own_cell(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The finest cell that each point lies in, -1 for none."""
        ix, iy = np.floor(x / self.side) - self.origin[0], np.floor(y / self.side) - self.origin[1]
        inside = (ix >= 0) & (iy >= 0) & (ix < 1 << 20) & (iy < 1 << 20)
        code = _spread_bits(np.where(inside, ix, 0)) | _spread_bits(np.where(inside, iy, 0)) << 1
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(inside & (self.codes[at] == code), at, -1)


def build(cells: np.ndarray, side: float) -> QuadTree:
    """The tree over counted cells (not none)."""
    origin = cells[:, :2].min(axis=0)
    codes = _spread_bits(cells[:, 0] - origin[0]) | _spread_bits(cells[:, 1] - origin[1]) << 1
    order = np.argsort(codes)
    finest, (n, sx, sy) = codes[order], cells[order, 2:].T
    levels, now, first = [], finest, np.zeros(len(finest) + 1, np.int64)
    while True:
        levels.append(Level(n, sx / n, sy / n, first))
        if len(now) == 1:
            return QuadTree(side, origin, finest, levels)
        parent, first = np.unique(now >> 2, return_index=True)
        n, sx, sy = (np.add.reduceat(v, first) for v in (n, sx, sy))
        now, first = parent, np.append(first, len(now))


Kernel = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def push(tree: QuadTree, x: np.ndarray, y: np.ndarray, weight: np.ndarray, kernel: Kernel, theta: float = THETA) -> np.ndarray:
    """Rows (fx, fy, z): the sums of ``kernel(dx, dy)`` over all other points; a point itself (of ``weight``) is left out."""
    out = np.zeros((3, len(x)))
    for low in range(0, len(x), CHUNK):
        at = slice(low, min(low + CHUNK, len(x)))
        px, py, own = x[at], y[at], tree.own_cell(x[at], y[at])
        node = np.zeros(len(px), np.int64)
        who = np.arange(len(px))
        for height in range(len(tree.levels) - 1, -1, -1):
            level = tree.levels[height]
            dx, dy, n = px[who] - level.x[node], py[who] - level.y[node], level.n[node]
            if height:
                small = (tree.side * 2.0 ** height) ** 2 < theta * theta * (dx * dx + dy * dy)
            else:
                small = np.ones(len(who), bool)
                mine = np.flatnonzero(own[who] == node)
                rest = n[mine] - weight[at][who[mine]]
                # The centre of the others in the cell lies beyond the cell's, seen from the point.
                grown = np.where(rest > 1e-9, n[mine] / np.maximum(rest, 1e-9), 0.0)
                n[mine], dx[mine], dy[mine] = np.where(rest > 1e-9, rest, 0.0), dx[mine] * grown, dy[mine] * grown
            for i, values in enumerate(kernel(dx[small], dy[small])):
                out[i, at] += np.bincount(who[small], values * n[small], len(px))
            who, node = who[~small], node[~small]
            if not len(who):
                break
            many = level.first[node + 1] - level.first[node]
            ends = np.cumsum(many)
            node = np.repeat(level.first[node] - ends + many, many) + np.arange(ends[-1])
            who = np.repeat(who, many)
    return out
