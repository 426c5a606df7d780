"""Boxes of many groups at once, on the cells between all abscissae and ordinates of each group's boxes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from geolith.geometry.batch import _ranges, _starts

MOST_PLACES = 1 << 16
CHUNK = 1 << 20


def _levels(group: np.ndarray, lo: np.ndarray, hi: np.ndarray, size: int):
    """Distinct values of each group in order, their number and start by group, and the places of lo and hi among them."""
    who, v = np.concatenate((group, group)), np.concatenate((lo, hi))
    order = np.lexsort((v, who))
    w, s = who[order], v[order]
    new = np.ones(len(s), dtype=bool)
    new[1:] = (w[1:] != w[:-1]) | (s[1:] != s[:-1])
    n = np.bincount(w[new], minlength=size)
    rank = np.empty(len(s), dtype=np.int64)
    rank[order] = np.cumsum(new) - 1
    rank -= _starts(n)[:-1][who]
    return s[new], n, _starts(n)[:-1], rank[: len(lo)], rank[len(lo) :]


def both_levels(group: np.ndarray, bounds: np.ndarray, size: int) -> tuple[tuple, tuple]:
    return _levels(group, bounds[:, 0], bounds[:, 2], size), _levels(group, bounds[:, 1], bounds[:, 3], size)


class Cells:
    """Cells of groups 0 .. size - 1, none of them empty. A group's places lie column by column; its last column and the last place of each column are no cells, and are never covered."""

    def __init__(self, group: np.ndarray, bounds: np.ndarray, size: int, levels: tuple | None = None):
        (self.x, self.xn, self.x_at, *cx), (self.y, self.yn, self.y_at, *cy) = levels or both_levels(group, bounds, size)
        n = self.xn * self.yn
        self.at = _starts(n)
        self.group = np.repeat(np.arange(size), n)
        k = _ranges(n)
        self.column, self.row = k // self.yn[self.group], k % self.yn[self.group]
        # Places row by row: where each of them lies column by column.
        self.turned = self.at[self.group] + k % self.xn[self.group] * self.yn[self.group] + k // self.xn[self.group]
        base, high = self.at[group], self.yn[group]
        self.corners = [base + c * high + r for c in cx for r in cy]

    def covered(self, some: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Which places lie in one of some of the boxes."""
        n = int(self.at[-1])
        ll, lh, hl, hh = (np.bincount(c[some], minlength=n) for c in self.corners)
        up = np.cumsum(ll - lh - hl + hh)  # what a column gets, it loses
        out = np.empty(n, dtype=bool)
        out[self.turned] = np.cumsum(up[self.turned]) > 0
        return out

    def _steps(self, v: np.ndarray, n: np.ndarray) -> np.ndarray:
        d = np.append(np.diff(v), 0.0)
        d[np.cumsum(n) - 1] = 0.0
        return d

    def inner(self) -> np.ndarray:
        """Which places are cells."""
        return (self.column < self.xn[self.group] - 1) & (self.row < self.yn[self.group] - 1)

    def bounds_at(self, at: np.ndarray) -> np.ndarray:
        x, y = self.x_at[self.group[at]] + self.column[at], self.y_at[self.group[at]] + self.row[at]
        return np.column_stack((self.x[x], self.y[y], self.x[x + 1], self.y[y + 1]))

    def areas(self) -> np.ndarray:
        return self._steps(self.x, self.xn)[self.x_at[self.group] + self.column] * self._steps(self.y, self.yn)[self.y_at[self.group] + self.row]


def connected_cells(cells: Cells, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of some of the cells, and the number of the part each belongs to: cells with a common side are of one part."""
    at = np.flatnonzero(some)
    turned = some[cells.turned]
    across = (np.cumsum(some) - 1)[cells.turned[turned]]

    def runs(mask):
        first = mask.copy()
        first[1:] &= ~mask[:-1]
        run = np.cumsum(first[mask]) - 1
        return np.flatnonzero(np.diff(run, prepend=-1)), run

    (up, up_run), (over, over_run) = runs(some), runs(turned)
    label, before = np.arange(len(at)), None
    while len(at) and (before is None or (label != before).any()):
        before = label
        column = np.minimum.reduceat(label, up)[up_run]
        label = np.empty_like(column)
        label[across] = np.minimum.reduceat(column[across], over)[over_run]
    return at, np.unique(label, return_inverse=True)[1]


def _parts(rows: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """One group cut into parts of few places: rows and bounds of each."""
    levels = [np.unique(bounds[:, [k, k + 2]]) for k in (0, 1)]
    if len(levels[0]) * len(levels[1]) <= MOST_PLACES:
        yield rows, bounds
        return
    k = int(len(levels[1]) > len(levels[0]))
    cut = levels[k][len(levels[k]) // 2]
    for below in (True, False):
        some = bounds[:, k] < cut if below else bounds[:, k + 2] > cut
        part = bounds[some]
        if below:
            part[:, k + 2] = np.minimum(part[:, k + 2], cut)
        else:
            part[:, k] = np.maximum(part[:, k], cut)
        if len(part):
            yield from _parts(rows[some], part)


def union_areas(group: np.ndarray, bounds: np.ndarray, side: np.ndarray) -> tuple[float, float, float]:
    """Areas of the unions of boxes of side 0 and of side 1 within each group, and of their common part, summed over groups. Groups rise."""
    total = np.zeros(3)
    solid = (bounds[:, :2] < bounds[:, 2:]).all(1)
    group, bounds, side = group[solid], bounds[solid], side[solid]
    if not len(group):
        return 0.0, 0.0, 0.0
    starts = np.flatnonzero(np.diff(group, prepend=-1))
    group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(group))))
    levels = both_levels(group, bounds, len(starts))
    places = levels[0][1] * levels[1][1]
    if (places > MOST_PLACES).any():
        parts = []
        for g in np.flatnonzero(places > MOST_PLACES):
            rows = np.flatnonzero(group == g)
            parts += _parts(rows, bounds[rows])
        few = places[group] <= MOST_PLACES
        rows = np.concatenate([np.flatnonzero(few), *[r for r, _ in parts]])
        bounds = np.concatenate([bounds[few], *[b for _, b in parts]])
        group = np.concatenate([group[few], np.repeat(len(starts) + np.arange(len(parts)), [len(r) for r, _ in parts])])
        side = side[rows]
        starts = np.flatnonzero(np.diff(group, prepend=-1))
        group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(group))))
        levels = both_levels(group, bounds, len(starts))
        places = levels[0][1] * levels[1][1]
    chunk = (np.cumsum(places) - places) // CHUNK
    for c in np.unique(chunk):
        mine = chunk[group] == c
        some = group[mine] - int(np.argmax(chunk == c))
        cells = Cells(some, bounds[mine], int((chunk == c).sum()), levels if mine.all() else None)
        area, a, b = cells.areas(), cells.covered(side[mine] == 0), cells.covered(side[mine] == 1)
        total += area[a].sum(), area[b].sum(), area[a & b].sum()
    return tuple(total.tolist())
