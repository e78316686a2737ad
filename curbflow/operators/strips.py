"""Counts of places near straight lines within one tile: strips of places are counted by their ranges, only those at an edge are measured."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: (line, strip) pairs that are looked at together.
BLOCK = 1 << 16
#: Places that are measured together.
MEASURED = 1 << 20


class Strips:
    """A tile's places in strips of equal numbers by y, in each by columns of x; ``counts`` has a row of whole numbers for each place."""

    def __init__(self, x: np.ndarray, y: np.ndarray, counts: np.ndarray):
        n = len(x)
        self.n = max(1, int(np.sqrt(n)))
        by_y = np.argsort(y, kind="stable")
        strip = np.empty(n, np.int64)
        strip[by_y] = np.arange(n) * self.n // n
        self.columns = 2 * self.n
        self.low, wide = x.min(), x.max() - x.min()
        self.scale = self.columns / wide if wide > 0 and np.isfinite(self.columns / wide) else 0.0
        column = self.column(x)
        cell = strip * (self.columns + 2) + column
        order = np.argsort(cell, kind="stable")
        self.x, self.y, self.counts = x[order], y[order], counts[order]
        # places before a strip's column; columns -1 and beyond the last are empty
        self.before = np.searchsorted(cell[order], np.arange(self.n * (self.columns + 2) + 1))
        self.total = np.concatenate([np.zeros((1, counts.shape[1]), np.int64), np.cumsum(self.counts, axis=0)])
        firsts = np.searchsorted(strip[by_y], np.arange(self.n))
        self.levels = np.append(y[by_y][firsts], y.max())
        self.row = np.arange(self.n) * (self.columns + 2)

    def column(self, x: np.ndarray) -> np.ndarray:
        """Column from 1, 0 and the last for what is left and right of the places; it never falls where x grows."""
        return np.clip(np.floor((x - self.low) * self.scale), -1, self.columns).astype(np.int64) + 1 if self.scale else np.sign(x - self.low).astype(np.int64) + 1


def span(y: np.ndarray, line: list[np.ndarray], r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest x at heights y of what is at most r from each line; inf and -inf where there is none."""
    ax, ay, bx, by = line
    dx, dy = bx - ax, by - ay
    length = np.hypot(dx, dy)
    low, high = np.inf, -np.inf
    for cx, cy in ((ax, ay), (bx, by)):
        square = r * r - (y - cy) ** 2
        half = np.sqrt(np.maximum(square, 0.0))
        low = np.minimum(low, np.where(square >= 0, cx - half, np.inf))
        high = np.maximum(high, np.where(square >= 0, cx + half, -np.inf))
    with np.errstate(divide="ignore", invalid="ignore"):
        for side in (r / length, -r / length):
            t = (y - (ay + side * dx)) / dy
            x = ax - side * dy + t * dx
            on = (t >= 0) & (t <= 1)
            low = np.minimum(low, np.where(on, x, np.inf))
            high = np.maximum(high, np.where(on, x, -np.inf))
    return low, high


def distances(x: np.ndarray, y: np.ndarray, ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray) -> np.ndarray:
    dx, dy, px, py = bx - ax, by - ay, x - ax, y - ay
    square = dx * dx + dy * dy
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.where(square > 0, np.clip((px * dx + py * dy) / square, 0.0, 1.0), 0.0)
    return np.hypot(px - t * dx, py - t * dy)


def runs(first: np.ndarray, last: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(number of the run, place in it) of all runs first..last - 1, in blocks."""
    n = np.maximum(last - first, 0)
    ends = np.cumsum(n)
    a = 0
    while a < len(n):
        done = ends[a] - n[a]
        b = max(a + 1, int(np.searchsorted(ends, done + MEASURED, "right")))
        m = n[a:b]
        which = np.repeat(np.arange(a, b), m)
        yield which, np.arange(len(which)) - np.repeat(ends[a:b] - m - done, m) + first[which]
        a = b


def counts_near(strips: Strips, lines: np.ndarray, radius: float) -> np.ndarray:
    """For each line (ax, ay, bx, by) the sums of the counts of places at most ``radius`` away.

    What is near a line is convex: a strip's places between the ends of its
    span at both levels are near, those outside its widest span are not.  Both
    are judged with slack, and what lies between is measured.
    """
    out = np.zeros((len(lines), strips.counts.shape[1]), np.int64)
    step = max(1, BLOCK // strips.n)
    low, high = strips.levels[None, :-1], strips.levels[None, 1:]
    for at in range(0, len(lines), step):
        ends = lines[at : at + step]
        ax, ay, bx, by = line = [ends[:, i : i + 1] for i in range(4)]
        slack = 1e-6 * radius + 1e-9 * (np.abs(ends).max(axis=1, keepdims=True) + np.hypot(bx - ax, by - ay))
        outer, inner = radius + slack, np.maximum(radius - slack, 0.0)
        bottom, top = np.minimum(ay, by) - outer, np.maximum(ay, by) + outer
        x1, x2 = span(np.clip(strips.levels[None, :], bottom, top), line, outer)
        first, last = np.minimum(x1[:, :-1], x1[:, 1:]), np.maximum(x2[:, :-1], x2[:, 1:])
        left, right = np.where(ax <= bx, ay, by), np.where(ax >= bx, ay, by)
        first = np.where((low <= left) & (left <= high), np.minimum(ax, bx) - outer, first) - slack
        last = np.where((low <= right) & (right <= high), np.maximum(ax, bx) + outer, last) + slack
        met = (high >= bottom) & (low <= top)
        row = strips.row[None, :]
        a, b = (strips.before[row + strips.column(v) + i] for v, i in ((first, 0), (last, 1)))
        b = np.where(met, np.maximum(a, b), a)
        x1, x2 = span(strips.levels[None, :], line, inner)
        x1, x2 = np.maximum(x1[:, :-1], x1[:, 1:]), np.minimum(x2[:, :-1], x2[:, 1:])
        # the columns of the ends themselves are measured
        c, d = (strips.before[row + i] for i in (np.minimum(strips.column(x1) + 1, strips.columns + 1), strips.column(x2)))
        sure = met & (x1 < x2) & (c < d)
        c, d = np.where(sure, np.clip(c, a, b), b), np.where(sure, np.clip(d, a, b), b)
        d = np.maximum(c, d)
        out[at : at + step] += (strips.total[d] - strips.total[c]).sum(axis=1)
        for f, g in ((a, c), (d, b)):
            for which, place in runs(f.ravel(), g.ravel()):
                mine = which // strips.n
                near = distances(strips.x[place], strips.y[place], *ends[mine].T) <= radius
                mine, place = mine[near], place[near]
                for k in range(out.shape[1]):
                    out[at : at + step, k] += np.bincount(mine, strips.counts[place, k], len(ends)).astype(np.int64)
    return out
