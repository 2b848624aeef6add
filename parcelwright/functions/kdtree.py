"""k-d splits that partition space, and local k-d trees that answer radius queries, in vectorised numpy.

Points are rows of an ``(n, 3)`` array: unit vectors on the sphere, or ``(x, y, 0)`` in the plane.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

CHUNK = 1 << 20  # candidate pairs that are compared at once


def unit_vectors(lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
    """Unit vectors of longitudes and latitudes in degrees."""
    lam, phi = np.radians(lon), np.radians(lat)
    return np.column_stack([np.cos(phi) * np.cos(lam), np.cos(phi) * np.sin(lam), np.sin(phi)])


def plane_vectors(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Points of a plane as vectors; the chord between two of them is their straight-line distance."""
    return np.column_stack([x, y, np.zeros(len(x))])


def chord_of(distance: float, sphere_radius: float) -> float:
    """Chord between unit vectors whose great-circle distance on a sphere of ``sphere_radius`` is ``distance``."""
    return 2.0 * float(np.sin(min(distance / sphere_radius, np.pi) / 2.0))


class KdSplits:
    """A complete binary tree of axis-parallel splits; its leaves are the partitions (cells).

    ``axis`` and ``value`` hold the inner nodes in heap order. It is fitted on a bounded sample;
    whatever the sample, every point has exactly one home cell, so the sample only affects balance.
    """

    def __init__(self, axis: np.ndarray, value: np.ndarray):
        self.axis, self.value = axis, value
        self.depth = int(np.log2(len(axis) + 1))

    @classmethod
    def fit(cls, sample: np.ndarray, cells: int) -> KdSplits:
        """Median splits of ``sample`` along the axis of largest spread until there are at least ``cells`` leaves."""
        depth = max(0, int(np.ceil(np.log2(max(1, cells)))))
        axis, value = np.zeros(2**depth - 1, dtype=np.int8), np.zeros(2**depth - 1)
        parts = {0: sample}
        for node in range(2**depth - 1):
            part = parts.pop(node)
            if len(part):
                k = int(np.argmax(np.ptp(part, axis=0)))
                axis[node], value[node] = k, float(np.median(part[:, k]))
            below = part[:, axis[node]] < value[node]
            parts[2 * node + 1], parts[2 * node + 2] = part[below], part[~below]
        return cls(axis, value)

    def home(self, points: np.ndarray) -> np.ndarray:
        """The one cell each point belongs to."""
        node = np.zeros(len(points), dtype=np.int64)
        rows = np.arange(len(points))
        for _ in range(self.depth):
            node = 2 * node + 1 + (points[rows, self.axis[node]] >= self.value[node])
        return node - (2**self.depth - 1)

    def reach(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) for every cell that the box from ``low`` to ``high`` of a row touches."""
        row, node = np.arange(len(low)), np.zeros(len(low), dtype=np.int64)
        for _ in range(self.depth):
            k, v = self.axis[node], self.value[node]
            left, right = low[row, k] < v, high[row, k] >= v
            row, node = np.concatenate([row[left], row[right]]), np.concatenate([2 * node[left] + 1, 2 * node[right] + 2])
        return row, node - (2**self.depth - 1)


def _ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The ranges ``starts[i] .. starts[i] + counts[i]``, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - counts - starts, counts)


def pairs_within(points: np.ndarray, radius: float, leaf: int = 12) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j), each unordered pair once, whose chord is at most ``radius``.

    A balanced k-d tree is built level by level; a frontier of node pairs descends it, keeping those whose
    boxes lie within the radius, and the points of the remaining leaf pairs are compared in chunks.
    """
    n = len(points)
    if n < 2:
        return
    depth = max(0, int(np.floor(np.log2(n / leaf)))) if n > leaf else 0
    order, starts, ends = np.arange(n), np.array([0]), np.array([n])
    for _ in range(depth):
        ordered = points[order]
        spread = np.maximum.reduceat(ordered, starts) - np.minimum.reduceat(ordered, starts)
        node = np.repeat(np.arange(len(starts)), ends - starts)
        along = ordered[np.arange(n), np.argmax(spread, axis=1)[node]]
        order = order[np.lexsort((along, node))]
        middle = (starts + ends) // 2
        starts, ends = np.column_stack([starts, middle]).ravel(), np.column_stack([middle, ends]).ravel()
    ordered = points[order]
    boxes = [(np.minimum.reduceat(ordered, starts), np.maximum.reduceat(ordered, starts))]
    for _ in range(depth):
        low, high = boxes[0]
        boxes.insert(0, (np.minimum(low[::2], low[1::2]), np.maximum(high[::2], high[1::2])))
    reach = radius * (1 + 1e-9)
    a = b = np.array([0])
    for low, high in boxes[1:]:
        a, b = np.concatenate([2 * a, 2 * a, 2 * a + 1, 2 * a + 1]), np.concatenate([2 * b, 2 * b + 1, 2 * b, 2 * b + 1])
        keep = a <= b
        a, b = a[keep], b[keep]
        gap = np.maximum(0, np.maximum(low[a] - high[b], low[b] - high[a]))
        keep = (gap * gap).sum(axis=1) <= reach * reach
        a, b = a[keep], b[keep]
    sizes = ends - starts
    work = np.cumsum(sizes[a] * sizes[b])
    at = 0
    while at < len(a):
        upto = max(at + 1, int(np.searchsorted(work, (work[at - 1] if at else 0) + CHUNK)))
        # a leaf pair is a block of left points, each with all right points
        left = _ragged(starts[a[at:upto]], sizes[a[at:upto]])
        right_count = np.repeat(sizes[b[at:upto]], sizes[a[at:upto]])
        right = _ragged(np.repeat(starts[b[at:upto]], sizes[a[at:upto]]), right_count)
        left = np.repeat(left, right_count)
        keep = left < right
        left, right = left[keep], right[keep]
        chord = ordered[left] - ordered[right]
        keep = np.sqrt((chord * chord).sum(axis=1)) <= radius
        if keep.any():
            yield order[left[keep]], order[right[keep]]
        at = upto


def points_in_rings(x: np.ndarray, y: np.ndarray, ring_of: np.ndarray, ring_x: np.ndarray, ring_y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(point, ring) for each point strictly inside a ring, by a sweep over y.

    ``ring_of`` numbers the ring (0, 1, ...) of each vertex, the vertices of a ring standing together in order;
    a ring is closed by its first vertex. The points are swept in the order of y: an edge is active between its
    ends, and each active edge to the right of a point flips whether the point lies inside (even-odd rule).
    Points on an edge are outside. Rings with fewer than three distinct vertices enclose nothing.
    """
    if not len(x) or not len(ring_of):
        return
    first = np.r_[True, ring_of[1:] != ring_of[:-1]]
    start = np.flatnonzero(first)
    following = np.r_[np.arange(1, len(ring_of)), 0]
    last = np.r_[start[1:], len(ring_of)] - 1
    following[last] = start
    ax, ay, bx, by = ring_x, ring_y, ring_x[following], ring_y[following]
    left = np.minimum.reduceat(ring_x, start)[ring_of]
    right = np.maximum.reduceat(ring_x, start)[ring_of]
    by_y = np.argsort(y, kind="stable")
    sx, sy = x[by_y], y[by_y]
    low, high = np.minimum(ay, by), np.maximum(ay, by)
    begin, end = np.searchsorted(sy, low, "left"), np.searchsorted(sy, high, "right")
    counts = end - begin
    # whole rings are handled together: cut the edges into runs of rings with a bounded number of candidates
    per_ring = np.add.reduceat(counts, start)
    ring_end = np.r_[start[1:], len(ring_of)]
    work = np.cumsum(per_ring)
    at = 0
    while at < len(start):
        upto = max(at + 1, int(np.searchsorted(work, (work[at - 1] if at else 0) + CHUNK)))
        edges = np.arange(start[at], ring_end[upto - 1])
        e = np.repeat(edges, counts[edges])
        p = _ragged(begin[edges], counts[edges])
        keep = (sx[p] >= left[e]) & (sx[p] <= right[e])
        e, p = e[keep], p[keep]
        px, py = sx[p], sy[p]
        side = (bx[e] - ax[e]) * (py - ay[e]) - (by[e] - ay[e]) * (px - ax[e])
        on_edge = (side == 0) & (px >= np.minimum(ax[e], bx[e])) & (px <= np.maximum(ax[e], bx[e]))
        up = by[e] > ay[e]
        active = (py >= low[e]) & (py < high[e])
        crossing = active & np.where(up, side > 0, side < 0)
        code = (ring_of[e].astype(np.int64) - at) * len(x) + p
        pair, which = np.unique(code[crossing | on_edge], return_inverse=True)
        odd = np.bincount(which, weights=crossing[crossing | on_edge], minlength=len(pair)).astype(np.int64) % 2 == 1
        touched = np.bincount(which, weights=on_edge[crossing | on_edge], minlength=len(pair)) > 0
        pair = pair[odd & ~touched]
        if len(pair):
            yield by_y[pair % len(x)], pair // len(x) + at
        at = upto
