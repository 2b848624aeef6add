"""Numpy kernels for shapes that expressions can't describe: clipping, hulls, simplification, faces, least squares."""

from __future__ import annotations

import math
from collections import defaultdict
from fractions import Fraction

import numpy as np


def signed_area(ring: np.ndarray) -> float:
    """Area of a ring, positive when it runs counter-clockwise."""
    p = ring - ring[0]
    q = np.roll(p, -1, axis=0)
    return float((p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]).sum()) / 2


def _clip(subject: list[tuple[float, float]], clip: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """The part of a polygon inside a counter-clockwise convex one, side by side."""
    out = subject
    for (ax, ay), (bx, by) in zip(clip, clip[1:] + clip[:1]):
        inner, out = out, []
        for (px, py), (qx, qy) in zip(inner, inner[1:] + inner[:1]):
            sp, sq = (bx - ax) * (py - ay) - (by - ay) * (px - ax), (bx - ax) * (qy - ay) - (by - ay) * (qx - ax)
            if sp >= 0:
                out.append((px, py))
            if (sp > 0 > sq) or (sp < 0 < sq):
                t = sp / (sp - sq)
                out.append((px + t * (qx - px), py + t * (qy - py)))
        if len(out) < 3:
            return []
    return out


def _fan(ring: np.ndarray) -> list[tuple[int, list[tuple[float, float]]]]:
    """A ring as signed triangles about its first vertex, each of them counter-clockwise."""
    parts = []
    for i in range(1, len(ring) - 1):
        a, b, c = ring[0], ring[i], ring[i + 1]
        twice = (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
        if twice:
            corners = [tuple(a), tuple(b), tuple(c)] if twice > 0 else [tuple(a), tuple(c), tuple(b)]
            parts.append((1 if twice > 0 else -1, corners))
    return parts


def overlap_area(a: np.ndarray, b: np.ndarray) -> float:
    """Area that two simple rings share: signed sums over the triangles that each ring fans into."""
    if len(a) < 3 or len(b) < 3 or (a.max(axis=0) < b.min(axis=0)).any() or (b.max(axis=0) < a.min(axis=0)).any():
        return 0.0
    origin = a[0]
    total = 0.0
    for sa, ta in _fan(a - origin):
        for sb, tb in _fan(b - origin):
            part = _clip(ta, tb)
            if len(part) >= 3:
                total += sa * sb * abs(signed_area(np.array(part)))
    return abs(total)


def _cut(corners: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Many polygons (n, k, 2), of which the first ``size`` corners count, each cut to the left of its line from a to b."""
    n, k = corners.shape[:2]
    place = np.arange(k)
    live = place[None, :] < size[:, None]
    following = np.take_along_axis(corners, np.where(place[None, :] + 1 < size[:, None], place[None, :] + 1, 0)[:, :, None].repeat(2, 2), axis=1)
    side = lambda p: (b - a)[:, None, 0] * (p[:, :, 1] - a[:, None, 1]) - (b - a)[:, None, 1] * (p[:, :, 0] - a[:, None, 0])
    here, there = side(corners), side(following)
    keeps, crosses = live & (here >= 0), live & (((here > 0) & (there < 0)) | ((here < 0) & (there > 0)))
    t = here / np.where(crosses, here - there, 1.0)
    made = np.stack([corners, corners + t[:, :, None] * (following - corners)], axis=2).reshape(n, 2 * k, 2)
    kept = np.stack([keeps, crosses], axis=2).reshape(n, 2 * k)
    count = kept.sum(axis=1)
    order = np.argsort(~kept, axis=1, kind="stable")[:, : int(count.max(initial=0)) or 1]
    return np.take_along_axis(made, order[:, :, None].repeat(2, 2), axis=1), count


def _fans(xy: np.ndarray, size: np.ndarray, origin: np.ndarray, sound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Triangles about the first corner of each ring (its corners in ``xy``, one ring after another), turned counter-clockwise, with their signs; and their number by ring."""
    xy = xy - np.repeat(origin, size, axis=0)
    first = np.cumsum(size) - size
    count = np.where(sound, np.maximum(size - 2, 0), 0)
    ring = np.repeat(np.arange(len(size)), count)
    at = first[ring] + np.arange(len(ring)) - np.repeat(np.cumsum(count) - count, count)
    tri = np.stack([xy[first[ring]], xy[at + 1], xy[at + 2]], axis=1)
    twice = (tri[:, 1, 0] - tri[:, 0, 0]) * (tri[:, 2, 1] - tri[:, 0, 1]) - (tri[:, 1, 1] - tri[:, 0, 1]) * (tri[:, 2, 0] - tri[:, 0, 0])
    tri, ring, twice = tri[twice != 0], ring[twice != 0], twice[twice != 0]
    tri[twice < 0] = tri[twice < 0][:, ::-1]
    return tri, np.sign(twice), np.bincount(ring, minlength=len(size))


def overlap_areas_flat(left: np.ndarray, left_size: np.ndarray, right: np.ndarray, right_size: np.ndarray, batch: int = 200_000) -> np.ndarray:
    """overlap_area() of many pairs of rings at once, given as all corners one after another and the number of each ring's: all triangles of all pairs are clipped together, ``batch`` of them at a time."""
    n = len(left_size)
    out = np.zeros(n)
    origin = np.zeros((n, 2))
    begun = left_size > 0
    origin[begun] = left[(np.cumsum(left_size) - left_size)[begun]]
    a, a_sign, a_count = _fans(left, left_size, origin, begun)
    b, b_sign, b_count = _fans(right, right_size, origin, begun)
    a_first, b_first, sizes = np.cumsum(a_count) - a_count, np.cumsum(b_count) - b_count, a_count * b_count
    upto = np.cumsum(sizes)
    begin = 0
    while begin < n:
        end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + batch, "right")))
        part = np.arange(begin, end)
        which = np.repeat(part, sizes[part])
        if len(which):
            at = np.arange(len(which)) - np.repeat(np.cumsum(sizes[part]) - sizes[part], sizes[part])
            i, j = a_first[which] + at // b_count[which], b_first[which] + at % b_count[which]
            sign, subject, clip = a_sign[i] * b_sign[j], a[i], b[j]
            meet = (subject.min(axis=1) <= clip.max(axis=1)).all(axis=1) & (clip.min(axis=1) <= subject.max(axis=1)).all(axis=1)
            which, sign, subject, clip = which[meet], sign[meet], subject[meet], clip[meet]
            size = np.full(len(subject), 3)
            for k in range(3):
                subject, size = _cut(subject, size, clip[:, k], clip[:, (k + 1) % 3])
            live = np.arange(subject.shape[1])[None, :] < size[:, None]
            rest = np.where(live[:, :, None], subject - subject[:, :1], 0.0)  # corners that don't count lie on the first
            area = np.abs((rest[:, :-1, 0] * rest[:, 1:, 1] - rest[:, 1:, 0] * rest[:, :-1, 1]).sum(axis=1)) / 2 if subject.shape[1] > 2 else np.zeros(len(subject))
            out += np.bincount(which, sign * area, n)
        begin = end
    return np.abs(out)


def overlap_areas(lefts: list[np.ndarray], rights: list[np.ndarray], batch: int = 200_000) -> np.ndarray:
    """overlap_areas_flat() of lists of rings."""
    flat = lambda rings: (np.concatenate([np.zeros((0, 2)), *rings]), np.array([len(r) for r in rings], np.int64))
    return overlap_areas_flat(*flat(lefts), *flat(rights), batch)


def ring_areas(xy: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The area of each ring, given as all corners one after another and the number of each ring's; 0 with fewer than three."""
    first = np.cumsum(size) - size
    ring = np.repeat(np.arange(len(size)), size)
    r = xy - xy[first[ring]]
    after = np.arange(len(xy)) + 1
    after[(first + size - 1)[size > 0]] = first[size > 0]
    twice = np.bincount(ring, r[:, 0] * r[after, 1] - r[after, 0] * r[:, 1], len(size))
    return np.where(size >= 3, np.abs(twice) / 2, 0.0)


def overlap_measures(a: np.ndarray, b: np.ndarray) -> tuple[float, float, float]:
    """(shared area, share of the smaller ring, intersection over union)."""
    shared, x, y = overlap_area(a, b), abs(signed_area(a)), abs(signed_area(b))
    return shared, shared / min(x, y) if min(x, y) > 0 else 0.0, shared / (x + y - shared) if x + y - shared > 0 else 0.0


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Counter-clockwise hull by monotone chains, without collinear points."""
    pts = sorted(set(map(tuple, points.tolist())))
    if len(pts) <= 2:
        return np.array(pts).reshape(-1, 2)

    def chain(seq):
        out = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(chain(pts) + chain(pts[::-1]))


def _turn(a, b, p) -> float:
    """Positive where p lies left of a to b, with the right sign even where rounding could decide."""
    l, r = (a[0] - p[0]) * (b[1] - p[1]), (a[1] - p[1]) * (b[0] - p[0])
    if abs(l - r) > 3.4e-16 * (abs(l) + abs(r)):
        return l - r
    (ax, ay), (bx, by), (px, py) = [map(Fraction, q) for q in (a, b, p)]
    return (ax - px) * (by - py) - (ay - py) * (bx - px)


def _in_circle(a, b, c, p) -> float:
    """Positive where p lies within the circle of the counter-clockwise a, b, c; see _turn()."""

    def terms(a, b, c, p):
        ax, ay, bx, by, cx, cy = a[0] - p[0], a[1] - p[1], b[0] - p[0], b[1] - p[1], c[0] - p[0], c[1] - p[1]
        return [(ax * ax + ay * ay, bx * cy, by * cx), (bx * bx + by * by, cx * ay, cy * ax), (cx * cx + cy * cy, ax * by, ay * bx)]

    parts = terms(a, b, c, p)
    total = sum(s * (u - v) for s, u, v in parts)
    if abs(total) > 1.2e-15 * sum(s * (abs(u) + abs(v)) for s, u, v in parts):
        return total
    return sum(s * (u - v) for s, u, v in terms(*[tuple(map(Fraction, q)) for q in (a, b, c, p)]))


def delaunay(points: np.ndarray) -> list[tuple[int, int, int]]:
    """Triangles of the distinct points, by inserting them one by one and retriangulating the circles they break.

    Points are taken in rows of a grid, each found by a walk from the last, so that the work grows about as their number.
    """
    n = len(points)
    low, span = points.min(axis=0), float(np.ptp(points, axis=0).max()) or 1.0
    scaled = (points - low) / span
    p = [tuple(q) for q in np.vstack([scaled, [[-20.0, -20.0], [20.0, -20.0], [0.0, 30.0]]]).tolist()]
    grid = np.floor(scaled * max(1.0, math.sqrt(n / 4))).astype(int)
    order = np.lexsort((np.where(grid[:, 1] % 2, -scaled[:, 0], scaled[:, 0]), grid[:, 1]))
    apex = {(n, n + 1): n + 2, (n + 1, n + 2): n, (n + 2, n): n + 1}  # the third corner left of each directed side
    at = (n, n + 1)
    for i in order.tolist():
        q = p[i]
        while True:
            a, b = at
            c = apex[at]
            crossed = next(((u, v) for u, v in ((a, b), (b, c), (c, a)) if _turn(p[u], p[v], q) < 0), None)
            if crossed is None:
                break
            at = crossed[1], crossed[0]
        for side in ((a, b), (b, c), (c, a)):
            del apex[side]
        open_sides, rim = [(a, b), (b, c), (c, a)], []
        while open_sides:
            a, b = open_sides.pop()
            c = apex.get((b, a))
            if c is not None and _in_circle(p[b], p[a], p[c], q) > 0:
                for side in ((b, a), (a, c), (c, b)):
                    del apex[side]
                open_sides += [(a, c), (c, b)]
            else:
                rim.append((a, b))
        for a, b in rim:
            apex[a, b], apex[b, i], apex[i, a] = i, a, b
        at = rim[0]
    return [(a, b, c) for (a, b), c in apex.items() if a < b and a < c and max(b, c) < n]


# How many median edges a triangle's circumradius may be in a concave hull, and the share of the convex hull it covers at least.
HULL_FACTOR, HULL_SHARE = 2.5, 0.2


def concave_hull(points: np.ndarray, factor: float = HULL_FACTOR, least_share: float = HULL_SHARE) -> np.ndarray:
    """Outer ring of the triangles whose circumradius is at most ``factor`` times the median edge.

    The convex hull where there are fewer than four points, or the triangles cover less than ``least_share`` of it.
    """
    pts = np.unique(points, axis=0)
    hull = convex_hull(pts)
    if len(pts) < 4 or len(hull) < 3:
        return hull
    triangles = delaunay(pts)
    edges = np.array([np.hypot(*(pts[a] - pts[b])) for t in triangles for a, b in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0]))])
    if not len(edges):
        return hull
    limit = factor * float(np.median(edges))
    kept, sides = [], defaultdict(int)
    for t in triangles:
        a, b, c = pts[list(t)]
        area = abs((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])) / 2
        lengths = np.hypot(*(a - b)), np.hypot(*(b - c)), np.hypot(*(c - a))
        if area > 0 and lengths[0] * lengths[1] * lengths[2] / (4 * area) <= limit:
            kept.append(t)
            for e in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0])):
                sides[min(e), max(e)] += 1
    rings = faces([(tuple(pts[a]), tuple(pts[b])) for (a, b), uses in sides.items() if uses == 1])
    best = max(rings, key=lambda r: abs(signed_area(r)), default=hull)
    return best if abs(signed_area(best)) >= least_share * abs(signed_area(hull)) else hull


def faces(segments: list[tuple[tuple[float, float], tuple[float, float]]], digits: int = 6) -> list[np.ndarray]:
    """The bounded faces of a network of segments that meet at their ends, as counter-clockwise rings."""
    node = lambda p: (round(p[0], digits), round(p[1], digits))
    neighbours: dict[tuple, set] = defaultdict(set)
    for a, b in segments:
        a, b = node(a), node(b)
        if a != b:
            neighbours[a].add(b)
            neighbours[b].add(a)
    loose = [p for p, q in neighbours.items() if len(q) == 1]
    while loose:  # ends that lead nowhere bound no face
        p = loose.pop()
        if len(neighbours[p]) == 1:
            q = neighbours[p].pop()
            neighbours[q].discard(p)
            if len(neighbours[q]) == 1:
                loose.append(q)
    around = {p: sorted(q, key=lambda r: math.atan2(r[1] - p[1], r[0] - p[0])) for p, q in neighbours.items() if q}
    used, out = set(), []
    for p, q in [(p, q) for p in around for q in around[p]]:
        if (p, q) in used:
            continue
        ring, a, b = [], p, q
        while (a, b) not in used:
            used.add((a, b))
            ring.append(a)
            turns = around[b]
            a, b = b, turns[(turns.index(a) - 1) % len(turns)]
        area = signed_area(np.array(ring)) if len(ring) > 2 else 0.0
        if area > 1e-12:
            out.append(np.array(ring))
    return out


def simplify(points: np.ndarray, tolerance: float) -> np.ndarray:
    """The vertices of a line that Douglas and Peucker keep."""
    keep = np.zeros(len(points), bool)
    keep[[0, -1]] = True
    stack = [(0, len(points) - 1)]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        d, inner = points[b] - points[a], points[a + 1 : b] - points[a]
        length = math.hypot(*d)
        off = np.abs(inner[:, 0] * d[1] - inner[:, 1] * d[0]) / length if length else np.hypot(inner[:, 0], inner[:, 1])
        k = int(off.argmax())
        if off[k] > tolerance:
            keep[a + 1 + k] = True
            stack += [(a, a + 1 + k), (a + 1 + k, b)]
    return points[keep]


# Tolerances in metres that a skeleton is tried with.
SKELETON_LADDER = (1, 2, 3, 5, 8, 12, 18, 25)


def skeleton(ring: np.ndarray, most: int, ladder: tuple[float, ...] = SKELETON_LADDER) -> np.ndarray:
    """A ring with at most ``most`` corners: the first tolerance of the ladder that gets there, else the last."""
    far = int(np.hypot(*(ring - ring[0]).T).argmax())
    turned = np.vstack([ring, ring[:1]])
    out = ring
    for tolerance in ladder:
        out = np.vstack([simplify(turned[: far + 1], tolerance)[:-1], simplify(turned[far:], tolerance)[:-1]])
        if len(out) <= most:
            break
    return out


def visvalingam(points: np.ndarray, least: float) -> np.ndarray:
    """The vertices of a line left when those with the smallest triangle go first, up to an area of ``least``."""
    kept = list(range(len(points)))
    while len(kept) > 2:
        a, b, c = points[kept[:-2]], points[kept[1:-1]], points[kept[2:]]
        area = np.abs((b[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (c[:, 0] - a[:, 0])) / 2
        k = int(area.argmin())
        if area[k] >= least:
            break
        kept.pop(k + 1)
    return points[kept]


def rigid_fit(src: np.ndarray, dst: np.ndarray, scaled: bool = False) -> tuple[float, float, float, float]:
    """(angle, scale, tx, ty) of the least squares transform of points onto points."""
    a, b = src - src.mean(axis=0), dst - dst.mean(axis=0)
    c, s = float((a * b).sum()), float((a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]).sum())
    angle = math.atan2(s, c)
    scale = math.hypot(c, s) / float((a * a).sum()) if scaled and (a * a).sum() > 1e-9 else 1.0
    turned = scale * (src.mean(axis=0) @ np.array([[math.cos(angle), math.sin(angle)], [-math.sin(angle), math.cos(angle)]]))
    return angle, scale, *(dst.mean(axis=0) - turned).tolist()


def moved(points: np.ndarray, pose: tuple[float, float, float, float]) -> np.ndarray:
    angle, scale, tx, ty = pose
    return scale * (points @ np.array([[math.cos(angle), math.sin(angle)], [-math.sin(angle), math.cos(angle)]])) + (tx, ty)


# Rounds of nearest corners; weight of fixed positions against edge lengths in an adjustment.
ICP_ROUNDS, POSITION_WEIGHT = 12, 1000.0


def icp(src: np.ndarray, dst: np.ndarray, pose: tuple[float, float, float, float], rounds: int = ICP_ROUNDS) -> tuple[tuple[float, float, float, float], float]:
    """A rigid pose refined by matching each point with its nearest target; and its mean distance."""
    mean = math.inf
    for _ in range(rounds):
        gap = np.hypot(*(moved(src, pose)[:, None, :] - dst[None, :, :]).transpose(2, 0, 1))
        now = float(gap.min(axis=1).mean())
        if mean - now < 1e-9:
            break
        mean, pose = now, rigid_fit(src, dst[gap.argmin(axis=1)])
    return pose, mean


def adjust(start: np.ndarray, fixed: dict[int, np.ndarray], lengths: list[tuple[int, int, float]], position_weight: float = POSITION_WEIGHT, length_weight: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Positions that hold ``fixed`` points and edge ``lengths`` in the sense of least squares, by Gauss-Newton steps."""
    p = start.astype(float).copy()
    n = len(p)
    touched = set(fixed) | {k for a, b, _ in lengths for k in (a, b)}
    for _ in range(rounds):
        rows, rest = [], []
        for i, goal in fixed.items():
            for k in (0, 1):
                row = np.zeros(2 * n)
                row[2 * i + k] = position_weight
                rows.append(row)
                rest.append(position_weight * (goal[k] - p[i, k]))
        for a, b, want in lengths:
            d = p[b] - p[a]
            now = math.hypot(*d) or 1e-9
            row = np.zeros(2 * n)
            row[2 * a : 2 * a + 2], row[2 * b : 2 * b + 2] = -length_weight * d / now, length_weight * d / now
            rows.append(row)
            rest.append(length_weight * (want - now))
        for i in set(range(n)) - touched:
            for k in (0, 1):
                row = np.zeros(2 * n)
                row[2 * i + k] = 1.0
                rows.append(row)
                rest.append(start[i, k] - p[i, k])
        if not rows:
            break
        step = np.linalg.lstsq(np.array(rows), np.array(rest), rcond=None)[0].reshape(n, 2)
        p += step
        if np.abs(step).max() < 1e-10:
            break
    return p


def matched_once(points: np.ndarray, targets: np.ndarray, reach: float, nearest: int = 4) -> list[tuple[int, int, float]]:
    """(point, target, distance): each target at most once, the closest pairs first, each point with its nearest few targets."""
    if not len(points) or not len(targets):
        return []
    gap = np.hypot(*(points[:, None, :] - targets[None, :, :]).transpose(2, 0, 1))
    order = np.argsort(gap, axis=1, kind="stable")[:, :nearest]
    options = sorted((float(gap[i, j]), i, int(j)) for i in range(len(points)) for j in order[i] if gap[i, j] <= reach)
    out, seen, taken = [], set(), set()
    for d, i, j in options:
        if i not in seen and j not in taken:
            seen.add(i)
            taken.add(j)
            out.append((i, j, d))
    return out


def pose_keys(plot: np.ndarray, *parts: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of a long and doubles."""
    p1, p2, p3, p4, p5 = (np.uint64(v) for v in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda v, k: (v << np.uint64(k)) | (v >> np.uint64(64 - k))
    h = np.full(len(plot), 42, np.uint64)
    for part in (np.asarray(plot, np.int64), *[np.asarray(v, float) + 0.0 for v in parts]):
        h = turn((h + p5 + np.uint64(8)) ^ (turn(part.view(np.uint64) * p2, 31) * p1), 27) * p1 + p4
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        h ^= h >> np.uint64(32)
    return h.view(np.int64)


class Spots:
    """The nearest of some places within ``reach``; ties go to the one given first."""

    def __init__(self, xy: np.ndarray, reach: float):
        self.xy, self.reach, self.side = xy, reach, 2 * reach
        cells = np.floor((xy - reach) / self.side).astype(np.int64)
        self.low = cells.min(axis=0)
        self.span = cells.max(axis=0) - self.low + 2  # each place goes to two by two cells
        u, v = (cells - self.low).T
        keys = np.concatenate([(u + i) * self.span[1] + v + j for i in (0, 1) for j in (0, 1)])
        order = np.argsort(keys, kind="stable")
        order = order[np.lexsort((order % len(xy), keys[order]))]
        self.keys, self.which = keys[order], order % len(xy)

    def nearest(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which place, or -1, and its distance."""
        u, v = np.floor(x / self.side).astype(np.int64) - self.low[0], np.floor(y / self.side).astype(np.int64) - self.low[1]
        found, gap = np.full(len(x), -1), np.full(len(x), np.inf)
        rows = np.flatnonzero((u >= 0) & (v >= 0) & (u < self.span[0]) & (v < self.span[1]))
        key = u[rows] * self.span[1] + v[rows]
        at = np.searchsorted(self.keys, key)
        while len(rows):
            live = at < len(self.keys)
            live[live] = self.keys[at[live]] == key[live]
            rows, key, at = rows[live], key[live], at[live]
            place = self.which[at]
            d = np.hypot(x[rows] - self.xy[place, 0], y[rows] - self.xy[place, 1])
            better = (d <= self.reach) & (d < gap[rows])
            found[rows[better]], gap[rows[better]] = place[better], d[better]
            at = at + 1
        return found, gap


class Nearby:
    """Whether places may lie within ``reach`` of a corner: a bitmap of cells on a torus. It says yes too often, but never no where one does.

    Places far apart share cells. Corners lie within ``widest`` of a place; positions are single complex numbers in cells
    from the torus' edge, and ``slack`` is more than all that rounding can do.
    """

    def __init__(self, xy: np.ndarray, reach: float, widest: float):
        self.side = reach or 1.0
        self.bits = min(12, max(6, math.ceil(math.log2(1600 * len(xy)) / 2)))
        m, far = 1 << self.bits, widest / self.side
        self.shift = m * (int(far) // m + 1)
        slack = 2.0**-20 * (self.shift + m + 2 * far) + 2.0**-48 * float(np.abs(xy).max()) / self.side
        self.table = np.full(m * m // 8, 255, np.uint8)  # eight bands of rows, a bit each, so it stays in the cache
        at = np.mod(xy / self.side, m)
        self.at = ((at + self.shift) @ (1, 1j)).astype(np.complex64)
        if slack > 2:
            return
        cells = np.floor(at).astype(np.int64)
        part, wide = at - cells, reach / self.side + slack
        steps = np.arange(-math.ceil(wide), math.ceil(wide) + 1)
        off = np.maximum(0, np.maximum(steps - part[:, :, None], part[:, :, None] - steps - 1)) ** 2
        which, i, j = np.nonzero(off[:, 0, :, None] + off[:, 1, None, :] <= wide * wide)
        taken = np.zeros(m * m, np.uint8)
        taken[(((cells[which, 1] + steps[j]) & (m - 1)) << self.bits) | ((cells[which, 0] + steps[i]) & (m - 1))] = 1
        self.table = (taken.reshape(8, -1) << np.arange(8, dtype=np.uint8)[:, None]).sum(axis=0, dtype=np.uint8)

    def count(self, p: np.ndarray, w: np.ndarray, k: np.ndarray, block: int = 32_768) -> np.ndarray:
        """For each place p (of ``at``) and way w in cells, how many of the corners p + w k may have a place nearby."""
        k, m, size = k.astype(np.complex64)[:, None], self.bits, max(1, block // max(1, len(k)))
        out = np.empty(len(p), np.uint8 if len(k) < 254 else np.int32)
        for i in range(0, len(p), size):
            xy = k * w[i : i + size]
            xy += p[i : i + size]
            cell = xy.view(np.float32).astype(np.int32)
            cell &= (1 << m) - 1
            pair = cell.view(np.int64)  # x in the low half, y in the high
            key = pair >> (32 - m)
            key |= pair
            key &= (1 << 2 * m) - 1
            band = (key >> (2 * m - 3)).astype(np.uint8)
            key &= (1 << (2 * m - 3)) - 1
            near = self.table.take(key)
            near >>= band
            near &= 1
            np.add.reduce(near, axis=0, dtype=out.dtype, out=out[i : i + size])
        return out


# Corners farther from each other, in reaches, aren't sought in the bitmap; all poses of their plot are judged in full.
WIDEST = 20_000.0


def best_placements(plots: list[tuple[int, np.ndarray]], stones: np.ndarray, names: np.ndarray, tolerance: float, longest: float, scales: tuple[float, float], block: int = 1_000_000) -> list[tuple]:
    """The best pose of each plot (name, corners in ring order) on the stones: rows of plot, pose, angle, scale, tx, ty, inliers, residual.

    All poses count, ``block`` pairs of stones and about as many corners at a time; of a plot only the best so far is kept:
    most inliers, then the smallest residual to six digits, then the smallest key. A pose is judged in full only if as many
    of its corners as the best one's inliers may have a stone nearby (Nearby), so those left out can't be the best.
    Edges with the fewest pairs go first: after them n - m + 1 corners of the n tell that a pose has less than m.
    """
    if not plots or len(stones) < 2:
        return []
    order = np.lexsort((names,))
    spots, code = Spots(stones[order], tolerance), np.unique(names, return_inverse=True)[1]
    spot_code = code[order]
    size = np.array([len(r) for _, r in plots])
    ring = np.zeros((len(plots), size.max(), 2))
    for i, (_, r) in enumerate(plots):
        ring[i, : len(r)] = r
    own, at = np.nonzero(np.arange(size.max())[None, :] < size[:, None])
    a, b = ring[own, at], ring[own, (at + 1) % size[own]]
    length = np.hypot(*(b - a).T)
    sound = (length > 0) & (length <= longest)
    own, a, b, length = own[sound], a[sound], b[sound], length[sound]
    if not len(own):
        return []
    turned = np.arctan2(*(b - a).T[::-1])
    spot, origin, along = stones @ (1, 1j), a @ (1, 1j), (b - a) @ (1, 1j)
    twice = np.concatenate([np.tile(r @ (1, 1j), 2) for _, r in plots])  # so the corners after an edge are a slice
    after = (2 * (np.cumsum(size) - size))[own] + at[sound] + 2
    across = np.array([np.hypot(*np.ptp(r, axis=0)) for _, r in plots]) * scales[1]
    odd = ~(across <= WIDEST * tolerance)
    nearby = Nearby(stones, tolerance, float(across[~odd].max(initial=0.0)))
    best: dict[int, tuple] = {}
    need = np.zeros(len(plots), int)  # inliers of the best so far

    def score(edge: np.ndarray, p: np.ndarray, q: np.ndarray, gap: np.ndarray) -> None:
        scale = gap / length[edge]
        fits = (scale >= scales[0]) & (scale <= scales[1])
        edge, p, q, scale = edge[fits], p[fits], q[fits], scale[fits]
        if not len(edge):
            return
        plot = own[edge]
        angle = np.arctan2(q[:, 1] - p[:, 1], q[:, 0] - p[:, 0]) - turned[edge]
        c, s = scale * np.cos(angle), scale * np.sin(angle)
        tx, ty = p[:, 0] - (c * a[edge, 0] - s * a[edge, 1]), p[:, 1] - (s * a[edge, 0] + c * a[edge, 1])
        n = size[plot].max()
        hit, total, hits = np.full((len(plot), n), -1), np.zeros(len(plot)), np.zeros(len(plot), int)
        for k in range(n):
            on = np.flatnonzero(size[plot] > k)
            x, y = ring[plot[on], k].T
            found, d = spots.nearest(c[on] * x - s[on] * y + tx[on], s[on] * x + c[on] * y + ty[on])
            near = found >= 0
            hit[on[near], k] = spot_code[found[near]]
            total[on[near]] += d[near]
            hits[on[near]] += 1
        hit.sort(axis=1)
        inliers = (hit[:, :1] >= 0).sum(axis=1) + ((hit[:, 1:] >= 0) & (hit[:, 1:] != hit[:, :-1])).sum(axis=1)
        residual = total / np.maximum(hits, 1)
        rough = np.round(residual, 6)
        by = np.lexsort((rough, -inliers, plot))
        first = np.r_[True, plot[by][1:] != plot[by][:-1]]
        lead = by[first][np.cumsum(first) - 1]
        tied = by[(inliers[by] == inliers[lead]) & (rough[by] == rough[lead]) & (inliers[by] > 0)]
        held = {i: (-v[6], round(v[7], 6)) for i, v in best.items()}
        tied = tied[[held.get(i, (0, 0.0)) >= (-m, r) for i, m, r in zip(plot[tied].tolist(), inliers[tied].tolist(), rough[tied].tolist())]]
        half = lambda v, digits: np.copysign(np.floor(np.abs(v) * 10.0**digits + 0.5) / 10.0**digits, v)
        key = pose_keys(np.array([plots[i][0] for i in plot[tied]], np.int64), half(angle[tied], 4), half(tx[tied], 2), half(ty[tied], 2), half(scale[tied], 4))
        by = np.lexsort((key, plot[tied]))
        for j in by[np.r_[True, plot[tied][by][1:] != plot[tied][by][:-1]]] if len(by) else []:
            i = tied[j]
            new = (plots[plot[i]][0], int(key[j]), float(angle[i]), float(scale[i]), float(tx[i]), float(ty[i]), int(inliers[i]), float(residual[i]))
            rank = lambda v: (-v[6], round(v[7], 6), v[1])
            if plot[i] not in best or rank(new) < rank(best[plot[i]]):
                best[int(plot[i])] = new
                need[plot[i]] = new[6]

    def meet(p: np.ndarray, q: np.ndarray, gap: np.ndarray) -> None:
        """All poses on the pairs p, q and q, p."""
        by = np.argsort(gap)
        p, q, gap = np.stack([p[by], q[by]], axis=1).ravel(), np.stack([q[by], p[by]], axis=1).ravel(), np.repeat(gap[by], 2)
        place, way = nearby.at[p], ((spot[q] - spot[p]) / nearby.side).astype(np.complex64)
        low = np.searchsorted(gap, np.maximum(length - tolerance, length * scales[0] * (1 - 1e-9)))
        high = np.searchsorted(gap, np.minimum(length + tolerance, length * scales[1] * (1 + 1e-9)), "right")

        def sifted(e: int, least: int) -> tuple[np.ndarray, np.ndarray]:
            """Pairs that may give the edge's plot as many inliers as it has, or ``least``, and how many at most."""
            i, n, s, m = own[e], int(size[own[e]]), slice(low[e], high[e]), max(least, int(need[own[e]]))
            if odd[i]:
                return np.arange(s.start, s.stop), np.full(s.stop - s.start, n)
            k = (twice[after[e] : after[e] + n - 2] - origin[e]) / along[e]
            first = min(n - m + 1, len(k)) if m > 2 else len(k)
            most = nearby.count(place[s], way[s], k[:first])
            rows = np.flatnonzero(most >= (m - 2 if first == len(k) else 1))
            most = most[rows].astype(int) + 2
            rows += s.start
            if first == len(k) or not len(rows):
                return rows, most
            most += nearby.count(place[rows], way[rows], k[first:])
            kept = most >= m
            return rows[kept], most[kept]

        def judged(rest: tuple, whole: bool) -> tuple:
            """What is left when those of each plot that may have the most inliers are judged, if that may be more than it has; ``whole``: until none is left."""
            edge, pair, most = rest
            while len(edge):
                plot = own[edge]
                top = np.zeros(len(plots), int)
                for v in np.unique(most):
                    top[plot[most == v]] = v
                chosen = (most == top[plot]) & (whole | (most > need[plot]))
                rows, step = np.flatnonzero(chosen), max(1, block // int(size.max()))
                for i in range(0, len(rows), step):
                    r = rows[i : i + step]
                    score(edge[r], stones[p[pair[r]]], stones[q[pair[r]]], gap[pair[r]])
                left = ~chosen & (most >= need[plot])
                edge, pair, most = edge[left], pair[left], most[left]
                if not whole:
                    break
            return edge, pair, most

        def together(rest: tuple, held: list) -> tuple:
            e, pair, most = zip((0, *rest[1:]), *held)
            edge = np.repeat(e[1:], [len(v) for v in pair[1:]]).astype(int)
            return np.r_[rest[0], edge], np.concatenate(pair), np.concatenate(most)

        by = np.lexsort((high - low, own))
        rank = np.arange(len(by)) - np.searchsorted(own[by], own[by])
        rest = none = (np.zeros(0, int),) * 3
        for turn in range(5):
            if turn == 4:  # plots with no third corner on a stone
                rest = judged(rest, True)
            held, count = [], len(rest[0])
            for e in by[(rank == turn) if turn < 3 else (rank >= 3) if turn == 3 else need[own[by]] < 3].tolist():
                if high[e] <= low[e]:
                    continue
                pair, most = sifted(e, 3 if turn < 4 else 0)
                held.append((e, pair, most))
                count += len(pair)
                if count >= block:
                    judged(together(rest, held), True)
                    rest, held, count = none, [], 0
            rest = judged(together(rest, held), turn == 4)

    by = np.argsort(stones[:, 0], kind="stable")
    xs, farthest = stones[by, 0], min(longest * scales[1], float((length + tolerance).max()))
    held, count, begin = [], 0, 0
    while begin < len(by):
        high = int(np.searchsorted(xs, xs[begin] + 1.25 * farthest, "right"))
        end = max(begin + 1, min(begin + block // (high - begin), int(np.searchsorted(xs, xs[begin] + 0.25 * farthest, "right"))))
        left, right = by[begin:end], by[begin:high]
        dx, dy = stones[left, 0][:, None] - stones[right, 0], stones[left, 1][:, None] - stones[right, 1]
        i, j = np.nonzero(dx * dx + dy * dy <= farthest * farthest * (1 + 1e-9))
        gap = np.hypot(dx[i, j], dy[i, j])
        kept = (gap <= farthest) & (i < j) & (code[left[i]] != code[right[j]])
        held.append((left[i[kept]], right[j[kept]], gap[kept]))
        count, begin = count + int(kept.sum()), end
        if count >= block or begin >= len(by):
            meet(*[np.concatenate(v) for v in zip(*held)])
            held, count = [], 0
    return list(best.values())
