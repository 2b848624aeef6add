import math

import numpy as np
import pytest

from parcelwright.functions import kernels as K

SQUARE = np.array([(0, 0), (10, 0), (10, 10), (0, 10)], float)


def scanlines(a, b, n=1500):
    """Area of the common part by horizontal lines."""
    low, high = max(a[:, 1].min(), b[:, 1].min()), min(a[:, 1].max(), b[:, 1].max())
    if high <= low:
        return 0.0
    step, total = (high - low) / n, 0.0

    def spans(ring, y):
        q = np.roll(ring, -1, axis=0)
        x = sorted(p[0] + (y - p[1]) / (r[1] - p[1]) * (r[0] - p[0]) for p, r in zip(ring, q) if (p[1] <= y) != (r[1] <= y))
        return list(zip(x[::2], x[1::2]))

    for k in range(n):
        y = low + (k + 0.5) * step
        total += sum(max(0.0, min(e, g) - max(d, f)) for d, e in spans(a, y) for f, g in spans(b, y)) * step
    return total


def star(rng, n):
    angle = np.sort(rng.uniform(0, 2 * math.pi, n))
    return np.column_stack([np.cos(angle), np.sin(angle)]) * rng.uniform(3, 10, n)[:, None] + rng.uniform(-3, 3, 2)


def test_overlap_of_concave_rings():
    rng = np.random.default_rng(1)
    for _ in range(8):
        a, b = star(rng, 9), star(rng, 7)[::-1]
        assert abs(K.overlap_area(a, b) - scanlines(a, b)) < 0.05
    assert K.overlap_area(SQUARE, SQUARE + 20) == 0.0
    assert np.allclose(K.overlap_measures(SQUARE + 700_000, SQUARE + 700_005), (25, 0.25, 25 / 175))


def test_hulls():
    rng = np.random.default_rng(2)
    points = rng.uniform(0, 10, (200, 2))
    hull = K.convex_hull(points)
    q = np.roll(hull, -1, axis=0)
    side = (q - hull)[:, None, 0] * (points - hull[:, None])[..., 1] - (q - hull)[:, None, 1] * (points - hull[:, None])[..., 0]
    assert (side >= -1e-9).all() and K.signed_area(hull) > 0
    grid = np.array([(x, y) for x in range(12) for y in range(12) if x < 4 or y < 4], float)
    concave = K.concave_hull(grid, 1.2)
    assert abs(abs(K.signed_area(concave)) - (11 * 3 + 3 * 8)) < 1.01 and abs(K.signed_area(K.convex_hull(grid))) > 80
    assert len(K.concave_hull(grid[:3])) <= 3


def test_delaunay_circles_are_empty():
    points = np.random.default_rng(3).uniform(0, 1, (40, 2))
    triangles = K.delaunay(points)
    area = sum(abs((points[b] - points[a])[0] * (points[c] - points[a])[1] - (points[b] - points[a])[1] * (points[c] - points[a])[0]) / 2 for a, b, c in triangles)
    assert area <= K.signed_area(K.convex_hull(points)) + 1e-9 and area > 0.95 * K.signed_area(K.convex_hull(points))


def test_faces():
    cross = [((0, 0), (2, 0)), ((2, 0), (4, 0)), ((4, 0), (4, 2)), ((4, 2), (2, 2)), ((2, 2), (0, 2)), ((0, 2), (0, 0)), ((2, 0), (2, 2)), ((4, 2), (6, 6))]
    assert sorted(K.signed_area(f) for f in K.faces(cross)) == [4.0, 4.0]
    assert K.faces([((0, 0), (1, 0)), ((1, 0), (2, 3))]) == []


def test_simplification():
    line = np.array([(0, 0), (1, 0.1), (2, -0.1), (3, 5), (4, 6), (5, 7), (6, 8.1), (7, 9)], float)
    assert K.simplify(line, 1.0).tolist() == [[0, 0], [2, -0.1], [3, 5], [7, 9]]
    ring = np.array([(math.cos(a) * 50, math.sin(a) * 50) for a in np.linspace(0, 2 * math.pi, 40, endpoint=False)])
    assert len(K.skeleton(ring, 8)) <= 8
    assert K.visvalingam(line, 0.5).tolist()[0] == [0, 0] and len(K.visvalingam(line, 1e9)) == 2


def test_planted_pose_is_found():
    plot = np.array([(0, 0), (50, 0), (50, 35), (0, 22)], float)
    pose = (math.radians(20), 1.0, 783_000.0, 1_241_000.0)
    there = K.moved(plot, pose)
    assert np.allclose(K.rigid_fit(plot, there), pose)
    assert np.allclose(K.rigid_fit(plot, K.moved(plot, (0.3, 1.7, 5.0, 6.0)), True), (0.3, 1.7, 5.0, 6.0))
    near, rest = K.icp(plot, there[[2, 0, 3, 1]], (pose[0] + 0.1, 1.0, pose[2] + 2, pose[3] - 2))
    assert np.allclose(near, pose) and rest < 1e-6


def test_adjustment_holds_fixed_points_and_lengths():
    start = np.array([(0, 0), (9, 0), (9, 11), (0, 9), (50, 50)], float)
    got = K.adjust(start, {0: np.array([0.0, 0.0]), 1: np.array([10.0, 0.0])}, [(1, 2, 10.0), (2, 3, 10.0), (3, 0, 10.0), (0, 2, math.sqrt(200))])
    assert np.allclose(got[:4], SQUARE, atol=1e-3) and np.allclose(got[4], (50, 50))


def test_matching_takes_each_target_once():
    pairs = K.matched_once(np.array([(0, 0), (0.4, 0), (9, 9)], float), np.array([(0.3, 0), (1, 0)], float), 2.0)
    assert sorted((i, j) for i, j, _ in pairs) == [(0, 1), (1, 0)] and K.matched_once(np.zeros((0, 2)), SQUARE, 1.0) == []


@pytest.mark.parametrize("n", [0, 1, 2])
def test_small_inputs(n):
    points = SQUARE[:n]
    assert K.overlap_area(points, SQUARE) == 0.0 and len(K.convex_hull(points)) == n


def test_many_overlaps_at_once_equal_one_by_one():
    from parcelwright.functions.kernels import overlap_area, overlap_areas

    rng = np.random.default_rng(8)

    def ring():
        n = int(rng.integers(3, 10))
        angle, far = np.sort(rng.random(n) * 2 * np.pi), rng.random(n) + 0.3
        made = np.stack([far * np.cos(angle), far * np.sin(angle)], axis=1) + rng.random(2) * 1.5 + 1e5
        return made[::-1] if rng.random() < 0.5 else made

    left, right = [ring() for _ in range(120)] + [np.zeros((0, 2)), np.zeros((2, 2)), ring()], [ring() for _ in range(122)] + [np.zeros((1, 2))]
    for batch in (1, 500, 1_000_000):
        assert np.allclose(overlap_areas(left, right, batch), [overlap_area(a, b) if len(a) else 0.0 for a, b in zip(left, right)], atol=1e-6)
    assert overlap_areas([], []).tolist() == []
