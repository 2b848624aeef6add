import math

import numpy as np
import pytest

from parcelwright.functions.kdtree import KdSplits, pairs_within, plane_vectors, points_in_rings
from parcelwright.operators.proximity import EARTH_RADIUS, near_and_inside

POINTS = "id long, x double, y double, grp string, kind string"
REGIONS = "id long, ring array<struct<x double, y double>>, grp string, xs int"


def brute_pairs(points, radius):
    return {(i, j) for i in range(len(points)) for j in range(i + 1, len(points)) if np.sqrt(((points[i] - points[j]) ** 2).sum()) <= radius}


@pytest.mark.parametrize("n,radius", [(0, 1.0), (1, 1.0), (2, 5.0), (300, 0.7), (300, 0.0), (500, 20.0)])
def test_local_tree_against_brute_force(n, radius):
    rng = np.random.default_rng(n)
    points = plane_vectors(rng.integers(0, 40, n) / 3.0, rng.integers(0, 40, n) / 3.0)  # many ties
    got = [tuple(sorted(p)) for i, j in pairs_within(points, radius) for p in zip(i.tolist(), j.tolist())]
    assert len(got) == len(set(got))
    assert set(got) == brute_pairs(points, radius)


def test_splits_give_each_point_one_home_within_its_reach():
    rng = np.random.default_rng(1)
    points = plane_vectors(rng.normal(size=400), rng.integers(0, 3, 400))
    splits = KdSplits.fit(points[:100], 16)
    home = splits.home(points)
    row, cell = splits.reach(points - 0.1, points + 0.1)
    reached = set(zip(row.tolist(), cell.tolist()))
    assert len(reached) == len(row)
    assert all((i, h) in reached for i, h in enumerate(home.tolist()))


def inside(x, y, ring):
    odd = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        side = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
        if side == 0 and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by):
            return False
        if (ay <= y < by and side > 0) or (by <= y < ay and side < 0):
            odd = not odd
    return odd


def test_sweep_against_brute_force():
    rng = np.random.default_rng(3)
    rings = []
    for _ in range(60):
        k = int(rng.integers(3, 9))
        angle = np.sort(rng.uniform(0, 2 * math.pi, k))
        cx, cy = rng.integers(0, 12, 2)
        ring = [(round(cx + 3 * math.cos(a)), round(cy + 3 * math.sin(a))) for a in angle]
        rings.append(ring if rng.random() < 0.5 else ring + ring[:1])
    x, y = rng.integers(-2, 15, 500).astype(float), rng.integers(-2, 15, 500).astype(float)
    of = np.repeat(np.arange(len(rings)), [len(r) for r in rings])
    flat = np.array([p for r in rings for p in r], float)
    got = [p for i, r in points_in_rings(x, y, of, flat[:, 0], flat[:, 1]) for p in zip(i.tolist(), r.tolist())]
    want = {(i, r) for i in range(500) for r, ring in enumerate(rings) if inside(x[i], y[i], ring)}
    assert len(got) == len(set(got)) and set(got) == want


def test_operator_over_many_cells(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), float(rng.integers(0, 60)) / 4, float(rng.integers(0, 60)) / 4, "ab"[int(rng.integers(0, 2))], "clash") for i in range(600)]
    rows += rows[:50] + [(7, 200.0, 200.0, "a", None), (9, 200.1, 200.0, "a", None)]
    rows += [(1000, None, 1.0, "a", None), (1001, float("nan"), 1.0, "a", None), (1002, 0.0, 0.0, "a", None), (1003, 0.0, 0.0, "a", None), (None, 1.0, 1.0, "a", None), (1004, float("inf"), 1.0, "a", None)]
    square = [(1.1, 1.1), (9.3, 1.1), (9.3, 8.2), (1.1, 8.2)]
    regions = [(1, square, "a", 1), (2, square + square[:1], "b", 1), (3, [(0.0, 0.0), (5.0, 5.0)], "a", 1), (4, None, "a", 1), (5, [], "a", 1), (6, [(0.0, 0.0), None, (float("nan"), 2.0), (3.0, 1.0)], "a", 1), (7, [(2.0, 2.0), (4.0, 2.0), (4.0, 4.0), (2.0, 4.0)], None, 1)]
    points = spark.createDataFrame(rows, POINTS)
    got = {tuple(r) for r in near_and_inside(points, spark.createDataFrame(regions, REGIONS), 0.3, cell_rows=20).collect()}
    known = {(i, x, y, g) for i, x, y, g, _ in rows if i is not None and x is not None and math.isfinite(x) and not (x == 0 and y == 0)}
    near = {("near", a[0], b[0]) for a in known for b in known if a[3] == b[3] and a[0] < b[0] and math.sqrt((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2) <= 0.3}
    within = {("inside", i, k) for i, x, y, g in known for k, ring, rg, _ in regions[:2] if g == rg and inside(x, y, ring)}
    assert ("near", 7, 9) in got
    assert got == near | within


def test_sphere_uses_great_circle_distance(spark):
    rng = np.random.default_rng(6)
    rows = [(i, float(rng.uniform(179.9, 180.1)), float(rng.uniform(-0.1, 0.1)), "a", "k") for i in range(200)]
    rows = [(i, x if x <= 180 else x - 360, y, g, k) for i, x, y, g, k in rows] + [(900, 10.0, 90.0, "a", "k"), (901, -120.0, 89.99999, "a", "k")]

    def great_circle(a, b):
        p, q = math.radians(a[2]), math.radians(b[2])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
        return 2 * EARTH_RADIUS * math.asin(math.sqrt(h))

    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and great_circle(a, b) <= 2000}
    got = near_and_inside(spark.createDataFrame(rows, POINTS), None, 2000.0, "sphere", cell_rows=16)
    assert {(r.key_a, r.key_b) for r in got.collect()} == want and (900, 901) in want


def test_empty_tables(spark):
    assert near_and_inside(spark.createDataFrame([], POINTS), spark.createDataFrame([], REGIONS), 0.6).collect() == []
    with pytest.raises(ValueError):
        near_and_inside(spark.createDataFrame([], POINTS), None, 1.0, "taxicab")
