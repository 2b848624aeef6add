import numpy as np

from parcelwright.functions import kernels as K
from parcelwright.operators import shapes


def test_hulls_lose_no_corner_and_large_keys_have_both(spark):
    rng = np.random.default_rng(3)
    angle = np.arange(90) * 2 * np.pi / 90
    circle = np.column_stack([np.cos(angle), np.sin(angle)]) * 3
    many = rng.uniform(0, 400, (5_000, 2)) + (700_000, 1_200_000)
    rows = [(1, float(x), float(y)) for x, y in circle] + [(2, float(x), float(y)) for x, y in many] + [(2, float("nan"), 1.0), (None, 1.0, 1.0)]
    got = {r.k: r for r in shapes.hulls(spark.createDataFrame(rows, "k long, x double, y double").repartition(5), "k").collect()}
    assert got[1].corners == 90 and abs(got[1].area - abs(K.signed_area(circle))) < 1e-9
    assert got[2].corners == len(K.convex_hull(many)) and got[2].concave_corners > got[2].corners
    assert 0.9 * got[2].area < got[2].concave_area <= got[2].area and got[None].corners == 1


def test_triangles_have_empty_circles():
    grid = np.array([(x, y) for x in range(9) for y in range(9)], float)
    assert len(K.delaunay(grid)) == 2 * 8 * 8
    points = np.random.default_rng(4).uniform(0, 50, (60, 2))
    for a, b, c in K.delaunay(points):
        (bx, by), (cx, cy) = points[b] - points[a], points[c] - points[a]
        d = 2 * (bx * cy - by * cx)
        middle = np.array([cy * (bx * bx + by * by) - by * (cx * cx + cy * cy), bx * (cx * cx + cy * cy) - cx * (bx * bx + by * by)]) / d
        assert (np.hypot(*(points - points[a] - middle).T) >= np.hypot(*middle) * (1 - 1e-9)).all()
