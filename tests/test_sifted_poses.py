import numpy as np

from parcelwright.functions import kernels
from parcelwright.operators import matching


def _village(seed: int, n: int = 250):
    """Rings of many kinds, some laid on stones, among far, doubled and crowded stones; the origin is far off, as on a map."""
    r = np.random.default_rng(seed)
    origin = np.array([250_000.0, 908_000.0])
    spots = [origin + r.uniform(0, 300, (n, 2)), origin + r.normal(50, 1.5, (40, 2)), origin * (1000, 1) + r.uniform(0, 60, (12, 2))]
    plots = []
    for k in range(14):
        ring = r.uniform(0, 80, (int(r.integers(3, 9)), 2))
        if k % 3:
            there = kernels.moved(ring, (k * 0.7, 1.0, *(origin + r.uniform(50, 250, 2)))) + r.uniform(-0.2, 0.2, ring.shape)
            spots.append(there[: len(there) - (k % 3 - 1)])
        plots.append((k, ring))
    plots.append((20, np.array([(0, 0), (0.4, 0), (0.4, 0), (30, 3), (0, 40)], float)))  # a short edge, a corner twice
    plots.append((21, np.array([(0, 0), (25_000, 0), (40, 0.0)], float)))  # a corner far away
    plots.append((22, r.uniform(0, 3, (300, 2)).cumsum(axis=0)))  # more corners than a byte counts
    plots.append((23, np.array([(0, 0), (3000, 1), (3000, 4)], float)))  # no third corner on a stone
    stones = np.concatenate(spots)
    return plots, stones, r.permutation(len(stones))


def _placed(monkeypatch, widest: float, seed: int, block: int):
    """The placements, and how many corners were laid on the stones."""
    seen, nearest = [0], kernels.Spots.nearest

    def counted(self, x, y):
        seen[0] += len(x)
        return nearest(self, x, y)

    with monkeypatch.context() as m:
        m.setattr(kernels, "WIDEST", widest, raising=False)
        m.setattr(kernels.Spots, "nearest", counted)
        return sorted(kernels.best_placements(*_village(seed), 0.5, 90.0, (0.9, 1.1), block)), seen[0]


def test_sifted_poses_give_the_best_of_all(monkeypatch):
    for seed, block in ((1, 1_000_000), (2, 60_000)):
        few, judged = _placed(monkeypatch, 20_000.0, seed, block)
        whole, every = _placed(monkeypatch, 0.0, seed, block)
        best = lambda rows: [(v[0], v[1], v[6], round(v[7], 6)) for v in rows]
        assert best(few) == best(whole) and len(few) == 18
        assert {v[6] for v in few} >= {2, 3, 6}


def test_few_poses_are_judged_in_full(monkeypatch):
    plain = [v for v in _village(3)[0] if v[0] < 14]
    monkeypatch.setattr(f"{__name__}._village", lambda seed, of=_village: (plain, *of(seed)[1:]))
    few, judged = _placed(monkeypatch, 20_000.0, 3, 1_000_000)
    whole, every = _placed(monkeypatch, 0.0, 3, 1_000_000)
    assert few == whole and judged * 20 < every


def test_a_bitmap_never_says_no_where_a_place_is_near():
    r = np.random.default_rng(4)
    xy = np.concatenate([r.uniform(0, 400, (500, 2)) + (250_000, 908_000), r.uniform(-1e9, 1e9, (30, 2))])
    for widest in (50.0, 9000.0):
        found = kernels.Nearby(xy, 0.5, widest)
        p = r.integers(0, len(xy), 20_000)
        to = np.where(r.random(20_000) < 0.5, r.integers(0, 500, 20_000), p)
        rim = r.uniform(0, 2 * np.pi, 20_000)
        there = xy[to] + 0.4999999 * np.stack([np.cos(rim), np.sin(rim)], axis=1)
        step = there - xy[p]
        near = np.hypot(*step.T) <= widest
        count = found.count(found.at[p[near]], ((step[near] / found.side) @ (1, 1j) * 2).astype(np.complex64), np.array([0.5, 0.5]))
        assert near.sum() > 5000 and (count == 2).all()
        apart = r.uniform(0, 400, (20_000, 2)) + (250_000, 908_000)
        far = np.full(20_000, found.at[0])
        assert found.count(far, (((apart - xy[0]) / found.side) @ (1, 1j)).astype(np.complex64), np.array([1.0])).mean() < 0.1


def test_only_large_areas_are_dealt_to_parts(spark, monkeypatch):
    r = np.random.default_rng(6)
    corners = [(area * 100 + k, area, i, float(x), float(y)) for area in range(12) for k in range(20 if area == 7 else 1) for i, (x, y) in enumerate(r.uniform(0, 50, (4, 2)))]
    stones = [(area * 100 + i, area, float(x), float(y)) for area in range(12) for i, (x, y) in enumerate(r.uniform(2000, 2100, (9, 2)))]
    c, s = spark.createDataFrame(corners, "plot long, area long, at int, x double, y double"), spark.createDataFrame(stones, "stone long, area long, x double, y double")
    plan = matching.placed_best(c, s, 0.5, 90.0)._jdf.queryExecution().optimizedPlan().toString()
    assert "area#" in plan and "= 7)" in plan and not [k for k in range(12) if k != 7 and f"= {k})" in plan]
    want = matching.best_poses(matching.poses(c, s, 0.5, 90.0)).select("plot", "pose", "inliers").collect()
    assert sorted(map(tuple, matching.placed_best(c, s, 0.5, 90.0).select("plot", "pose", "inliers").collect())) == sorted(map(tuple, want))
