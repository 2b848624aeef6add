import numpy as np
from pyspark.sql import functions as F

from parcelwright.functions.kernels import moved, pose_keys
from parcelwright.operators import matching


def test_placements_equal_the_best_of_all_poses_without_a_row_for_each(spark):
    r = np.random.default_rng(5)
    stones, corners = [], []
    for area in (1, 2):
        spots = r.uniform(2000, 2200, (40, 2))
        for k in range(6):
            ring = r.uniform(0, 60, (int(r.integers(3, 7)), 2))
            if k % 2:
                spots = np.vstack([spots, moved(ring, (k * 1.1, 1.0, 2050.0 + 20 * k, 2100.0)) + r.uniform(-0.1, 0.1, ring.shape)])
            corners += [(area * 10 + k, area, i, float(x), float(y)) for i, (x, y) in enumerate(ring)]
        stones += [(area * 1000 + i, area, float(x), float(y)) for i, (x, y) in enumerate(spots)]
    c, s = spark.createDataFrame(corners, "plot long, area long, at int, x double, y double"), spark.createDataFrame(stones, "stone long, area long, x double, y double")
    got = matching.placed_best(c, s, 0.5, 90.0, parts=2)
    assert "CoGroup" in got._jdf.queryExecution().executedPlan().toString()
    row = lambda v: (v.inliers, round(v.residual, 6), v.pose, round(v.angle, 6), round(v.tx, 4))
    want = {v.plot: row(v) for v in matching.best_poses(matching.poses(c, s, 0.5, 90.0)).collect()}
    assert {v.plot: row(v) for v in got.collect()} == want and len(want) == 12


def test_pose_keys_are_those_of_spark(spark):
    rows = [(7, 0.1234, -5.25), (-1, 0.0, -0.0), (600_000, 1e9, 3.5)]
    got = [v[0] for v in spark.createDataFrame(rows, "a long, b double, c double").select(F.xxhash64("a", "b", "c")).collect()]
    assert pose_keys(*[np.array(v) for v in zip(*rows)]).tolist() == got


def test_placed_plots_needs_no_row_for_a_pose(spark, tmp_path):
    from parcelwright.plans.matched import placed_plots

    spark.createDataFrame([(1, 7, [(0.0, 0.0), (30.0, 0.0), (30.0, 20.0)])], "parcel_id long, lgd_village_code long, polygon array<struct<x double, y double>>").write.parquet(f"{tmp_path}/parcels.parquet")
    spark.createDataFrame([(i, 7, x, y) for i, (x, y) in enumerate([(2000.0, 2000.0), (2030.0, 2000.0), (2030.0, 2020.0)])], "stone_id long, lgd_village_code long, x double, y double").write.parquet(f"{tmp_path}/stones.parquet")
    got = placed_plots(spark, str(tmp_path))
    text = got._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" in text and "Join" not in text
    assert [(v.plot, v.inliers) for v in got.collect()] == [(1, 3)]
