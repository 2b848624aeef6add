import math
import random

from pyspark.sql import functions as F

from parcelwright.functions.kernels import moved
from parcelwright.operators import matching


def test_planted_pose_is_found(spark):
    import numpy as np

    plot = np.array([(0, 0), (50, 0), (50, 35), (0, 22)], float)
    there = moved(plot, (math.radians(20), 1.0, 783_000.0, 1_241_000.0))
    rng = random.Random(1)
    stones = [(i, 7, float(x), float(y)) for i, (x, y) in enumerate(there)] + [(100 + i, 7, 783_000 + rng.uniform(-90, 90), 1_241_000 + rng.uniform(-90, 90)) for i in range(20)] + [(900, 8, 783_000.0, 1_241_000.0)]
    corners = [("p", 7, i, float(x), float(y)) for i, (x, y) in enumerate(plot)] + [("q", 9, i, float(x), float(y)) for i, (x, y) in enumerate(plot)]
    got = matching.best_poses(matching.poses(spark.createDataFrame(corners, "plot string, area int, at int, x double, y double"), spark.createDataFrame(stones, "stone long, area int, x double, y double"), 0.3, 80.0)).collect()
    assert [(r.plot, r.inliers) for r in got] == [("p", 4)]
    assert abs(got[0].angle - math.radians(20)) < 1e-4 and abs(got[0].tx - 783_000) < 0.1 and got[0].residual < 0.01


def test_edges_and_segments(spark):
    edges = [(1, 10, 0.0, 0.0, 10.0, 0.0), (1, 11, 10.0, 0.0, 10.0, 10.0), (2, 20, 10.0, 0.5, 0.0, 0.2), (3, 30, 0.0, 0.0, 9.0, 3.0)]
    frame = spark.createDataFrame(edges, "plot int, eid int, x1 double, y1 double, x2 double, y2 double")
    assert [(r.plot_a, r.plot_b, r.edges, r.length) for r in matching.shared_edges(frame, 1.0).collect()] == [(1, 2, 1, 10.0)]
    points = spark.createDataFrame([(1, 5.0, 2.0), (2, 90.0, 90.0), (3, None, 1.0), (4, 5.0, 0.0)], "pid int, x double, y double")
    got = {r.pid: (r.sid, round(r.gap, 6)) for r in matching.nearest_segments(points, frame.drop("plot").withColumnRenamed("eid", "sid"), 3.0).collect()}
    assert got[4] == (10, 0.0) and set(got) == {1, 4}


def test_support_and_blocks(spark):
    rows = [(1, "a", 0.0, 0.0, 0.5), (2, "a", 100.0, 0.0, 0.9), (3, "b", 1.0, 0.0, 0.5), (4, "c", 0.0, 1.0, 0.5), (5, "b", 101.0, 0.0, 0.1)]
    frame = spark.createDataFrame(rows, "rid long, name string, x double, y double, confidence double")
    assert {(r.name, r.rid, r.support) for r in matching.supported_readings(frame, 5.0).collect()} == {("a", 1, 2), ("b", 3, 2), ("c", 4, 2)}
    blocks = matching.density_blocks(frame.select(F.col("rid").alias("node"), "name", "x", "y"), 5.0).collect()
    assert {r.node: r.block for r in blocks} == {1: 1, 3: 1, 4: 1, 2: 2, 5: 2}


def test_snapping_keeps_lone_and_far_corners(spark):
    rows = [(1, 1, 0, 0.0, 0.0), (2, 2, 0, 0.2, 0.0), (3, 1, 1, 9.0, 9.0), (4, 1, 2, 9.1, 9.0), (5, 3, 0, 50.0, 50.0)]
    got = {(r.plot, r.at): (round(r.x, 6), round(r.moved, 6)) for r in matching.snapped_corners(spark.createDataFrame(rows, "node long, plot int, at int, x double, y double"), 0.5, 1.0).collect()}
    assert got == {(1, 0): (0.1, 0.1), (2, 0): (0.1, 0.1), (1, 1): (9.0, 0.0), (1, 2): (9.1, 0.0), (3, 0): (50.0, 0.0)}


def test_nearest_values_and_ranges(spark):
    left = spark.createDataFrame([(1, "a", 5.0), (2, "a", 1.5), (3, "b", 1.0), (4, "a", None), (5, "c", 1.0)], "i int, k string, v double")
    right = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 9.0), ("b", None), ("c", 7.0)], "k string, w double")
    assert {r.i: r.nearest for r in matching.nearest_value(left, right, ["k"], "v", "w").collect()} == {1: 2.0, 2: 1.0, 3: None, 4: None, 5: 7.0}
    ranges = spark.createDataFrame([("x", 0.0, 3.0), ("y", 2.0, 40.0), ("z", 5.0, 1.0)], "r string, low double, high double")
    got = {(r.i, r.r) for r in matching.in_ranges(left, ranges, "v", "low", "high", 2.0).collect()}
    assert got == {(1, "y"), (2, "x"), (3, "x"), (5, "x")}


def test_bends_and_paths(spark):
    ring = [(0.0, 0.0), (5.0, 0.01), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
    assert spark.createDataFrame([(ring,)], "r array<struct<x double, y double>>").select(F.size(matching.without_bends(F.col("r")))).collect()[0][0] == 4
    paths = [
        ("rim1", 0.0, 0.0, 50.0, 0.0, 2.0, "black", False), ("rim2", 50.0, 0.0, 50.0, 40.0, 2.0, "black", False),
        ("short", 50.0, 0.0, 50.0, 0.0, 2.0, "black", False), ("stub", 50.0, 0.0, 53.0, 0.0, 2.0, "black", False),
        ("twice", 50.0, 0.0, 0.0, 0.0, 0.5, "black", False), ("inner", 0.0, 0.0, 20.0, 20.0, 0.5, "black", False),
        ("ref", 0.0, 0.0, 90.0, 0.0, 0.5, "grey", True), ("chain", 0.0, 0.0, 90.0, 0.0, 3.0, "blue", False),
    ]
    got = matching.classified_paths(spark.createDataFrame(paths, "path string, x1 double, y1 double, x2 double, y2 double, width double, colour string, dashed boolean"), 10.0, 1.5)
    assert {r.path: r.kind for r in got.collect()} == {"rim1": "boundary", "rim2": "boundary", "short": "boundary", "stub": "separation", "twice": "doubled", "inner": "internal", "ref": "reference", "chain": "chain"}
