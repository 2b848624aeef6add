import math

import numpy as np

from parcelwright.functions.kernels import moved
from parcelwright.plans.matched import placed_plots


def test_closed_large_and_long_rings_are_placed_exactly(spark, tmp_path):
    plot = np.array([(0, 0), (170, 3), (181, 62), (140, 95), (133.3, 131), (61, 140.2), (12, 101), (-9, 47)], float)
    there = moved(plot, (math.radians(35), 1.0, 783_000.4, 1_241_000.4))
    ring = [(float(x), float(y)) for x, y in plot + (500_000, 1_000_000)]
    spark.createDataFrame([(1, 7, ring + ring[:1]), (2, 7, ring[:2] + ring[:1])], "parcel_id long, lgd_village_code long, polygon array<struct<x double, y double>>").write.parquet(f"{tmp_path}/parcels.parquet")
    spark.createDataFrame([(i, 7, float(x), float(y)) for i, (x, y) in enumerate(there)], "stone_id long, lgd_village_code long, x double, y double").write.parquet(f"{tmp_path}/stones.parquet")
    got = placed_plots(spark, str(tmp_path)).collect()
    assert [(r.plot, r.inliers) for r in got] == [(1, 8)]
    assert got[0].residual < 1e-3 and abs(math.cos(got[0].angle - math.radians(35)) - 1) < 1e-9
