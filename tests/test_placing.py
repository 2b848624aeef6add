import math

from pyspark.sql import functions as F

from parcelwright.functions import plane, text
from parcelwright.operators import matching, placing
from parcelwright.sources import sinks


def test_named_edges_and_best_of_two(spark):
    edges = spark.createDataFrame([(1, 0, 0.0, 0.0, 9.0, 0.0), (1, 1, 9.0, 0.0, 9.0, 9.0), (2, 0, 0.0, 0.0, 1.0, 0.0)], "plot long, eid int, x1 double, y1 double, x2 double, y2 double")
    labels = spark.createDataFrame([(1, "a", 8.9, 5.0), (1, "a", 3.0, 4.0), (1, "b", 9.0, 0.0), (1, None, 0.0, 0.0), (3, "a", 0.0, 0.0)], "plot long, name string, x double, y double")
    got = {(r.plot, r["name"]): (r.eid, r.gap) for r in placing.named_edges(edges, labels).collect()}
    assert got == {(1, "a"): (1, 0.1), (1, "b"): (0, 0.0)}
    scores = spark.createDataFrame([("k", "x", 4.0), ("k", "y", 2.0), ("k", "z", 2.0), ("l", "b", 5.0), ("l", "a", 5.0), ("m", "only", 0.5)], "key string, value string, s double")
    best = {r.key: (r.value, r.score, r.second, r.decisive) for r in placing.best_and_second(scores, ["key"], "value", F.col("s"), 1.0, 1.5).collect()}
    assert best == {"k": ("x", 4.0, 2.0, True), "l": ("a", 5.0, 5.0, False), "m": ("only", 0.5, None, False)}


def test_fences_and_distances(spark):
    ring = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (5.0, 2.0), (0.0, 10.0)]
    points = [(1, 5.0, 1.0), (2, 5.0, 5.0), (3, -2.0, 5.0), (4, 30.0, 5.0), (5, None, 1.0), (6, 1.0, 5.0)]
    found = placing.within_fences(spark.createDataFrame(points, "pid long, x double, y double"), spark.createDataFrame([(7, ring), (8, None), (9, ring[:2])], "fid long, ring array<struct<x double, y double>>"), 2.5, 4.0)
    got = {(r.pid, r.fid): round(r.gap, 6) for r in found.collect()}
    assert set(got) == {(1, 7), (2, 7), (3, 7), (6, 7)} and got[1, 7] == got[6, 7] == 0 and got[3, 7] == 2 and 1.5 < got[2, 7] < 1.7


def test_small_expressions(spark):
    row = spark.range(1).select(
        plane.best_skip(F.array(*[F.lit(v) for v in (3.0, 9.0, 4.0)]), plane.fingerprint(F.array(F.lit(4.0), F.lit(3.0)))).alias("skip"),
        plane.turned_text(F.lit(1.0), F.lit(0.0), F.lit(300.0), F.lit(math.pi / 2), F.lit(2.0), F.lit(5.0), F.lit(5.0)).alias("t"),
        text.first_coordinate(F.lit('{"coordinates": [[[ 1.5 , -2e1], [3, 4]]]}')).alias("c"), text.first_coordinate(F.lit("[]")).alias("none"),
        text.check_line(F.lit("area"), F.lit(None).cast("string"), F.lit(" off ")).alias("line"), text.stated_scale(F.lit("1 : 2,000")).alias("scale"),
        text.kind_of_text(F.lit("ЗА")).alias("part"), text.listed_text(F.array(F.lit("a"), F.lit(None), F.lit("b"), F.lit("c")), 2).alias("listed"),
    ).collect()[0]
    assert row.skip.skip == 1 and row.skip.rms == 0 and (round(row.t.x, 6), round(row.t.y, 6), round(row.t.rotation, 6)) == (5, 7, 30)
    assert (row.c.x, row.c.y, row.none, row.scale, row.part, row.listed) == (1.5, -20.0, None, 2000, "part", "a; b (+1)") and row.line == "area" + " " * 20 + "?: off"


def test_fingerprints_candidates_and_lists(spark):
    left = spark.createDataFrame([(1, [3.0, 4.0, 5.0]), (2, [1.0, 1.0]), (3, None)], "lid long, lengths array<double>")
    right = spark.createDataFrame([(11, [5.0, 3.0, 4.0]), (10, [4.0, 5.0, 3.0]), (12, [9.0, 9.0, 9.0])], "rid long, lengths array<double>")
    assert [(r.lid, r.rid, r.rms) for r in matching.by_fingerprint(left, right, 1.0, 2.0).collect()] == [(1, 10, 0.0)]
    a, b = spark.createDataFrame([(1, "k", 5.0)], "lid long, k string, v double"), spark.createDataFrame([(1, "k", 4.0), (2, "k", 6.0), (3, "k", None), (4, "z", 5.0)], "rid long, k string, w double")
    assert [(r.rid, r.place) for r in matching.ranked_candidates(a, b, ["k"], -F.abs(F.col("v") - F.col("w")), 5).orderBy("place").collect()] == [(1, 1), (2, 2)]
    rows = spark.createDataFrame([("g", 3), ("g", 1), ("g", 2)], "g string, n int")
    assert {(r.n, r.dx, r.dy) for r in sinks.staged(rows, "g", [F.col("n")], 2, 10.0).collect()} == {(1, 0.0, 0.0), (2, 10.0, 0.0), (3, 0.0, -10.0)}
    corner = sinks.located_corners(spark.createDataFrame([(1, [(500_000.0, 0.0)])], "k int, ring array<struct<x double, y double>>"), ["k"], F.lit(43)).collect()[0]
    assert (corner.lon, corner.lat, corner.x) == ("75.0000000", "0.0000000", "500000.000")


def test_projected_metres(spark):
    """On the central meridian and the equator the position is known: the scale there is 0.9996."""
    got = spark.range(1).select(plane.to_utm(F.lit(75.0), F.lit(0.0), F.lit(43)).alias("m"), plane.to_utm(F.lit(75.0), F.lit(90.0), F.lit(43)).alias("pole")).collect()[0]
    assert abs(got.m.x - 500_000) < 1e-6 and abs(got.m.y) < 1e-6
    assert abs(got.pole.y - 0.9996 * 10_001_965.729) < 0.01  # a quarter of the meridian of WGS84
