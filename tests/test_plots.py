import math

from pyspark.sql import functions as F

from parcelwright.operators import plots

EDGE = "plot int, eid int, x1 double, y1 double, x2 double, y2 double"


def test_best_edge_pairs(spark):
    rows = [(1, 1, 0.0, 0.0, 40.0, 0.0), (1, 2, 40.0, 0.0, 40.0, 30.0), (2, 5, 38.0, 2.0, 5.0, 1.0), (2, 6, 5.0, 1.0, 5.0, -30.0), (3, 9, 0.0, 90.0, 40.0, 90.0), (4, 7, 41.0, 100.0, 41.0, 130.0)]
    got = [(r.plot_a, r.plot_b, r.eid_a, r.eid_b, round(r.gap, 6)) for r in plots.best_edge_pairs(spark.createDataFrame(rows, EDGE), 5.0).collect()]
    assert got == [(1, 2, 1, 5, 1.5)]


def test_seats_and_shifts(spark):
    corners = spark.createDataFrame([("p", l, x, y) for l, x, y in (("A", 0.0, 0.0), ("B", 41.0, 0.0), ("C", 41.0, 27.0))] + [("q", "A", 0.0, 0.0)], "plot string, label string, x double, y double")
    controls = spark.createDataFrame([("p", "A", 100.0, 100.0), ("p", "B", 100.0, 141.0), ("p", "C", 73.0, 141.0), ("p", "Z", 0.0, 0.0), ("q", "A", 5.0, 5.0)], "plot string, label string, tx double, ty double")
    got = {r.plot: r for r in plots.seats_by_controls(corners, controls).collect()}
    assert got["p"].controls == 3 and abs(got["p"].angle - math.pi / 2) < 1e-9 and (round(got["p"].shift_x, 6), round(got["p"].shift_y, 6)) == (100, 100) and got["p"].baseline > 49
    assert got["q"].angle is None
    shift = spark.range(1).select(plots.rigid_shift(F.lit(0.0), F.lit(1.2), F.lit(5.0), F.lit(6.0), F.lit(10.0), F.lit(20.0)).alias("s")).collect()[0].s
    assert (round(shift.x, 6), round(shift.y, 6)) == (7, 10)
    placed = spark.createDataFrame([("p", i, x, y, x + 100.4, y + 100) for i, (x, y) in enumerate([(0.0, 0.0), (41.0, 0.0), (41.0, 27.0)])], "plot string, at int, x double, y double, px double, py double")
    stones = spark.createDataFrame([(1, 100.0, 100.0), (2, 141.0, 100.0), (3, 900.0, 0.0)], "stone long, x double, y double")
    fit = plots.refined_poses(placed, stones, 5.0).collect()
    assert [(r.plot, r.n, round(r.shift_x, 6)) for r in fit] == [("p", 2, 100.0)]


def test_ring_corners(spark):
    ring = spark.createDataFrame([(1, i, float(x), float(y)) for i, (x, y) in enumerate([(0, 0), (5, 0), (10, 0), (10, 10), (0, 10)])], "plot int, at int, x double, y double")
    stones = spark.createDataFrame([(1, "A", 0.2, 0.1), (1, "B", 10.0, 0.5), (1, "C", 10.0, 0.1), (1, "D", 10.0, 9.0), (1, "far", 50.0, 50.0), (2, "A", 0.0, 0.0)], "plot int, label string, x double, y double")
    got = [(r.at, r.label, round(r.length, 6)) for r in plots.ring_corners(ring, stones, 3.0).orderBy("at").collect()]
    assert got == [(0, "A", 10.0), (2, "C", 10.0), (3, "D", round(200**0.5, 6))]


def test_tokens(spark):
    schema = "tid long, page int, text string, x double, y double, confidence double"
    rows = [(1, 1, "45", 0.0, 0.0, 0.5), (2, 1, "45", 3.0, 0.0, 0.9), (3, 1, "145,6", 4.0, 0.0, 0.4), (4, 1, "45", 99.0, 0.0, 0.1), (5, 2, "45", 3.0, 0.0, 0.2), (6, 1, "7", 4.0, 1.0, 0.5)]
    assert sorted(r.tid for r in plots.distinct_tokens(spark.createDataFrame(rows, schema)).collect()) == [3, 4, 5, 6]
    kept, more = spark.createDataFrame(rows[3:4], schema), spark.createDataFrame([(10, 1, "x", 95.0, 0.0, 0.9), (11, 1, "y", 50.0, 0.0, 0.3), (12, 1, "z", 52.0, 0.0, 0.8), (13, 2, "w", 99.0, 0.0, 0.1)], schema)
    assert sorted(r.tid for r in plots.new_tokens(kept, more, 8.0).collect()) == [4, 12, 13]


def test_dimensions_and_totals(spark):
    edges = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 0.0), (1, 2, 10.0, 0.0, 10.0, 20.0)], EDGE)
    values = spark.createDataFrame([(1, 1, 5.0, 1.0, 10.5), (2, 1, 11.0, 10.0, 40.0), (3, 1, 500.0, 0.0, 1.0)], "did int, plot int, x double, y double, value double")
    got = plots.dimension_fit(edges, values, 5.0).collect()[0]
    assert (got.dimensions, got.agreeing) == (2, 0.5) and abs(got.median_ratio - (1.05 + 2.0) / 2) < 1e-9
    measures = [(1, 1, 0.0, 0.0, 30.0, 0.0, 30.2), (2, 1, 0.0, 1.0, 12.0, 1.0, 12.0), (3, 1, 12.0, 0.0, 30.0, 0.0, 18.0), (4, 1, 0.0, 0.0, 0.0, 9.0, 9.0)]
    assert [r.mid for r in plots.totals_among(spark.createDataFrame(measures, "mid int, plot int, x1 double, y1 double, x2 double, y2 double, value double")).collect()] == [1]


def test_split_edges_and_axis_order(spark):
    edges = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 0.0), (2, 0.0, 5.0, 10.0, 5.0)], "eid int, x1 double, y1 double, x2 double, y2 double")
    nodes = spark.createDataFrame([(1, 4.0, 0.5), (2, 4.1, 0.0), (3, 0.5, 0.0), (4, 7.0, -1.0), (5, 5.0, 90.0)], "nid int, x double, y double")
    got = [(r.eid, r.part, round(r.x1, 6), round(r.x2, 6)) for r in plots.split_edges(edges, nodes).orderBy("eid", "part").collect()]
    assert got == [(1, 0, 0.0, 4.0), (1, 1, 4.0, 7.0), (1, 2, 7.0, 10.0), (2, 0, 0.0, 10.0)]
    points = spark.createDataFrame([("a", i, float(x), 2.0 * x + 0.1 * (i % 2)) for i, x in enumerate([3, 1, 2, 9])], "k string, pid int, x double, y double")
    assert [r.pid for r in plots.along_axis(points, "k").orderBy("place").collect()] == [1, 2, 0, 3]
