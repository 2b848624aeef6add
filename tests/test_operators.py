import random

from pyspark.sql import functions as F

from parcelwright.operators import fits, graph, joins, shapes, windows


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_distance_joins(spark):
    rng = random.Random(1)
    left = [(i, rng.uniform(0, 20), rng.uniform(0, 20)) for i in range(60)] + [(90, None, 1.0)]
    right = [(i, rng.uniform(0, 20), rng.uniform(0, 20)) for i in range(80)] + [(200, 100.0, 100.0)]
    a, b = frame(spark, left, "lid long, lx double, ly double"), frame(spark, right, "rid long, rx double, ry double")
    gap = lambda p, q: ((p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2) ** 0.5
    want = {(p[0], q[0]) for p in left[:60] for q in right if gap(p, q) <= 1.5}
    assert {(r.lid, r.rid) for r in joins.within(a, b, 1.5).collect()} == want
    best = {p[0]: min((gap(p, q), q[0]) for q in right if gap(p, q) <= 1.5)[1] for p in left[:60] if any(gap(p, q) <= 1.5 for q in right)}
    assert {r.lid: r.rid for r in joins.nearest(a, b, 1.5).collect()} == best
    assert {r.lid for r in joins.none_within(a, b, 1.5).collect()} == {p[0] for p in left} - set(best)
    assert joins.within(a.limit(0), b, 1.5).collect() == []


def test_bands_boxes_and_priorities(spark):
    a, b = frame(spark, [(1, 1.0), (2, 5.0), (3, None)], "i int, u double"), frame(spark, [(7, 1.4), (8, 5.5), (9, 6.1)], "j int, w double")
    assert {(r.i, r.j) for r in joins.band(a, b, "u", "w", 0.5).collect()} == {(1, 7), (2, 8)}
    rng = random.Random(2)
    box = lambda i: (i, *(lambda x, y: (x, y, x + rng.randint(0, 30), y + rng.randint(0, 5)))(rng.randint(-40, 40), rng.randint(-40, 40)))
    left, right = [tuple(map(float, box(i))) for i in range(40)], [tuple(map(float, box(i))) for i in range(40)]
    cols = lambda p: f"{p}id double, {p}x0 double, {p}y0 double, {p}x1 double, {p}y1 double"
    got = [(r.lid, r.rid) for r in joins.boxes_meeting(frame(spark, left, cols("l")), frame(spark, right, cols("r")), 10.0).collect()]
    want = {(p[0], q[0]) for p in left for q in right if p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4]}
    assert len(got) == len(set(got)) and set(got) == want
    first = joins.first_of(frame(spark, [("a", 1), ("b", None)], "k string, v int"), frame(spark, [("b", 2), ("c", 3), ("a", 9)], "k string, v int"), "k", "v")
    assert {(r.k, r.v, r.origin) for r in first.collect()} == {("a", 1, "primary"), ("b", 2, "secondary"), ("c", 3, "secondary")}
    kept = joins.keep_first(frame(spark, [("a", 2, "x"), ("a", 1, "y"), (None, 3, "z")], "k string, o int, v string"), ["k"], [F.col("o")])
    assert {(r.k, r.v) for r in kept.collect()} == {("a", "y"), (None, "z")}


def test_windows(spark):
    ring = frame(spark, [("r", i, float(x), float(y)) for i, (x, y) in enumerate([(0, 0), (2, 0), (2, 2)])], "k string, i int, x double, y double")
    assert [(r.next_x, r.next_y) for r in windows.ring_edges(ring, "k", ["i"]).orderBy("at").collect()] == [(2, 0), (2, 2), (0, 0)]
    assert [r.window for r in windows.sliding(ring, "k", ["i"], "i", 2).orderBy("start").collect()] == [[0, 1], [1, 2]]
    s = windows.sessions(frame(spark, [("a", 1), ("a", 2), ("a", 9), ("b", 4)], "k string, t int"), ["k"], F.col("t"), F.lit(5))
    assert {(r.k, r.t, r.session) for r in s.collect()} == {("a", 1, 0), ("a", 2, 0), ("a", 9, 1), ("b", 4, 0)}
    t = windows.trimmed_mean(frame(spark, [("a", float(v)) for v in (1, 2, 3, 4, 100)] + [("b", 5.0), ("b", None)], "k string, v double"), "k", "v")
    assert {(r.k, r.trimmed_mean, r.kept) for r in t.collect()} == {("a", 2.5, 4), ("b", 5.0, 1)}
    v = windows.valley(frame(spark, [("a", x) for x in (0.1, 0.15, 0.55, 0.6, 0.9)] + [("b", 0.5)], "k string, v double"), ["k"], "v", 0.1, 0.8, 0.1, 0.15)
    assert [(r.k, round(r.threshold, 6)) for r in v.collect()] == [("a", 0.35)]
    log = frame(spark, [(1, 1, "new"), (1, 3, "done"), (1, 2, "work"), (2, 1, "new")], "k int, at int, state string")
    assert {(r.k, r.state) for r in windows.latest(log, ["k"], ["at"]).collect()} == {(1, "done"), (2, "new")}


def test_fits(spark):
    rows = [(1, 0.0, 0.0, 5.0, 5.0), (1, 2.0, 0.0, 5.0, 9.0), (1, 0.0, 1.0, 3.0, 5.0), (2, 1.0, 1.0, 0.0, 0.0), (3, 1.0, 1.0, 0.0, 0.0), (3, 1.0, 1.0, 1.0, 0.0)]
    got = {r.k: r for r in fits.transform_fit(frame(spark, rows, "k int, x double, y double, tx double, ty double"), "k").collect()}
    assert abs(got[1].angle - 1.5707963) < 1e-6 and abs(got[1].scale - 2) < 1e-9 and (round(got[1].shift_x, 6), round(got[1].shift_y, 6)) == (5, 5) and got[1].rms < 1e-6
    assert got[2].scale == got[3].scale == 0 and got[2].angle is None
    axis = fits.principal_axis(frame(spark, [("a", float(i), 2.0 * i + (i % 2) * 0.01) for i in range(50)], "k string, x double, y double"), "k").collect()[0]
    assert abs(axis.axis - 1.1071) < 1e-3 and axis.aspect > 100


def test_clusters_against_brute_force(spark):
    rng = random.Random(4)
    points = [(i, rng.uniform(0, 12), rng.uniform(0, 12)) for i in range(90)] + [(500, None, None)] + [(600 + i, 40.0, 40.0) for i in range(20)]
    parent = {p[0]: p[0] for p in points}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for p in points:
        for q in points:
            if p[1] is not None and q[1] is not None and (p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2 <= 1.0:
                a, b = sorted((find(p[0]), find(q[0])))
                parent[b] = a
    got = {r.node: r.label for r in graph.distance_clusters(frame(spark, points, "node long, x double, y double"), 1.0).collect()}
    assert got == {i: find(i) for i in parent}


def test_greedy_rounds_equal_the_sequential_procedure(spark):
    rng = random.Random(5)
    nodes = [(i, float(rng.randint(0, 9)) if i % 7 else None) for i in range(40)]
    pairs = [(rng.randrange(40), rng.randrange(40)) for _ in range(70)]
    kept = []
    for i, r in sorted(nodes, key=lambda n: (-(n[1] if n[1] is not None else float("-inf")), n[0])):
        if not any((i, k) in pairs or (k, i) in pairs for k in kept):
            kept.append(i)
    got = graph.greedy_keep(frame(spark, nodes, "node long, rank double"), frame(spark, pairs, "a long, b long")).collect()
    assert {r.node for r in got if r.kept} == set(kept) and len(got) == 40
    costs = [(a, b + 100, float(rng.randint(0, 5))) for a, b in pairs]
    used, want = set(), set()
    for a, b, c in sorted({(a, b): c for a, b, c in sorted(costs, reverse=True)}.items() and [(a, b, c) for (a, b), c in {(a, b): c for a, b, c in sorted(costs, key=lambda t: -t[2])}.items()], key=lambda t: (t[2], t[0], t[1])):
        if ("a", a) not in used and ("b", b) not in used:
            used |= {("a", a), ("b", b)}
            want.add((a, b, c))
    assert {(r.a, r.b, r.cost) for r in graph.greedy_matching(frame(spark, costs, "a long, b long, cost double")).collect()} == want
    assert {r.node for r in graph.losers(frame(spark, [(1, 2, 0.5, 0.5), (3, 4, 0.9, 0.1)], "a long, b long, rank_a double, rank_b double")).collect()} == {1, 4}


def test_shapes(spark):
    line = [(1, 0.0, 0.0, 10.0, 0.0), (2, 0.0, 50.0, 10.0, 50.0)]
    near = [(0.0, 1.0, 4.0, 1.0), (3.0, -1.0, 5.0, -1.0)]
    got = {r.sid: r.covered for r in shapes.covered_lengths(frame(spark, line, "sid int, x1 double, y1 double, x2 double, y2 double"), frame(spark, near, "lx1 double, ly1 double, lx2 double, ly2 double"), 1.0).collect()}
    assert abs(got[1] - 5.0) < 0.2 and got[2] == 0
    square = [("a", 0.0, 0.0, 4.0, 0.0), ("a", 4.0, 0.0, 4.0, 4.0), ("a", 4.0, 4.0, 0.0, 4.0), ("a", 0.0, 4.0, 0.0, 0.0), ("b", 0.0, 0.0, 1.0, 1.0)]
    faces = {r.k: (r.faces, r.area) for r in shapes.network_faces(frame(spark, square, "k string, x1 double, y1 double, x2 double, y2 double"), "k").collect()}
    assert faces == {"a": (1, 16.0), "b": (0, 0.0)}
    points = [("v", float(x), float(y)) for x in range(8) for y in range(8)] + [("w", 1.0, 1.0), ("v", None, 1.0)]
    hull = {r.k: r for r in shapes.hulls(frame(spark, points, "k string, x double, y double"), "k").collect()}
    assert hull["v"].corners == 4 and hull["v"].area == 49 and abs(hull["v"].concave_area - 49) < 1e-6 and hull["w"].corners == 1
