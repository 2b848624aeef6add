import random

from parcelwright.operators import graph, matching


def test_worst_first_equals_the_sequential_procedure(spark):
    rng = random.Random(7)
    pairs = {}
    for _ in range(40):
        a, b = sorted(rng.sample(range(20), 2))
        pairs[a, b] = float(rng.randint(1, 9))
    rank = {i: float(rng.randint(0, 3)) for i in range(20)}
    left, want = dict(pairs), set()
    while left:
        a, b = max(left, key=lambda p: (left[p], -p[0], -p[1]))
        gone = min(a, b) if rank[a] == rank[b] else a if rank[a] < rank[b] else b
        want.add(gone)
        left = {p: c for p, c in left.items() if gone not in p}
    rows = [(a, b, c, rank[a], rank[b]) for (a, b), c in pairs.items()]
    got = {r.node for r in graph.worst_first(spark.createDataFrame(rows, "a long, b long, cost double, rank_a double, rank_b double")).collect()}
    assert got == want


def test_propagation_sees_only_the_rounds_before(spark):
    links = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (3, 4, 1.0), (1, 3, 9.0), (8, 9, 1.0)], "a long, b long, cost double")
    got = {r.node: (r.parent, r.round) for r in graph.propagated(spark.createDataFrame([(1,)], "node long"), links, 2).collect()}
    assert got == {1: (None, 0), 2: (1, 1), 3: (1, 1), 4: (3, 2)}


def test_relaxation_closes_gaps_and_keeps_fixed_nodes(spark):
    nodes = spark.createDataFrame([(1, True), (2, False), (3, None)], "node long, fixed boolean")
    gaps = spark.createDataFrame([(2, 1, -4.0, 0.0), (3, 2, 0.0, 2.0)], "a long, b long, gx double, gy double")
    got = {r.node: (r.dx, r.dy) for r in graph.relaxed_offsets(nodes, gaps, rounds=12).collect()}
    assert got[1] == (0, 0) and abs(got[2][0] + 4) < 0.6 and abs(got[3][1] - 2) < 0.3 and abs(got[3][0] + 4) < 1.2
    capped = {r.node: r.dx for r in graph.relaxed_offsets(nodes, gaps, rounds=6, cap=1.0).collect()}
    assert abs(capped[2]) <= 1.0 + 1e-9


def test_networks_and_carried_points(spark):
    rows = [("a", 0.0, 0.0, 1.0, 0.0), ("a", 1.0, 0.0, 0.0, 0.0), ("a", 1.0, 0.0, 1.0, 1.0), ("a", 5.0, 5.0, 5.0, 5.0)]
    got = matching.network_checks(spark.createDataFrame(rows, "k string, x1 double, y1 double, x2 double, y2 double"), "k").collect()[0]
    assert (got.segments, got.repeated, got.nodes, got.odd_nodes, got.loose_ends, got.length) == (3, 1, 3, 2, 2, 2.0)
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 90.0, 0.0)], "pid int, x double, y double")
    controls = spark.createDataFrame([(1, -1.0, 0.0, -1.0, 1.0), (2, 1.0, 0.0, 1.0, 3.0), (3, 5.0, 0.0, 5.0, 99.0)], "cid int, x double, y double, to_x double, to_y double")
    got = {r.pid: (round(r.x, 6), round(r.y, 6)) for r in matching.carried(points, controls, 10.0).collect()}
    assert got == {1: (0.0, 2.0), 2: (90.0, 0.0)}


def test_drawings_give_stones_and_chains(spark):
    rows = [("f", 0, "POINT", "0", 0, 0.0, 0.0, None, None), ("f", 1, "POINT", "0", 0, 10.0, 0.0, None, None), ("f", 2, "TEXT", "c", 0, 0.5, 0.5, "B", None), ("f", 3, "LWPOLYLINE", "l", 0, 0.1, 0.0, None, None), ("f", 3, "LWPOLYLINE", "l", 1, 9.9, 0.1, None, None), ("f", 3, "LWPOLYLINE", "l", 2, 0.0, 0.2, None, None)]
    drawing = spark.createDataFrame(rows, "file string, ord int, entity string, layer string, at int, x double, y double, text string, rotation double")
    stones = matching.surveyed_stones(drawing)
    assert {(r.x, r.code) for r in stones.collect()} == {(0.0, "B"), (10.0, None)}
    assert [round(r.length, 6) for r in matching.traced_edges(drawing, stones, 5.0).collect()] == [10.0]


def test_clusters_by_distance_with_a_third_of_all_points_at_one_spot(spark):
    """Two dense spots a little more or less than the gap apart, a chain, copies and points without a place."""
    import random

    from parcelwright.operators.graph import distance_clusters

    for apart in (0.97, 1.03):
        rng = random.Random(int(apart * 100))
        points = [(i, rng.random() * 0.01, rng.random() * 0.01) for i in range(300)] + [(300 + i, apart + 0.01 + rng.random() * 0.01, rng.random() * 0.01) for i in range(300)]
        points += [(600 + i, 10 + rng.random() * 6, rng.random() * 6) for i in range(120)] + [(800, 50.0, 50.0), (801, 50.0, 50.0), (802, None, 1.0)]
        parent = {p[0]: p[0] for p in points}

        def find(n):
            while parent[n] != n:
                n = parent[n]
            return n

        for a, ax, ay in points:
            for b, bx, by in points:
                if a < b and None not in (ax, bx) and ((ax - bx) ** 2 + (ay - by) ** 2) ** 0.5 <= 1.0:
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
        got = {r.node: r.label for r in distance_clusters(spark.createDataFrame(points, "node long, x double, y double"), 1.0).collect()}
        groups = lambda of: sorted(sorted(n for n in parent if of(n) == g) for g in {of(n) for n in parent})
        assert groups(got.get) == groups(find)
