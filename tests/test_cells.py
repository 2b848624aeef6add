"""Joins on cells: their rows aren't broadcast, and every near pair meets."""

import math
import random

from pyspark.sql import functions as F

from parcelwright.operators import joins, shapes


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_cells_of_covered_segments_are_not_broadcast(spark):
    n = spark.range(100)
    segments = n.select(F.col("id").alias("sid"), F.lit(0.0).alias("x1"), (F.col("id") * 10.0).alias("y1"), F.lit(100.0).alias("x2"), (F.col("id") * 10.0).alias("y2"))
    lines = n.select(F.lit(5.0).alias("lx1"), (F.col("id") * 10.0).alias("ly1"), F.lit(15.0).alias("lx2"), (F.col("id") * 10.0).alias("ly2"))
    got = shapes.covered_lengths(segments, lines, 2.0)
    assert "Broadcast" not in plan(got)
    assert {round(r.covered, 6) for r in got.collect()} == {14.0}


def test_intervals_are_solved_once_and_in_code_that_compiles(spark):
    segments = spark.range(9).select(F.col("id").alias("sid"), F.lit(0.0).alias("x1"), (F.col("id") * 10.0).alias("y1"), F.lit(100.0).alias("x2"), (F.col("id") * 10.0).alias("y2"))
    lines = spark.range(9).select(F.lit(5.0).alias("lx1"), (F.col("id") * 10.0).alias("ly1"), F.lit(15.0).alias("lx2"), (F.col("id") * 10.0).alias("ly2"))
    wide = plan(shapes.covered_lengths(segments, lines, 2.0)).splitlines()
    joins_made = [line for line in wide if "SortMergeJoin" in line]
    assert joins_made and not [line for line in joins_made if "CASE" in line]
    assert max(len(line) for line in wide) < 3000


def test_cells_along_segments_hold_all_near_places(spark):
    r = random.Random(3)
    segments = [(i, r.uniform(-50, 50), r.uniform(-50, 50), r.uniform(-50, 50), r.uniform(-50, 50)) for i in range(200)] + [(900, 3.0, -20.0, 3.0, 40.0), (901, -8.0, 6.0, 8.0, 6.0), (902, 1.0, 1.0, 1.0, 1.0)]
    rows = joins.along_cells(spark.createDataFrame(segments, "sid int, x1 double, y1 double, x2 double, y2 double"), "x1", "y1", "x2", "y2", 1.5, 4.0).collect()
    met = {}
    for row in rows:
        met.setdefault(row.sid, []).append((row["_u"], row["_v"]))
    for sid, x1, y1, x2, y2 in segments:
        cells = set(met[sid])
        assert len(cells) == len(met[sid])
        for _ in range(100):
            t, a, b = r.random(), r.uniform(-1.06, 1.06), r.uniform(-1.06, 1.06)
            assert ((x1 + t * (x2 - x1) + a) // 4, (y1 + t * (y2 - y1) + b) // 4) in cells
    crossed = len(met[0])
    box = (abs(segments[0][3] - segments[0][1]) / 4 + 1) * (abs(segments[0][4] - segments[0][2]) / 4 + 1)
    assert crossed < max(40, box)


def test_lines_of_all_sizes_cover(spark):
    segments = spark.createDataFrame([(1, 0.0, 0.0, 1000.0, 0.0), (2, 3.0, 3.0, 3.5, 3.0)], "sid int, x1 double, y1 double, x2 double, y2 double")
    lines = [(-5000.0, 1.0, 400.0, 1.0), (500.0, 0.5, 500.2, 0.5), (600.0, -1.0, 640.0, -1.0), (3.0, -9000.0, 3.0, 9000.0)]
    got = {r.sid: r.covered for r in shapes.covered_lengths(segments, spark.createDataFrame(lines, "lx1 double, ly1 double, lx2 double, ly2 double"), 2.0).collect()}
    assert abs(got[1] - (400 + 3 ** 0.5 + 0.2 + 2 * 3.75 ** 0.5 + 40 + 2 * 3 ** 0.5)) < 1e-6 and abs(got[2] - 0.5) < 1e-9


def test_poses_on_lines_cover_without_broadcast_cells(spark):
    from parcelwright.operators import placing

    n = spark.range(20)
    edges = n.select(F.col("id").alias("plot"), F.col("id").alias("window"), F.lit(0).alias("eid"), F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"), F.lit(30.0).alias("x2"), F.lit(0.0).alias("y2"))
    segments = n.select(F.col("id").alias("window"), (F.col("id") * 1000.0).alias("x1"), F.lit(0.0).alias("y1"), (F.col("id") * 1000.0).alias("x2"), F.lit(30.0).alias("y2"))
    got = placing.poses_on_lines(edges, segments, 0.5, 0.5, ["window"])
    cells = [line for line in plan(got).splitlines() if "_u" in line and "Join" in line]
    assert cells and not [line for line in cells if "Broadcast" in line]
    assert {(r.plot, round(r.tx), r.coverage) for r in got.collect()} == {(i, i * 1000, 1.0) for i in range(20)}


def test_poses_on_lines_without_broadcast_edges(spark, monkeypatch):
    from parcelwright.operators import placing

    plans = []
    monkeypatch.setattr(placing, "materialise", lambda df: plans.append(plan(df)) or df.checkpoint(eager=True))
    at = F.explode(F.array(*[F.struct(F.lit(i).alias("eid"), *[F.lit(v).alias(c) for c, v in zip(("x1", "y1", "x2", "y2"), e)]) for i, e in enumerate(((0.0, 0.0, 30.0, 0.0), (30.0, 0.0, 30.0, 20.0)))]))
    edges = spark.range(20).select(F.col("id").alias("plot"), F.col("id").alias("window"), at.alias("e")).select("plot", "window", "e.*")
    segments = edges.select("window", *[(F.col(c) + F.col("plot") * (1000.0 if c[0] == "x" else 0.0)).alias(c) for c in ("x1", "y1", "x2", "y2")])
    got = placing.poses_on_lines(edges, segments, 0.5, 0.5, ["window"])
    assert plans and not [p for p in [*plans, plan(got)] if "Broadcast" in p]
    assert {(r.plot, round(r.angle, 3) + 0.0, round(r.tx), round(r.ty), r.coverage) for r in got.collect()} == {(i, 0.0, i * 1000, 0, 1.0) for i in range(20)}


def test_parts_of_a_pose_go_by_its_number(spark):
    from parcelwright.operators import placing

    shape = ((0.0, 0.0, 30.0, 0.0), (30.0, 0.0, 30.0, 20.0), (30.0, 20.0, 0.0, 0.0))
    edges = spark.createDataFrame([(k, 5, i, *e) for k in (1, 2) for i, e in enumerate(shape)], "plot long, window long, eid int, x1 double, y1 double, x2 double, y2 double")
    # one side traced whole, of another the last 8 metres in two parts that overlap, the third not at all
    segments = spark.createDataFrame([(5, 100.0, 0.0, 130.0, 0.0), (5, 130.0, 12.5, 130.0, 18.0), (5, 130.0, 16.0, 130.0, 19.5)], "window long, x1 double, y1 double, x2 double, y2 double")
    got = placing.poses_on_lines(edges, segments, 0.5, 0.5, ["window"])
    assert not [line for line in plan(got).splitlines() if "Exchange" in line and "angle" in line]

    def gap(x, y, x1, y1, x2, y2):
        t = max(0.0, min(1.0, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2)))
        return math.hypot(x - x1 - t * (x2 - x1), y - y1 - t * (y2 - y1))

    steps, near, whole, lines = 4000, 0.0, 0.0, [r[1:] for r in segments.collect()]
    for x1, y1, x2, y2 in shape:
        at = ((100.0 + x1 + (x2 - x1) * (k + 0.5) / steps, y1 + (y2 - y1) * (k + 0.5) / steps) for k in range(steps))
        whole += math.hypot(x2 - x1, y2 - y1)
        near += math.hypot(x2 - x1, y2 - y1) / steps * sum(any(gap(*p, *line) <= 0.5 for line in lines) for p in at)
    rows = sorted(got.collect())
    assert [r[:4] for r in rows] == [(1, 0.0, 100.0, 0.0), (2, 0.0, 100.0, 0.0)]
    assert all(abs(r.coverage - near / whole) < 1e-3 for r in rows)


def test_split_edges_without_broadcast_cells(spark):
    from parcelwright.operators import plots

    n = spark.range(50)
    edges = n.select(F.col("id").alias("eid"), F.lit(0.0).alias("x1"), (F.col("id") * 20.0).alias("y1"), F.lit(100.0).alias("x2"), (F.col("id") * 20.0).alias("y2"))
    nodes = n.select(F.col("id").alias("nid"), (F.col("id") + 20.0).alias("x"), (F.col("id") * 20.0 + 1.4).alias("y"))
    got = plots.split_edges(edges, nodes.union(nodes))
    assert "Broadcast" not in plan(got)
    assert {(r.eid, r.part, r.x1, r.x2) for r in got.collect()} == {p for i in range(50) for p in ((i, 0, 0.0, i + 20.0), (i, 1, i + 20.0, 100.0))}


def test_seats_spread_without_broadcast_rows(spark, monkeypatch):
    from parcelwright.operators import placing

    plans = []
    monkeypatch.setattr(placing, "materialise", lambda df: plans.append(plan(df)) or df.checkpoint(eager=True))
    at = F.explode(F.array(*[F.struct(F.lit(i).alias("at"), F.lit(x).alias("x"), F.lit(y).alias("y")) for i, (x, y) in enumerate(((0.0, 0.0), (40.0, 0.0), (40.0, 40.0), (0.0, 40.0)))]))
    corners = spark.range(6).select(F.col("id").alias("plot"), at.alias("c")).select("plot", "c.*").select("plot", "at", "x", "y", (F.col("plot") * 40.0 + F.col("x") + 0.1 * (F.col("plot") > 0).cast("int")).alias("gx"), F.col("y").alias("gy"))
    got = placing.seats_spread(corners, spark.range(1).select(F.col("id").alias("plot")), 1.0, 2)
    assert {(r.plot, r.at, round(r.gx, 6), r.round) for r in got.select("plot", "at", F.col("x").alias("gx"), "round").collect()} == {(p, i, p * 40.0 + (40.0 if i in (1, 2) else 0.0), p) for p in range(6) for i in range(4)}
    wide = [line for p in plans for line in p.splitlines() if "Join" in line and any(k in line for k in ("_u", "by_at", "LeftSemi", "LeftAnti"))]
    assert wide and not [line for line in wide if "Broadcast" in line]


def test_known_readings_join_as_the_expression(spark):
    from parcelwright.functions import text
    from parcelwright.operators import matching

    readings = spark.createDataFrame([(1, "IlO"), (2, "78-4"), (3, "x"), (4, None), (5, "12 7"), (6, "IlO"), (6, "7-l2")], "k int, reading string")
    listed = ["110", "784", "7", "12", "9"]
    got = matching.known_readings(readings, spark.createDataFrame([(v,) for v in [*listed, "12", None]], "known string")).select("k", "reading", "survey")
    want = readings.select("k", "reading", text.known_survey(F.col("reading"), F.array(*[F.lit(v) for v in listed])).alias("survey"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and {r.k: r.survey for r in got.collect()}[5] == "12"


def test_known_surveys_meet_by_equality(spark, tmp_path):
    from parcelwright.plans.measures import known_surveys

    spark.range(2000).select(F.col("id").alias("c_custkey")).write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(100).select(F.col("id").alias("s_suppkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    got = known_surveys(spark, str(tmp_path))
    assert "collect_set" not in plan(got)
    assert {r.c_custkey: r.survey for r in got.collect()} == {k: str(k) if k % 11 == 0 and k < 1100 else None for k in range(2000)}


def test_equal_rings_are_clipped_once(spark, tmp_path, monkeypatch):
    from parcelwright.plans import shaped

    pairs = []
    monkeypatch.setattr(shaped.shapes, "overlaps", lambda df, f=shapes.overlaps: pairs.append(df) or f(df))
    keys = spark.createDataFrame([(k,) for k in (5, 5 + 143_000, 5 + 286_000, 7)], "c_custkey long")
    keys.write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(5,), (5 + 143_000,)], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    got = shaped.plot_overlaps(spark, str(tmp_path)).collect()
    assert pairs[0].count() == 1 and len(got) == 6
    assert {(r.customer % 143_000, r.supplier % 143_000, r.shared) for r in got} == {(5, 5, 13.0 * 11.0)}
