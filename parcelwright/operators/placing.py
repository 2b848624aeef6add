"""Placing plots: by named neighbours, by traced lines, by corresponding corners, and from plot to plot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelwright.functions.plane import ring_distance, segment_distance, similarity
from parcelwright.operators.fits import transform_fit
from parcelwright.operators.joins import band, boxes_meeting, merged, nearest
from parcelwright.operators.shapes import covered_parts, newly_covered
from parcelwright.plans.checkpoints import materialise


def named_edges(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """plot, name, eid, gap: the edge (plot, eid, x1, y1, x2, y2) of each plot nearest to any of its labels (plot, name, x, y) with that name; ties go to the smaller eid."""
    met = edges.join(labels.where("name IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL"), "plot").withColumn("gap", F.round(segment_distance(*[F.col(c) for c in ("x", "y", "x1", "y1", "x2", "y2")]), 6))
    return met.groupBy("plot", "name").agg(F.min(F.struct("gap", "eid")).alias("m")).select("plot", "name", "m.eid", "m.gap")


def traced_segments(vertices: DataFrame, shortest: float) -> DataFrame:
    """sid, line, x1, y1, x2, y2: the steps of at least ``shortest`` between consecutive vertices (line, at, x, y) of traced lines."""
    w = Window.partitionBy("line").orderBy("at")
    steps = vertices.select("line", "at", "x", "y", F.lead("x").over(w).alias("x2"), F.lead("y").over(w).alias("y2")).where(F.hypot(F.col("x2") - F.col("x"), F.col("y2") - F.col("y")) >= shortest)
    return steps.select(F.struct("line", "at").alias("sid"), "line", F.col("x").alias("x1"), F.col("y").alias("y1"), "x2", "y2")


def poses_on_lines(edges: DataFrame, segments: DataFrame, error: float, reach: float, on: list[str] | None = None) -> DataFrame:
    """plot, angle, tx, ty, coverage: the rigid pose of each plot whose edges (plot, eid, x1, y1, x2, y2) the traced segments cover best.

    Every edge is laid on every segment (x1, y1, x2, y2) whose length differs by at most ``error``, in both directions;
    ``coverage`` is the share of all edges that lies within ``reach`` of segments. Ties go to the smaller pose. Edges and
    segments agree on the columns ``on`` (a village, a window), which bounds the poses.
    """
    length = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    keys = on or []
    a = edges.select("plot", *keys, *[F.col(c).alias(f"a{c}") for c in ("x1", "y1", "x2", "y2")], length.alias("al"))
    s = segments.select(*keys, *[F.col(c).alias(f"s{c}") for c in ("x1", "y1", "x2", "y2")], length.alias("sl"))
    met = band(a, s.hint("merge"), "al", "sl", error, keys).where("al > 0")
    ways = F.explode(F.array(F.struct(*[F.col(f"s{c}").alias(n) for c, n in (("x1", "px"), ("y1", "py"), ("x2", "qx"), ("y2", "qy"))]), F.struct(*[F.col(f"s{c}").alias(n) for c, n in (("x2", "px"), ("y2", "py"), ("x1", "qx"), ("y1", "qy"))])))
    turn = F.atan2(F.col("w.qy") - F.col("w.py"), F.col("w.qx") - F.col("w.px")) - F.atan2(F.col("ay2") - F.col("ay1"), F.col("ax2") - F.col("ax1"))
    laid = met.withColumn("w", ways).withColumn("turn", turn)
    # the middle of the edge goes to the middle of the segment, without scale
    mx, my = (F.col("ax1") + F.col("ax2")) / 2, (F.col("ay1") + F.col("ay2")) / 2
    tx, ty = similarity(F.col("turn"), F.lit(1.0), F.lit(0.0), F.lit(0.0), mx, my)
    pose = laid.select("plot", F.round(F.atan2(F.sin("turn"), F.cos("turn")), 5).alias("angle"), F.round((F.col("w.px") + F.col("w.qx")) / 2 - tx, 2).alias("tx"), F.round((F.col("w.py") + F.col("w.qy")) / 2 - ty, 2).alias("ty")).distinct()
    # the edges of a pose carry its number, not the pose
    pose = materialise(pose.withColumn("pose", F.monotonically_increasing_id()))
    at = lambda x, y: similarity(F.col("angle"), F.lit(1.0), F.col("tx"), F.col("ty"), F.col(x), F.col(y))
    (x1, y1), (x2, y2) = at("x1", "y1"), at("x2", "y2")
    own = edges.select("plot", "eid", "x1", "y1", "x2", "y2", length.alias("length"))
    put = merged(pose, own, ["plot"]).select("pose", "eid", "length", x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))
    parts = covered_parts(put, segments.select(*[F.col(c).alias(f"l{c}") for c in ("x1", "y1", "x2", "y2")]), reach, ["pose", "eid", "length"])
    # all parts of a pose go to one task, for the unions as for the sums
    covered = parts.repartition("pose").withColumn("new", newly_covered("pose", "eid")).groupBy("pose").agg(F.sum(F.col("new") * F.col("length")).alias("covered"))
    judged = merged(merged(pose, covered, ["pose"], "left"), own.groupBy("plot").agg(F.sum("length").alias("length")), ["plot"])
    share = judged.withColumn("coverage", F.round(F.coalesce("covered", F.lit(0.0)) / F.col("length"), 6))
    return share.groupBy("plot").agg(F.min_by(F.struct("angle", "tx", "ty", "coverage"), F.struct(-F.col("coverage"), "angle", "tx", "ty")).alias("b")).select("plot", "b.*")


def best_correspondence(left: DataFrame, right: DataFrame) -> DataFrame:
    """plot, shift, flipped, coherence: how the points of ``right`` (plot, at from 0, x, y) correspond to those of ``left``, of all rotations of their order in both senses.

    ``coherence`` is the mean difference of the distances between two points on either side; the smallest wins, then
    the unflipped order, then the smaller shift. Plots whose sides differ in number, or have fewer than three points, have no row.
    """
    size = lambda df, n: df.groupBy("plot").agg(F.count("*").alias(n))
    equal = size(left, "n").join(size(right, "m"), "plot").where("n = m AND n >= 3").select("plot", "n")

    def distances(df: DataFrame, p: str) -> DataFrame:
        one = df.join(equal, "plot").select("plot", "n", F.col("at").cast("int").alias("i"), F.col("x").alias("ix"), F.col("y").alias("iy"))
        two = df.select("plot", F.col("at").cast("int").alias("j"), F.col("x").alias("jx"), F.col("y").alias("jy"))
        return one.join(two, "plot").where("i <> j").select("plot", "n", F.col("i").alias(f"{p}i"), F.col("j").alias(f"{p}j"), F.hypot(F.col("ix") - F.col("jx"), F.col("iy") - F.col("jy")).alias(f"{p}d"))

    orders = distances(left, "a").where("ai < aj").withColumn("shift", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1))).withColumn("flipped", F.explode(F.array(F.lit(False), F.lit(True))))
    to = lambda k: F.when(F.col("flipped"), F.pmod(F.col("shift") - F.col(k), F.col("n"))).otherwise(F.pmod(F.col(k) + F.col("shift"), F.col("n"))).cast("int")
    met = orders.withColumns({"bi": to("ai"), "bj": to("aj")}).join(distances(right, "b").drop("n"), ["plot", "bi", "bj"])
    scored = met.groupBy("plot", "shift", "flipped").agg(F.round(F.avg(F.abs(F.col("ad") - F.col("bd"))), 6).alias("coherence"))
    return scored.groupBy("plot").agg(F.min(F.struct("coherence", "flipped", "shift")).alias("m")).select("plot", "m.shift", "m.flipped", "m.coherence")


def seats_spread(corners: DataFrame, seeds: DataFrame, reach: float, least: int = 3) -> DataFrame:
    """plot, at, x, y, round: corners of plots seated one from another.

    ``corners``: plot, at, x, y (its own shape), gx, gy (where it is guessed). ``seeds``: plot, whose guess is right. In
    each round a plot with at least ``least`` guessed corners within ``reach`` of seated ones (of earlier rounds) is fitted to
    them rigidly. It ends when a round seats none; each round is written to the shared folder.
    """
    seated = materialise(merged(corners, seeds.select("plot").distinct(), ["plot"], "left_semi").select("plot", "at", F.col("gx").alias("x"), F.col("gy").alias("y"), F.lit(0).alias("round")))
    fresh, number = seated, 0
    while True:
        number += 1
        waiting = merged(corners, seated.select("plot").distinct(), ["plot"], "left_anti")
        near_fresh = nearest(waiting.select(F.struct("plot", "at").alias("lid"), F.col("gx").alias("lx"), F.col("gy").alias("ly")), fresh.select(F.struct("plot", "at").alias("rid"), F.col("x").alias("rx"), F.col("y").alias("ry")), reach)
        touched = merged(waiting, near_fresh.select("lid.plot").distinct(), ["plot"], "left_semi")
        near = nearest(touched.select(F.struct("plot", "at").alias("lid"), F.col("gx").alias("lx"), F.col("gy").alias("ly")), seated.select(F.struct("plot", "at").alias("rid"), F.col("x").alias("rx"), F.col("y").alias("ry")), reach)
        goals = merged(near.select("lid.plot", "lid.at", F.col("rid.plot").alias("by"), F.col("rid.at").alias("by_at")), seated.select(F.col("plot").alias("by"), F.col("at").alias("by_at"), F.col("x").alias("tx"), F.col("y").alias("ty")), ["by", "by_at"])
        fit = transform_fit(merged(touched, goals, ["plot", "at"]), "plot", scaled=False).where((F.col("n") >= least) & F.col("angle").isNotNull())
        x, y = similarity(F.col("angle"), F.lit(1.0), F.col("shift_x"), F.col("shift_y"), F.col("x"), F.col("y"))
        fresh = materialise(merged(touched, fit, ["plot"]).select("plot", "at", x.alias("x"), y.alias("y"), F.lit(number).alias("round")))
        if not fresh.limit(1).count():
            return seated
        seated = materialise(seated.unionByName(fresh))


def within_fences(points: DataFrame, fences: DataFrame, buffer: float, side: float) -> DataFrame:
    """pid, fid, gap: points (pid, x, y) inside the rings (fid, ring) or at most ``buffer`` outside them; gap is 0 inside. Boxes meet in cells of ``side`` first."""
    at = points.select(F.col("pid").alias("lid"), F.col("x").alias("lx0"), F.col("y").alias("ly0"), F.col("x").alias("lx1"), F.col("y").alias("ly1")).where("lx0 IS NOT NULL AND ly0 IS NOT NULL")
    bound = lambda f, c: f(F.transform("ring", lambda v: v[c]))
    boxes = fences.where(F.size("ring") >= 3).select(F.col("fid").alias("rid"), (bound(F.array_min, "x") - buffer).alias("rx0"), (bound(F.array_min, "y") - buffer).alias("ry0"), (bound(F.array_max, "x") + buffer).alias("rx1"), (bound(F.array_max, "y") + buffer).alias("ry1"), "ring")
    met = boxes_meeting(at, boxes, side).withColumn("gap", ring_distance(F.col("lx0"), F.col("ly0"), F.col("ring")))
    return met.where(F.col("gap") <= buffer).select(F.col("lid").alias("pid"), F.col("rid").alias("fid"), "gap")


def best_and_second(scores: DataFrame, key: list[str], value: str, score: Column, least: float, lead: float) -> DataFrame:
    """key, value, score, second, decisive: the best value of each key and whether its score is at least ``least`` and ``lead`` times the second; ties go to the smaller value."""
    ranked = scores.withColumn("_s", score).withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(F.col("_s").desc(), value))).where("_r <= 2")
    best = ranked.groupBy(*key).agg(F.max(F.when(F.col("_r") == 1, F.col(value))).alias(value), F.max(F.when(F.col("_r") == 1, F.col("_s"))).alias("score"), F.max(F.when(F.col("_r") == 2, F.col("_s"))).alias("second"))
    return best.withColumn("decisive", (F.col("score") >= least) & (F.col("score") >= lead * F.coalesce("second", F.lit(0.0))))
