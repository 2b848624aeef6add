"""Operators on plots and their drawings: edge pairs, seats, corners, tokens, dimensions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelwright.functions.plane import angle_between, orientation, projected_overlap, similarity
from parcelwright.operators.fits import principal_axis, transform_fit
from parcelwright.operators.graph import greedy_keep
from parcelwright.operators.joins import along_cells, cell, merged, nearest, within


def best_edge_pairs(edges: DataFrame, farthest: float, angle: float = 10.0, overlap: float = 0.5) -> DataFrame:
    """plot_a < plot_b with their closest pair of nearly parallel edges: eid_a, eid_b, gap.

    ``edges``: plot, eid, x1, y1, x2, y2. Directions differ by at most ``angle`` degrees, the edges overlap by at least
    ``overlap`` of the shorter one along the first, and their middles lie off it by at most ``farthest``; ties go to the smaller eids.
    """
    e = edges.withColumns({"o": orientation(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")), "l": F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))}).where("l > 0")
    side = F.lit(2.0 * farthest)
    spread = lambda p, pad: e.select(*[F.col(c).alias(f"{p}{c}") for c in ("plot", "eid", "x1", "y1", "x2", "y2", "o", "l")]).withColumn("_u", F.explode(F.sequence(cell(F.least(f"{p}x1", f"{p}x2") - pad, side), cell(F.greatest(f"{p}x1", f"{p}x2") + pad, side)))).withColumn("_v", F.explode(F.sequence(cell(F.least(f"{p}y1", f"{p}y2") - pad, side), cell(F.greatest(f"{p}y1", f"{p}y2") + pad, side))))
    met = spread("a", farthest).join(spread("b", 0.0), ["_u", "_v"]).drop("_u", "_v").where((F.col("aplot") < F.col("bplot")) & (angle_between(F.col("ao"), F.col("bo")) <= angle)).distinct()
    ux, uy = (F.col("ax2") - F.col("ax1")) / F.col("al"), (F.col("ay2") - F.col("ay1")) / F.col("al")
    along = lambda x, y: (F.col(x) - F.col("ax1")) * ux + (F.col(y) - F.col("ay1")) * uy
    off = F.abs(((F.col("bx1") + F.col("bx2")) / 2 - F.col("ax1")) * uy - ((F.col("by1") + F.col("by2")) / 2 - F.col("ay1")) * ux)
    fits = met.withColumns({"gap": off, "share": projected_overlap(F.lit(0.0), F.col("al"), along("bx1", "by1"), along("bx2", "by2"))}).where((F.col("gap") <= farthest) & (F.col("share") >= overlap))
    best = fits.groupBy("aplot", "bplot").agg(F.min(F.struct("gap", "aeid", "beid")).alias("m"))
    return best.select(F.col("aplot").alias("plot_a"), F.col("bplot").alias("plot_b"), F.col("m.aeid").alias("eid_a"), F.col("m.beid").alias("eid_b"), F.col("m.gap").alias("gap"))


def seats_by_controls(corners: DataFrame, controls: DataFrame) -> DataFrame:
    """The rigid pose of each plot from control points on its labelled corners: plot, controls, baseline, angle, shift_x, shift_y, rms.

    ``corners``: plot, label, x, y. ``controls``: plot, label, tx, ty. Fewer than two resolved labels give a null pose.
    """
    pairs = corners.join(controls, ["plot", "label"])
    fit = transform_fit(pairs, "plot", scaled=False)
    reach = pairs.groupBy("plot").agg(F.hypot(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("baseline"))
    return fit.join(reach, "plot").select("plot", F.col("n").alias("controls"), "baseline", "angle", "shift_x", "shift_y", "rms")


def rigid_shift(angle: Column, scale: Column, shift_x: Column, shift_y: Column, cx: Column, cy: Column) -> Column:
    """struct(x, y): the shift of the same pose without its scale that keeps the place of the centre (cx, cy)."""
    x, y = similarity(angle, F.lit(1.0), F.lit(0.0), F.lit(0.0), cx, cy)
    return F.struct((shift_x + (scale - 1) * x).alias("x"), (shift_y + (scale - 1) * y).alias("y"))


def refined_poses(corners: DataFrame, stones: DataFrame, reach: float) -> DataFrame:
    """Poses fitted again to the stones (stone, x, y) within ``reach`` of the placed corners (plot, at, x, y, px, py): as transform_fit(), key plot; plots with fewer than two pairs have no row."""
    placed = corners.select(F.struct("plot", "at").alias("lid"), F.col("px").alias("lx"), F.col("py").alias("ly"))
    near = nearest(placed, stones.select(F.col("stone").alias("rid"), F.col("x").alias("rx"), F.col("y").alias("ry")), reach)
    pairs = near.select("lid.plot", "lid.at", "rid").join(corners.select("plot", "at", "x", "y"), ["plot", "at"]).join(stones.select(F.col("stone").alias("rid"), F.col("x").alias("tx"), F.col("y").alias("ty")), "rid")
    return transform_fit(pairs, "plot", scaled=False).where("n >= 2")


def ring_corners(vertices: DataFrame, stones: DataFrame, reach: float) -> DataFrame:
    """plot, at, label, x, y, length: the vertices (plot, at, x, y) of each ring that have a stone (plot, label, x, y), in ring order, with the chord to the next.

    A stone stands for its nearest vertex within ``reach``, a vertex for the closest of its stones.
    """
    a = stones.select(F.struct("plot", "label").alias("lid"), "plot", F.col("x").alias("lx"), F.col("y").alias("ly"))
    b = vertices.select(F.col("at").alias("rid"), "plot", F.col("x").alias("rx"), F.col("y").alias("ry"))
    near = within(a, b, reach, ["plot"]).groupBy("lid").agg(F.min(F.struct("gap", "rid")).alias("m"))
    one = near.groupBy(F.col("lid.plot").alias("plot"), F.col("m.rid").alias("at")).agg(F.min(F.struct("m.gap", "lid.label")).alias("s"))
    w = Window.partitionBy("plot").orderBy("at")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    found = one.select("plot", "at", "s.label").join(vertices, ["plot", "at"])
    nx, ny = (F.coalesce(F.lead(c).over(w), F.first(c).over(whole)) for c in ("x", "y"))
    return found.select("plot", "at", "label", "x", "y", F.hypot(nx - F.col("x"), ny - F.col("y")).alias("length"))


def distinct_tokens(tokens: DataFrame, same: float = 10.0, part: float = 6.0) -> DataFrame:
    """The tokens (tid, page, text, x, y, confidence) left when of equal texts within ``same`` the more confident stays, and of digits within ``part`` that are part of a longer text the longer one."""
    a = tokens.select(F.col("tid").alias("lid"), "page", F.col("x").alias("lx"), F.col("y").alias("ly"), F.col("text").alias("lt"))
    b = tokens.select(F.col("tid").alias("rid"), "page", F.col("x").alias("rx"), F.col("y").alias("ry"), F.col("text").alias("rt"))
    twins = within(a, b, same, ["page"]).where("lid < rid AND lt = rt").select(F.col("lid").alias("a"), F.col("rid").alias("b"))
    first = greedy_keep(tokens.select(F.col("tid").alias("node"), F.col("confidence").alias("rank")), twins).where("kept").select(F.col("node").alias("tid"))
    kept = tokens.join(first, "tid", "left_semi")
    inner = within(a.join(first.withColumnRenamed("tid", "lid"), "lid"), b.join(first.withColumnRenamed("tid", "rid"), "rid"), part, ["page"]).where("lid <> rid AND length(lt) < length(rt) AND contains(rt, lt)").where(F.col("lt").rlike(r"^\d+$"))
    return kept.join(inner.select(F.col("lid").alias("tid")).distinct(), "tid", "left_anti")


def new_tokens(kept: DataFrame, more: DataFrame, apart: float) -> DataFrame:
    """``kept`` and those of ``more`` (tid, page, text, x, y, confidence) that lie farther than ``apart`` from every kept token, and from better ones among themselves."""
    side = lambda df, p: df.select(F.col("tid").alias(f"{p}id"), "page", F.col("x").alias(f"{p}x"), F.col("y").alias(f"{p}y"))
    free = more.join(within(side(more, "l"), side(kept, "r"), apart, ["page"]).select(F.col("lid").alias("tid")).distinct(), "tid", "left_anti")
    close = within(side(free, "l"), side(free, "r"), apart, ["page"]).where("lid < rid").select(F.col("lid").alias("a"), F.col("rid").alias("b"))
    chosen = greedy_keep(free.select(F.col("tid").alias("node"), F.col("confidence").alias("rank")), close).where("kept").select(F.col("node").alias("tid"))
    return kept.unionByName(free.join(chosen, "tid", "left_semi"))


def dimension_fit(edges: DataFrame, dimensions: DataFrame, reach: float) -> DataFrame:
    """How the dimensions (did, plot, x, y, value) of a drawing agree with its edges (plot, eid, x1, y1, x2, y2): plot, dimensions, median_ratio, agreeing.

    A dimension belongs to the edge with the nearest middle within ``reach``; it agrees if its ratio to the edge's length is in [0.80, 1.25].
    """
    a = dimensions.select(F.struct("plot", "did").alias("lid"), "plot", F.col("x").alias("lx"), F.col("y").alias("ly"), "value")
    b = edges.select(F.col("eid").alias("rid"), "plot", ((F.col("x1") + F.col("x2")) / 2).alias("rx"), ((F.col("y1") + F.col("y2")) / 2).alias("ry"), F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")).alias("length"))
    near = within(a, b, reach, ["plot"]).where("length > 0").groupBy("lid", "value").agg(F.min(F.struct("gap", "rid", "length")).alias("m"))
    ratio = near.select("lid.plot", (F.col("value") / F.col("m.length")).alias("ratio"))
    return ratio.groupBy("plot").agg(F.count("*").alias("dimensions"), F.median("ratio").alias("median_ratio"), F.avg(F.col("ratio").between(0.80, 1.25).cast("int")).alias("agreeing"))


def totals_among(measures: DataFrame, angle: float = 12.0, apart: float = 6.0, error: float = 0.03) -> DataFrame:
    """mid: measures (mid, plot, x1, y1, x2, y2, value) that are about the sum of at least two smaller ones along the same line."""
    o = orientation(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    m = measures.withColumn("o", o)
    a, b = (m.select("plot", *[F.col(c).alias(f"{p}_{c}") for c in ("mid", "x1", "y1", "x2", "y2", "value", "o")]) for p in "ab")
    length = F.hypot(F.col("a_x2") - F.col("a_x1"), F.col("a_y2") - F.col("a_y1"))
    off = F.abs(((F.col("b_x1") + F.col("b_x2")) / 2 - F.col("a_x1")) * (F.col("a_y2") - F.col("a_y1")) - ((F.col("b_y1") + F.col("b_y2")) / 2 - F.col("a_y1")) * (F.col("a_x2") - F.col("a_x1"))) / F.when(length > 0, length)
    met = a.join(b, "plot").where((F.col("a_mid") != F.col("b_mid")) & (F.col("b_value") < F.col("a_value")) & (angle_between(F.col("a_o"), F.col("b_o")) <= angle) & (off <= apart))
    sums = met.groupBy("a_mid", "a_value").agg(F.count("*").alias("n"), F.sum("b_value").alias("s"))
    return sums.where((F.col("n") >= 2) & (F.abs(F.col("s") - F.col("a_value")) <= error * F.col("a_value"))).select(F.col("a_mid").alias("mid"))


def split_edges(edges: DataFrame, nodes: DataFrame, off: float = 1.5, clear: float = 1.0, spacing: float = 0.3) -> DataFrame:
    """eid, part, x1, y1, x2, y2: edges (eid, x1, y1, x2, y2) cut at the nodes (nid, x, y) that lie on them.

    A node cuts an edge if it is within ``off`` of it and at least ``clear`` from its ends; of nodes closer than ``spacing`` along the edge the first cuts.
    """
    side = max(off, 1e-9) * 4
    e = edges.withColumn("l", F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))).where("l > 0")
    spread = along_cells(e, "x1", "y1", "x2", "y2", off, side)
    placed = nodes.where("x IS NOT NULL AND y IS NOT NULL").select("x", "y", cell(F.col("x"), side).alias("_u"), cell(F.col("y"), side).alias("_v"))
    ux, uy = (F.col("x2") - F.col("x1")) / F.col("l"), (F.col("y2") - F.col("y1")) / F.col("l")
    s, d = (F.col("x") - F.col("x1")) * ux + (F.col("y") - F.col("y1")) * uy, F.abs((F.col("x") - F.col("x1")) * uy - (F.col("y") - F.col("y1")) * ux)
    cuts = merged(spread, placed, ["_u", "_v"]).withColumns({"s": s, "d": d}).where((F.col("d") <= off) & (F.col("s") >= clear) & (F.col("s") <= F.col("l") - clear)).select("eid", "s")
    places = cuts.groupBy("eid").agg(F.array_sort(F.collect_set("s")).alias("all"))
    kept = F.aggregate("all", F.array().cast("array<double>"), lambda k, v: F.when((F.size(k) == 0) | (v - F.element_at(k, -1) > spacing), F.array_append(k, v)).otherwise(k))
    at = merged(e, places.select("eid", kept.alias("s")), ["eid"], "left").withColumn("s", F.concat(F.array(F.lit(0.0)), F.coalesce("s", F.array().cast("array<double>")), F.array("l")))
    piece = at.select("eid", "x1", "y1", ux.alias("ux"), uy.alias("uy"), F.posexplode(F.zip_with(F.slice("s", F.lit(1), F.size("s") - 1), F.slice("s", F.lit(2), F.size("s") - 1), lambda p, q: F.struct(p.alias("p"), q.alias("q")))).alias("part", "r"))
    along = lambda c, u, r: F.col(c) + F.col(u) * F.col(f"r.{r}")
    return piece.select("eid", "part", along("x1", "ux", "p").alias("x1"), along("y1", "uy", "p").alias("y1"), along("x1", "ux", "q").alias("x2"), along("y1", "uy", "q").alias("y2"))


def along_axis(points: DataFrame, key: str) -> DataFrame:
    """The points (key, pid, x, y) with place: their order along the principal axis of their key, which runs towards larger x (then y)."""
    axis = principal_axis(points, key).select(key, "cx", "cy", "axis")
    turn = F.when((F.cos("axis") < -1e-12) | ((F.abs(F.cos("axis")) <= 1e-12) & (F.sin("axis") < 0)), F.col("axis") + math.pi).otherwise(F.col("axis"))
    s = F.cos(turn) * (F.col("x") - F.col("cx")) + F.sin(turn) * (F.col("y") - F.col("cy"))
    return points.join(axis, key).withColumn("s", s).withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("s", "pid"))).select(key, "pid", "x", "y", "s", "place")
