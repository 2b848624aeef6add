"""Matching of plots, stones and lines: nearest segments, shared edges, poses by votes, support, snapping, ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelwright.functions.plane import angle_between, orientation, pair_similarity, segment_distance, similarity
from parcelwright.functions.text import survey_options
from parcelwright.operators.graph import distance_clusters, greedy_keep
from parcelwright.operators.joins import around, band, cell, merged, nearest, within


def nearest_segments(points: DataFrame, segments: DataFrame, reach: float, shortest: float = 0.0, digits: int | None = None) -> DataFrame:
    """pid, sid, gap: the segment (sid, x1, y1, x2, y2) nearest to each point (pid, x, y) within ``reach``; ties go to the smaller sid. ``digits``: gaps are rounded before they are compared.

    A segment goes to the cells its box touches, a point to its nine neighbours' cells, so long segments cost a row for each cell.
    """
    side = max(reach, 1e-9)
    long = segments.where(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) >= shortest)
    spread = long.withColumn("_u", F.explode(F.sequence(cell(F.least("x1", "x2"), side), cell(F.greatest("x1", "x2"), side)))).withColumn("_v", F.explode(F.sequence(cell(F.least("y1", "y2"), side), cell(F.greatest("y1", "y2"), side))))
    placed = around(points.where("x IS NOT NULL AND y IS NOT NULL").withColumns({"_u": cell(F.col("x"), side), "_v": cell(F.col("y"), side)}), "_u", "_v")
    met = placed.join(spread, ["_u", "_v"]).withColumn("gap", segment_distance(*[F.col(c) for c in ("x", "y", "x1", "y1", "x2", "y2")]))
    met = (met if digits is None else met.withColumn("gap", F.round("gap", digits))).where(F.col("gap") <= reach)
    return met.groupBy("pid").agg(F.min(F.struct("gap", "sid")).alias("b")).select("pid", "b.sid", "b.gap")


def shared_edges(edges: DataFrame, tolerance: float) -> DataFrame:
    """plot_a < plot_b with the number and length of edges (plot, eid, x1, y1, x2, y2) whose ends coincide within ``tolerance``, in either direction."""
    mid = edges.withColumns({"mx": (F.col("x1") + F.col("x2")) / 2, "my": (F.col("y1") + F.col("y2")) / 2})
    a = mid.select(*[F.col(c).alias(f"a_{c}") for c in mid.columns]).withColumns({"_u": cell(F.col("a_mx"), 2 * tolerance), "_v": cell(F.col("a_my"), 2 * tolerance)})
    b = around(mid.select(*[F.col(c).alias(f"b_{c}") for c in mid.columns]).withColumns({"_u": cell(F.col("b_mx"), 2 * tolerance), "_v": cell(F.col("b_my"), 2 * tolerance)}), "_u", "_v")
    near = lambda p, q: F.hypot(F.col(f"a_x{p}") - F.col(f"b_x{q}"), F.col(f"a_y{p}") - F.col(f"b_y{q}")) <= tolerance
    met = a.join(b, ["_u", "_v"]).where((F.col("a_plot") < F.col("b_plot")) & ((near(1, 1) & near(2, 2)) | (near(1, 2) & near(2, 1))))
    once = met.groupBy(F.col("a_plot").alias("plot_a"), F.col("b_plot").alias("plot_b"), "a_eid").agg(F.max(F.hypot(F.col("a_x2") - F.col("a_x1"), F.col("a_y2") - F.col("a_y1"))).alias("length"))
    return once.groupBy("plot_a", "plot_b").agg(F.count("*").alias("edges"), F.sum("length").alias("length"))


def poses(corners: DataFrame, stones: DataFrame, tolerance: float, longest: float, scales: tuple[float, float] = (0.9, 1.1)) -> DataFrame:
    """Every pose that takes a ring edge of a plot to two stones of about the same distance: plot, pose, angle, scale, tx, ty, inliers, residual.

    ``corners``: plot, area, at, x, y (ring order). ``stones``: stone, area, x, y; a plot only meets the stones of its
    area (a village, a window), which bounds the poses. Lengths meet in bands; a pose's inliers are the corners with a
    stone within ``tolerance``, of which each stone counts once. Edges longer than ``longest`` take no part.
    """
    w = Window.partitionBy("plot").orderBy("at")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edge = corners.select("plot", "area", F.col("x").alias("ax"), F.col("y").alias("ay"), F.coalesce(F.lead("x").over(w), F.first("x").over(whole)).alias("bx"), F.coalesce(F.lead("y").over(w), F.first("y").over(whole)).alias("by")).withColumn("length", F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))).where((F.col("length") > 0) & (F.col("length") <= longest))
    side = lambda p: stones.select("area", F.col("stone").alias(f"{p}id"), F.col("x").alias(f"{p}x"), F.col("y").alias(f"{p}y"))
    pair = within(side("l"), side("r"), longest * scales[1], ["area"]).where("lid <> rid").select("area", F.col("lx").alias("px"), F.col("ly").alias("py"), F.col("rx").alias("qx"), F.col("ry").alias("qy"), "gap")
    met = band(edge, pair, "length", "gap", tolerance, ["area"]).withColumn("p", pair_similarity(*[F.col(c) for c in ("ax", "ay", "bx", "by", "px", "py", "qx", "qy")], scales)).where("p IS NOT NULL")
    key = F.xxhash64("plot", F.round("p.angle", 4), F.round("p.tx", 2), F.round("p.ty", 2), F.round("p.scale", 4))
    each = met.select("plot", key.alias("pose"), "p.*").dropDuplicates(["plot", "pose"])
    x, y = similarity(F.col("angle"), F.col("scale"), F.col("tx"), F.col("ty"), F.col("x"), F.col("y"))
    laid = each.join(corners, "plot").select("plot", "area", "pose", "at", x.alias("lx"), y.alias("ly")).withColumn("lid", F.struct("plot", "pose", "at"))
    hit = nearest(laid, side("r"), tolerance, on=["area"])
    votes = hit.groupBy(F.col("lid.plot").alias("plot"), F.col("lid.pose").alias("pose")).agg(F.count_distinct("rid").alias("inliers"), F.avg("gap").alias("residual"))
    return each.join(votes, ["plot", "pose"])


def best_poses(found: DataFrame) -> DataFrame:
    """The pose of each plot with the most inliers, then the smallest residual, then the smallest key."""
    rest = ["pose", "angle", "scale", "tx", "ty", "inliers", "residual"]
    return found.groupBy("plot").agg(F.min_by(F.struct(*rest), F.struct(-F.col("inliers"), F.round("residual", 6), "pose")).alias("b")).select("plot", "b.*")


def placed_best(corners: DataFrame, stones: DataFrame, tolerance: float, longest: float, scales: tuple[float, float] = (0.9, 1.1), parts: int = 8) -> DataFrame:
    """As best_poses() of poses(), from the same tables, without a row for each pose.

    A kernel tries all poses of the plots of an area, with all stones of the area, and keeps the best, so the shuffle holds
    corners and stones, whatever the number of poses. An area with more corners than half a task's share is dealt to
    ``parts`` groups; as a share bounds their number, their list on the driver is short.
    """

    def run(left, right):
        import numpy as np
        import pyarrow as pa

        from parcelwright.functions.kernels import best_placements

        plot, own = np.unique(left["plot"].to_numpy(), return_inverse=True)
        by = np.lexsort((left["at"].to_numpy(), own))
        xy = lambda t: np.stack([t["x"].to_numpy(), t["y"].to_numpy()], axis=1).astype(float)
        rings = list(zip(plot, np.split(xy(left)[by], np.cumsum(np.bincount(own))[:-1]))) if len(plot) else []
        found = best_placements(rings, xy(right), right["stone"].to_numpy(), tolerance, longest, scales)
        kinds = [left.schema.field("plot").type, pa.int64(), *[pa.float64()] * 4, pa.int64(), pa.float64()]
        return pa.table([pa.array([v[i] for v in found], k) for i, k in enumerate(kinds)], names=["plot", "pose", "angle", "scale", "tx", "ty", "inliers", "residual"])

    tasks = int(corners.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a few bytes may be much work, so small partitions aren't brought together
    known = corners.where("area IS NOT NULL AND plot IS NOT NULL")
    counts = known.rollup("area").count().orderBy(F.desc("count"), F.asc_nulls_first("area")).limit(2 * tasks + 1).collect()  # the first is the total
    large = [r["area"] for r in counts[1:] if r["count"] * 2 * tasks > counts[0]["count"]]
    split = F.col("area").isin(large)
    dealt = known.withColumn("part", F.when(split, F.pmod(F.hash("plot"), F.lit(parts))).otherwise(0)).select("area", "part", "plot", "at", "x", "y")
    everywhere = stones.where("area IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL").withColumn("part", F.explode(F.sequence(F.lit(0), F.when(split, F.lit(parts - 1)).otherwise(0)))).select("area", "part", "stone", "x", "y")
    kind = corners.schema["plot"].dataType.simpleString()
    spread = lambda df: df.repartition(tasks, "area", "part").groupBy("area", "part")
    return spread(dealt).cogroup(spread(everywhere)).applyInArrow(run, f"plot {kind}, pose bigint, angle double, scale double, tx double, ty double, inliers bigint, residual double")


def supported_readings(readings: DataFrame, reach: float) -> DataFrame:
    """The reading (rid, name, x, y, confidence) of each name with the most other names within ``reach``: name, rid, support; ties by confidence, then rid."""
    a = readings.select(F.col("rid").alias("lid"), F.col("x").alias("lx"), F.col("y").alias("ly"), F.col("name").alias("ln"), "confidence")
    b = readings.select("rid", F.col("x").alias("rx"), F.col("y").alias("ry"), F.col("name").alias("rn"))
    count = within(a, b, reach).where("ln <> rn").groupBy("lid").agg(F.count_distinct("rn").alias("support"))
    scored = a.join(count, "lid", "left").withColumn("support", F.coalesce("support", F.lit(0)))
    return scored.groupBy(F.col("ln").alias("name")).agg(F.max_by(F.struct(F.col("lid").alias("rid"), "support"), F.struct("support", "confidence", -F.col("lid"))).alias("b")).select("name", "b.rid", "b.support")


def density_blocks(points: DataFrame, radius: float) -> DataFrame:
    """node, block: points (node, name, x, y) with the densest place within ``radius``; places are taken by falling number of names around, each clearing its surroundings."""
    a = points.select(F.col("node").alias("lid"), F.col("x").alias("lx"), F.col("y").alias("ly"))
    b = points.select(F.col("node").alias("rid"), F.col("x").alias("rx"), F.col("y").alias("ry"), "name")
    met = within(a, b, radius)
    rank = met.groupBy(F.col("lid").alias("node")).agg(F.count_distinct("name").cast("double").alias("rank"))
    kept = greedy_keep(rank, met.where("lid < rid").select(F.col("lid").alias("a"), F.col("rid").alias("b"))).where("kept").select(F.col("node").alias("rid"))
    centres = b.join(kept, "rid").drop("name")
    return nearest(a, centres, radius).select(F.col("lid").alias("node"), F.col("rid").alias("block"))


def snapped_corners(corners: DataFrame, tolerance: float, farthest: float) -> DataFrame:
    """plot, at, x, y, moved: corners (node, plot, at, x, y) of different plots within ``tolerance`` of each other, brought to their mean.

    A cluster of one plot's corners only stays, and so does a corner that would move more than ``farthest``.
    """
    label = distance_clusters(corners.select("node", "x", "y"), tolerance)
    both = corners.join(label, "node")
    mean = both.groupBy("label").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.count_distinct("plot").alias("plots"))
    step = F.hypot(F.col("mx") - F.col("x"), F.col("my") - F.col("y"))
    go = (F.col("plots") > 1) & (step <= farthest)
    return both.join(mean, "label").select("plot", "at", F.when(go, F.col("mx")).otherwise(F.col("x")).alias("x"), F.when(go, F.col("my")).otherwise(F.col("y")).alias("y"), F.when(go, step).otherwise(0.0).alias("moved"))


def nearest_value(left: DataFrame, right: DataFrame, key: list[str], lvalue: str, rvalue: str) -> DataFrame:
    """Each left row with the nearest right value of its key (column nearest); ties go to the smaller value.

    Both sides are sorted together, and the last value below and the first above are carried along, so keys need no pairs.
    """
    rest = [c for c in left.columns if c not in key]
    a = left.select(*key, F.struct(*rest).alias("_row"), F.col(lvalue).cast("double").alias("_v"), F.lit(1).alias("_side"))
    b = right.where(F.col(rvalue).isNotNull()).select(*key, F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), F.col(rvalue).cast("double").alias("_v"), F.lit(0).alias("_side")).distinct()
    known = F.when(F.col("_side") == 0, F.col("_v"))
    w = Window.partitionBy(*key)
    up, down = w.orderBy(F.col("_v").asc_nulls_first(), "_side"), w.orderBy(F.col("_v").desc_nulls_last(), "_side")
    both = a.unionByName(b).withColumns({"_low": F.last(known, ignorenulls=True).over(up), "_high": F.last(known, ignorenulls=True).over(down)})
    pick = F.when(F.col("_v").isNull(), None).when(F.col("_low").isNull(), F.col("_high")).when(F.col("_high").isNull(), F.col("_low")).when(F.col("_v") - F.col("_low") <= F.col("_high") - F.col("_v"), F.col("_low")).otherwise(F.col("_high"))
    return both.where("_side = 1").select(*key, "_row.*", pick.alias("nearest"))


def in_ranges(points: DataFrame, ranges: DataFrame, value: str, low: str, high: str, width: float) -> DataFrame:
    """Pairs of points and ranges with low <= value <= high; ranges go to every bin of ``width`` that they touch."""
    bins = ranges.where(F.col(low) <= F.col(high)).withColumn("_b", F.explode(F.sequence(cell(F.col(low), width), cell(F.col(high), width))))
    return points.where(F.col(value).isNotNull()).withColumn("_b", cell(F.col(value), width)).join(bins, "_b").drop("_b").where(F.col(value).between(F.col(low), F.col(high)))


def without_bends(ring: Column, least: float = 2.0) -> Column:
    """The vertices of a ring where it turns by at least ``least`` degrees, judged by their neighbours in the ring as given."""
    n = F.size(ring)

    def turn(p: Column, i: Column) -> Column:
        before, after = F.get(ring, F.pmod(i - 1 + n, n)), F.get(ring, F.pmod(i + 1, n))
        d = angle_between(orientation(before["x"], before["y"], p["x"], p["y"]), orientation(p["x"], p["y"], after["x"], after["y"]))
        return d >= least

    return F.filter(ring, turn)


def classified_paths(paths: DataFrame, long: float, thick: float) -> DataFrame:
    """Adds kind to drawn segments (path, x1, y1, x2, y2, width, colour, dashed): 'reference', 'chain', 'boundary', 'separation', 'internal' or 'doubled'.

    Dashed grey is reference; blue is chain; thick and long black is boundary. A thick short path is boundary if all its
    ends are ends of boundaries, else separation; a thin path is internal unless each of its segments repeats a boundary.
    """
    length = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    spot = lambda a, b: F.concat_ws(",", F.bround(F.col(a), 1).cast("string"), F.bround(F.col(b), 1).cast("string"))
    p = paths.withColumns({"_length": length, "_a": spot("x1", "y1"), "_b": spot("x2", "y2")})
    p = p.withColumn("_first", F.when(F.col("dashed") & (F.col("colour") == "grey"), "reference").when(F.col("colour") == "blue", "chain").when((F.col("width") >= thick) & (F.col("_length") >= long), "boundary"))
    rim = p.where("_first = 'boundary'")
    ends = rim.select(F.explode(F.array("_a", "_b")).alias("_end")).distinct()
    sides = rim.select(F.least("_a", "_b").alias("_lo"), F.greatest("_a", "_b").alias("_hi")).distinct().withColumn("_on", F.lit(True))
    known = p.select("path", F.explode(F.array("_a", "_b")).alias("_end")).join(ends.withColumn("_met", F.lit(True)), "_end", "left").groupBy("path").agg(F.bool_and(F.coalesce("_met", F.lit(False))).alias("_all_met"))
    repeats = p.withColumns({"_lo": F.least("_a", "_b"), "_hi": F.greatest("_a", "_b")}).join(sides, ["_lo", "_hi"], "left").groupBy("path").agg(F.bool_and(F.coalesce("_on", F.lit(False))).alias("_repeats"))
    out = p.join(known, "path", "left").join(repeats, "path", "left")
    kind = F.when(F.col("_first").isNotNull(), F.col("_first")).when((F.col("width") >= thick) & F.col("_all_met"), "boundary").when(F.col("width") >= thick, "separation").when(F.col("_repeats"), "doubled").otherwise("internal")
    return out.withColumn("kind", kind).drop("_length", "_a", "_b", "_first", "_all_met", "_repeats")


def network_checks(segments: DataFrame, key: str, digits: int = 1) -> DataFrame:
    """Soundness of each key's network of segments (x1, y1, x2, y2): segments, repeated (undirected, after rounding), nodes, odd_nodes, loose_ends, length."""
    spot = lambda x, y: F.struct(F.bround(x, digits).alias("x"), F.bround(y, digits).alias("y"))
    s = segments.select(key, spot("x1", "y1").alias("a"), spot("x2", "y2").alias("b"), F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")).alias("l")).where("a <> b")
    sides = s.groupBy(key, F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(F.count("*").alias("n"), F.max("l").alias("l"))
    total = sides.groupBy(key).agg(F.sum("n").alias("segments"), F.sum(F.col("n") - 1).alias("repeated"), F.sum("l").alias("length"))
    degree = sides.select(key, F.explode(F.array("lo", "hi")).alias("p")).groupBy(key, "p").agg(F.count("*").alias("d"))
    nodes = degree.groupBy(key).agg(F.count("*").alias("nodes"), F.count_if(F.col("d") % 2 == 1).alias("odd_nodes"), F.count_if(F.col("d") == 1).alias("loose_ends"))
    return total.join(nodes, key)


def carried(points: DataFrame, controls: DataFrame, reach: float, k: int = 2) -> DataFrame:
    """pid, x, y: points (pid, x, y) moved like their ``k`` nearest controls (cid, x, y, to_x, to_y) within ``reach``, by inverse distance; others stay."""
    a = points.select(F.col("pid").alias("lid"), F.col("x").alias("lx"), F.col("y").alias("ly"))
    b = controls.select(F.col("cid").alias("rid"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    near = nearest(a, b, reach, k).join(controls.select(F.col("cid").alias("rid"), (F.col("to_x") - F.col("x")).alias("sx"), (F.col("to_y") - F.col("y")).alias("sy")), "rid")
    weight = 1 / (F.col("gap") + 1e-9)
    shift = near.groupBy(F.col("lid").alias("pid")).agg((F.sum(weight * F.col("sx")) / F.sum(weight)).alias("sx"), (F.sum(weight * F.col("sy")) / F.sum(weight)).alias("sy"))
    return points.join(shift, "pid", "left").select("pid", (F.col("x") + F.coalesce("sx", F.lit(0.0))).alias("x"), (F.col("y") + F.coalesce("sy", F.lit(0.0))).alias("y"))


def surveyed_stones(drawing: DataFrame, reach: float = 2.0) -> DataFrame:
    """stone, x, y, code of the POINT entities of drawing rows (see sources.files.read_dxf), each with the nearest text within ``reach``."""
    numbered = F.xxhash64("file", "ord")
    points = drawing.where("entity = 'POINT'").select(numbered.alias("lid"), F.col("x").alias("lx"), F.col("y").alias("ly"))
    labels = drawing.where("entity IN ('TEXT', 'MTEXT') AND text IS NOT NULL").select(numbered.alias("rid"), F.col("x").alias("rx"), F.col("y").alias("ry"), F.col("text").alias("code"))
    named = nearest(points, labels.drop("code"), reach).join(labels.select("rid", "code"), "rid").select("lid", "code")
    return points.join(named, "lid", "left").select(F.col("lid").alias("stone"), F.col("lx").alias("x"), F.col("ly").alias("y"), "code")


def traced_edges(drawing: DataFrame, stones: DataFrame, reach: float) -> DataFrame:
    """a < b, length: the undirected edges between stones that traced lines of a drawing follow, each vertex standing for its nearest stone within ``reach``."""
    v = drawing.where("entity IN ('LWPOLYLINE', 'POLYLINE', 'LINE')").select(F.struct("file", "ord", "at").alias("lid"), F.col("x").alias("lx"), F.col("y").alias("ly"))
    near = nearest(v, stones.select(F.col("stone").alias("rid"), F.col("x").alias("rx"), F.col("y").alias("ry")), reach)
    w = Window.partitionBy("lid.file", "lid.ord").orderBy("lid.at")
    steps = near.select(F.col("rid").alias("p"), F.lag("rid").over(w).alias("q")).where("p <> q").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()
    place = lambda s: stones.select(F.col("stone").alias(s), F.col("x").alias(f"{s}x"), F.col("y").alias(f"{s}y"))
    return steps.join(place("a"), "a").join(place("b"), "b").select("a", "b", F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")).alias("length"))


def known_readings(readings: DataFrame, known: DataFrame) -> DataFrame:
    """Each row of ``readings`` (reading, ...) with survey: the longest number of ``known`` (known) that it may mean, then the smallest; null if there is none.

    As text.known_survey(), but what a reading may mean meets the known numbers by equality, so the list has no bound.
    """
    options = readings.select("reading").where("reading IS NOT NULL").distinct().withColumn("known", F.explode(survey_options(F.col("reading"))))
    hits = merged(options, known.select("known").distinct(), ["known"])
    found = hits.groupBy("reading").agg(F.min(F.struct((-F.length("known")).alias("size"), "known")).alias("b")).select("reading", F.col("b.known").alias("survey"))
    return merged(readings, found, ["reading"], "left")


def by_fingerprint(left: DataFrame, right: DataFrame, worst: float, apart: float) -> DataFrame:
    """lid, rid, rms: for each ring of ``left`` (lid, lengths) the ring of ``right`` (rid, lengths) whose sorted edge lengths fit best, up to an rms of ``worst``; ties go to the smaller rid.

    Only rings with equal numbers of edges whose lengths sum to within ``apart`` meet, in bands of that sum. Equal
    fingerprints of the right side are one candidate, the smallest rid, so that copies make no pairs.
    """
    from parcelwright.functions.plane import fingerprint, fingerprint_rms

    made = lambda df, k: df.select(F.col(k), fingerprint(F.col("lengths")).alias(f"{k}_print")).withColumns({"edges": F.col(f"{k}_print.n"), f"{k}_sum": F.aggregate(f"{k}_print.bins", F.lit(0.0), lambda s, v: s + v)})
    once = made(right, "rid").groupBy("rid_print", "edges", "rid_sum").agg(F.min("rid").alias("rid"))
    met = band(made(left, "lid"), once, "lid_sum", "rid_sum", apart, ["edges"]).where("lid <> rid")
    fit = met.withColumn("rms", F.round(fingerprint_rms(F.col("lid_print"), F.col("rid_print")), 9)).where(F.col("rms") <= worst)
    return fit.groupBy("lid").agg(F.min(F.struct("rms", "rid")).alias("m")).select("lid", "m.rid", "m.rms")


def ranked_candidates(left: DataFrame, right: DataFrame, key: list[str], score: Column, most: int) -> DataFrame:
    """lid, rid, score, place: the ``most`` best rows of ``right`` (rid) for each of ``left`` (lid) with the same key; larger scores first, ties to the smaller rid, null scores out."""
    met = left.join(right, key).withColumn("score", score).where("score IS NOT NULL")
    ranked = met.withColumn("place", F.row_number().over(Window.partitionBy("lid").orderBy(F.col("score").desc(), "rid")))
    return ranked.where(F.col("place") <= most).select("lid", "rid", "score", "place")
