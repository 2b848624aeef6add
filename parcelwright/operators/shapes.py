"""Shapes that need a kernel: exact overlaps, hulls, skeletons, faces, rigid placements. Kernels run on Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelwright.functions.plane import finite
from parcelwright.operators.joins import along_cells, merged

HULL_BUFFER = 100_000  # hull points that a task holds before it hands them on; see hulls()


def overlaps(pairs: DataFrame, a: str = "ring_a", b: str = "ring_b") -> DataFrame:
    """Adds shared (area), share (of the smaller ring) and iou to pairs of rings; 0 where a ring is null or has no area.

    Pairs should come from joins.boxes_meeting(), so that only rings that may meet are clipped.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        from parcelwright.functions.kernels import overlap_areas_flat, ring_areas

        def flat(rings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
            v = rings.flatten()
            return np.column_stack([v.field(c).to_numpy(zero_copy_only=False).astype(float) for c in ("x", "y")]), pc.fill_null(pc.list_value_length(rings), 0).to_numpy(zero_copy_only=False).astype(np.int64)

        for batch in batches:
            left, right = flat(batch.column(a)), flat(batch.column(b))
            shared = overlap_areas_flat(*left, *right).round(9)  # clipping leaves a last digit that would move shares on the edge of rounding
            x, y = ring_areas(*left), ring_areas(*right)
            smaller, union = np.minimum(x, y), x + y - shared
            part = lambda whole: np.where(whole > 0, shared / np.where(whole > 0, whole, 1.0), 0.0)
            kept = [c for c in batch.schema.names if c not in (a, b)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *[pa.array(v) for v in (shared, part(smaller), part(union))]], [*kept, "shared", "share", "iou"])

    fields = [f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema if f.name not in (a, b)]
    return pairs.mapInArrow(run, ", ".join([*fields, "shared double, share double, iou double"]))


def hulls(points: DataFrame, key: str, factor: float = 2.5) -> DataFrame:
    """Convex and concave hull of the points (x, y) of each key: corners, area, concave_corners, concave_area.

    Each task draws the convex hulls of its own points, and the hull of those hulls is the whole one. A concave hull needs
    inner points: all distinct points of a key meet in one task.
    """
    kind = points.schema[key].dataType.simpleString()
    placed = points.select(key, finite(F.col("x")).alias("x"), finite(F.col("y")).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")

    def partial(frames: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        from parcelwright.functions.kernels import convex_hull

        held: dict = {}

        def out():
            keys = [k for k, r in held.items() for _ in r]
            xy = np.vstack([*held.values(), np.zeros((0, 2))])
            return pd.DataFrame({key: pd.Series(keys, dtype=object), "x": xy[:, 0], "y": xy[:, 1]})

        for frame in frames:
            for k, part in frame.groupby(key, dropna=False):
                k = None if pd.isna(k) else k
                held[k] = convex_hull(np.vstack([held.get(k, np.zeros((0, 2))), part[["x", "y"]].to_numpy(float)]))
            if sum(map(len, held.values())) > HULL_BUFFER:
                yield out()
                held.clear()
        yield out()

    def run(frames: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        from parcelwright.functions.kernels import concave_hull, convex_hull, signed_area

        as_points = lambda r: np.array([(v["x"], v["y"]) for v in r], float).reshape(-1, 2)
        area = lambda r: abs(signed_area(r)) if len(r) >= 3 else 0.0
        for frame in frames:
            out = []
            for k, rim, inner in zip(frame[key], frame["rim"], frame["inner"]):
                hull, concave = convex_hull(as_points(rim)), concave_hull(as_points(inner), factor)
                out.append((k, len(hull), area(hull), len(concave), area(concave)))
            yield pd.DataFrame(out, columns=[key, "corners", "area", "concave_corners", "concave_area"])

    rims = placed.mapInPandas(partial, f"{key} {kind}, x double, y double").groupBy(key).agg(F.collect_list(F.struct("x", "y")).alias("rim"))
    every = placed.groupBy(key).agg(F.collect_set(F.struct("x", "y")).alias("inner"))
    both = rims.join(every.withColumnRenamed(key, "_key"), F.col(key).eqNullSafe(F.col("_key")))
    return both.select(key, "rim", "inner").mapInPandas(run, f"{key} {kind}, corners int, area double, concave_corners int, concave_area double")


def skeletons(rings: DataFrame, key: str, most: int) -> DataFrame:
    """Corners of each ring (column ring) simplified until at most ``most`` are left: key, corners, area, kept_area."""

    def run(frames: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        from parcelwright.functions.kernels import signed_area, skeleton

        for frame in frames:
            out = []
            for k, ring in zip(frame[key], frame["ring"]):
                r = np.array([(v["x"], v["y"]) for v in ring], float)
                r = r[:-1] if len(r) > 3 and (r[0] == r[-1]).all() else r
                s = skeleton(r, most)
                out.append((k, len(s), abs(signed_area(r)), abs(signed_area(s)) if len(s) >= 3 else 0.0))
            yield pd.DataFrame(out, columns=[key, "corners", "area", "kept_area"])

    kind = rings.schema[key].dataType.simpleString()
    return rings.where(F.size("ring") >= 3).select(key, "ring").mapInPandas(run, f"{key} {kind}, corners int, area double, kept_area double")


def network_faces(segments: DataFrame, key: str) -> DataFrame:
    """The largest face of each key's network of segments (x1, y1, x2, y2): faces, area, outer ring as array<struct<x, y>>; a drawing is one task."""

    def run(frame):
        import pandas as pd

        from parcelwright.functions.kernels import faces, signed_area

        rings = faces(list(zip(zip(frame["x1"], frame["y1"]), zip(frame["x2"], frame["y2"]))))
        best = max(rings, key=signed_area, default=None)
        ring = [{"x": float(x), "y": float(y)} for x, y in best] if best is not None else None
        return pd.DataFrame({key: [frame[key].iloc[0]], "faces": [len(rings)], "area": [float(signed_area(best)) if best is not None else 0.0], "ring": [ring]})

    kind = segments.schema[key].dataType.simpleString()
    return segments.groupBy(key).applyInPandas(run, f"{key} {kind}, faces int, area double, ring array<struct<x: double, y: double>>")


def rigid_placements(pairs: DataFrame, key: str) -> DataFrame:
    """A rigid pose that lays ring ``src`` on ring ``dst`` of each row: angle, shift_x, shift_y, residual.

    Seeds are the rotations that take one edge of ``src`` to an edge of ``dst`` of similar length; each is refined by
    nearest corners (ICP), and the smallest mean distance wins.
    """

    def run(frames: Iterator) -> Iterator:
        import math

        import numpy as np
        import pandas as pd

        from parcelwright.functions.kernels import icp, moved

        ring = lambda r: np.array([(v["x"], v["y"]) for v in r], float)
        for frame in frames:
            out = []
            for k, a, b in zip(frame[key], frame["src"], frame["dst"]):
                a, b = ring(a), ring(b)
                ea, eb = np.roll(a, -1, axis=0) - a, np.roll(b, -1, axis=0) - b
                la, lb = np.hypot(*ea.T), np.hypot(*eb.T)
                seeds = []
                for i in range(len(a)):
                    for j in range(len(b)):
                        if abs(la[i] - lb[j]) <= max(2.0, 0.08 * max(la[i], lb[j])):
                            for flip in (0.0, math.pi):
                                angle = math.atan2(eb[j][1], eb[j][0]) - math.atan2(ea[i][1], ea[i][0]) + flip
                                turned = moved(a, (angle, 1.0, 0.0, 0.0))
                                seeds.append((angle, 1.0, *(b.mean(axis=0) - turned.mean(axis=0))))
                best = min((icp(a, b, s) for s in seeds), key=lambda r: r[1], default=None)
                pose = best[0] if best else (None,) * 4
                out.append((k, pose[0], pose[2], pose[3], best[1] if best else None))
            yield pd.DataFrame(out, columns=[key, "angle", "shift_x", "shift_y", "residual"])

    kind = pairs.schema[key].dataType.simpleString()
    return pairs.where(F.size("src") >= 3).where(F.size("dst") >= 3).select(key, "src", "dst").mapInPandas(run, f"{key} {kind}, angle double, shift_x double, shift_y double, residual double")


def covered_parts(segments: DataFrame, lines: DataFrame, reach: float, keep: list[str]) -> DataFrame:
    """The columns ``keep``, low, high: the shares of the way along each segment (x1, y1, x2, y2) between which it lies within ``reach`` of a line (lx1, ly1, lx2, ly2).

    The part of a segment near one line is one interval, since the places within ``reach`` of a line are convex: it is
    solved for the strip along the line and the discs about its ends. A line goes to the cells, of about its own size,
    that it touches, a segment to the cells of each such size near it, so only near ones are compared; a pair that meets
    in several cells gives its interval again, which changes no union.
    """
    c = F.col
    base = max(1.0, 4 * reach)
    size = F.greatest(F.abs(c("lx2") - c("lx1")), F.abs(c("ly2") - c("ly1")))
    level = F.greatest(F.lit(0), F.ceil(F.log2(size / base) / 2).cast("int"))
    side = base * F.pow(F.lit(4.0), c("_level"))
    sized = lines.select("lx1", "ly1", "lx2", "ly2", F.when(size > 0, level).when(size == 0, 0).alias("_level")).where("_level IS NOT NULL")
    levels = [r[0] for r in sized.select("_level").distinct().collect()]
    b = along_cells(sized, "lx1", "ly1", "lx2", "ly2", 0.0, side)
    a = along_cells(segments.select(*keep, "x1", "y1", "x2", "y2", F.explode(F.array(*[F.lit(k) for k in levels]).cast("array<int>")).alias("_level")), "x1", "y1", "x2", "y2", reach, side)
    met = merged(a, b, ["_level", "_u", "_v"])
    met = met.select(*keep, (c("x2") - c("x1")).alias("dx"), (c("y2") - c("y1")).alias("dy"), (c("lx2") - c("lx1")).alias("ex"), (c("ly2") - c("ly1")).alias("ey"), (c("x1") - c("lx1")).alias("px"), (c("y1") - c("ly1")).alias("py"), (c("x1") - c("lx2")).alias("qx"), (c("y1") - c("ly2")).alias("qy"))
    # each step's columns are used several times in the next, so a step isn't written out within the other: the code would be too long to compile
    met = met.withColumns({"_long": c("ex") * c("ex") + c("ey") * c("ey"), "_square": c("dx") * c("dx") + c("dy") * c("dy")})
    met = met.withColumns({"_off": c("ex") * c("py") - c("ey") * c("px"), "_off_slope": c("ex") * c("dy") - c("ey") * c("dx"), "_wide": reach * F.sqrt("_long"), "_along": c("ex") * c("px") + c("ey") * c("py"), "_along_slope": c("ex") * c("dx") + c("ey") * c("dy"), "_phalf": c("dx") * c("px") + c("dy") * c("py"), "_qhalf": c("dx") * c("qx") + c("dy") * c("qy")})
    root = lambda p: c(f"_{p}half") * c(f"_{p}half") - c("_square") * (c(f"{p}x") * c(f"{p}x") + c(f"{p}y") * c(f"{p}y") - reach * reach)

    def between(at: Column, slope: Column, low: Column, high: Column) -> tuple[Column, Column]:
        inside = F.when(at.between(low, high), 0.0), F.when(at.between(low, high), 1.0)
        return F.when(slope > 0, (low - at) / slope).when(slope < 0, (high - at) / slope).otherwise(inside[0]), F.when(slope > 0, (high - at) / slope).when(slope < 0, (low - at) / slope).otherwise(inside[1])

    off, along = between(c("_off"), c("_off_slope"), -c("_wide"), c("_wide")), between(c("_along"), c("_along_slope"), F.lit(0.0), c("_long"))
    met = met.withColumns({"_off0": off[0], "_off1": off[1], "_along0": along[0], "_along1": along[1], "_proot": F.when(c("_square") > 0, root("p")), "_qroot": F.when(c("_square") > 0, root("q"))})
    met = met.withColumns({"_strip0": F.greatest("_off0", "_along0"), "_strip1": F.least("_off1", "_along1"), "_pwide": F.when(c("_proot") >= 0, F.sqrt("_proot")), "_qwide": F.when(c("_qroot") >= 0, F.sqrt("_qroot"))})
    both = (c("_long") > 0) & c("_off0").isNotNull() & c("_along0").isNotNull() & (c("_strip0") <= c("_strip1"))
    disc = lambda p: tuple(F.when(c(f"_{p}wide").isNotNull(), (-c(f"_{p}half") + way * c(f"_{p}wide")) / c("_square")) for way in (-1, 1))
    parts = [(F.when(both, c("_strip0")), F.when(both, c("_strip1"))), disc("p"), disc("q")]
    # the three parts make one interval; greatest() and least() would skip a null, so pairs without one are left out
    met = met.withColumns({"_low": F.least(*[low for low, _ in parts]), "_high": F.greatest(*[high for _, high in parts])})
    met = met.withColumns({"low": F.when(c("_low").isNotNull(), F.greatest(F.lit(0.0), c("_low"))), "high": F.least(F.lit(1.0), c("_high"))})
    one = F.explode(F.when(c("low") < c("high"), F.array(F.struct("low", "high"))))
    return met.select(*keep, one.alias("_part")).select(*keep, "_part.low", "_part.high")


def newly_covered(*key: str) -> Column:
    """How much of an interval (low, high) none of its ``key`` that starts earlier holds; the sum is the length of their union."""
    before = Window.partitionBy(*key).orderBy("low", "high").rowsBetween(Window.unboundedPreceding, -1)
    return F.greatest(F.lit(0.0), F.col("high") - F.greatest("low", F.coalesce(F.max("high").over(before), F.lit(0.0))))


def covered_lengths(segments: DataFrame, lines: DataFrame, reach: float) -> DataFrame:
    """How much of each segment (sid, x1, y1, x2, y2) lies within ``reach`` of a line (lx1, ly1, lx2, ly2): sid, length, covered; the union of its covered_parts()."""
    c = F.col
    near = covered_parts(segments, lines, reach, ["sid"])
    length = F.hypot(c("x2") - c("x1"), c("y2") - c("y1"))
    whole = near.withColumn("length", F.lit(None).cast("double")).unionByName(segments.select("sid", F.lit(0.0).alias("low"), F.lit(0.0).alias("high"), length.alias("length")))
    union = whole.withColumn("new", newly_covered("sid")).groupBy("sid").agg(F.max("length").alias("length"), F.sum("new").alias("share"))
    return union.select("sid", "length", (c("length") * c("share")).alias("covered"))
