"""Plane geometry as Columns: angles, segments, rings, similarity transforms."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def orientation(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Direction of a line without its sense, in [0, 180)."""
    return F.pmod(F.degrees(F.atan2(y2 - y1, x2 - x1)) + 360, F.lit(180.0))


def angle_between(a: Column, b: Column) -> Column:
    """Difference of two orientations, in [0, 90]."""
    d = F.pmod(F.abs(a - b), F.lit(180.0))
    return F.least(d, 180 - d)


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point from a segment."""
    length2 = (bx - ax) * (bx - ax) + (by - ay) * (by - ay)
    t = F.when(length2 == 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / F.when(length2 == 0, 1.0).otherwise(length2))))
    return F.hypot(px - (ax + t * (bx - ax)), py - (ay + t * (by - ay)))


def projected_overlap(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """Overlap of two intervals as a share of the shorter one."""
    low, high = F.greatest(F.least(a1, a2), F.least(b1, b2)), F.least(F.greatest(a1, a2), F.greatest(b1, b2))
    shorter = F.least(F.abs(a2 - a1), F.abs(b2 - b1))
    return F.when(shorter > 0, F.greatest(F.lit(0.0), high - low) / shorter).otherwise(0.0)


def boxes_overlap(ax0: Column, ay0: Column, ax1: Column, ay1: Column, bx0: Column, by0: Column, bx1: Column, by1: Column) -> Column:
    """Whether two closed boxes meet."""
    return (ax0 <= bx1) & (bx0 <= ax1) & (ay0 <= by1) & (by0 <= ay1)


def box_overlap_area(ax0: Column, ay0: Column, ax1: Column, ay1: Column, bx0: Column, by0: Column, bx1: Column, by1: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(ax1, bx1) - F.greatest(ax0, bx0)) * F.greatest(F.lit(0.0), F.least(ay1, by1) - F.greatest(ay0, by0))


def closed_pairs(ring: Column) -> Column:
    """Array of struct(x1, y1, x2, y2): the edges of a ring, the last one back to its start."""
    following = F.concat(F.slice(ring, 2, F.greatest(F.size(ring), F.lit(1))), F.slice(ring, 1, 1))
    return F.zip_with(ring, following, lambda p, n: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), n["x"].alias("x2"), n["y"].alias("y2")))


def ring_area(ring: Column) -> Column:
    """Area by the shoelace formula about the first vertex; 0 with fewer than three vertices."""
    o = F.get(ring, F.lit(0))
    cross = F.aggregate(closed_pairs(ring), F.lit(0.0), lambda s, e: s + (e["x1"] - o["x"]) * (e["y2"] - o["y"]) - (e["x2"] - o["x"]) * (e["y1"] - o["y"]))
    return F.when(F.size(ring) >= 3, F.abs(cross) / 2).otherwise(0.0)


def ring_length(ring: Column) -> Column:
    return F.aggregate(closed_pairs(ring), F.lit(0.0), lambda s, e: s + F.hypot(e["x2"] - e["x1"], e["y2"] - e["y1"]))


def closure_gap(ring: Column) -> Column:
    """Distance of the last vertex from the first; null with fewer than three."""
    a, b = F.get(ring, F.lit(0)), F.element_at(ring, -1)
    return F.when(F.size(ring) >= 3, F.hypot(b["x"] - a["x"], b["y"] - a["y"]))


def ring_diagonal(ring: Column) -> Column:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.hypot(F.array_max(xs) - F.array_min(xs), F.array_max(ys) - F.array_min(ys))


def densified(ring: Column, step: float) -> Column:
    """The vertices of a ring with points every ``step`` along its edges."""

    def along(e: Column) -> Column:
        length = F.hypot(e["x2"] - e["x1"], e["y2"] - e["y1"])
        inner = F.greatest(F.floor(length / step).cast("int") - 1, F.lit(0))
        at = lambda k: k * step / length
        return F.transform(F.sequence(F.lit(0), inner), lambda k: F.struct((e["x1"] + F.when(length > 0, at(k)).otherwise(0.0) * (e["x2"] - e["x1"])).alias("x"), (e["y1"] + F.when(length > 0, at(k)).otherwise(0.0) * (e["y2"] - e["y1"])).alias("y")))

    return F.flatten(F.transform(closed_pairs(ring), along))


def similarity(angle: Column, scale: Column, tx: Column, ty: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """The point (x, y) turned by ``angle`` (radians), scaled and moved."""
    return scale * (F.cos(angle) * x - F.sin(angle) * y) + tx, scale * (F.sin(angle) * x + F.cos(angle) * y) + ty


def pair_similarity(ax: Column, ay: Column, bx: Column, by: Column, px: Column, py: Column, qx: Column, qy: Column, scales: tuple[float, float] | None = None) -> Column:
    """struct(angle, scale, tx, ty) that takes segment ab to segment pq; null for a point, or a scale outside ``scales``."""
    length = F.hypot(bx - ax, by - ay)
    angle = F.atan2(qy - py, qx - px) - F.atan2(by - ay, bx - ax)
    scale = F.hypot(qx - px, qy - py) / F.when(length > 0, length)
    tx, ty = similarity(angle, scale, F.lit(0.0), F.lit(0.0), ax, ay)
    made = F.struct(angle.alias("angle"), scale.alias("scale"), (px - tx).alias("tx"), (py - ty).alias("ty"))
    return F.when(scale.isNotNull() & (scale.between(*scales) if scales else F.lit(True)), made)


def utm_zone(lon: Column) -> Column:
    """Number of the UTM zone of a longitude."""
    return F.least(F.greatest(F.floor((lon + 180) / 6).cast("int") + 1, F.lit(1)), F.lit(60))


def utm_crs(lon: Column, northern: bool = True) -> Column:
    return F.concat(F.lit("EPSG:326" if northern else "EPSG:327"), F.lpad(utm_zone(lon).cast("string"), 2, "0"))


# The WGS84 ellipsoid and the scale of the central meridian.
SEMI_MAJOR, FLATTENING, MERIDIAN_SCALE = 6_378_137.0, 1 / 298.257223563, 0.9996


def _kruger() -> tuple[float, list[float], list[float]]:
    """Rectifying radius, and the coefficients of the forward and the inverse series in n to the third order and more."""
    n = FLATTENING / (2 - FLATTENING)
    radius = SEMI_MAJOR / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    forward = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]
    inverse = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280]
    return radius, forward, inverse


def to_utm(lon: Column, lat: Column, zone: Column) -> Column:
    """struct(x, y): easting and northing (northern hemisphere) of a longitude and latitude in degrees, by Krüger's series."""
    radius, series, _ = _kruger()
    e = math.sqrt(FLATTENING * (2 - FLATTENING))
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    xi, eta = F.atan2(t, F.cos(lam)), F.asinh(F.sin(lam) / F.sqrt(t * t + F.cos(lam) * F.cos(lam)))
    x, y = eta, xi
    for k, a in enumerate(series, 1):
        x = x + a * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
        y = y + a * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
    return F.struct((500_000 + MERIDIAN_SCALE * radius * x).alias("x"), (MERIDIAN_SCALE * radius * y).alias("y"))


def from_utm(x: Column, y: Column, zone: Column) -> Column:
    """struct(lon, lat) in degrees of a UTM position (northern hemisphere)."""
    radius, _, series = _kruger()
    e = math.sqrt(FLATTENING * (2 - FLATTENING))
    xi, eta = y / (MERIDIAN_SCALE * radius), (x - 500_000) / (MERIDIAN_SCALE * radius)
    a, b = xi, eta
    for k, c in enumerate(series, 1):
        a = a - c * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
        b = b - c * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
    goal = F.sin(a) / F.cosh(b)  # sine of the conformal latitude
    q, s = F.atanh(goal), goal
    for _ in range(5):
        s = F.tanh(q + e * F.atanh(e * s))
    return F.struct((F.degrees(F.atan2(F.sinh(b), F.cos(a))) + zone * 6 - 183).alias("lon"), F.degrees(F.asin(s)).alias("lat"))


def tile_pixel(lon: Column, lat: Column, zoom: int, size: int = 256) -> Column:
    """struct(px, py): pixel of a place in the square world of a zoom level."""
    world = float(size * 2**zoom)
    return F.struct(((lon + 180) / 360 * world).alias("px"), ((1 - F.asinh(F.tan(F.radians(lat))) / math.pi) / 2 * world).alias("py"))


def pixel_place(px: Column, py: Column, zoom: int, size: int = 256) -> Column:
    """struct(lon, lat) of a pixel."""
    world = float(size * 2**zoom)
    return F.struct((px / world * 360 - 180).alias("lon"), F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * py / world)))).alias("lat"))


def binned(length: Column, width: float = 0.5) -> Column:
    return F.bround(length / width) * width


def fingerprint(lengths: Column) -> Column:
    """struct(n, bins): number and sorted bins of edge lengths."""
    return F.struct(F.size(lengths).alias("n"), F.array_sort(F.transform(lengths, lambda v: binned(v))).alias("bins"))


def fingerprint_rms(a: Column, b: Column) -> Column:
    """Root mean square of the differences of two fingerprints; null if their numbers differ."""
    return F.when((a["n"] == b["n"]) & (a["n"] > 0), F.sqrt(F.aggregate(F.zip_with(a["bins"], b["bins"], lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, d: s + d) / a["n"]))


def finite(c: Column) -> Column:
    """NaN and infinities as null."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def area_check(area: Column, stated_ha: Column, tolerance: float) -> Column:
    """struct(ratio, error, ok) of an area in square metres against a stated one in hectares; null where none is stated."""
    ratio = area / F.when(stated_ha > 0, stated_ha * 10_000)
    return F.when(ratio.isNotNull(), F.struct(ratio.alias("ratio"), F.abs(ratio - 1).alias("error"), (F.abs(ratio - 1) <= tolerance).alias("ok")))


def clamped(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def beside_line(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column, offset: float) -> Column:
    """struct(x, y): the foot of a point on a line, moved off the line by ``offset`` to the side of the point (left of ab on the line itself)."""
    dx, dy = bx - ax, by - ay
    length = F.hypot(dx, dy)
    t = ((px - ax) * dx + (py - ay) * dy) / F.when(length > 0, length * length)
    side = F.when(dx * (py - ay) - dy * (px - ax) >= 0, 1.0).otherwise(-1.0)
    return F.struct((ax + t * dx - side * offset * dy / F.when(length > 0, length)).alias("x"), (ay + t * dy + side * offset * dx / F.when(length > 0, length)).alias("y"))


def label_box(x: Column, y: Column, angle: Column, letters: Column, height: float, pad: float = 0.0) -> Column:
    """struct(x0, y0, x1, y1) of a text of ``letters`` characters, turned by ``angle`` degrees about its middle."""
    half_w, half_h = letters * height * 0.3 + pad, F.lit(height / 2 + pad)
    c, s = F.abs(F.cos(F.radians(angle))), F.abs(F.sin(F.radians(angle)))
    w, h = half_w * c + half_h * s, half_w * s + half_h * c
    return F.struct((x - w).alias("x0"), (y - h).alias("y0"), (x + w).alias("x1"), (y + h).alias("y1"))


def warped_along(px: Column, py: Column, a: tuple[Column, Column], b: tuple[Column, Column], to_a: tuple[Column, Column], to_b: tuple[Column, Column]) -> Column:
    """struct(x, y): a point of edge ab carried along when its ends move, in proportion to where it lies between them."""
    da, db = F.hypot(px - a[0], py - a[1]), F.hypot(px - b[0], py - b[1])
    t = F.when(da + db > 0, da / (da + db)).otherwise(0.0)
    return F.struct(*[(p + (1 - t) * (ta - fa) + t * (tb - fb)).alias(n) for n, p, fa, fb, ta, tb in zip("xy", (px, py), a, b, to_a, to_b)])


def seed_error(ax: Column, ay: Column, bx: Column, by: Column, radius: Column, sigma: float) -> Column:
    """How far two seed points that are each off by ``sigma`` can throw a point ``radius`` away; null without a baseline."""
    length = F.hypot(bx - ax, by - ay)
    return math.sqrt(2) * sigma / F.when(length > 0, length) * radius


def colour_name(red: Column, green: Column, blue: Column, lead: float = 0.4) -> Column:
    """blue, red, grey or black by which channel (0 to 1) leads; black where any is unknown."""
    grey = (F.abs(red - green) < 0.1) & (F.abs(green - blue) < 0.1) & red.between(0.3, 0.9)
    return F.when((blue - red > lead) & (blue - green > lead), "blue").when((red - green > lead) & (red - blue > lead), "red").when(grey, "grey").otherwise("black")


def page_metres(points: Column, denominator: Column) -> Column:
    """Metres on the ground of a length in points (1/72 inch) on a page drawn at 1 : ``denominator``."""
    return points / 72 * 0.0254 * denominator


def page_place(px: Column, py: Column, height: Column, denominator: Column) -> Column:
    """struct(x, y) in metres of a place on a page whose y runs down from its top, ``height`` points high."""
    return F.struct(page_metres(px, denominator).alias("x"), page_metres(height - py, denominator).alias("y"))


def readable_angle(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Direction of a line in degrees within (-90, 90], so that a text along it isn't upside down."""
    a = orientation(x1, y1, x2, y2)
    return F.when(a > 90, a - 180).otherwise(a)


def square_metres_per_pixel(lat: Column, zoom: int, size: int = 256) -> Column:
    """Ground area of a pixel of a zoom level at a latitude."""
    side = 2 * math.pi * SEMI_MAJOR * F.cos(F.radians(lat)) / float(size * 2**zoom)
    return side * side


def placed(ring: Column, angle: Column, scale: Column, tx: Column, ty: Column) -> Column:
    """The vertices of a ring under a similarity transform."""

    def point(p: Column) -> Column:
        x, y = similarity(angle, scale, tx, ty, p["x"], p["y"])
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(ring, point)


def inner_point(ring: Column) -> Column:
    """struct(x, y): the centroid of a ring, where a label goes; the mean of its vertices where it has no area."""
    o, n = F.get(ring, F.lit(0)), F.size(ring)
    start = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def add(s: Column, e: Column) -> Column:
        x1, y1, x2, y2 = e["x1"] - o["x"], e["y1"] - o["y"], e["x2"] - o["x"], e["y2"] - o["y"]
        cross = x1 * y2 - x2 * y1
        return F.struct((s["a"] + cross).alias("a"), (s["x"] + (x1 + x2) * cross).alias("x"), (s["y"] + (y1 + y2) * cross).alias("y"))

    total = F.aggregate(closed_pairs(ring), start, add)
    mean = lambda k: F.aggregate(ring, F.lit(0.0), lambda s, p: s + p[k]) / n
    flat = F.abs(total["a"]) <= 1e-9
    return F.when(n > 0, F.struct(*[F.when(flat, mean(k)).otherwise(o[k] + total[k] / (3 * F.when(flat, 1.0).otherwise(total["a"]))).alias(k) for k in "xy"]))


def ring_distance(px: Column, py: Column, ring: Column) -> Column:
    """Distance of a point from a ring's area: 0 inside, else that from its nearest edge."""
    edges = closed_pairs(ring)
    crosses = F.size(F.filter(edges, lambda e: ((e["y1"] > py) != (e["y2"] > py)) & (px < (e["x2"] - e["x1"]) * (py - e["y1"]) / F.when(e["y2"] != e["y1"], e["y2"] - e["y1"]) + e["x1"])))
    apart = F.array_min(F.transform(edges, lambda e: segment_distance(px, py, e["x1"], e["y1"], e["x2"], e["y2"])))
    return F.when(crosses % 2 == 1, 0.0).otherwise(apart)


def best_skip(lengths: Column, target: Column) -> Column:
    """struct(skip, rms): which of ``lengths`` to leave out so that the rest fits the fingerprint ``target`` best; the first of several; null where the numbers don't allow it."""
    without = lambda k: F.filter(lengths, lambda v, i: i != k)
    options = F.transform(F.sequence(F.lit(0), F.greatest(F.size(lengths) - 1, F.lit(0))), lambda k: F.struct(F.round(fingerprint_rms(fingerprint(without(k)), target), 9).alias("rms"), k.alias("skip")))
    best = F.array_min(F.filter(options, lambda o: o["rms"].isNotNull()))
    return F.when(best.isNotNull(), F.struct(best["skip"].alias("skip"), best["rms"].alias("rms")))


def gathered(points: Column, indices: Column) -> Column:
    """The points at ``indices`` (from 0), in their order; all points where no index is given or one lies outside."""
    sound = (F.size(indices) > 0) & ~F.exists(indices, lambda i: i.isNull() | (i < 0) | (i >= F.size(points)))
    return F.when(F.coalesce(sound, F.lit(False)), F.transform(indices, lambda i: F.get(points, i))).otherwise(points)


def turned_text(x: Column, y: Column, rotation: Column, angle: Column, scale: Column, tx: Column, ty: Column) -> Column:
    """struct(x, y, rotation) of a text under a similarity transform, its rotation in degrees within [0, 360)."""
    px, py = similarity(angle, scale, tx, ty, x, y)
    return F.struct(px.alias("x"), py.alias("y"), F.pmod(rotation + F.degrees(angle), F.lit(360.0)).alias("rotation"))
