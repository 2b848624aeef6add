"""Queries of the placing operators, of candidates and of reports on whole tables, each with its oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelwright.functions import plane, text
from parcelwright.operators import fits, joins, placing
from parcelwright.plans.measures import _EDGES_SQL, _RINGS_SQL, _edges, _rings, _through
from parcelwright.sources import files, sinks
from parcelwright.sources.tables import table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


@query(_EDGES_SQL + """
, l AS (SELECT plot, 'N' || eid % 3 AS name, x1 * 0.8 + x2 * 0.2 + 0.5 AS x, y1 * 0.8 + y2 * 0.2 - 0.25 AS y FROM e),
m AS (SELECT e.*, l.name, l.x, l.y, (x2 - x1) ** 2 + (y2 - y1) ** 2 AS q FROM e JOIN l USING (plot)), t AS (SELECT *, CASE WHEN q = 0 THEN 0 ELSE least(1, greatest(0, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / q)) END AS t FROM m),
g AS (SELECT plot, name, eid, round(sqrt((x - x1 - t * (x2 - x1)) ** 2 + (y - y1 - t * (y2 - y1)) ** 2), 6) AS gap FROM t)
SELECT plot AS parcel_id, name, min(gap) AS gap FROM g GROUP BY plot, name""")
def neighbour_edges(spark: SparkSession, folder: str) -> DataFrame:
    """The edge of each parcel nearest to the labels that name a neighbour."""
    e = _edges(spark, folder)
    labels = e.select("plot", F.concat(F.lit("N"), (F.col("eid") % 3).cast("string")).alias("name"), (F.col("x1") * 0.8 + F.col("x2") * 0.2 + 0.5).alias("x"), (F.col("y1") * 0.8 + F.col("y2") * 0.2 - 0.25).alias("y"))
    return placing.named_edges(e, labels).select(F.col("plot").alias("parcel_id"), "name", "gap")


_SHAPE = ((0.0, 0.0), (31.0, 0.0), (37.0, 22.0), (11.0, 29.0))  # a plot without symmetry


@query("""
SELECT c_custkey, round(cos(c_custkey % 300 / 50.0), 2) AS cosine, CAST(c_custkey % 40 * 1000 AS DOUBLE) AS tx, CAST(c_custkey // 40 * 1000 AS DOUBLE) AS ty, 1.0::DOUBLE AS coverage FROM customer""")
def poses_on_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Plots of customers laid on traced lines, which are the same plots under planted poses."""
    c = F.col("c_custkey")
    base = table(spark, folder, "customer").select(c.alias("plot"), (c % 300 / 50.0).alias("turn"), (c % 40 * 1000).cast("double").alias("tx"), (F.floor(c / 40) * 1000).cast("double").alias("ty"))
    corners = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in _SHAPE])
    edges = base.select("plot", F.posexplode(plane.closed_pairs(corners)).alias("eid", "e")).select("plot", "eid", "e.*")
    traced = F.concat(plane.placed(corners, F.col("turn"), F.lit(1.0), F.col("tx"), F.col("ty")), F.slice(plane.placed(corners, F.col("turn"), F.lit(1.0), F.col("tx"), F.col("ty")), 1, 1))
    vertices = base.select(F.col("plot").alias("line"), F.posexplode(traced).alias("at", "p")).select("line", "at", "p.x", "p.y")
    segments = placing.traced_segments(vertices, 4.0).withColumnRenamed("line", "window")
    found = placing.poses_on_lines(edges.withColumn("window", F.col("plot")), segments, 0.5, 0.5, ["window"])
    return found.select(F.col("plot").alias("c_custkey"), (F.round(F.cos("angle"), 2) + 0.0).alias("cosine"), (F.round("tx", 1) + 0.0).alias("tx"), (F.round("ty", 1) + 0.0).alias("ty"), F.round("coverage", 3).alias("coverage"))


@query("SELECT c_custkey, CAST(c_custkey % 4 AS INTEGER) AS shift, c_custkey % 2 = 1 AS flipped, 0.0::DOUBLE AS coherence FROM customer")
def corner_orders(spark: SparkSession, folder: str) -> DataFrame:
    """How the corners of a turned and reordered plot correspond to the plot's own."""
    c = F.col("c_custkey")
    corners = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in _SHAPE])
    own = table(spark, folder, "customer").select(c.alias("plot"), F.posexplode(corners).alias("at", "p")).select("plot", "at", "p.x", "p.y")
    shift, flipped = F.col("plot") % 4, F.col("plot") % 2 == 1
    to = F.when(flipped, F.pmod(shift - F.col("at"), F.lit(4))).otherwise(F.pmod(F.col("at") + shift, F.lit(4)))
    x, y = plane.similarity(F.col("plot") % 300 / 50.0, F.lit(1.0), F.lit(5.0), F.lit(6.0), F.col("x"), F.col("y"))
    other = own.select("plot", to.cast("int").alias("at"), x.alias("x"), y.alias("y"))
    found = placing.best_correspondence(own, other)
    return found.select(F.col("plot").alias("c_custkey"), "shift", "flipped", (F.round("coherence", 4) + 0.0).alias("coherence"))


@query(_EDGES_SQL + """
, l AS (SELECT plot, list(round_even(sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) / 0.5, 0) * 0.5 ORDER BY eid) AS b FROM e GROUP BY plot), w AS (SELECT plot, b, CAST(plot % len(b) AS BIGINT) AS k FROM l),
t AS (SELECT plot, b, list_sort(list_filter(b, lambda v, i: i - 1 <> k)) AS target FROM w), o AS (SELECT plot, s - 1 AS skip, list_sort(list_filter(b, lambda v, i: i <> s)) AS rest, target FROM (SELECT *, unnest(range(1, len(b) + 1)) AS s FROM t)),
z AS (SELECT plot, skip, round(sqrt(list_sum(list_transform(list_zip(rest, target), lambda z: (z[1] - z[2]) ** 2)) / len(rest)), 9) AS rms FROM o)
SELECT plot AS parcel_id, CAST(m.s AS INTEGER) AS skip, m.r AS rms FROM (SELECT plot, min({'r': rms, 's': skip}) AS m FROM z GROUP BY plot)""")
def skipped_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Which edge of a ring to leave out so that it fits the fingerprint of the ring without one edge."""
    lengths = F.transform(plane.closed_pairs(F.col("polygon")), lambda e: F.hypot(e["x2"] - e["x1"], e["y2"] - e["y1"]))
    k = F.col("parcel_id") % F.size("lengths")
    p = _rings(spark, folder).select("parcel_id", lengths.alias("lengths"))
    target = plane.fingerprint(F.filter("lengths", lambda v, i: i != k))
    return p.select("parcel_id", plane.best_skip(F.col("lengths"), target).alias("b")).select("parcel_id", "b.skip", "b.rms")


@query("SELECT c_custkey, CAST(pos AS INTEGER) AS corner, CAST(c_custkey % 30 * 40 + CASE WHEN pos IN (1, 2) THEN 40 ELSE 0 END AS DOUBLE) AS x, CAST(c_custkey // 30 * 40 + CASE WHEN pos >= 2 THEN 40 ELSE 0 END AS DOUBLE) AS y FROM customer, (VALUES (0), (1), (2), (3)) v(pos)")
def spread_poses(spark: SparkSession, folder: str) -> DataFrame:
    """Square plots in a grid, guessed a little wrongly, seated one from another until all are; every seventh is a seed."""
    c = F.col("c_custkey")
    side = 40.0
    square = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (side, 0.0), (side, side), (0.0, side))])
    seed = F.col("plot") % 7 == 0
    off = lambda k: F.when(seed, 0.0).otherwise((F.col("plot") % k - k // 2) / 20.0)
    made = table(spark, folder, "customer").select(c.alias("plot"), F.posexplode(square).alias("at", "p"))
    corners = made.select("plot", "at", "p.x", "p.y", (F.col("plot") % 30 * side + F.col("p.x") + off(7)).alias("gx"), (F.floor(F.col("plot") / 30) * side + F.col("p.y") + off(5)).alias("gy"))
    seated = placing.seats_spread(corners, corners.where(seed).select("plot"), 1.0, 2)
    return seated.select(F.col("plot").alias("c_custkey"), F.col("at").alias("corner"), (F.round("x", 4) + 0.0).alias("x"), (F.round("y", 4) + 0.0).alias("y"))


@query("""
WITH b AS (SELECT c_custkey AS f, c_custkey * 37 % 1000 AS x0, c_custkey * 91 % 1000 AS y0, c_custkey * 37 % 1000 + 10 + c_custkey % 13 AS x1, c_custkey * 91 % 1000 + 8 + c_custkey % 11 AS y1 FROM customer), p AS (SELECT o_orderkey AS k, o_orderkey * 7 % 1009 + 0.5 AS x, o_custkey * 3 % 997 + 0.25 AS y FROM orders),
d AS (SELECT k, f, sqrt(greatest(0, x0 - x, x - x1) ** 2 + greatest(0, y0 - y, y - y1) ** 2) AS gap FROM p JOIN b ON x BETWEEN x0 - 3 AND x1 + 3 AND y BETWEEN y0 - 3 AND y1 + 3)
SELECT k AS o_orderkey, f AS c_custkey, round(gap, 6) AS gap FROM d WHERE gap <= 3""")
def fenced_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Points inside fences or at most three outside."""
    c, k = F.col("c_custkey"), F.col("o_orderkey")
    x0, y0 = (c * 37 % 1000).cast("double"), (c * 91 % 1000).cast("double")
    x1, y1 = x0 + 10 + c % 13, y0 + 8 + c % 11
    ring = F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))])
    points = table(spark, folder, "orders").select(k.alias("pid"), (k * 7 % 1009 + 0.5).cast("double").alias("x"), (F.col("o_custkey") * 3 % 997 + 0.25).cast("double").alias("y"))
    found = placing.within_fences(points, table(spark, folder, "customer").select(c.alias("fid"), ring.alias("ring")), 3.0, 25.0)
    return found.select(F.col("pid").alias("o_orderkey"), F.col("fid").alias("c_custkey"), F.round("gap", 6).alias("gap"))


@query("""
WITH b AS (SELECT c_custkey AS k, c_custkey * 37 % 1000 AS x0, c_custkey * 91 % 1000 AS y0, c_custkey * 37 % 1000 + 10 + c_custkey % 13 AS x1, c_custkey * 91 % 1000 + 8 + c_custkey % 11 AS y1 FROM customer)
SELECT k AS c_custkey FROM b WHERE EXISTS (SELECT 1 FROM b o WHERE o.k < b.k AND o.x0 <= b.x1 AND b.x0 <= o.x1 AND o.y0 <= b.y1 AND b.y0 <= o.y1 AND (least(b.x1, o.x1) - greatest(b.x0, o.x0)) * (least(b.y1, o.y1) - greatest(b.y0, o.y0)) > 0.3 * least((b.x1 - b.x0) * (b.y1 - b.y0), (o.x1 - o.x0) * (o.y1 - o.y0)))""")
def contested_boxes(spark: SparkSession, folder: str) -> DataFrame:
    """Boxes of which an earlier one covers more than 0.3 of the smaller of both."""
    c = F.col("c_custkey")
    x0, y0 = (c * 37 % 1000).cast("double"), (c * 91 % 1000).cast("double")
    side = lambda p: table(spark, folder, "customer").select(c.alias(f"{p}id"), x0.alias(f"{p}x0"), y0.alias(f"{p}y0"), (x0 + 10 + c % 13).alias(f"{p}x1"), (y0 + 8 + c % 11).alias(f"{p}y1"))
    met = joins.boxes_meeting(side("l"), side("r"), 25.0).where("lid < rid")
    box = lambda p: [F.col(f"{p}{e}") for e in ("x0", "y0", "x1", "y1")]
    size = lambda p: (F.col(f"{p}x1") - F.col(f"{p}x0")) * (F.col(f"{p}y1") - F.col(f"{p}y0"))
    return met.where(plane.box_overlap_area(*box("l"), *box("r")) > 0.3 * F.least(size("l"), size("r"))).select(F.col("rid").alias("c_custkey")).distinct()


@query("""
WITH n AS (SELECT source, village, count(*) AS n FROM parcels WHERE village IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, village) AS i FROM n)
SELECT a.source, a.village, CAST(a.n AS DOUBLE) AS score, CAST(b.n AS DOUBLE) AS second, a.n >= 3 AND a.n >= 1.25 * coalesce(b.n, 0) AS decisive FROM r a LEFT JOIN r b ON a.source IS NOT DISTINCT FROM b.source AND b.i = 2 WHERE a.i = 1""")
def leading_villages(spark: SparkSession, folder: str) -> DataFrame:
    """The village spelling each source has most records of, and whether it leads clearly."""
    n = table(spark, folder, "parcels").where("village IS NOT NULL").groupBy("source", "village").agg(F.count("*").cast("double").alias("n"))
    return placing.best_and_second(n, ["source"], "village", F.col("n"), 3.0, 1.25)


@query("""
WITH a AS (SELECT lgd_village_code AS code, area_ha, parcel_id FROM parcels WHERE area_ha IS NOT NULL AND lgd_village_code IS NOT NULL), s AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY area_ha) AS i, count(*) OVER (PARTITION BY code) AS n FROM a), m AS (SELECT code, area_ha AS middle FROM s WHERE i = n // 2 + 1)
SELECT parcel_id, middle, area_ha < 0.1 * middle AS small, area_ha > 4 * middle AS large FROM a JOIN m USING (code)""")
def odd_areas(spark: SparkSession, folder: str) -> DataFrame:
    """Areas against the upper median of their village, from an aggregate that collapses equal values."""
    a = table(spark, folder, "parcels").where("area_ha IS NOT NULL AND lgd_village_code IS NOT NULL").select("parcel_id", F.col("lgd_village_code").alias("code"), "area_ha")
    middle = a.groupBy("code").agg(F.expr("-(percentile_disc(0.5) WITHIN GROUP (ORDER BY -area_ha))").alias("middle"))
    return a.join(middle, "code").select("parcel_id", "middle", (F.col("area_ha") < 0.1 * F.col("middle")).alias("small"), (F.col("area_ha") > 4 * F.col("middle")).alias("large"))


@query(r"""
WITH b AS (SELECT DISTINCT nullif(regexp_extract(survey, '(\d{1,5})', 1), '') AS base FROM fmb_errors), p AS (SELECT nullif(regexp_extract(e.survey_number, '(\d{1,5})', 1), '') AS base, count(*) AS proposals, count(*) FILTER (e.accepted_by_gate) AS accepted FROM (SELECT unnest(proposals) AS e FROM agent_reports) GROUP BY 1),
q AS (SELECT nullif(regexp_extract(e.survey_number, '(\d{1,5})', 1), '') AS base, arg_max(e.disposition, {'t': run_at, 'r': report_id, 'd': e.disposition}) AS last_disposition FROM (SELECT report_id, run_at, unnest(requests) AS e FROM agent_reports) WHERE e.disposition IS NOT NULL GROUP BY 1)
SELECT base, proposals, accepted, last_disposition FROM b LEFT JOIN p USING (base) LEFT JOIN q USING (base) WHERE base IS NOT NULL""")
def survey_traces(spark: SparkSession, folder: str) -> DataFrame:
    """For each surveyed number the proposals made and the last request's disposition."""
    from parcelwright.operators.state import with_evidence

    r = table(spark, folder, "agent_reports")
    base = table(spark, folder, "fmb_errors").select(text.base_survey(F.col("survey")).alias("base")).where("base IS NOT NULL").distinct()
    proposals = r.select(F.explode("proposals").alias("e")).groupBy(text.base_survey(F.col("e.survey_number")).alias("base")).agg(F.count("*").alias("proposals"), F.count_if("e.accepted_by_gate").alias("accepted"))
    requests = r.select("report_id", "run_at", F.explode("requests").alias("e")).where("e.disposition IS NOT NULL").groupBy(text.base_survey(F.col("e.survey_number")).alias("base")).agg(F.max_by("e.disposition", F.struct("run_at", "report_id", "e.disposition")).alias("last_disposition"))
    return with_evidence(base, "base", {"p": proposals, "q": requests}).select("base", "p.proposals", "p.accepted", "q.last_disposition")


@query("""
SELECT report_id, CAST(i AS INTEGER) AS at, rpad(coalesce(e.name, ''), 24, ' ') || upper(coalesce(e.severity, '?')) || coalesce(': ' || trim(e.detail), '') AS line FROM (SELECT report_id, unnest(checks) AS e, unnest(range(len(checks))) AS i FROM agent_reports) WHERE e IS NOT NULL""")
def check_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Checks as lines of a report."""
    e = table(spark, folder, "agent_reports").select("report_id", F.posexplode("checks").alias("at", "e")).where("e IS NOT NULL")
    return e.select("report_id", "at", text.check_line(F.col("e.name"), F.col("e.severity"), F.col("e.detail")).alias("line"))


@query("""
SELECT village, fmb_id, CAST(row_number() OVER w AS INTEGER) AS priority, CAST((row_number() OVER w - 1) % 5 * 100 AS DOUBLE) AS dx, CAST(-((row_number() OVER w - 1) // 5) * 100 AS DOUBLE) AS dy FROM (SELECT coalesce(header_village, '') AS village, fmb_id, CASE WHEN isfinite(median_err) THEN median_err END AS m FROM fmb_errors) WINDOW w AS (PARTITION BY village ORDER BY m DESC NULLS LAST, fmb_id)""")
def worklists(spark: SparkSession, folder: str) -> DataFrame:
    """The sketches of each village, the worst first, and their places in a grid."""
    f = table(spark, folder, "fmb_errors").select(F.coalesce("header_village", F.lit("")).alias("village"), "fmb_id", plane.finite(F.col("median_err")).alias("m"))
    order = [F.col("m").desc_nulls_last(), F.col("fmb_id")]
    return sinks.staged(sinks.worklist(f, "village", order).withColumnRenamed("priority", "p"), "village", order, 5, 100.0).select("village", "fmb_id", F.col("p").alias("priority"), F.col("dx").cast("double").alias("dx"), (F.col("dy") + 0.0).cast("double").alias("dy"))


@query("SELECT parcel_id, polygon[1].x AS x, polygon[1].y AS y FROM parcels WHERE len(polygon) > 0 AND polygon[1].x IS NOT NULL AND polygon[1].y IS NOT NULL")
def first_coordinates(spark: SparkSession, folder: str) -> DataFrame:
    """The first coordinate of each ring written as GeoJSON."""
    p = table(spark, folder, "parcels").where("size(polygon) > 0 AND polygon[0].x IS NOT NULL AND polygon[0].y IS NOT NULL")
    written = F.concat(F.lit('{"type": "Polygon", "coordinates": '), F.to_json(F.array(F.transform("polygon", lambda v: F.array(v["x"], v["y"])))), F.lit("}"))
    return p.select("parcel_id", text.first_coordinate(written).alias("c")).select("parcel_id", "c.x", "c.y")


@query(f"""
WITH {_RINGS_SQL}, o AS (SELECT parcel_id, list_filter(g, lambda v, i: i = 1 OR v <> g[i - 1]) AS g FROM r), c AS (SELECT parcel_id, CASE WHEN len(g) > 1 AND g[1] = g[len(g)] THEN g[1:len(g) - 1] ELSE g END AS g FROM o)
SELECT parcel_id, CAST(len(g) AS INTEGER) AS corners FROM c WHERE len(g) >= 3 AND abs(list_sum(list_transform(range(1, len(g) + 1), lambda i: (g[i].x - g[1].x) * (g[i % len(g) + 1].y - g[1].y) - (g[i % len(g) + 1].x - g[1].x) * (g[i].y - g[1].y)))) > 0""")
def repaired_rings(spark: SparkSession, folder: str) -> DataFrame:
    """Rings without repeated and closing vertices; those without an area are left out."""
    return _rings(spark, folder).select("parcel_id", files.repaired(F.col("polygon")).alias("ring")).where("ring IS NOT NULL").select("parcel_id", F.size("ring").alias("corners"))


@query(f"WITH {_RINGS_SQL} SELECT parcel_id, CAST(len(CASE WHEN parcel_id % 3 = 0 THEN g ELSE [g[1], g[3]] END) AS INTEGER) AS points, CASE WHEN parcel_id % 3 = 0 THEN g[n].x ELSE g[1].x END AS last_x FROM r")
def gathered_corners(spark: SparkSession, folder: str) -> DataFrame:
    """Corners picked by their numbers, all of them where a number is wrong."""
    picked = F.when(F.col("parcel_id") % 3 == 0, F.array(F.lit(0), F.lit(100_000))).otherwise(F.array(F.lit(2), F.lit(0)))
    got = _rings(spark, folder).select("parcel_id", plane.gathered(F.col("polygon"), picked).alias("g"))
    return got.select("parcel_id", F.size("g").alias("points"), F.element_at("g", -1)["x"].alias("last_x"))


@query("""
SELECT o_orderkey, round(1.5 * (cos(a) * x - sin(a) * y) + 10, 5) AS x, round(1.5 * (sin(a) * x + cos(a) * y) - 20, 5) AS y, round((r + degrees(a)) % 360, 5) AS rotation FROM (SELECT o_orderkey, o_custkey % 50 AS x, o_orderkey % 60 AS y, o_orderkey % 360 AS r, o_custkey % 314 / 50.0 AS a FROM orders)""")
def turned_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Texts of drawings under poses."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    got = plane.turned_text((c % 50).cast("double"), (k % 60).cast("double"), (k % 360).cast("double"), c % 314 / 50.0, F.lit(1.5), F.lit(10.0), F.lit(-20.0))
    return table(spark, folder, "orders").select("o_orderkey", *[F.round(got[n], 5).alias(n) for n in ("x", "y", "rotation")])


@query(f"""
WITH {_RINGS_SQL}, v AS (SELECT parcel_id, unnest(g) AS p FROM r), a AS (SELECT parcel_id, var_pop(p.x - 200000) AS vx, var_pop(p.y - 900000) AS vy, covar_pop(p.x - 200000, p.y - 900000) AS cv FROM v GROUP BY parcel_id)
SELECT parcel_id, round(abs(cos(0.5 * atan2(2 * cv, vx - vy))), 4) AS cosine FROM a WHERE sqrt((vx - vy) ** 2 + 4 * cv ** 2) > 1""")
def ring_axes(spark: SparkSession, folder: str) -> DataFrame:
    """Principal axes of parcel corners that have one."""
    v = _rings(spark, folder).select("parcel_id", F.explode("polygon").alias("p")).select("parcel_id", (F.col("p.x") - 200_000).alias("x"), (F.col("p.y") - 900_000).alias("y"))
    clear = v.groupBy("parcel_id").agg(F.var_pop("x").alias("a"), F.var_pop("y").alias("b"), F.covar_pop("x", "y").alias("c")).where(F.sqrt((F.col("a") - F.col("b")) * (F.col("a") - F.col("b")) + 4 * F.col("c") * F.col("c")) > 1).select("parcel_id")
    return fits.principal_axis(v, "parcel_id").join(clear, "parcel_id", "left_semi").select("parcel_id", F.round(F.abs(F.cos("axis")), 4).alias("cosine"))


@query(f"WITH {_RINGS_SQL} SELECT 'P' || parcel_id AS layer, CAST(n AS BIGINT) AS edges, round(2 * list_sum(list_transform(g, lambda v: round(v.x, 6))), 3) AS sum_x FROM r")
def edge_drawings(spark: SparkSession, folder: str) -> DataFrame:
    """Parcels written as a drawing with a line for each edge, and read back."""
    none = F.lit(None).cast("double")
    p = _rings(spark, folder).select(F.concat(F.lit("P"), F.col("parcel_id").cast("string")).alias("layer"), F.col("polygon").alias("ring"), F.lit(None).cast("string").alias("text"), none.alias("x"), none.alias("y"))
    found = _through(spark, lambda out: sinks.write_dxf(p, out, edges=True), lambda out: files.read_dxf(spark, out, suffix=".txt"))
    return found.where("entity = 'LINE'").groupBy("layer").agg(F.count_if(F.col("at") == 0).alias("edges"), F.round(F.sum("x"), 3).alias("sum_x"))
