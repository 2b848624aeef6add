"""Queries of the matching operators on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelwright.functions import plane, text
from parcelwright.operators import matching
from parcelwright.sources.tables import table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def _edges(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "parcels").where(F.size("polygon") >= 3).select("parcel_id", F.posexplode(plane.closed_pairs(F.col("polygon"))).alias("at", "e"))
    return p.select(F.col("parcel_id").alias("plot"), F.struct("parcel_id", "at").alias("eid"), "e.x1", "e.y1", "e.x2", "e.y2").where("x1 IS NOT NULL AND x2 IS NOT NULL")


_EDGE_SQL = """
WITH r AS (SELECT parcel_id, polygon AS g, len(polygon) AS n FROM parcels WHERE len(polygon) >= 3),
e AS (SELECT parcel_id AS plot, i - 1 AS eid, g[i].x AS x1, g[i].y AS y1, g[i % n + 1].x AS x2, g[i % n + 1].y AS y2 FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM r))
"""


@query(_EDGE_SQL + """
, f AS (SELECT fmb_id, placed_x AS x, placed_y AS y FROM fmb_errors WHERE isfinite(placed_x) AND isfinite(placed_y)),
c AS (SELECT f.*, e.*, (x2 - x1) ** 2 + (y2 - y1) ** 2 AS l FROM f JOIN e ON least(x1, x2) <= x + 30 AND greatest(x1, x2) >= x - 30 AND least(y1, y2) <= y + 30 AND greatest(y1, y2) >= y - 30),
t AS (SELECT *, CASE WHEN l = 0 THEN 0 ELSE least(1, greatest(0, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / CASE WHEN l = 0 THEN 1 ELSE l END)) END AS t FROM c WHERE l >= 64),
d AS (SELECT fmb_id, plot, eid, round(sqrt((x - (x1 + t * (x2 - x1))) ** 2 + (y - (y1 + t * (y2 - y1))) ** 2), 6) AS gap FROM t)
SELECT fmb_id, m.gap AS gap, m.plot AS parcel_id, CAST(m.eid AS INTEGER) AS edge FROM (SELECT fmb_id, min({'gap': gap, 'plot': plot, 'eid': eid}) AS m FROM d WHERE gap <= 30 GROUP BY fmb_id)""")
def nearest_edges(spark: SparkSession, folder: str) -> DataFrame:
    """The nearest parcel edge of at least eight metres within thirty metres of each sketch; ties (of copies) go to the smaller parcel and edge."""
    f = table(spark, folder, "fmb_errors").select(F.col("fmb_id").alias("pid"), plane.finite(F.col("placed_x")).alias("x"), plane.finite(F.col("placed_y")).alias("y"))
    s = _edges(spark, folder).withColumnRenamed("eid", "sid").drop("plot")
    return matching.nearest_segments(f, s, 30.0, 8.0, digits=6).select(F.col("pid").alias("fmb_id"), "gap", "sid.parcel_id", F.col("sid.at").alias("edge"))


@query(_EDGE_SQL + """
, m AS (SELECT a.plot AS plot_a, b.plot AS plot_b, a.eid, sqrt((a.x2 - a.x1) ** 2 + (a.y2 - a.y1) ** 2) AS l FROM e a JOIN e b ON a.plot < b.plot AND b.x1 + b.x2 BETWEEN a.x1 + a.x2 - 6 AND a.x1 + a.x2 + 6 AND b.y1 + b.y2 BETWEEN a.y1 + a.y2 - 6 AND a.y1 + a.y2 + 6
 WHERE (sqrt((a.x1 - b.x1) ** 2 + (a.y1 - b.y1) ** 2) <= 3 AND sqrt((a.x2 - b.x2) ** 2 + (a.y2 - b.y2) ** 2) <= 3) OR (sqrt((a.x1 - b.x2) ** 2 + (a.y1 - b.y2) ** 2) <= 3 AND sqrt((a.x2 - b.x1) ** 2 + (a.y2 - b.y1) ** 2) <= 3))
SELECT plot_a, plot_b, count(*) AS edges, round(sum(l), 3) AS length FROM (SELECT DISTINCT * FROM m) GROUP BY plot_a, plot_b""")
def shared_borders(spark: SparkSession, folder: str) -> DataFrame:
    """Parcel records with edges in common, within three metres."""
    return matching.shared_edges(_edges(spark, folder), 3.0).select("plot_a", "plot_b", "edges", F.round("length", 3).alias("length"))


@query(r"""
WITH r AS (SELECT fmb_id AS rid, coalesce(nullif(regexp_extract(survey, '(\d{1,5})', 1), ''), '?') AS name, placed_x AS x, placed_y AS y, CASE WHEN isfinite(pct_within_tol) THEN pct_within_tol END AS c FROM fmb_errors WHERE isfinite(placed_x) AND isfinite(placed_y)),
s AS (SELECT a.rid, count(DISTINCT b.name) AS support FROM r a JOIN r b ON a.name <> b.name AND b.x BETWEEN a.x - 450 AND a.x + 450 AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 450 GROUP BY a.rid)
SELECT name, rid, support FROM (SELECT r.name, r.rid, coalesce(support, 0) AS support, row_number() OVER (PARTITION BY r.name ORDER BY coalesce(support, 0) DESC, r.c DESC NULLS LAST, r.rid) AS i FROM r LEFT JOIN s USING (rid)) WHERE i = 1""")
def supported_sketches(spark: SparkSession, folder: str) -> DataFrame:
    """The sketch of each survey number with the most other numbers within 450 metres."""
    f = table(spark, folder, "fmb_errors").select(F.col("fmb_id").alias("rid"), F.coalesce(text.base_survey(F.col("survey")), F.lit("?")).alias("name"), plane.finite(F.col("placed_x")).alias("x"), plane.finite(F.col("placed_y")).alias("y"), plane.finite(F.col("pct_within_tol")).alias("confidence")).where("x IS NOT NULL AND y IS NOT NULL")
    return matching.supported_readings(f, 450.0)


@query()
def sketch_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Sketches gathered around the densest places within 900 metres."""
    f = table(spark, folder, "fmb_errors").select(F.col("fmb_id").alias("node"), F.coalesce(text.base_survey(F.col("survey")), F.lit("?")).alias("name"), plane.finite(F.col("placed_x")).alias("x"), plane.finite(F.col("placed_y")).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    return matching.density_blocks(f, 900.0)


@query()
def snapped_parcels(spark: SparkSession, folder: str) -> DataFrame:
    """Corners of different parcel records within half a metre, brought together."""
    p = table(spark, folder, "parcels").select(F.col("parcel_id").alias("plot"), F.posexplode("polygon").alias("at", "p")).where("p.x IS NOT NULL AND p.y IS NOT NULL")
    return matching.snapped_corners(p.select(F.struct("plot", "at").alias("node"), "plot", "at", "p.x", "p.y"), 0.5, 2.0)


@query(r"""
WITH f AS (SELECT fmb_id, nullif(regexp_extract(survey, '(\d{1,5})', 1), '') AS base, stated_area_ha AS a FROM fmb_errors WHERE isfinite(stated_area_ha)), p AS (SELECT DISTINCT nullif(regexp_extract(survey_number, '(\d{1,5})', 1), '') AS base, area_ha FROM parcels WHERE area_ha IS NOT NULL)
SELECT fmb_id, round(arg_min(area_ha, (abs(area_ha - a), area_ha)), 6) AS area_ha FROM f LEFT JOIN p USING (base) WHERE base IS NOT NULL GROUP BY fmb_id""")
def nearest_areas(spark: SparkSession, folder: str) -> DataFrame:
    """The area, among parcels of the same number, nearest to what each sketch states."""
    f = table(spark, folder, "fmb_errors").select("fmb_id", text.base_survey(F.col("survey")).alias("base"), plane.finite(F.col("stated_area_ha")).alias("a")).where("a IS NOT NULL AND base IS NOT NULL")
    p = table(spark, folder, "parcels").select(text.base_survey(F.col("survey_number")).alias("base"), "area_ha").where("area_ha IS NOT NULL")
    return matching.nearest_value(f, p, ["base"], "a", "area_ha").select("fmb_id", F.round("nearest", 6).alias("area_ha"))


@query("""
SELECT s_suppkey, o_orderkey FROM supplier JOIN orders ON o_totalprice BETWEEN abs(s_acctbal) * 30 AND abs(s_acctbal) * 30 + 2000 WHERE o_orderstatus = 'P'""")
def priced_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """Orders whose price lies in a supplier's range."""
    low = F.abs("s_acctbal") * 30
    ranges = table(spark, folder, "supplier").select("s_suppkey", low.alias("low"), (low + 2000).alias("high"))
    return matching.in_ranges(table(spark, folder, "orders").where("o_orderstatus = 'P'").select("o_orderkey", "o_totalprice"), ranges, "o_totalprice", "low", "high", 4000.0).select("s_suppkey", "o_orderkey")


@query(_EDGE_SQL.replace("n FROM parcels WHERE len(polygon) >= 3", "n FROM parcels WHERE len(polygon) >= 3") + """
, a AS (SELECT plot, eid, (degrees(atan2(y2 - y1, x2 - x1)) + 360) % 180 AS o FROM e), b AS (SELECT plot, eid, o, coalesce(lag(o) OVER (PARTITION BY plot ORDER BY eid), last(o) OVER (PARTITION BY plot ORDER BY eid ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS p FROM a)
SELECT plot AS parcel_id, CAST(count(*) FILTER (least(abs(o - p), 180 - abs(o - p)) >= 2) AS INTEGER) AS corners FROM b GROUP BY plot""")
def true_corners(spark: SparkSession, folder: str) -> DataFrame:
    """Corners of each parcel ring where it bends by two degrees or more."""
    p = table(spark, folder, "parcels").where(F.size("polygon") >= 3)
    return p.select("parcel_id", F.size(matching.without_bends(F.col("polygon"))).alias("corners"))


@query()
def placed_plots(spark: SparkSession, folder: str) -> DataFrame:
    """Parcel rings laid on the surveyed stones of their village by votes of their edges."""
    there = F.filter("polygon", lambda v: v.isNotNull() & plane.finite(v["x"]).isNotNull() & plane.finite(v["y"]).isNotNull())
    closed = (F.size("whole") > 1) & (F.get("whole", F.lit(0)) == F.get("whole", F.size("whole") - 1))
    ring = F.col("ring")
    p = table(spark, folder, "parcels").withColumn("whole", there).withColumn("ring", F.when(closed, F.slice("whole", 1, F.size("whole") - 1)).otherwise(F.col("whole"))).where(F.size(F.array_distinct("ring")) >= 3)
    first = F.get(ring, F.lit(0))
    turned = F.transform(ring, lambda v: F.struct((v["x"] - first["x"]).alias("x"), (v["y"] - first["y"]).alias("y")))
    corners = p.where("lgd_village_code IS NOT NULL").select(F.col("parcel_id").alias("plot"), F.col("lgd_village_code").alias("area"), F.posexplode(turned).alias("at", "v")).select("plot", "area", "at", "v.x", "v.y")
    sound = table(spark, folder, "stones").where("lgd_village_code IS NOT NULL").select("stone_id", F.col("lgd_village_code").alias("area"), plane.finite(F.col("x")).alias("x"), plane.finite(F.col("y")).alias("y")).where("x > 1000 AND y > 1000")
    stones = sound.groupBy("area", "x", "y").agg(F.min("stone_id").alias("stone"))
    sides = p.where("lgd_village_code IS NOT NULL").select(F.explode(plane.closed_pairs(ring)).alias("e"))
    longest = sides.agg(F.max(F.hypot(F.col("e.x2") - F.col("e.x1"), F.col("e.y2") - F.col("e.y1")))).collect()[0][0]
    return matching.placed_best(corners, stones, 0.5, longest or 1.0)


@query(_EDGE_SQL + """
, s AS (SELECT plot, struct_pack(x := round_even(x1, 1), y := round_even(y1, 1)) AS a, struct_pack(x := round_even(x2, 1), y := round_even(y2, 1)) AS b, sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) AS l FROM e),
u AS (SELECT plot, least(a, b) AS lo, greatest(a, b) AS hi, count(*) AS n, max(l) AS l FROM s WHERE a <> b GROUP BY plot, least(a, b), greatest(a, b)), t AS (SELECT plot, sum(n) AS segments, sum(n - 1) AS repeated, sum(l) AS length FROM u GROUP BY plot),
d AS (SELECT plot, p, count(*) AS d FROM (SELECT plot, unnest([lo, hi]) AS p FROM u) GROUP BY ALL), o AS (SELECT plot, count(*) AS nodes, count(*) FILTER (d % 2 = 1) AS odd_nodes, count(*) FILTER (d = 1) AS loose_ends FROM d GROUP BY plot)
SELECT plot AS parcel_id, CAST(segments AS BIGINT) AS segments, CAST(repeated AS BIGINT) AS repeated, round(length, 4) AS length, nodes, odd_nodes, loose_ends FROM t JOIN o USING (plot)""")
def ring_soundness(spark: SparkSession, folder: str) -> DataFrame:
    """Repeated edges, odd corners and loose ends of each parcel ring."""
    return matching.network_checks(_edges(spark, folder).withColumnRenamed("plot", "parcel_id"), "parcel_id").withColumn("length", F.round("length", 4))
