"""Queries that exercise the relational operators on whole tables, each with its oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelwright.functions import plane, text
from parcelwright.operators import fits, joins, windows
from parcelwright.sources.tables import table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    """Registers a query under its name, with its oracle SQL if there is one."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


# -- text -------------------------------------------------------------------------------------------------------------


@query(r"""
SELECT parcel_id, nullif(regexp_extract(survey_number, '(\d{1,5})', 1), '') AS base,
       CASE WHEN regexp_matches(nullif(regexp_extract(survey_number, '(\d{1,5})', 1), ''), '^[01689]+$')
            THEN translate(reverse(regexp_extract(survey_number, '(\d{1,5})', 1)), '69', '96') END AS upside_down,
       translate(survey_number, '.', ',') AS comma, left(village, 6) AS short_name,
       'clients/' || coalesce(source, '') || '/' || parcel_id AS object_key
FROM parcels""")
def survey_texts(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "parcels")
    base = text.base_survey(F.col("survey_number"))
    return p.select("parcel_id", base.alias("base"), text.upside_down(base).alias("upside_down"), text.comma_decimal(F.col("survey_number")).alias("comma"), F.substring("village", 1, 6).alias("short_name"), F.concat(F.lit("clients/"), F.coalesce("source", F.lit("")), F.lit("/"), F.col("parcel_id").cast("string")).alias("object_key"))


@query(r"""
WITH raw AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
         CASE l_linenumber % 4 WHEN 0 THEN '(' || replace(CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS VARCHAR), '.', ',') || ')'
              WHEN 1 THEN CAST(CAST(l_quantity AS DECIMAL(12,1)) AS VARCHAR) || '.' WHEN 2 THEN l_returnflag || CAST(l_partkey AS VARCHAR)
              ELSE replace(CAST(CAST(l_tax AS DECIMAL(12,2)) AS VARCHAR), '.', ' , ') END AS raw FROM lineitem
), clean AS (
  SELECT *, regexp_replace(replace(replace(regexp_replace(trim(raw), '^\(+|\)+$', '', 'g'), ',', '.'), ' ', ''), '\.+$', '') AS t FROM raw
), val AS (SELECT *, CASE WHEN regexp_matches(t, '^-?\d+(\.\d+)?$') THEN CAST(t AS DOUBLE) END AS v FROM clean)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN v IS NOT NULL THEN t END AS normalized,
       CASE WHEN v IS NULL THEN 'noise' WHEN v < 0.1 OR v > 1000 THEN 'out_of_range' ELSE 'ok' END AS reason,
       CAST(replace(nullif(regexp_extract(raw, '(\d{1,4}[.,]\d{1,2})', 1), ''), ',', '.') AS DOUBLE) AS measured
FROM val""")
def readings(spark: SparkSession, folder: str) -> DataFrame:
    li = table(spark, folder, "lineitem")
    decimal = lambda c, n: F.col(c).cast(f"decimal(12,{n})").cast("string")
    raw = F.when(F.col("l_linenumber") % 4 == 0, F.concat(F.lit("("), F.translate(decimal("l_extendedprice", 2), ".", ","), F.lit(")"))).when(F.col("l_linenumber") % 4 == 1, F.concat(decimal("l_quantity", 1), F.lit("."))).when(F.col("l_linenumber") % 4 == 2, F.concat("l_returnflag", F.col("l_partkey").cast("string"))).otherwise(F.replace(decimal("l_tax", 2), F.lit("."), F.lit(" , ")))
    read = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", raw.alias("raw")).withColumn("c", text.checked_reading(F.col("raw")))
    return read.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "c.normalized", "c.reason", text.measured_value(F.col("raw")).alias("measured"))


@query(r"""
SELECT fmb_id, nullif(regexp_extract(m1_file, '^(?:m1/)?([A-Z]+)[_-]([A-Za-z]+)[_-]', 1), '') AS district,
       nullif(regexp_extract(m1_file, '^(?:m1/)?([A-Z]+)[_-]([A-Za-z]+)[_-]', 2), '') AS taluk, nullif(lower(regexp_extract(m1_file, '\.([A-Za-z]+)$', 1)), '') AS suffix FROM fmb_errors""")
def file_parts(spark: SparkSession, folder: str) -> DataFrame:
    pattern = r"^(?:m1/)?([A-Z]+)[_-]([A-Za-z]+)[_-]"
    f = F.col("m1_file")
    return table(spark, folder, "fmb_errors").select("fmb_id", text.first_match(f, pattern, 1).alias("district"), text.first_match(f, pattern, 2).alias("taluk"), F.lower(text.first_match(f, r"\.([A-Za-z]+)$")).alias("suffix"))


# -- geometry ---------------------------------------------------------------------------------------------------------

_RING_SQL = """
WITH r AS (
  SELECT parcel_id, polygon AS g, len(polygon) AS n FROM parcels WHERE polygon IS NOT NULL AND len(polygon) > 0
), e AS (
  SELECT parcel_id, n, i, g[1].x AS ox, g[1].y AS oy, g[i].x AS x1, g[i].y AS y1, g[i % n + 1].x AS x2, g[i % n + 1].y AS y2
  FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM r)
)
"""


@query(_RING_SQL + """
SELECT parcel_id, round(CASE WHEN n >= 3 THEN abs(sum((x1 - ox) * (y2 - oy) - (x2 - ox) * (y1 - oy))) / 2 ELSE 0 END, 3) AS area,
       round(sum(sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2)), 3) AS length,
       round(CASE WHEN n >= 3 THEN sqrt((arg_max(x1, i) - any_value(ox)) ** 2 + (arg_max(y1, i) - any_value(oy)) ** 2) END, 3) AS gap,
       round(sqrt((max(x1) - min(x1)) ** 2 + (max(y1) - min(y1)) ** 2), 3) AS diagonal
FROM e GROUP BY parcel_id, n""")
def ring_measures(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "parcels").where(F.size("polygon") > 0)
    g = F.col("polygon")
    return p.select("parcel_id", F.round(plane.ring_area(g), 3).alias("area"), F.round(plane.ring_length(g), 3).alias("length"), F.round(plane.closure_gap(g), 3).alias("gap"), F.round(plane.ring_diagonal(g), 3).alias("diagonal"))


@query(_RING_SQL + """
SELECT parcel_id, CAST(n AS INTEGER) AS corners, array_to_string(list_sort(list(CAST(round_even(sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) / 0.5, 0) AS INTEGER))), ',') AS bins
FROM e GROUP BY parcel_id, n""")
def fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "parcels").where(F.size("polygon") > 0)
    lengths = F.transform(plane.closed_pairs(F.col("polygon")), lambda e: F.hypot(e["x2"] - e["x1"], e["y2"] - e["y1"]))
    f = plane.fingerprint(lengths)
    return p.select("parcel_id", f["n"].alias("corners"), F.array_join(F.transform(f["bins"], lambda b: F.round(b / 0.5).cast("int").cast("string")), ",").alias("bins"))


@query(_RING_SQL + """
, two AS (
  SELECT parcel_id, max(CASE WHEN i = 1 THEN (degrees(atan2(y2 - y1, x2 - x1)) + 360) % 180 END) AS a, max(CASE WHEN i = 2 THEN (degrees(atan2(y2 - y1, x2 - x1)) + 360) % 180 END) AS b
  FROM e WHERE n >= 3 GROUP BY parcel_id
)
SELECT parcel_id, round(a, 4) AS first_direction, round(b, 4) AS second_direction, round(least(abs(a - b), 180 - abs(a - b)), 4) AS between_them FROM two""")
def edge_angles(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "parcels").where(F.size("polygon") >= 3).withColumn("e", plane.closed_pairs(F.col("polygon")))
    turn = lambda i: plane.orientation(*[F.get("e", F.lit(i))[c] for c in ("x1", "y1", "x2", "y2")])
    a, b = turn(0), turn(1)
    return p.select("parcel_id", F.round(a, 4).alias("first_direction"), F.round(b, 4).alias("second_direction"), F.round(plane.angle_between(a, b), 4).alias("between_them"))


@query("""
SELECT c_custkey, floor(px / 256)::BIGINT AS tx, floor(py / 256)::BIGINT AS ty, round(px, 3) AS px, round(py, 3) AS py, round(px / w * 360 - 180, 7) AS lon, round(degrees(atan((exp(m) - exp(-m)) / 2)), 7) AS lat
FROM (SELECT *, pi() * (1 - 2 * py / w) AS m FROM (SELECT c_custkey, 67108864.0 AS w, (lon + 180) / 360 * 67108864.0 AS px, (1 - asinh(tan(radians(lat))) / pi()) / 2 * 67108864.0 AS py
  FROM (SELECT c_custkey, 76 + (c_custkey * 37 % 1000) / 500.0 AS lon, 8 + (c_custkey * 91 % 1000) / 200.0 AS lat FROM customer)))""")
def map_tiles(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "customer").select("c_custkey", (76 + (F.col("c_custkey") * 37 % 1000) / 500.0).alias("lon"), (8 + (F.col("c_custkey") * 91 % 1000) / 200.0).alias("lat"))
    c = c.withColumn("p", plane.tile_pixel(F.col("lon"), F.col("lat"), 18)).withColumn("back", plane.pixel_place(F.col("p.px"), F.col("p.py"), 18))
    return c.select("c_custkey", F.floor(F.col("p.px") / 256).alias("tx"), F.floor(F.col("p.py") / 256).alias("ty"), F.round("p.px", 3).alias("px"), F.round("p.py", 3).alias("py"), F.round("back.lon", 7).alias("lon"), F.round("back.lat", 7).alias("lat"))


@query("""
SELECT c_custkey, CAST(least(greatest(floor((lon + 180) / 6) + 1, 1), 60) AS INTEGER) AS zone, 'EPSG:326' || lpad(CAST(CAST(least(greatest(floor((lon + 180) / 6) + 1, 1), 60) AS INTEGER) AS VARCHAR), 2, '0') AS crs, round(lon, 7) AS lon, round(lat, 7) AS lat
FROM (SELECT c_custkey, c_custkey * 37 % 360 - 179.5 + (c_custkey % 7) / 10.0 AS lon, (c_custkey * 91 % 800) / 10.0 AS lat FROM customer)""")
def utm_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Places projected to their UTM zone and back; the oracle has the places themselves."""
    c = table(spark, folder, "customer").select("c_custkey", (F.col("c_custkey") * 37 % 360 - 179.5 + (F.col("c_custkey") % 7) / 10.0).alias("lon"), ((F.col("c_custkey") * 91 % 800) / 10.0).alias("lat"))
    c = c.withColumn("zone", plane.utm_zone(F.col("lon"))).withColumn("u", plane.to_utm(F.col("lon"), F.col("lat"), F.col("zone"))).withColumn("back", plane.from_utm(F.col("u.x"), F.col("u.y"), F.col("zone")))
    return c.select("c_custkey", "zone", plane.utm_crs(F.col("lon")).alias("crs"), F.round("back.lon", 7).alias("lon"), F.round("back.lat", 7).alias("lat"))


# -- joins ------------------------------------------------------------------------------------------------------------


def _places(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "fmb_errors").select(F.col("fmb_id").alias("lid"), plane.finite(F.col("placed_x")).alias("lx"), plane.finite(F.col("placed_y")).alias("ly"))


def _stones(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "stones").select(F.col("stone_id").alias("rid"), plane.finite(F.col("x")).alias("rx"), plane.finite(F.col("y")).alias("ry")).where("rx IS NOT NULL AND ry IS NOT NULL").distinct()


_NEAR_SQL = """
WITH s AS (SELECT DISTINCT stone_id, x, y, floor(x / 40) AS u, floor(y / 40) AS v FROM stones WHERE isfinite(x) AND isfinite(y)),
f AS (SELECT fmb_id, placed_x AS x, placed_y AS y, floor(placed_x / 40) AS u, floor(placed_y / 40) AS v FROM fmb_errors WHERE isfinite(placed_x) AND isfinite(placed_y)),
m AS (SELECT f.fmb_id, s.stone_id, sqrt((f.x - s.x) ** 2 + (f.y - s.y) ** 2) AS gap FROM f JOIN s ON s.u BETWEEN f.u - 1 AND f.u + 1 AND s.v BETWEEN f.v - 1 AND f.v + 1 WHERE sqrt((f.x - s.x) ** 2 + (f.y - s.y) ** 2) <= 40)
"""


@query(_NEAR_SQL + "SELECT fmb_id, stone_id, round(gap, 4) AS gap, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY fmb_id ORDER BY gap, stone_id) AS INTEGER) AS place FROM m) WHERE place <= 3")
def nearest_stones(spark: SparkSession, folder: str) -> DataFrame:
    found = joins.nearest(_places(spark, folder), _stones(spark, folder), 40.0, 3)
    return found.select(F.col("lid").alias("fmb_id"), F.col("rid").alias("stone_id"), F.round("gap", 4).alias("gap"), "place")


@query(_NEAR_SQL + "SELECT fmb_id FROM fmb_errors WHERE fmb_id NOT IN (SELECT fmb_id FROM m)")
def sketches_without_stones(spark: SparkSession, folder: str) -> DataFrame:
    return joins.none_within(_places(spark, folder), _stones(spark, folder), 40.0).select(F.col("lid").alias("fmb_id"))


@query("""
WITH b AS (SELECT parcel_id, list_min(list_transform(polygon, lambda p: p.x)) AS x0, list_min(list_transform(polygon, lambda p: p.y)) AS y0, list_max(list_transform(polygon, lambda p: p.x)) AS x1, list_max(list_transform(polygon, lambda p: p.y)) AS y1 FROM parcels WHERE len(polygon) >= 3),
m AS (SELECT a.parcel_id AS parcel_a, c.parcel_id AS parcel_b, (least(a.x1, c.x1) - greatest(a.x0, c.x0)) * (least(a.y1, c.y1) - greatest(a.y0, c.y0)) AS shared, least((a.x1 - a.x0) * (a.y1 - a.y0), (c.x1 - c.x0) * (c.y1 - c.y0)) AS smaller
  FROM b a JOIN b c ON a.parcel_id < c.parcel_id AND a.x0 <= c.x1 AND c.x0 <= a.x1 AND a.y0 <= c.y1 AND c.y0 <= a.y1)
SELECT parcel_a, parcel_b, round(shared / smaller, 4) AS share FROM m WHERE smaller > 0 AND shared / smaller > 0.05""")
def box_overlaps(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "parcels").where(F.size("polygon") >= 3)
    bound = lambda f, c: f(F.transform("polygon", lambda v: v[c]))
    b = p.select("parcel_id", bound(F.array_min, "x").alias("x0"), bound(F.array_min, "y").alias("y0"), bound(F.array_max, "x").alias("x1"), bound(F.array_max, "y").alias("y1"))
    side = lambda df, s: df.select(F.col("parcel_id").alias(f"{s}id"), *[F.col(c).alias(f"{s}{c}") for c in ("x0", "y0", "x1", "y1")])
    met = joins.boxes_meeting(side(b, "l"), side(b, "r"), 100.0).where("lid < rid")
    box = [F.col(c) for c in ("lx0", "ly0", "lx1", "ly1", "rx0", "ry0", "rx1", "ry1")]
    smaller = F.least((F.col("lx1") - F.col("lx0")) * (F.col("ly1") - F.col("ly0")), (F.col("rx1") - F.col("rx0")) * (F.col("ry1") - F.col("ry0")))
    share = plane.box_overlap_area(*box) / F.when(smaller > 0, smaller)
    return met.where(share > 0.05).select(F.col("lid").alias("parcel_a"), F.col("rid").alias("parcel_b"), F.round(share, 4).alias("share"))


@query(r"""
WITH p AS (SELECT parcel_id, nullif(regexp_extract(survey_number, '(\d{1,5})', 1), '') AS base, area_ha FROM parcels WHERE area_ha IS NOT NULL),
f AS (SELECT fmb_id, nullif(regexp_extract(survey, '(\d{1,5})', 1), '') AS base, stated_area_ha FROM fmb_errors WHERE isfinite(stated_area_ha))
SELECT fmb_id, parcel_id, round(abs(stated_area_ha - area_ha), 6) AS difference FROM f JOIN p USING (base) WHERE abs(stated_area_ha - area_ha) <= 0.01""")
def area_bands(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "parcels").where("area_ha IS NOT NULL").select("parcel_id", text.base_survey(F.col("survey_number")).alias("base"), "area_ha")
    f = table(spark, folder, "fmb_errors").select("fmb_id", text.base_survey(F.col("survey")).alias("base"), plane.finite(F.col("stated_area_ha")).alias("stated")).where("stated IS NOT NULL")
    return joins.band(f, p, "stated", "area_ha", 0.01, ["base"]).select("fmb_id", "parcel_id", F.round(F.abs(F.col("stated") - F.col("area_ha")), 6).alias("difference"))


@query(r"""
WITH p AS (SELECT nullif(regexp_extract(survey_number, '(\d{1,5})', 1), '') AS base, source, area_ha, parcel_id FROM parcels),
one AS (SELECT base, source, arg_min(parcel_id, (-coalesce(area_ha, -1), parcel_id)) AS parcel_id FROM p WHERE base IS NOT NULL AND source IN ('state_vector', 'legacy_csv') GROUP BY base, source)
SELECT coalesce(a.base, b.base) AS base, coalesce(a.parcel_id, b.parcel_id) AS parcel_id, CASE WHEN a.parcel_id IS NOT NULL THEN 'primary' ELSE 'secondary' END AS origin
FROM (SELECT * FROM one WHERE source = 'state_vector') a FULL JOIN (SELECT * FROM one WHERE source = 'legacy_csv') b ON a.base = b.base""")
def preferred_source(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "parcels").select(text.base_survey(F.col("survey_number")).alias("base"), "source", F.coalesce("area_ha", F.lit(-1.0)).alias("size"), "parcel_id").where("base IS NOT NULL AND source IN ('state_vector', 'legacy_csv')")
    one = joins.keep_first(p, ["base", "source"], [-F.col("size"), F.col("parcel_id")])
    return joins.first_of(one.where("source = 'state_vector'"), one.where("source = 'legacy_csv'"), "base", "parcel_id")


# -- aggregates -------------------------------------------------------------------------------------------------------


@query(r"""
WITH wanted AS (SELECT DISTINCT regexp_extract(survey, '(\d{1,5})', 1) AS base FROM fmb_errors WHERE regexp_extract(survey, '(\d{1,5})', 1) <> ''),
p AS (SELECT lgd_village_code AS code, regexp_extract(survey_number, '(\d{1,5})', 1) AS base, polygon[1].x AS x, polygon[1].y AS y FROM parcels WHERE lgd_village_code IS NOT NULL)
SELECT code, count(DISTINCT CASE WHEN base IN (SELECT base FROM wanted) THEN base END) AS overlap, round(avg(x), 3) AS cx, round(avg(y), 3) AS cy FROM p GROUP BY code
HAVING count(DISTINCT CASE WHEN base IN (SELECT base FROM wanted) THEN base END) >= 3 ORDER BY overlap DESC, code LIMIT 6""")
def village_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """The six villages that hold most of the wanted survey numbers."""
    wanted = table(spark, folder, "fmb_errors").select(text.base_survey(F.col("survey")).alias("base")).where("base IS NOT NULL").distinct().withColumn("wanted", F.lit(True))
    first = F.get("polygon", F.lit(0))
    p = table(spark, folder, "parcels").where("lgd_village_code IS NOT NULL").select(F.col("lgd_village_code").alias("code"), text.base_survey(F.col("survey_number")).alias("base"), first["x"].alias("x"), first["y"].alias("y"))
    counted = p.join(wanted, "base", "left").groupBy("code").agg(F.count_distinct(F.when(F.col("wanted"), F.col("base"))).alias("overlap"), F.round(F.avg("x"), 3).alias("cx"), F.round(F.avg("y"), 3).alias("cy"))
    return windows.page(counted.where("overlap >= 3"), [F.col("overlap").desc(), F.col("code")], 6)


@query(r"""
SELECT coalesce(code, '') AS code, coalesce(len(list_filter(regexp_split_to_array(upper(code), '[-\s]+'), lambda t: t IN ('B', 'BS', 'RBS', 'VBS', 'RB', 'RS'))) > 0, false) AS boundary, count(*) AS stones, count(DISTINCT source_file) AS files FROM stones GROUP BY 1, 2""")
def code_distribution(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "stones")
    return s.groupBy(F.coalesce("code", F.lit("")).alias("code"), text.boundary_code(F.col("code")).alias("boundary")).agg(F.count("*").alias("stones"), F.count_distinct("source_file").alias("files"))


@query("""
SELECT source_file, count(*) AS stones, count(*) FILTER (isfinite(x) AND isfinite(y)) AS finite_stones, round(min(x) FILTER (isfinite(x)), 4) AS x0, round(max(x) FILTER (isfinite(x)), 4) AS x1, round(min(y) FILTER (isfinite(y)), 4) AS y0, round(max(y) FILTER (isfinite(y)), 4) AS y1,
       count(*) FILTER (isfinite(x) AND isfinite(y)) - count(DISTINCT CASE WHEN isfinite(x) AND isfinite(y) THEN (round(x, 3), round(y, 3)) END) AS repeated
FROM stones GROUP BY source_file""")
def stone_catalogue(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "stones").select("source_file", plane.finite(F.col("x")).alias("x"), plane.finite(F.col("y")).alias("y"))
    both = F.col("x").isNotNull() & F.col("y").isNotNull()
    spot = F.when(both, F.struct(F.round("x", 3), F.round("y", 3)))
    return s.groupBy("source_file").agg(F.count("*").alias("stones"), F.count_if(both).alias("finite_stones"), F.round(F.min("x"), 4).alias("x0"), F.round(F.max("x"), 4).alias("x1"), F.round(F.min("y"), 4).alias("y0"), F.round(F.max("y"), 4).alias("y1"), (F.count_if(both) - F.count_distinct(spot)).alias("repeated"))


@query(r"""
SELECT base, code, parcel_id, round(area_ha, 4) AS area_ha FROM (SELECT nullif(regexp_extract(survey_number, '(\d{1,5})', 1), '') AS base, coalesce(lgd_village_code, -1) AS code, parcel_id, area_ha,
  row_number() OVER (PARTITION BY nullif(regexp_extract(survey_number, '(\d{1,5})', 1), ''), coalesce(lgd_village_code, -1) ORDER BY area_ha DESC, parcel_id) AS r FROM parcels WHERE area_ha IS NOT NULL) WHERE r = 1 AND base IS NOT NULL""")
def largest_parcels(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "parcels").where("area_ha IS NOT NULL").select(text.base_survey(F.col("survey_number")).alias("base"), F.coalesce("lgd_village_code", F.lit(-1)).alias("code"), "parcel_id", "area_ha").where("base IS NOT NULL")
    return joins.keep_first(p, ["base", "code"], [-F.col("area_ha"), F.col("parcel_id")]).select("base", "code", "parcel_id", F.round("area_ha", 4).alias("area_ha"))


@query("""
SELECT verdict, count(*) AS sketches, round(median(median_err) FILTER (isfinite(median_err)), 6) AS median_of_medians, round(avg(mean_err) FILTER (isfinite(mean_err)), 6) AS mean_error, round(max(max_err) FILTER (isfinite(max_err)), 6) AS worst, round(avg(CAST(median_err <= 3 AS INTEGER)) FILTER (isfinite(median_err)), 6) AS within_three
FROM fmb_errors GROUP BY verdict""")
def sketch_errors(spark: SparkSession, folder: str) -> DataFrame:
    f = table(spark, folder, "fmb_errors")
    e = lambda c: plane.finite(F.col(c))
    return f.groupBy("verdict").agg(F.count("*").alias("sketches"), F.round(F.median(e("median_err")), 6).alias("median_of_medians"), F.round(F.avg(e("mean_err")), 6).alias("mean_error"), F.round(F.max(e("max_err")), 6).alias("worst"), F.round(F.avg((e("median_err") <= 3).cast("int")), 6).alias("within_three"))


@query("""
WITH once AS (SELECT DISTINCT report_id, agent, checks FROM agent_reports)
SELECT agent, coalesce(lower(c.severity), '') AS severity, count(*) AS checks, count(DISTINCT report_id) AS reports FROM (SELECT report_id, agent, unnest(checks) AS c FROM once) WHERE c IS NOT NULL GROUP BY 1, 2""")
def check_counts(spark: SparkSession, folder: str) -> DataFrame:
    once = table(spark, folder, "agent_reports").select("report_id", "agent", "checks").distinct()
    return once.select("report_id", "agent", F.explode("checks").alias("c")).where("c IS NOT NULL").groupBy("agent", F.coalesce(F.lower("c.severity"), F.lit("")).alias("severity")).agg(F.count("*").alias("checks"), F.count_distinct("report_id").alias("reports"))


@query("""
WITH r AS (SELECT DISTINCT report_id, village, requests FROM agent_reports), q AS (SELECT village, unnest(requests) AS q FROM r)
SELECT CASE WHEN grouping(village) = 1 THEN '(all)' ELSE coalesce(village, '(none)') END AS village, CASE WHEN grouping(q.input_type) = 1 THEN '(all)' ELSE coalesce(q.input_type, '(none)') END AS input_type, count(*) AS requests FROM q WHERE q IS NOT NULL GROUP BY ROLLUP (village, q.input_type)""")
def request_rollup(spark: SparkSession, folder: str) -> DataFrame:
    r = table(spark, folder, "agent_reports").select("report_id", "village", "requests").distinct()
    q = r.select("village", F.explode("requests").alias("q")).where("q IS NOT NULL").select(F.coalesce("village", F.lit("(none)")).alias("village"), F.coalesce("q.input_type", F.lit("(none)")).alias("input_type"))
    return q.rollup("village", "input_type").agg(F.count("*").alias("requests"), F.grouping("village").alias("gv"), F.grouping("input_type").alias("gi")).select(F.when(F.col("gv") == 1, "(all)").otherwise(F.col("village")).alias("village"), F.when(F.col("gi") == 1, "(all)").otherwise(F.col("input_type")).alias("input_type"), "requests")


@query(r"""
WITH t AS (SELECT session_id, said_at, turn_id, nullif(regexp_extract(message, 'survey (\d+[0-9A-Z/]*)', 1), '') AS survey, nullif(regexp_extract(message, '(\d+[.,]\d+) hectares', 1), '') AS area FROM (SELECT DISTINCT turn_id, session_id, said_at, message FROM chat_turns))
SELECT session_id, count(*) AS turns, arg_min(survey, (said_at, turn_id)) FILTER (survey IS NOT NULL) AS first_survey, arg_min(area, (said_at, turn_id)) FILTER (area IS NOT NULL) AS first_area FROM t GROUP BY session_id""")
def session_headers(spark: SparkSession, folder: str) -> DataFrame:
    """The first value that each field's pattern finds in a session, in the order of its turns."""
    t = table(spark, folder, "chat_turns").select("turn_id", "session_id", "said_at", "message").distinct()
    t = t.select("session_id", F.struct("said_at", "turn_id").alias("at"), text.first_match(F.col("message"), r"survey (\d+[0-9A-Z/]*)").alias("survey"), text.first_match(F.col("message"), r"(\d+[.,]\d+) hectares").alias("area"))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("at")))
    return t.groupBy("session_id").agg(F.count("*").alias("turns"), first("survey").alias("first_survey"), first("area").alias("first_area"))


@query(r"""
WITH p AS (SELECT DISTINCT lgd_village_code AS code, regexp_extract(survey_number, '(\d{1,5})', 1) AS base FROM parcels WHERE lgd_village_code IS NOT NULL), r AS (SELECT * FROM p WHERE regexp_matches(base, '^[01689]+$'))
SELECT a.code, a.base AS survey_a, b.base AS survey_b FROM r a JOIN r b ON a.code = b.code AND translate(reverse(a.base), '69', '96') = b.base AND a.base < b.base""")
def upside_down_pairs(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "parcels").where("lgd_village_code IS NOT NULL").select(F.col("lgd_village_code").alias("code"), text.base_survey(F.col("survey_number")).alias("base")).distinct()
    turned = p.select("code", F.col("base").alias("survey_a"), text.upside_down(F.col("base")).alias("base")).where("base IS NOT NULL AND survey_a < base")
    return turned.join(p, ["code", "base"]).select("code", "survey_a", F.col("base").alias("survey_b"))


@query(r"""
SELECT DISTINCT base FROM (SELECT nullif(regexp_extract(survey, '(\d{1,5})', 1), '') AS base FROM fmb_errors) WHERE base IS NOT NULL EXCEPT SELECT nullif(regexp_extract(survey_number, '(\d{1,5})', 1), '') FROM parcels""")
def surveys_without_parcels(spark: SparkSession, folder: str) -> DataFrame:
    wanted = table(spark, folder, "fmb_errors").select(text.base_survey(F.col("survey")).alias("base")).where("base IS NOT NULL")
    return wanted.subtract(table(spark, folder, "parcels").select(text.base_survey(F.col("survey_number")).alias("base")))


# -- order and state --------------------------------------------------------------------------------------------------


@query("""
SELECT user_id, start, ids FROM (SELECT user_id, CAST(row_number() OVER w - 1 AS INTEGER) AS start, event_id || ',' || lead(event_id) OVER w || ',' || lead(event_id, 2) OVER w AS ids FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE ids IS NOT NULL""")
def event_windows(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").select("user_id", "ts", "event_id")
    return windows.sliding(e, "user_id", ["ts", "event_id"], "event_id", 3).select("user_id", F.col("start").cast("int").alias("start"), F.array_join(F.transform("window", lambda i: i.cast("string")), ",").alias("ids"))


@query("""
WITH e AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY epoch_us(ts)) > 21600000000 THEN 1 ELSE 0 END AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY epoch_us(ts)) AS session FROM e)
SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS events, max(epoch_us(ts)) - min(epoch_us(ts)) AS lasted_us FROM s GROUP BY user_id, session""")
def event_sessions(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return windows.sessions(e, ["user_id"], F.col("us"), F.lit(6 * 3_600_000_000)).groupBy("user_id", "session").agg(F.count("*").alias("events"), (F.max("us") - F.min("us")).alias("lasted_us"))


@query("""
WITH r AS (SELECT n_corners, median_err, row_number() OVER (PARTITION BY n_corners ORDER BY median_err) AS i, count(*) OVER (PARTITION BY n_corners) AS n FROM fmb_errors WHERE isfinite(median_err))
SELECT n_corners, round(avg(median_err), 6) AS trimmed_mean, count(*) AS kept FROM r WHERE i <= greatest(3, round_even(n * 0.8, 0)) GROUP BY n_corners""")
def trimmed_errors(spark: SparkSession, folder: str) -> DataFrame:
    f = table(spark, folder, "fmb_errors").select("n_corners", plane.finite(F.col("median_err")).alias("e"))
    return windows.trimmed_mean(f, "n_corners", "e").select("n_corners", F.round("trimmed_mean", 6).alias("trimmed_mean"), "kept")


@query("""
WITH s AS (SELECT n_corners, pct_within_tol AS a, lead(pct_within_tol) OVER (PARTITION BY n_corners ORDER BY pct_within_tol) AS b FROM fmb_errors WHERE isfinite(pct_within_tol))
SELECT n_corners, round(min((a + b) / 2), 6) AS threshold FROM s WHERE b - a >= 2 AND (a + b) / 2 BETWEEN 20 AND 70 AND a <= 55 GROUP BY n_corners""")
def score_valleys(spark: SparkSession, folder: str) -> DataFrame:
    f = table(spark, folder, "fmb_errors").select("n_corners", plane.finite(F.col("pct_within_tol")).alias("p"))
    return windows.valley(f, ["n_corners"], "p", 20.0, 70.0, 2.0, 35.0).select("n_corners", F.round("threshold", 6).alias("threshold"))


@query("""
SELECT user_id, arg_max(event_type, (ts, event_id)) AS last_type, round(arg_max(value, (ts, event_id)), 6) AS last_value, count(*) AS events, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS kinds FROM events GROUP BY user_id""")
def latest_states(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    last = windows.latest(e.select("user_id", "ts", "event_id", "event_type", "value"), ["user_id"], ["ts", "event_id"]).select("user_id", F.col("event_type").alias("last_type"), F.round("value", 6).alias("last_value"))
    return last.join(e.groupBy("user_id").agg(F.count("*").alias("events"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds")), "user_id")


@query("SELECT o_orderkey, o_custkey, round(o_totalprice, 2) AS price FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40")
def order_page(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders").where("o_orderstatus = 'O'")
    return windows.page(o, [F.col("o_orderdate").desc(), F.col("o_orderkey")], 20, 2).select("o_orderkey", "o_custkey", F.round("o_totalprice", 2).alias("price"))


@query("""
SELECT stone_id, source_file, idx, round(x, 4) AS x, round(y, 4) AS y FROM (SELECT *, row_number() OVER (PARTITION BY stone_id ORDER BY ingested_at, source_file, idx) AS r FROM stones WHERE isfinite(x) AND isfinite(y)) WHERE r = 1""")
def first_deliveries(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "stones").select("stone_id", "source_file", "idx", plane.finite(F.col("x")).alias("x"), plane.finite(F.col("y")).alias("y"), "ingested_at").where("x IS NOT NULL AND y IS NOT NULL")
    return joins.keep_first(s, ["stone_id"], [F.col("ingested_at"), F.col("source_file"), F.col("idx")]).select("stone_id", "source_file", "idx", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


# -- fits -------------------------------------------------------------------------------------------------------------


@query("""
SELECT l_orderkey, n, round(atan2(sin(a), cos(a)), 6) AS angle, round(1 + l_orderkey % 5 / 10.0, 6) AS scale, CAST(641000 + l_orderkey % 97 AS DOUBLE) AS shift_x, CAST(987000 - l_orderkey % 89 AS DOUBLE) AS shift_y
FROM (SELECT l_orderkey, count(*) AS n, l_orderkey % 628 / 100.0 AS a FROM lineitem GROUP BY l_orderkey HAVING count(*) >= 3)""")
def planted_transforms(spark: SparkSession, folder: str) -> DataFrame:
    """Transforms that are applied to the points of each order and found again; the oracle has the transforms themselves."""
    li = table(spark, folder, "lineitem").select("l_orderkey", (F.col("l_extendedprice") / 100).alias("x"), (F.col("l_quantity") * 7 + F.col("l_linenumber")).alias("y"))
    k = F.col("l_orderkey")
    tx, ty = plane.similarity(k % 628 / 100.0, 1 + k % 5 / 10.0, (641000 + k % 97).cast("double"), (987000 - k % 89).cast("double"), F.col("x"), F.col("y"))
    fit = fits.transform_fit(li.withColumns({"tx": tx, "ty": ty}), "l_orderkey").where("n >= 3")
    return fit.select("l_orderkey", "n", F.round("angle", 6).alias("angle"), F.round("scale", 6).alias("scale"), F.round("shift_x", 3).alias("shift_x"), F.round("shift_y", 3).alias("shift_y"))


@query("""
SELECT source_file, n, round(cx, 3) AS cx, round(cy, 3) AS cy, round(0.5 * atan2(2 * cv, vx - vy), 6) AS axis, round(least(CASE WHEN h - r > 1e-9 THEN sqrt((h + r) / (h - r)) END, 1000), 3) AS aspect
FROM (SELECT *, (vx + vy) / 2 AS h, sqrt(((vx - vy) / 2) ** 2 + cv ** 2) AS r FROM (SELECT source_file, count(*) AS n, avg(x) AS cx, avg(y) AS cy, var_pop(x) AS vx, var_pop(y) AS vy, covar_pop(x, y) AS cv FROM stones WHERE isfinite(x) AND isfinite(y) AND y > 100000 AND x > 1000 AND x < y GROUP BY source_file))""")
def stone_axes(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "stones").select("source_file", plane.finite(F.col("x")).alias("x"), plane.finite(F.col("y")).alias("y")).where("y > 100000 AND x > 1000 AND x < y")
    return fits.principal_axis(s, "source_file").select("source_file", "n", F.round("cx", 3).alias("cx"), F.round("cy", 3).alias("cy"), F.round("axis", 6).alias("axis"), F.round(F.when(F.col("aspect").isNotNull(), F.least("aspect", F.lit(1000.0))), 3).alias("aspect"))


@query("""
SELECT source_file, round(regr_slope(x, idx), 4) AS slope, round(regr_intercept(x, idx), 2) AS intercept, count(*) AS n FROM stones WHERE isfinite(x) AND x > 1000 AND x < 400000 AND idx IS NOT NULL GROUP BY source_file HAVING count(DISTINCT idx) > 1""")
def corridor_trend(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "stones").where("x > 1000 AND x < 400000 AND idx IS NOT NULL AND NOT isnan(x)")
    return s.groupBy("source_file").agg(F.round(F.regr_slope("x", "idx"), 4).alias("slope"), F.round(F.regr_intercept("x", "idx"), 2).alias("intercept"), F.count("*").alias("n"), F.count_distinct("idx").alias("d")).where("d > 1").drop("d")
