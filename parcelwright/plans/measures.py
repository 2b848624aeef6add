"""Queries of the text, plane and state expressions and of the plot operators on whole tables, each with its oracle SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelwright.functions import plane, text
from parcelwright.operators import fits, graph, matching, plots, shapes, state
from parcelwright.plans.checkpoints import materialise, remove_folder, shared_folder
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


# -- text -------------------------------------------------------------------------------------------------------------


@query("SELECT parcel_id, survey_number AS label FROM parcels")
def foreign_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Survey numbers written with look-alike letters, read back; the oracle has the originals."""
    written = F.translate(F.col("survey_number"), "3AaBCcEeHKMOoPpTXxYy", "ЗАаВСсЕеНКМОоРрТХхУу")
    return table(spark, folder, "parcels").select("parcel_id", text.latin_label(written).alias("label"))


@query("""
WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey % 7 AS kind, l_suppkey AS n FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE kind WHEN 0 THEN 'chain' WHEN 1 THEN 'length' WHEN 2 THEN 'part' WHEN 3 THEN CASE WHEN n % 60 BETWEEN 1 AND 31 THEN 'stone' ELSE 'survey' END
 WHEN 4 THEN CASE WHEN n % 12 < 8 THEN 'stone' ELSE 'other' END WHEN 5 THEN 'survey' ELSE 'other' END AS kind,
 CASE WHEN kind = 3 AND n % 60 BETWEEN 1 AND 31 OR kind = 4 AND n % 12 < 8 THEN true ELSE false END AS is_stone FROM t""")
def drawing_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Texts of seven forms, told apart."""
    n, kind = F.col("l_suppkey"), F.col("l_partkey") % 7
    forms = [F.concat(F.lit("("), (n % 900 + 1).cast("string"), F.lit(".5)")), F.concat((n % 900 + 1).cast("string"), F.lit(",25")), F.concat((n % 9 + 1).cast("string"), F.lit("A2")), (n % 60).cast("string"), F.chr(65 + n % 12), (n % 900 + 100).cast("string"), F.concat(F.lit("No "), n.cast("string"))]
    made = F.element_at(F.array(*forms), (kind + 1).cast("int"))
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", text.kind_of_text(made).alias("kind"), text.stone_label(made).alias("is_stone"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(500 * (1 + o_orderkey % 9) AS INTEGER) END AS scale FROM orders")
def stated_scales(spark: SparkSession, folder: str) -> DataFrame:
    """The scale that a heading states, with or without a thousands separator."""
    k = F.col("o_orderkey")
    value = 500 * (1 + k % 9)
    shown = F.when(k % 2 == 0, F.format_number(value.cast("double"), 0)).otherwise(value.cast("string"))
    heading = F.when(k % 11 == 0, F.lit("no scale")).otherwise(F.concat(F.lit("Sheet 3, scale 1 : "), shown, F.lit(" of 1990")))
    return table(spark, folder, "orders").select("o_orderkey", text.stated_scale(heading).alias("scale"))


@query("""
SELECT o_orderkey, CAST(round_even(o_totalprice, 0) AS BIGINT)::VARCHAR || ',' || CAST(round_even(o_totalprice / 7, 0) AS BIGINT)::VARCHAR AS key, lower(o_orderpriority) AS tag, CAST(o_custkey AS DOUBLE) AS x, o_totalprice AS y FROM orders""")
def parsed_places(spark: SparkSession, folder: str) -> DataFrame:
    """Keys of places, names of tags, and positions that give the northing first."""
    price = F.col("o_totalprice")
    place = text.northing_easting(F.concat(price.cast("string"), F.lit(" "), F.col("o_custkey").cast("string"), F.lit(" 12.5")))
    tag = text.local_name(F.concat(F.lit("{http://example.org/a}"), F.col("o_orderpriority")))
    return table(spark, folder, "orders").select("o_orderkey", text.line_key(price, price / 7).alias("key"), tag.alias("tag"), place["x"].alias("x"), place["y"].alias("y"))


@query("SELECT parcel_id, CAST(len(polygon) AS INTEGER) AS points, round(list_sum(list_transform(polygon, lambda p: p.x)), 3) AS sum_x, round(list_sum(list_transform(polygon, lambda p: p.y)), 3) AS sum_y FROM parcels WHERE len(polygon) > 0")
def coordinate_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Rings written as lists of x,y,0 with a broken token between them, and read back."""
    p = table(spark, folder, "parcels").where(F.size("polygon") > 0)
    written = F.array_join(F.transform("polygon", lambda v: F.concat(v["x"].cast("string"), F.lit(","), v["y"].cast("string"), F.lit(",0 bad"))), " ")
    total = lambda k: F.round(F.aggregate(F.col("read"), F.lit(0.0), lambda s, v: s + v[k]), 3)
    return p.select("parcel_id", text.lon_lat_list(written).alias("read")).select("parcel_id", F.size("read").alias("points"), total("x").alias("sum_x"), total("y").alias("sum_y"))


@query("SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS survey, o_orderpriority AS action FROM orders WHERE o_orderkey % 5 <> 0 UNION ALL SELECT o_orderkey, NULL, NULL FROM orders WHERE o_orderkey % 5 = 0")
def proposals_in_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The proposal that an answer holds among other words; none where it has no JSON."""
    held = F.concat(F.lit("I suggest:\n```json\n"), F.to_json(F.struct(F.col("o_custkey").cast("string").alias("survey"), F.col("o_orderpriority").alias("action"))), F.lit("\n``` as said."))
    answer = F.when(F.col("o_orderkey") % 5 == 0, F.lit("I can't tell.")).otherwise(held)
    got = text.json_in_text(answer, "survey string, action string")
    return table(spark, folder, "orders").select("o_orderkey", got["survey"].alias("survey"), got["action"].alias("action"))


@query("""
WITH k AS (SELECT list(DISTINCT s) AS known FROM (SELECT CAST(s_suppkey * 11 AS VARCHAR) AS s FROM supplier))
SELECT c_custkey, CASE WHEN list_contains(known, CAST(c_custkey AS VARCHAR)) THEN CAST(c_custkey AS VARCHAR) END AS survey FROM customer, k""")
def known_surveys(spark: SparkSession, folder: str) -> DataFrame:
    """Misread numbers (O for 0, I for 1) found among known ones, here the multiples of 11 that suppliers have."""
    known = table(spark, folder, "supplier").select((F.col("s_suppkey") * 11).cast("string").alias("known"))
    misread = F.translate(F.col("c_custkey").cast("string"), "01", "OI")
    return matching.known_readings(table(spark, folder, "customer").select("c_custkey", misread.alias("reading")), known).select("c_custkey", "survey")


@query("""
SELECT fmb_id, concat_ws('; ', CASE WHEN survey IS NULL THEN 'no survey' END, CASE WHEN header_village IS NULL THEN 'no village' END, CASE WHEN NOT coalesce(congruent, false) THEN 'not congruent' END)
 || CASE WHEN (survey IS NULL)::INT + (header_village IS NULL)::INT + (NOT coalesce(congruent, false))::INT + (stated_area_ha IS NULL)::INT > 3 THEN ' (+1)' WHEN stated_area_ha IS NULL THEN CASE WHEN (survey IS NULL)::INT + (header_village IS NULL)::INT + (NOT coalesce(congruent, false))::INT > 0 THEN '; no area' ELSE 'no area' END ELSE '' END AS issues FROM fmb_errors""")
def sketch_issues(spark: SparkSession, folder: str) -> DataFrame:
    """What is amiss with each sketch on one line, three issues at most and the number of the rest."""
    f = table(spark, folder, "fmb_errors")
    issues = F.array(*[F.when(c, t) for c, t in ((F.col("survey").isNull(), "no survey"), (F.col("header_village").isNull(), "no village"), (~F.coalesce("congruent", F.lit(False)), "not congruent"), (F.col("stated_area_ha").isNull(), "no area"))])
    return f.select("fmb_id", text.listed_text(issues, 3).alias("issues"))


@query("""
SELECT report_id, strftime(run_at, '%Y-%m-%dT%H:%M:%SZ') AS stamp, date_trunc('day', run_at) AS day, CAST(floor(epoch(received_at)) - floor(epoch(run_at)) AS BIGINT) AS lag_s, CAST(isodow(run_at) AS INTEGER) AS weekday
FROM agent_reports""")
def report_times(spark: SparkSession, folder: str) -> DataFrame:
    """When reports were made, as texts and days, and how long they travelled."""
    r = table(spark, folder, "agent_reports")
    seconds = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / 1_000_000)
    return r.select("report_id", F.date_format("run_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("stamp"), F.date_trunc("day", "run_at").cast("timestamp_ntz").alias("day"), (seconds("received_at") - seconds("run_at")).alias("lag_s"), (F.weekday("run_at") + 1).alias("weekday"))


@query("""
SELECT coalesce(source, '') AS source, count(*) AS texts, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g'))) AS BIGINT) AS ascii, count(*) FILTER (contains(text, chr(65533))) AS damaged, count(*) FILTER (regexp_matches(text, '[\\p{Tamil}]')) AS tamil
FROM documents WHERE text IS NOT NULL GROUP BY 1""")
def text_encodings(spark: SparkSession, folder: str) -> DataFrame:
    """Characters of each source's texts: all, plain ones, texts with damaged ones and texts with Tamil ones."""
    d = table(spark, folder, "documents").where("text IS NOT NULL")
    return d.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.count("*").alias("texts"), F.sum(F.length("text")).cast("long").alias("chars"), F.sum(F.length(F.regexp_replace("text", r"[^\x00-\x7F]", ""))).cast("long").alias("ascii"), F.count_if(F.contains("text", F.lit("�"))).alias("damaged"), F.count_if(F.rlike("text", F.lit(r"[\p{IsTamil}]"))).alias("tamil"))


# -- plane ------------------------------------------------------------------------------------------------------------


@query("""
WITH p AS (SELECT o_orderkey, CAST(o_orderkey % 595 AS DOUBLE) AS px, CAST(o_custkey % 841 AS DOUBLE) AS py, 1000 * (1 + o_orderkey % 5) AS d FROM orders)
SELECT o_orderkey, round(px / 72 * 0.0254 * d, 6) AS x, round((841 - py) / 72 * 0.0254 * d, 6) AS y, round(CASE WHEN a > 90 THEN a - 180 ELSE a END, 6) AS angle, round((2 * pi() * 6378137 * cos(radians(py / 10)) / (256 * 2 ** 17)) ** 2, 9) AS pixel
FROM (SELECT *, (degrees(atan2(py - 400, px - 300)) + 360) % 180 AS a FROM p)""")
def page_places(spark: SparkSession, folder: str) -> DataFrame:
    """Places on a page in metres, readable directions, ground area of pixels."""
    k = F.col("o_orderkey")
    px, py = (k % 595).cast("double"), (F.col("o_custkey") % 841).cast("double")
    at = plane.page_place(px, py, F.lit(841.0), 1000 * (1 + k % 5))
    return table(spark, folder, "orders").select("o_orderkey", F.round(at["x"], 6).alias("x"), F.round(at["y"], 6).alias("y"), F.round(plane.readable_angle(F.lit(300.0), F.lit(400.0), px, py), 6).alias("angle"), F.round(plane.square_metres_per_pixel(py / 10, 17), 9).alias("pixel"))


@query("""
SELECT o_orderkey, round(cos(a), 6) AS cosine, round(sin(a), 6) AS sine, round(s, 6) AS scale, CAST(1000 + o_custkey % 37 AS DOUBLE) AS tx, CAST(2000 - o_custkey % 41 AS DOUBLE) AS ty
FROM (SELECT *, o_orderkey % 628 / 100.0 AS a, CAST(0.5 + o_custkey % 7 / 4.0 AS DOUBLE) AS s FROM orders)""")
def pair_transforms(spark: SparkSession, folder: str) -> DataFrame:
    """The transform that takes one segment to another, from planted ones."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    angle, scale, tx, ty = k % 628 / 100.0, 0.5 + c % 7 / 4.0, (1000 + c % 37).cast("double"), (2000 - c % 41).cast("double")
    ax, ay, bx, by = (k % 13).cast("double"), (k % 17).cast("double"), (k % 13 + 5).cast("double"), (k % 17 - 3 - k % 3).cast("double")
    p, q = plane.similarity(angle, scale, tx, ty, ax, ay), plane.similarity(angle, scale, tx, ty, bx, by)
    found = plane.pair_similarity(ax, ay, bx, by, *p, *q)
    return table(spark, folder, "orders").select("o_orderkey", F.round(F.cos(found["angle"]), 6).alias("cosine"), (F.round(F.sin(found["angle"]), 6) + 0.0).alias("sine"), F.round(found["scale"], 6).alias("scale"), F.round(found["tx"], 6).alias("tx"), F.round(found["ty"], 6).alias("ty"))


@query("""
WITH b AS (SELECT l_orderkey, l_linenumber, CAST(l_partkey % 50 AS DOUBLE) AS a1, CAST(l_suppkey % 60 AS DOUBLE) AS a2, CAST(l_partkey % 41 AS DOUBLE) AS b1, l_quantity AS b2 FROM lineitem),
s AS (SELECT *, abs(a2 - a1) AS la, abs(b2 - b1) AS lb, least(greatest(a1, a2), greatest(b1, b2)) - greatest(least(a1, a2), least(b1, b2)) AS o FROM b)
SELECT l_orderkey, l_linenumber, CASE WHEN least(la, lb) > 0 THEN round(greatest(0, o) / least(la, lb), 6) ELSE 0 END AS share, least(greatest(a1 / 30, 0.4), 1.2) AS height FROM s""")
def interval_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Common parts of intervals as shares of the shorter one; heights of texts within limits."""
    a1, a2, b1, b2 = (F.col("l_partkey") % 50).cast("double"), (F.col("l_suppkey") % 60).cast("double"), (F.col("l_partkey") % 41).cast("double"), F.col("l_quantity")
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", F.round(plane.projected_overlap(a1, a2, b1, b2), 6).alias("share"), plane.clamped(a1 / 30, 0.4, 1.2).alias("height"))


@query("""
WITH l AS (SELECT o_orderkey AS k, CAST(o_custkey % 30 AS DOUBLE) AS px, CAST(o_orderkey % 29 AS DOUBLE) AS py, CAST(o_orderkey % 180 AS DOUBLE) AS a, length(o_orderpriority) AS n FROM orders),
b AS (SELECT *, n * 2 * 0.3 + 0.5 AS hw, 1.5 AS hh, abs(cos(radians(a))) AS c, abs(sin(radians(a))) AS s FROM l),
d AS (SELECT *, hw * c + hh * s AS w, hw * s + hh * c AS h, (px * 20 + py * 10) / 500 AS t, CASE WHEN 20 * py - 10 * px >= 0 THEN 1 ELSE -1 END AS side FROM b)
SELECT k AS o_orderkey, round(t * 20 - side * 1.5 * 10 / sqrt(500), 6) AS x, round(t * 10 + side * 1.5 * 20 / sqrt(500), 6) AS y, round(px - w, 6) AS x0, round(py - h, 6) AS y0, round(px + w, 6) AS x1, round(py + h, 6) AS y1,
 px - w <= 20 AND px + w >= 10 AND py - h <= 20 AND py + h >= 10 AS covers FROM d""")
def label_layout(spark: SparkSession, folder: str) -> DataFrame:
    """Labels moved beside a line, their boxes, and whether these meet another box."""
    px, py = (F.col("o_custkey") % 30).cast("double"), (F.col("o_orderkey") % 29).cast("double")
    zero = F.lit(0.0)
    beside = plane.beside_line(px, py, zero, zero, F.lit(20.0), F.lit(10.0), 1.5)
    made = table(spark, folder, "orders").select("o_orderkey", beside.alias("at"), plane.label_box(px, py, (F.col("o_orderkey") % 180).cast("double"), F.length("o_orderpriority"), 2.0, 0.5).alias("b"))
    sides = [F.round(f"b.{c}", 6).alias(c) for c in ("x0", "y0", "x1", "y1")]
    return made.select("o_orderkey", F.round("at.x", 6).alias("x"), F.round("at.y", 6).alias("y"), *sides, plane.boxes_overlap(F.col("b.x0"), F.col("b.y0"), F.col("b.x1"), F.col("b.y1"), F.lit(10.0), F.lit(10.0), F.lit(20.0), F.lit(20.0)).alias("covers"))


@query("""
WITH r AS (SELECT parcel_id, area_ha, abs(list_sum(list_transform(range(1, len(polygon) + 1), lambda i: (polygon[i].x - polygon[1].x) * (polygon[i % len(polygon) + 1].y - polygon[1].y) - (polygon[i % len(polygon) + 1].x - polygon[1].x) * (polygon[i].y - polygon[1].y)))) / 2 AS a FROM parcels WHERE len(polygon) >= 3 AND area_ha > 0)
SELECT parcel_id, round(a / (area_ha * 10000), 6) AS ratio, round(abs(a / (area_ha * 10000) - 1), 6) AS error, abs(a / (area_ha * 10000) - 1) <= 0.05 AS ok FROM r WHERE a IS NOT NULL""")
def stated_areas(spark: SparkSession, folder: str) -> DataFrame:
    """Drawn areas against stated ones."""
    p = table(spark, folder, "parcels").where("size(polygon) >= 3 AND area_ha > 0")
    check = plane.area_check(plane.ring_area(F.col("polygon")), F.col("area_ha"), 0.05)
    return p.select("parcel_id", check.alias("c")).where("c IS NOT NULL").select("parcel_id", F.round("c.ratio", 6).alias("ratio"), F.round("c.error", 6).alias("error"), "c.ok")


@query("""
WITH p AS (SELECT o_orderkey, CAST(o_custkey % 30 AS DOUBLE) AS px, CAST(o_orderkey % 29 AS DOUBLE) AS py FROM orders), t AS (SELECT *, sqrt(px ** 2 + py ** 2) AS da, sqrt((px - 40) ** 2 + (py - 9) ** 2) AS db FROM p)
SELECT o_orderkey, round(px + (1 - da / (da + db)) * 1 + da / (da + db) * 3, 6) AS x, round(py + (1 - da / (da + db)) * 2 + da / (da + db) * -1, 6) AS y, round(sqrt(2) * 0.3 / sqrt(1681) * da, 6) AS error FROM t""")
def carried_places(spark: SparkSession, folder: str) -> DataFrame:
    """Places along an edge whose ends move, and how far errors of two seeds throw them."""
    px, py = (F.col("o_custkey") % 30).cast("double"), (F.col("o_orderkey") % 29).cast("double")
    pair = lambda x, y: (F.lit(float(x)), F.lit(float(y)))
    moved = plane.warped_along(px, py, pair(0, 0), pair(40, 9), pair(1, 2), pair(43, 8))
    return table(spark, folder, "orders").select("o_orderkey", F.round(moved["x"], 6).alias("x"), F.round(moved["y"], 6).alias("y"), F.round(plane.seed_error(*pair(0, 0), *pair(40, 9), F.hypot(px, py), 0.3), 6).alias("error"))


@query("""
WITH c AS (SELECT c_custkey, c_custkey % 11 / 10.0 AS r, c_custkey % 7 / 6.0 AS g, c_custkey % 13 / 12.0 AS b FROM customer)
SELECT c_custkey, CASE WHEN b - r > 0.4 AND b - g > 0.4 THEN 'blue' WHEN r - g > 0.4 AND r - b > 0.4 THEN 'red' WHEN abs(r - g) < 0.1 AND abs(g - b) < 0.1 AND r BETWEEN 0.3 AND 0.9 THEN 'grey' ELSE 'black' END AS colour FROM c""")
def colours(spark: SparkSession, folder: str) -> DataFrame:
    """Names of colours."""
    k = F.col("c_custkey")
    return table(spark, folder, "customer").select("c_custkey", plane.colour_name(k % 11 / 10.0, k % 7 / 6.0, k % 13 / 12.0).alias("colour"))


_RINGS_SQL = "r AS (SELECT parcel_id, polygon AS g, len(polygon) AS n FROM parcels WHERE len(polygon) >= 3 AND len(list_filter(polygon, lambda v: v IS NULL OR v.x IS NULL OR v.y IS NULL)) = 0)"


def _rings(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "parcels").where((F.size("polygon") >= 3) & ~F.exists("polygon", lambda v: v.isNull() | v["x"].isNull() | v["y"].isNull()))


@query(f"""
WITH {_RINGS_SQL}, e AS (SELECT parcel_id, g[i].x AS x1, g[i].y AS y1, g[i % n + 1].x AS x2, g[i % n + 1].y AS y2 FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM r)),
d AS (SELECT *, sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) AS l FROM e), k AS (SELECT *, unnest(range(0, CAST(greatest(floor(l / 7) - 1, 0) AS BIGINT) + 1)) AS k FROM d)
SELECT parcel_id, CAST(count(*) AS INTEGER) AS points, round(avg(x1 + CASE WHEN l > 0 THEN k * 7 / l ELSE 0 END * (x2 - x1)), 4) AS mean_x, round(avg(y1 + CASE WHEN l > 0 THEN k * 7 / l ELSE 0 END * (y2 - y1)), 4) AS mean_y FROM k GROUP BY parcel_id""")
def dense_rings(spark: SparkSession, folder: str) -> DataFrame:
    """Rings with points every seven metres: their number and mean."""
    d = _rings(spark, folder).select("parcel_id", plane.densified(F.col("polygon"), 7.0).alias("d"))
    mean = lambda k: F.round(F.aggregate("d", F.lit(0.0), lambda s, v: s + v[k]) / F.size("d"), 4)
    return d.select("parcel_id", F.size("d").alias("points"), mean("x").alias("mean_x"), mean("y").alias("mean_y"))


@query(f"""
WITH {_RINGS_SQL}, e AS (SELECT parcel_id, n, g, g[i].x - g[1].x AS x1, g[i].y - g[1].y AS y1, g[i % n + 1].x - g[1].x AS x2, g[i % n + 1].y - g[1].y AS y2 FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM r)),
s AS (SELECT parcel_id, any_value(g) AS g, sum(x1 * y2 - x2 * y1) AS a, sum((x1 + x2) * (x1 * y2 - x2 * y1)) AS sx, sum((y1 + y2) * (x1 * y2 - x2 * y1)) AS sy FROM e GROUP BY parcel_id)
SELECT parcel_id, round(g[1].x + sx / (3 * a), 3) AS x, round(g[1].y + sy / (3 * a), 3) AS y FROM s WHERE abs(a) > 2""")
def label_points(spark: SparkSession, folder: str) -> DataFrame:
    """Where the label of each parcel goes."""
    p = _rings(spark, folder).where(plane.ring_area(F.col("polygon")) > 1)
    return p.select("parcel_id", plane.inner_point(F.col("polygon")).alias("p")).select("parcel_id", F.round("p.x", 3).alias("x"), F.round("p.y", 3).alias("y"))


@query(f"""
WITH {_RINGS_SQL}, e AS (SELECT parcel_id, g[i].x - g[1].x AS x, g[i].y - g[1].y AS y, parcel_id % 300 / 50.0 AS a, i - 1 AS pos FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM r))
SELECT parcel_id, CAST(pos AS INTEGER) AS corner, round(1.5 * (cos(a) * x - sin(a) * y) + 1000, 4) AS x, round(1.5 * (sin(a) * x + cos(a) * y) + 2000, 4) AS y FROM e""")
def placed_corners(spark: SparkSession, folder: str) -> DataFrame:
    """Corners of footprints under poses."""
    first = F.get("polygon", F.lit(0))
    own = F.transform("polygon", lambda v: F.struct((v["x"] - first["x"]).alias("x"), (v["y"] - first["y"]).alias("y")))
    laid = plane.placed(own, F.col("parcel_id") % 300 / 50.0, F.lit(1.5), F.lit(1000.0), F.lit(2000.0))
    return _rings(spark, folder).select("parcel_id", F.posexplode(laid).alias("corner", "p")).select("parcel_id", "corner", F.round("p.x", 4).alias("x"), F.round("p.y", 4).alias("y"))


# -- plots ------------------------------------------------------------------------------------------------------------


def _edges(spark: SparkSession, folder: str) -> DataFrame:
    return _rings(spark, folder).select(F.col("parcel_id").alias("plot"), F.posexplode(plane.closed_pairs(F.col("polygon"))).alias("eid", "e")).select("plot", "eid", "e.*")


_EDGES_SQL = f"WITH {_RINGS_SQL}, e AS (SELECT parcel_id AS plot, CAST(i - 1 AS INTEGER) AS eid, g[i].x AS x1, g[i].y AS y1, g[i % n + 1].x AS x2, g[i % n + 1].y AS y2 FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM r))"


@query(_EDGES_SQL + """
, o AS (SELECT *, (degrees(atan2(y2 - y1, x2 - x1)) + 360) % 180 AS o, sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) AS l FROM e WHERE x1 <> x2 OR y1 <> y2),
m AS (SELECT a.plot AS plot_a, b.plot AS plot_b, a.eid AS ea, b.eid AS eb, a.l AS al, a.x1 AS ax, a.y1 AS ay, (a.x2 - a.x1) / a.l AS ux, (a.y2 - a.y1) / a.l AS uy, b.x1 AS bx1, b.y1 AS by1, b.x2 AS bx2, b.y2 AS by2
 FROM o a JOIN o b ON a.plot < b.plot AND least(b.x1, b.x2) <= greatest(a.x1, a.x2) + 8 AND greatest(b.x1, b.x2) >= least(a.x1, a.x2) - 8 AND least(b.y1, b.y2) <= greatest(a.y1, a.y2) + 8 AND greatest(b.y1, b.y2) >= least(a.y1, a.y2) - 8 WHERE least(abs(a.o - b.o), 180 - abs(a.o - b.o)) <= 10),
s AS (SELECT *, abs(((bx1 + bx2) / 2 - ax) * uy - ((by1 + by2) / 2 - ay) * ux) AS gap, (bx1 - ax) * ux + (by1 - ay) * uy AS s1, (bx2 - ax) * ux + (by2 - ay) * uy AS s2 FROM m),
f AS (SELECT * FROM s WHERE gap <= 4 AND (least(al, greatest(s1, s2)) - greatest(0, least(s1, s2))) / nullif(least(al, abs(s2 - s1)), 0) >= 0.5)
SELECT plot_a, plot_b, round(min(gap), 4) AS gap FROM f GROUP BY plot_a, plot_b""")
def edge_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """The closest pair of parallel edges of any two parcels within four metres."""
    return plots.best_edge_pairs(_edges(spark, folder), 4.0).select("plot_a", "plot_b", F.round("gap", 4).alias("gap"))


@query("""
WITH s AS (SELECT c_custkey AS sid, c_custkey * 10.0 AS y FROM customer), l AS (SELECT o_custkey AS c, o_custkey * 10.0 + o_orderkey % 5 / 2.0 AS y, CAST(o_orderkey * 7 % 100 AS DOUBLE) AS x0, CAST(o_orderkey * 7 % 100 + o_orderkey % 13 AS DOUBLE) AS x1 FROM orders),
i AS (SELECT sid, greatest(0, x0 - sqrt(4 - (l.y - s.y) ** 2)) AS a, least(100, x1 + sqrt(4 - (l.y - s.y) ** 2)) AS b FROM s JOIN l ON l.c = s.sid WHERE abs(l.y - s.y) <= 2),
w AS (SELECT *, max(b) OVER (PARTITION BY sid ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM i WHERE a < b)
SELECT sid AS c_custkey, 100.0::DOUBLE AS length, round(coalesce(t, 0), 6) AS covered FROM s LEFT JOIN (SELECT sid, sum(greatest(0, b - greatest(a, coalesce(m, 0)))) AS t FROM w GROUP BY sid) USING (sid)""")
def covered_segments(spark: SparkSession, folder: str) -> DataFrame:
    """How much of a segment of each customer lies within two metres of lines of the customer's orders."""
    c, k = F.col("c_custkey"), F.col("o_orderkey")
    segments = table(spark, folder, "customer").select(c.alias("sid"), F.lit(0.0).alias("x1"), (c * 10.0).alias("y1"), F.lit(100.0).alias("x2"), (c * 10.0).alias("y2"))
    y = F.col("o_custkey") * 10.0 + k % 5 / 2.0
    lines = table(spark, folder, "orders").select((k * 7 % 100).cast("double").alias("lx1"), y.alias("ly1"), (k * 7 % 100 + k % 13).cast("double").alias("lx2"), y.alias("ly2"))
    return shapes.covered_lengths(segments, lines, 2.0).select(F.col("sid").alias("c_custkey"), "length", F.round("covered", 6).alias("covered"))


@query(_EDGES_SQL + """
, m AS (SELECT *, (x1 + x2) / 2 AS mx, (y1 + y2) / 2 AS my, sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) AS l FROM e), d AS (SELECT plot, eid AS did, mx + 0.3 AS x, my - 0.2 AS y, l * (0.7 + eid % 5 * 0.15) AS v FROM m),
n AS (SELECT d.plot, d.did, d.v, arg_min(m.l, {'g': sqrt((d.x - m.mx) ** 2 + (d.y - m.my) ** 2), 'e': m.eid}) AS l FROM d JOIN m ON d.plot = m.plot AND sqrt((d.x - m.mx) ** 2 + (d.y - m.my) ** 2) <= 2 WHERE m.l > 0 GROUP BY d.plot, d.did, d.v)
SELECT plot AS parcel_id, count(*) AS dimensions, round(median(v / l), 5) AS median_ratio, round(avg(CASE WHEN v / l BETWEEN 0.80 AND 1.25 THEN 1 ELSE 0 END), 6) AS agreeing FROM n GROUP BY plot""")
def dimension_agreement(spark: SparkSession, folder: str) -> DataFrame:
    """How written dimensions agree with the edges they belong to."""
    e = _edges(spark, folder)
    length = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    d = e.select("plot", F.col("eid").alias("did"), ((F.col("x1") + F.col("x2")) / 2 + 0.3).alias("x"), ((F.col("y1") + F.col("y2")) / 2 - 0.2).alias("y"), (length * (0.7 + F.col("eid") % 5 * 0.15)).alias("value"))
    return plots.dimension_fit(e, d, 2.0).select(F.col("plot").alias("parcel_id"), "dimensions", F.round("median_ratio", 5).alias("median_ratio"), F.round("agreeing", 6).alias("agreeing"))


@query("""
WITH n AS (SELECT DISTINCT o_custkey AS eid, CAST(o_orderkey * 7 % 97 AS DOUBLE) AS s FROM orders WHERE o_orderkey % 4 < 3 AND o_orderkey * 7 % 97 BETWEEN 1 AND 99),
a AS (SELECT eid, s FROM n UNION ALL SELECT c_custkey, 0 FROM customer UNION ALL SELECT c_custkey, 100 FROM customer), w AS (SELECT eid, s, lead(s) OVER (PARTITION BY eid ORDER BY s) AS t, row_number() OVER (PARTITION BY eid ORDER BY s) AS i FROM a)
SELECT eid AS c_custkey, CAST(i - 1 AS INTEGER) AS part, s AS x1, t AS x2 FROM w WHERE t IS NOT NULL""")
def split_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Segments of customers cut at the places of their orders that lie near them."""
    c, k = F.col("c_custkey"), F.col("o_orderkey")
    edges = table(spark, folder, "customer").select(c.alias("eid"), F.lit(0.0).alias("x1"), (c * 20.0).alias("y1"), F.lit(100.0).alias("x2"), (c * 20.0).alias("y2"))
    nodes = table(spark, folder, "orders").select(k.alias("nid"), (k * 7 % 97).cast("double").alias("x"), (F.col("o_custkey") * 20.0 + k % 4 * 0.7).alias("y"))
    return plots.split_edges(edges, nodes).select(F.col("eid").alias("c_custkey"), "part", F.round("x1", 6).alias("x1"), F.round("x2", 6).alias("x2"))


@query("""
WITH p AS (SELECT o_custkey AS k, o_orderkey AS pid, CAST(o_orderkey * 13 % 101 AS DOUBLE) AS x, CAST(o_orderkey * 13 % 101 / 2 + o_orderkey % 3 AS DOUBLE) AS y FROM orders),
m AS (SELECT k, avg(x) AS cx, avg(y) AS cy, 0.5 * atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y)) AS a, count(DISTINCT (x, y)) AS n FROM p GROUP BY k HAVING count(DISTINCT (x, y)) > 2),
s AS (SELECT p.k, pid, round(CASE WHEN cos(a) < -1e-12 THEN -1 ELSE 1 END * (cos(a) * (x - cx) + sin(a) * (y - cy)), 6) AS s FROM p JOIN m USING (k))
SELECT k AS o_custkey, pid AS o_orderkey, s FROM s""")
def axis_places(spark: SparkSession, folder: str) -> DataFrame:
    """Where points lie along the principal axis of their group, of groups with three places or more."""
    k = F.col("o_orderkey")
    p = table(spark, folder, "orders").select("o_custkey", k.alias("pid"), (k * 13 % 101).cast("double").alias("x"), (k * 13 % 101 / 2 + k % 3).cast("double").alias("y"))
    many = p.groupBy("o_custkey").agg(F.count_distinct("x", "y").alias("n")).where("n > 2").select("o_custkey")
    return plots.along_axis(p.join(many, "o_custkey", "left_semi"), "o_custkey").select("o_custkey", F.col("pid").alias("o_orderkey"), (F.round("s", 6) + 0.0).alias("s"))


@query("""
SELECT o_custkey, count(*) AS n, round(cos(a), 6) AS cosine, round(sin(a), 6) AS sine, CAST(500 + o_custkey % 91 AS DOUBLE) AS shift_x, CAST(900 - o_custkey % 83 AS DOUBLE) AS shift_y FROM (SELECT *, o_custkey % 300 / 50.0 AS a FROM orders) GROUP BY o_custkey, a HAVING count(DISTINCT (o_orderkey % 31, o_orderkey % 37)) > 1""")
def rigid_fits(spark: SparkSession, folder: str) -> DataFrame:
    """Rigid transforms fitted to planted pairs, of groups with two places or more."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    x, y = (k % 31).cast("double"), (k % 37).cast("double")
    tx, ty = plane.similarity(c % 300 / 50.0, F.lit(1.0), (500 + c % 91).cast("double"), (900 - c % 83).cast("double"), x, y)
    found = fits.transform_fit(table(spark, folder, "orders").select("o_custkey", x.alias("x"), y.alias("y"), tx.alias("tx"), ty.alias("ty")), "o_custkey", scaled=False)
    return found.where("angle IS NOT NULL").select("o_custkey", "n", (F.round(F.cos("angle"), 6) + 0.0).alias("cosine"), (F.round(F.sin("angle"), 6) + 0.0).alias("sine"), F.round("shift_x", 4).alias("shift_x"), F.round("shift_y", 4).alias("shift_y"))


@query(f"""
WITH {_RINGS_SQL}, c AS (SELECT parcel_id, i, g[i].x - g[1].x AS x, g[i].y - g[1].y AS y FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM r) WHERE i <= 4)
SELECT parcel_id, count(*) AS controls, round(sqrt((max(x) - min(x)) ** 2 + (max(y) - min(y)) ** 2), 4) AS baseline, round(cos(parcel_id % 300 / 50.0), 5) AS cosine, 0.0::DOUBLE AS rms FROM c GROUP BY parcel_id HAVING var_pop(x) + var_pop(y) > 1""")
def control_seats(spark: SparkSession, folder: str) -> DataFrame:
    """Poses of parcels from control points on up to four corners, planted."""
    first = F.get("polygon", F.lit(0))
    own = F.transform(F.slice("polygon", 1, 4), lambda v: F.struct((v["x"] - first["x"]).alias("x"), (v["y"] - first["y"]).alias("y")))
    corners = _rings(spark, folder).select(F.col("parcel_id").alias("plot"), F.posexplode(own).alias("label", "p")).select("plot", "label", "p.x", "p.y")
    tx, ty = plane.similarity(F.col("plot") % 300 / 50.0, F.lit(1.0), F.lit(7000.0), F.lit(8000.0), F.col("x"), F.col("y"))
    wide = corners.groupBy("plot").agg((F.var_pop("x") + F.var_pop("y")).alias("v")).where("v > 1").select("plot")
    seats = plots.seats_by_controls(corners.join(wide, "plot", "left_semi"), corners.select("plot", "label", tx.alias("tx"), ty.alias("ty")))
    return seats.select(F.col("plot").alias("parcel_id"), "controls", F.round("baseline", 4).alias("baseline"), (F.round(F.cos("angle"), 5) + 0.0).alias("cosine"), (F.round("rms", 3) + 0.0).alias("rms"))


@query("""
WITH l AS (SELECT a, b, min(cost) AS cost FROM (SELECT c_custkey AS a, c_custkey * 7 % 1499 + 1 AS b, c_custkey % 5 AS cost FROM customer UNION ALL SELECT c_custkey * 7 % 1499 + 1, c_custkey, c_custkey % 5 FROM customer) GROUP BY a, b),
r0 AS (SELECT c_custkey AS node, CAST(NULL AS BIGINT) AS parent, 0 AS round FROM customer WHERE c_custkey % 100 = 0),
r1 AS (SELECT * FROM r0 UNION ALL SELECT a, arg_min(b, {'c': cost, 'b': b}), 1 FROM l WHERE b IN (SELECT node FROM r0) AND a NOT IN (SELECT node FROM r0) GROUP BY a),
r2 AS (SELECT * FROM r1 UNION ALL SELECT a, arg_min(b, {'c': cost, 'b': b}), 2 FROM l WHERE b IN (SELECT node FROM r1) AND a NOT IN (SELECT node FROM r1) GROUP BY a),
r3 AS (SELECT * FROM r2 UNION ALL SELECT a, arg_min(b, {'c': cost, 'b': b}), 3 FROM l WHERE b IN (SELECT node FROM r2) AND a NOT IN (SELECT node FROM r2) GROUP BY a)
SELECT node AS c_custkey, parent, CAST(round AS INTEGER) AS round FROM r3""")
def spread_seats(spark: SparkSession, folder: str) -> DataFrame:
    """What seeds reach over links in three rounds."""
    c = F.col("c_custkey")
    customers = table(spark, folder, "customer")
    links = customers.select(c.alias("a"), (c * 7 % 1499 + 1).alias("b"), (c % 5).alias("cost"))
    return graph.propagated(customers.where(c % 100 == 0).select(c.alias("node")), links, 3).select(F.col("node").alias("c_custkey"), "parent", "round")


@query(_EDGES_SQL + """
, b AS (SELECT plot, list_sort(list(round_even(sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) / 0.5, 0) * 0.5)) AS bins FROM e GROUP BY plot), s AS (SELECT *, len(bins) AS n, list_sum(bins) AS t FROM b), o AS (SELECT bins, n, t, min(plot) AS plot FROM s WHERE plot % 2 = 0 GROUP BY bins, n, t),
m AS (SELECT a.plot AS lid, o.plot AS rid, round(sqrt(list_sum(list_transform(list_zip(a.bins, o.bins), lambda z: (z[1] - z[2]) ** 2)) / a.n), 9) AS rms FROM s a JOIN o ON a.n = o.n AND abs(a.t - o.t) <= 4 WHERE a.plot % 2 = 1)
SELECT lid AS parcel_id, m.p AS found, round(m.r, 6) AS rms FROM (SELECT lid, min({'r': rms, 'p': rid}) AS m FROM m WHERE rms <= 1 GROUP BY lid)""")
def fingerprint_matches(spark: SparkSession, folder: str) -> DataFrame:
    """For each odd parcel record the even one whose edge lengths fit best."""
    lengths = F.transform(plane.closed_pairs(F.col("polygon")), lambda e: F.hypot(e["x2"] - e["x1"], e["y2"] - e["y1"]))
    p = _rings(spark, folder).select("parcel_id", lengths.alias("lengths"))
    side = lambda odd, k: p.where(F.col("parcel_id") % 2 == odd).select(F.col("parcel_id").alias(k), "lengths")
    return matching.by_fingerprint(side(1, "lid"), side(0, "rid"), 1.0, 4.0).select(F.col("lid").alias("parcel_id"), F.col("rid").alias("found"), F.round("rms", 6).alias("rms"))


@query(r"""
WITH f AS (SELECT fmb_id, nullif(regexp_extract(survey, '(\d{1,5})', 1), '') AS base, stated_area_ha AS a FROM fmb_errors WHERE isfinite(stated_area_ha) AND stated_area_ha > 0),
p AS (SELECT parcel_id, nullif(regexp_extract(survey_number, '(\d{1,5})', 1), '') AS base, area_ha FROM parcels WHERE area_ha > 0),
m AS (SELECT fmb_id, parcel_id, round(-abs(ln(f.a / p.area_ha)), 9) AS score FROM f JOIN p USING (base))
SELECT fmb_id, parcel_id, round(score, 6) AS score, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY fmb_id ORDER BY score DESC, parcel_id) AS place FROM m) WHERE place <= 3""")
def survey_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """The three parcel records of each sketch's number whose area fits best."""
    f = table(spark, folder, "fmb_errors").select(F.col("fmb_id").alias("lid"), text.base_survey(F.col("survey")).alias("base"), plane.finite(F.col("stated_area_ha")).alias("a")).where("a > 0 AND base IS NOT NULL")
    p = table(spark, folder, "parcels").where("area_ha > 0").select(F.col("parcel_id").alias("rid"), text.base_survey(F.col("survey_number")).alias("base"), "area_ha")
    best = matching.ranked_candidates(f, p, ["base"], F.round(-F.abs(F.log(F.col("a") / F.col("area_ha"))), 9), 3)
    return best.select(F.col("lid").alias("fmb_id"), F.col("rid").alias("parcel_id"), F.round("score", 6).alias("score"), "place")


@query("""
WITH s AS (SELECT l_orderkey AS path, l_partkey % 12 * 2.0 AS x1, l_suppkey % 8 * 2.0 AS y1, l_partkey % 12 * 2.0 + l_linenumber % 3 * 6 + 2 AS x2, l_suppkey % 8 * 2.0 AS y2, 1 + l_partkey % 2 AS w, CASE l_suppkey % 5 WHEN 0 THEN 'blue' WHEN 1 THEN 'grey' ELSE 'black' END AS c, l_partkey % 3 = 0 AS dashed FROM lineitem),
f AS (SELECT *, CASE WHEN dashed AND c = 'grey' THEN 'reference' WHEN c = 'blue' THEN 'chain' WHEN w >= 2 AND x2 - x1 >= 10 THEN 'boundary' END AS k FROM s),
en AS (SELECT DISTINCT unnest([x1, x2]) AS x, y1 AS y FROM f WHERE k = 'boundary'), si AS (SELECT DISTINCT x1, x2, y1 FROM f WHERE k = 'boundary'),
g AS (SELECT f.*, EXISTS (SELECT 1 FROM en WHERE en.x = f.x1 AND en.y = f.y1) AND EXISTS (SELECT 1 FROM en WHERE en.x = f.x2 AND en.y = f.y1) AS met, EXISTS (SELECT 1 FROM si WHERE si.x1 = f.x1 AND si.x2 = f.x2 AND si.y1 = f.y1) AS rep FROM f),
h AS (SELECT *, bool_and(met) OVER (PARTITION BY path) AS all_met, bool_and(rep) OVER (PARTITION BY path) AS all_rep FROM g)
SELECT path AS l_orderkey, coalesce(k, CASE WHEN w >= 2 AND all_met THEN 'boundary' WHEN w >= 2 THEN 'separation' WHEN all_rep THEN 'doubled' ELSE 'internal' END) AS kind, count(*) AS segments FROM h GROUP BY ALL""")
def path_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """Drawn segments by what they stand for, counted by path."""
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    x, y = p % 12 * 2.0, s % 8 * 2.0
    colour = F.when(s % 5 == 0, "blue").when(s % 5 == 1, "grey").otherwise("black")
    drawn = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("path"), x.alias("x1"), y.alias("y1"), (x + F.col("l_linenumber") % 3 * 6 + 2).alias("x2"), y.alias("y2"), (1 + p % 2).alias("width"), colour.alias("colour"), (p % 3 == 0).alias("dashed"))
    return matching.classified_paths(drawn, 10.0, 2.0).groupBy(F.col("path").alias("l_orderkey"), "kind").agg(F.count("*").alias("segments"))


# -- states -----------------------------------------------------------------------------------------------------------


@query("""
WITH o AS (SELECT o_custkey AS c, o_orderkey AS k, o_orderstatus AS s, o_orderdate AS d FROM orders), a AS (SELECT * FROM o WHERE k % 3 <> 0 UNION ALL SELECT c, k, s || '!', d + INTERVAL 1 DAY FROM o WHERE k % 2 = 0)
SELECT k AS o_orderkey, arg_max(s, {'d': d, 's': s}) AS status, max(d) AS changed FROM a GROUP BY k""")
def upserted_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders after a day of changes, some of them to orders that weren't there."""
    o = table(spark, folder, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("changed"))
    changes = o.where("o_orderkey % 2 = 0").select("o_orderkey", F.concat("status", F.lit("!")).alias("status"), (F.col("changed") + F.expr("INTERVAL 1 DAY")).alias("changed"))
    return state.upserted(o.where("o_orderkey % 3 <> 0"), changes, ["o_orderkey"], ["changed", "status"])


@query("SELECT DISTINCT l_partkey AS part, l_suppkey AS supplier FROM lineitem WHERE l_linenumber > 2 EXCEPT SELECT l_partkey, l_suppkey FROM lineitem WHERE l_linenumber <= 2")
def added_links(spark: SparkSession, folder: str) -> DataFrame:
    """Links of parts and suppliers that the later lines of orders add to those of the first two."""
    links = table(spark, folder, "lineitem").select(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"), "l_linenumber")
    return state.new_links(links.where("l_linenumber <= 2"), links.where("l_linenumber > 2"), ["part", "supplier"])


@query("SELECT job_id, CAST(count(*) AS INTEGER) AS events, arg_min(agent, {'t': run_at, 'r': report_id, 'a': agent}) AS first_agent, arg_max(agent, {'t': run_at, 'r': report_id, 'a': agent}) AS last_agent FROM agent_reports WHERE run_at IS NOT NULL AND agent IS NOT NULL GROUP BY job_id")
def job_trails(spark: SparkSession, folder: str) -> DataFrame:
    """The trail of each job: its events, the first and the last."""
    r = table(spark, folder, "agent_reports").where("run_at IS NOT NULL AND agent IS NOT NULL")
    t = state.trail(r, ["job_id"], ["run_at", "report_id"], ["agent"])
    return t.select("job_id", F.size("trail").alias("events"), F.get("trail", F.lit(0))["agent"].alias("first_agent"), F.element_at("trail", -1)["agent"].alias("last_agent"))


@query("""
SELECT 'sketch' AS origin, fmb_id AS id, survey, header_village AS village, stated_area_ha AS area_ha FROM fmb_errors WHERE NOT coalesce(isnan(stated_area_ha), false) UNION ALL SELECT 'parcel', parcel_id, survey_number, village, area_ha FROM parcels UNION ALL SELECT 'village', lgd_village_code, NULL, village, NULL FROM villages""")
def unified_records(spark: SparkSession, folder: str) -> DataFrame:
    """Sketches, parcels and villages as one table."""
    f = table(spark, folder, "fmb_errors").where("NOT coalesce(isnan(stated_area_ha), false)").select(F.col("fmb_id").alias("id"), "survey", F.col("header_village").alias("village"), F.col("stated_area_ha").alias("area_ha"))
    p = table(spark, folder, "parcels").select(F.col("parcel_id").alias("id"), F.col("survey_number").alias("survey"), "village", "area_ha")
    v = table(spark, folder, "villages").select(F.col("lgd_village_code").alias("id"), "village")
    return state.unified({"sketch": f, "parcel": p, "village": v}, {"id": "long", "survey": "string", "village": "string", "area_ha": "double"})


@query(r"""
WITH s AS (SELECT lgd_village_code AS code, count(*) AS stones FROM stones WHERE lgd_village_code IS NOT NULL GROUP BY 1), p AS (SELECT lgd_village_code AS code, count(*) AS parcels, round(sum(area_ha), 4) AS area FROM parcels WHERE lgd_village_code IS NOT NULL GROUP BY 1), d AS (SELECT village, count(*) AS documents FROM documents WHERE village IS NOT NULL GROUP BY 1)
SELECT lgd_village_code AS code, v.village, stones, parcels, area, documents, CAST((stones IS NOT NULL)::INT + (parcels IS NOT NULL)::INT + (documents IS NOT NULL)::INT AS INTEGER) AS sources FROM villages v LEFT JOIN s ON s.code = lgd_village_code LEFT JOIN p ON p.code = lgd_village_code LEFT JOIN d ON d.village = v.village""")
def village_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """What each table holds about a village."""
    by_code = lambda name, *aggs: table(spark, folder, name).where("lgd_village_code IS NOT NULL").groupBy(F.col("lgd_village_code").alias("code")).agg(*aggs)
    v = table(spark, folder, "villages").select(F.col("lgd_village_code").alias("code"), "village")
    told = table(spark, folder, "documents").where("village IS NOT NULL").groupBy("village").agg(F.count("*").alias("documents"))
    evidence = {"s": by_code("stones", F.count("*").alias("stones")), "p": by_code("parcels", F.count("*").alias("parcels"), F.sum("area_ha").alias("area")), "d": v.join(told, "village").select("code", "documents")}
    return state.with_evidence(v, "code", evidence).select("code", "village", "s.stones", "p.parcels", F.round("p.area", 4).alias("area"), "d.documents", "sources")


@query("""
SELECT source, count(*) AS records, round(avg(CASE WHEN regexp_matches(coalesce(survey_number, ''), '[0-9]') AND len(polygon) >= 3 THEN 1 ELSE 0 END), 6) AS usable, min(captured_at) AS first, max(captured_at) AS last FROM parcels GROUP BY source""")
def source_shares(spark: SparkSession, folder: str) -> DataFrame:
    """How large a share of each source's records has a number and a ring."""
    usable = F.rlike("survey_number", F.lit("[0-9]")) & (F.size("polygon") >= 3)
    return table(spark, folder, "parcels").groupBy("source").agg(F.count("*").alias("records"), F.round(state.share(usable), 6).alias("usable"), F.min("captured_at").alias("first"), F.max("captured_at").alias("last"))


# -- files ------------------------------------------------------------------------------------------------------------


def _through(spark: SparkSession, write, read) -> DataFrame:
    """What ``read`` finds of what ``write`` puts into a folder, which is deleted afterwards."""
    out = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    write(out)
    found = materialise(read(out))
    remove_folder(spark, out)
    return found


@query(f"SELECT coalesce(survey_number, '') AS survey, CAST(count(*) AS BIGINT) AS rings, CAST(sum(n + CASE WHEN g[1].x = g[n].x AND g[1].y = g[n].y THEN 0 ELSE 1 END) AS BIGINT) AS corners, round(sum(list_sum(list_transform(g, lambda v: v.x)) + CASE WHEN g[1].x = g[n].x AND g[1].y = g[n].y THEN 0 ELSE g[1].x END), 1) AS sum_x FROM (WITH {_RINGS_SQL} SELECT r.*, survey_number FROM r JOIN parcels USING (parcel_id)) GROUP BY 1")
def geojson_files(spark: SparkSession, folder: str) -> DataFrame:
    """Parcel rings written as GeoJSON features and read back: rings are closed on the way."""
    p = _rings(spark, folder).select(F.coalesce("survey_number", F.lit("")).alias("survey_no"), F.col("polygon").alias("ring"))
    found = _through(spark, lambda out: sinks.write_geojson(p, out, ["survey_no"]), lambda out: files.read_geojson_lines(spark, out))
    total = F.aggregate("ring", F.lit(0.0), lambda s, v: s + v["x"])
    return found.groupBy("survey").agg(F.count("*").alias("rings"), F.sum(F.size("ring")).alias("corners"), F.round(F.sum(total), 1).alias("sum_x"))


@query(f"WITH {_RINGS_SQL} SELECT CAST(parcel_id AS VARCHAR) AS survey, CAST(n AS INTEGER) AS corners, round(list_sum(list_transform(g, lambda v: round(v.x, 3))), 3) AS sum_x, round(list_sum(list_transform(g, lambda v: round(v.y, 3))), 3) AS sum_y FROM r")
def csv_files(spark: SparkSession, folder: str) -> DataFrame:
    """Corner rows of parcels written as CSV with three decimals, and read back as rings."""
    p = _rings(spark, folder).select(F.col("parcel_id").alias("survey"), F.col("polygon").alias("ring"))
    found = _through(spark, lambda out: sinks.write_csv(sinks.corner_rows(p, ["survey"]).withColumnRenamed("corner", "seq"), out), lambda out: files.read_csv_parcels(spark, out))
    total = lambda k: F.round(F.aggregate("ring", F.lit(0.0), lambda s, v: s + v[k]), 3)
    return found.select("survey", F.size("ring").alias("corners"), total("x").alias("sum_x"), total("y").alias("sum_y"))


@query(f"WITH {_RINGS_SQL} SELECT 'P' || parcel_id AS layer, CAST(n AS BIGINT) AS vertices, CAST(1 AS BIGINT) AS texts, round(sum_x, 2) AS sum_x FROM (SELECT *, list_sum(list_transform(g, lambda v: v.x)) AS sum_x FROM r)")
def drawing_files(spark: SparkSession, folder: str) -> DataFrame:
    """Parcels written as a drawing, a layer for each, and its entities read back."""
    first = F.get("polygon", F.lit(0))
    p = _rings(spark, folder).select(F.concat(F.lit("P"), F.col("parcel_id").cast("string")).alias("layer"), F.col("polygon").alias("ring"), F.col("parcel_id").cast("string").alias("text"), first["x"].alias("x"), first["y"].alias("y"))
    found = _through(spark, lambda out: sinks.write_dxf(p, out), lambda out: files.read_dxf(spark, out, suffix=".txt"))
    drawn = F.col("entity") == "LWPOLYLINE"
    return found.groupBy("layer").agg(F.count_if(drawn).alias("vertices"), F.count_if(F.col("entity") == "TEXT").alias("texts"), F.round(F.sum(F.when(drawn, F.col("x"))), 2).alias("sum_x"))


@query("SELECT source, land_use, count(*) AS records, round(sum(area_ha), 4) AS area FROM parcels WHERE source IS NOT NULL AND land_use IS NOT NULL GROUP BY ROLLUP (source, land_use)")
def land_report(spark: SparkSession, folder: str) -> DataFrame:
    """Records and areas by source and land use, with subtotals."""
    p = table(spark, folder, "parcels").where("source IS NOT NULL AND land_use IS NOT NULL")
    return sinks.report(p, ["source", "land_use"], {"area": F.round(F.sum("area_ha"), 4)})


@query("SELECT doc_id, CAST(count(*) AS BIGINT) AS lines, CAST(sum(length(t)) AS BIGINT) AS chars FROM (SELECT doc_id, trim(unnest(string_split_regex(text, '\\r?\\n')), ' ') AS t FROM documents WHERE text IS NOT NULL) WHERE t <> '' GROUP BY doc_id")
def page_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of texts that aren't blank."""
    lines = files.text_lines(table(spark, folder, "documents").select(F.col("doc_id").alias("page"), "text"))
    return lines.groupBy(F.col("page").alias("doc_id")).agg(F.count("*").alias("lines"), F.sum(F.length("text")).alias("chars"))
