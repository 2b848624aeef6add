"""Queries of the graph, shape and stream operators on whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcelwright.functions import plane
from parcelwright.operators import graph, joins, shapes
from parcelwright.plans.checkpoints import materialise, remove_folder, shared_folder
from parcelwright.sources.tables import table
from parcelwright.streaming import events

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def _spots(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "stones").select(F.col("stone_id").alias("node"), plane.finite(F.col("x")).alias("x"), plane.finite(F.col("y")).alias("y")).where("x IS NOT NULL AND y IS NOT NULL").groupBy("node").agg(F.min(F.struct("x", "y")).alias("p")).select("node", "p.x", "p.y")


@query("""
WITH RECURSIVE s AS (SELECT stone_id AS node, min((x, y)) AS p FROM stones WHERE isfinite(x) AND isfinite(y) GROUP BY stone_id), t AS (SELECT node, p[1] AS x, p[2] AS y, floor(p[1] / 1.5) AS u, floor(p[2] / 1.5) AS v FROM s),
e AS (SELECT a.node AS a, b.node AS b FROM t a JOIN t b ON b.u BETWEEN a.u - 1 AND a.u + 1 AND b.v BETWEEN a.v - 1 AND a.v + 1 AND a.node <> b.node AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 1.5),
r AS (SELECT node, node AS root FROM t UNION SELECT e.b, r.root FROM r JOIN e ON r.node = e.a)
SELECT node AS stone_id, min(root) AS cluster FROM r GROUP BY node""")
def stone_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Single-linkage clusters of stones within 1.5 of each other."""
    return graph.distance_clusters(_spots(spark, folder), 1.5).select(F.col("node").alias("stone_id"), F.col("label").alias("cluster"))


def _sketch_conflicts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    f = table(spark, folder, "fmb_errors").select(F.col("fmb_id").alias("node"), plane.finite(F.col("placed_x")).alias("x"), plane.finite(F.col("placed_y")).alias("y"), plane.finite(F.col("pct_within_tol")).alias("rank"))
    left = f.select(F.col("node").alias("lid"), F.col("x").alias("lx"), F.col("y").alias("ly"))
    right = f.select(F.col("node").alias("rid"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    return f, joins.within(left, right, 90.0).where("lid < rid").select(F.col("lid").alias("a"), F.col("rid").alias("b"), "gap")


@query()
def kept_sketches(spark: SparkSession, folder: str) -> DataFrame:
    """Sketches that stay when the better-measured of any two within 90 metres is taken first."""
    nodes, pairs = _sketch_conflicts(spark, folder)
    return graph.greedy_keep(nodes.select("node", "rank"), pairs.select("a", "b")).select(F.col("node").alias("fmb_id"), "kept")


@query("""
WITH f AS (SELECT fmb_id, placed_x AS x, placed_y AS y, CASE WHEN isfinite(pct_within_tol) THEN pct_within_tol END AS r FROM fmb_errors WHERE isfinite(placed_x) AND isfinite(placed_y)),
p AS (SELECT a.fmb_id AS a, b.fmb_id AS b, coalesce(a.r, -1) AS ra, coalesce(b.r, -1) AS rb FROM f a JOIN f b ON a.fmb_id < b.fmb_id AND b.x BETWEEN a.x - 90 AND a.x + 90 AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 90)
SELECT DISTINCT CASE WHEN ra = rb THEN least(a, b) WHEN ra < rb THEN a ELSE b END AS fmb_id FROM p""")
def outranked_sketches(spark: SparkSession, folder: str) -> DataFrame:
    """Of every two sketches within 90 metres the worse-measured one."""
    nodes, pairs = _sketch_conflicts(spark, folder)
    rank = nodes.select("node", F.coalesce("rank", F.lit(-1.0)).alias("rank"))
    ranked = pairs.join(rank.select(F.col("node").alias("a"), F.col("rank").alias("rank_a")), "a").join(rank.select(F.col("node").alias("b"), F.col("rank").alias("rank_b")), "b")
    return graph.losers(ranked).select(F.col("node").alias("fmb_id"))


@query()
def matched_sketches(spark: SparkSession, folder: str) -> DataFrame:
    """Each sketch with a stone of its own, the closest pairs first."""
    f = table(spark, folder, "fmb_errors").select(F.col("fmb_id").alias("lid"), plane.finite(F.col("placed_x")).alias("lx"), plane.finite(F.col("placed_y")).alias("ly"))
    s = _spots(spark, folder).select(F.col("node").alias("rid"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    near = joins.within(f, s, 25.0).select(F.col("lid").alias("a"), F.col("rid").alias("b"), F.col("gap").alias("cost"))
    return graph.greedy_matching(near).select(F.col("a").alias("fmb_id"), F.col("b").alias("stone_id"), F.round("cost", 4).alias("gap"))


_BOXES = "CAST({k} * 37 % 1000 + {d} AS DOUBLE) AS x0, CAST({k} * 91 % 1000 + {d} AS DOUBLE) AS y0, CAST({k} * 37 % 1000 + {d} + 10 + {k} % 13 AS DOUBLE) AS x1, CAST({k} * 91 % 1000 + {d} + 8 + {k} % 11 AS DOUBLE) AS y1"


@query(f"""
WITH a AS (SELECT c_custkey AS customer, {_BOXES.format(k='c_custkey', d=0)} FROM customer), b AS (SELECT s_suppkey AS supplier, {_BOXES.format(k='s_suppkey', d=2)} FROM supplier),
m AS (SELECT customer, supplier, greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS shared, (a.x1 - a.x0) * (a.y1 - a.y0) AS p, (b.x1 - b.x0) * (b.y1 - b.y0) AS q FROM a JOIN b ON a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1)
SELECT customer, supplier, round(CAST(shared AS DOUBLE), 4) AS shared, round(shared / least(p, q), 4) AS share, round(shared / (p + q - shared), 4) AS iou FROM m""")
def plot_overlaps(spark: SparkSession, folder: str) -> DataFrame:
    """Exact overlaps of rings, here rectangles, which the oracle can compute."""

    def boxes(name: str, k: str, d: int, side: str) -> DataFrame:
        key = F.col(k)
        x0, y0 = (key * 37 % 1000 + d).cast("double"), (key * 91 % 1000 + d).cast("double")
        corners = [f"{side}{e}" for e in ("x0", "y0", "x1", "y1")]
        drawn = table(spark, folder, name).select(key.alias("key"), x0.alias(corners[0]), y0.alias(corners[1]), (x0 + 10 + key % 13).alias(corners[2]), (y0 + 8 + key % 11).alias(corners[3]))
        return drawn.withColumn(f"{side}id", F.min("key").over(Window.partitionBy(*corners)))

    # equal rings are clipped once, as the first of them
    left, right = boxes("customer", "c_custkey", 0, "l"), boxes("supplier", "s_suppkey", 2, "r")
    met = joins.boxes_meeting(left.where("key = lid").drop("key"), right.where("key = rid").drop("key"), 20.0)
    point = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    ring = lambda s: F.array(point(f"{s}x0", f"{s}y0"), point(f"{s}x1", f"{s}y0"), point(f"{s}x1", f"{s}y1"), point(f"{s}x0", f"{s}y1"))
    found = shapes.overlaps(met.select("lid", "rid", ring("l").alias("ring_a"), ring("r").alias("ring_b"))).select("lid", "rid", *[F.round(c, 4).alias(c) for c in ("shared", "share", "iou")])
    each = joins.merged(found, right.select("rid", F.col("key").alias("supplier")), ["rid"])
    return joins.merged(each, left.select("lid", F.col("key").alias("customer")), ["lid"]).select("customer", "supplier", "shared", "share", "iou")


def _rings(spark: SparkSession, folder: str) -> DataFrame:
    """parcel_id, ring (unknown vertices left out), and shape: the smallest parcel_id with the same ring."""
    sound = F.filter("polygon", lambda v: v.isNotNull() & v["x"].isNotNull() & v["y"].isNotNull())
    p = table(spark, folder, "parcels").select("parcel_id", sound.alias("ring")).where(F.size("ring") >= 3).withColumn("hash", F.xxhash64("ring"))
    first = p.groupBy("hash").agg(F.min("parcel_id").alias("shape"))
    return p.join(first, "hash").drop("hash")


@query("""
WITH r AS (SELECT parcel_id, list_filter(polygon, lambda v: v IS NOT NULL AND v.x IS NOT NULL AND v.y IS NOT NULL) AS ring FROM parcels)
SELECT parcel_id, min(parcel_id) OVER (PARTITION BY ring) AS shape FROM r WHERE len(ring) >= 3""")
def parcel_shapes(spark: SparkSession, folder: str) -> DataFrame:
    """The parcel record that stands for all with exactly the same ring."""
    return _rings(spark, folder).select("parcel_id", "shape")


@query()
def parcel_overlaps(spark: SparkSession, folder: str) -> DataFrame:
    """Exact overlaps of different parcel rings; parcel_shapes says which records have a ring."""
    p = _rings(spark, folder).where("parcel_id = shape").select("shape", "ring")
    bound = lambda f, c: f(F.transform("ring", lambda v: v[c]))
    side = lambda s: p.select(F.col("shape").alias(f"{s}id"), bound(F.array_min, "x").alias(f"{s}x0"), bound(F.array_min, "y").alias(f"{s}y0"), bound(F.array_max, "x").alias(f"{s}x1"), bound(F.array_max, "y").alias(f"{s}y1"))
    met = joins.boxes_meeting(side("l"), side("r"), 100.0).where("lid < rid").select("lid", "rid")
    # boxes meet first; rings are fetched for the pairs that remain
    drawn = met.join(p.select(F.col("shape").alias("lid"), F.col("ring").alias("ring_l")), "lid").join(p.select(F.col("shape").alias("rid"), F.col("ring").alias("ring_r")), "rid")
    found = shapes.overlaps(drawn.select(F.col("lid").alias("parcel_a"), F.col("rid").alias("parcel_b"), "ring_l", "ring_r"), "ring_l", "ring_r")
    return found.where("share > 0.05").select("parcel_a", "parcel_b", *[F.round(c, 3).alias(c) for c in ("shared", "share", "iou")])


@query()
def village_hulls(spark: SparkSession, folder: str) -> DataFrame:
    """Convex and concave hulls of the parcel corners of each village."""
    p = table(spark, folder, "parcels").where("lgd_village_code IS NOT NULL").select(F.col("lgd_village_code").alias("code"), F.explode("polygon").alias("v")).where("v.x IS NOT NULL AND v.y IS NOT NULL AND v.x < v.y")
    return shapes.hulls(p.select("code", "v.x", "v.y"), "code")


@query()
def parcel_skeletons(spark: SparkSession, folder: str) -> DataFrame:
    """Parcel rings with at most five corners."""
    return shapes.skeletons(table(spark, folder, "parcels").select("parcel_id", F.filter("polygon", lambda v: v.isNotNull() & v["x"].isNotNull() & v["y"].isNotNull()).alias("ring")), "parcel_id", 5)


@query("SELECT parcel_id, CAST(0 AS DOUBLE) AS residual FROM parcels WHERE len(polygon) BETWEEN 4 AND 9 AND len(list_distinct(polygon)) = len(polygon)")
def turned_parcels(spark: SparkSession, folder: str) -> DataFrame:
    """Parcel rings that are turned and moved, and laid back; the oracle expects no residual."""
    ring = F.col("polygon")
    p = table(spark, folder, "parcels").where((F.size(ring) >= 4) & (F.size(ring) <= 9) & (F.size(F.array_distinct(ring)) == F.size(ring)))
    turn = (F.col("parcel_id") % 628) / 100.0
    first = F.get(ring, F.lit(0))
    moved = F.transform(ring, lambda v: F.struct((F.cos(turn) * (v["x"] - first["x"]) - F.sin(turn) * (v["y"] - first["y"])).alias("x"), (F.sin(turn) * (v["x"] - first["x"]) + F.cos(turn) * (v["y"] - first["y"])).alias("y")))
    found = shapes.rigid_placements(p.select("parcel_id", moved.alias("src"), ring.alias("dst")), "parcel_id")
    return found.select("parcel_id", F.abs(F.round("residual", 3)).alias("residual"))


@query("""
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS events, round(sum(value), 4) AS value FROM events GROUP BY 1, 2""")
def streamed_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly windows of the events, read as a stream until it has nothing new."""
    path = f"{folder}/events.parquet"
    batch = table(spark, folder, "events")
    reader = spark.readStream.schema(batch.schema)
    single = any(f.rstrip("/").endswith("/events.parquet") for f in batch.inputFiles())
    stream = reader.option("pathGlobFilter", "events.parquet").parquet(folder) if single else reader.parquet(path)
    out = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def keep(frame: DataFrame, _: int) -> None:
        frame.write.mode("overwrite").parquet(f"{out}/result")

    counted = events.windowed_counts(stream.select("ts", "event_type", "value"))
    counted.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    found = materialise(spark.read.parquet(f"{out}/result"))
    remove_folder(spark, out)
    return found.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "events", F.round("value", 4).alias("value"))
