"""Queries over the land-survey tables for the general problems: points and regions (p1), nested records (p5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelwright.operators.nested import Layout, as_bodies, json_parts, listed, position
from parcelwright.sources.tables import table

NEAR_METRES = 0.60

REPORTS = Layout(
    lists={"stages": "stage", "reports": "report", "checks": "check", "requests": "request", "proposals": "proposal", "attempts": "attempt"},
    keyed={"report": "agent"},
    own=frozenset({"agent", "passed", "checks", "requests", "proposals", "notes"}),
)
CHILDREN = {"checks": "check", "requests": "request", "proposals": "proposal"}


def _stones(spark: SparkSession, folder: str) -> DataFrame:
    from parcelwright.operators.proximity import crs_key

    return table(spark, folder, "stones").select(F.col("stone_id").alias("id"), "x", "y", crs_key(F.col("crs")).alias("grp"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Stones within 0.60 of each other, and the parcels that enclose a stone."""
    from parcelwright.operators.proximity import crs_key, near_and_inside

    parcels = table(spark, folder, "parcels").select(F.col("parcel_id").alias("id"), F.col("polygon").alias("ring"), crs_key(F.col("source_crs")).alias("grp"))
    return near_and_inside(_stones(spark, folder), parcels, NEAR_METRES)


def _parts(spark: SparkSession, folder: str) -> DataFrame:
    payloads = table(spark, folder, "report_payloads").select(F.col("payload_id").alias("record_id"), "body")
    return json_parts(payloads.unionByName(_report_bodies(spark, folder)), REPORTS)


def _report_bodies(spark: SparkSession, folder: str) -> DataFrame:
    return as_bodies(table(spark, folder, "agent_reports"), "report_id", ["agent", "passed", *CHILDREN, "notes"], "reports")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each check, request and proposal with its place in its report and record; a record delivered twice counts once."""
    part = _parts(spark, folder).where((F.col("parent") == "report") & F.col("entity").isin(*CHILDREN.values()))
    item = F.when(F.col("entity") == "check", F.col("members")["name"]).otherwise(F.col("members")["survey_number"])
    return part.select("record_id", F.col("parent_pos").cast("int").alias("report_pos"), F.col("entity").alias("child_kind"), F.col("child_pos").cast("int").alias("child_pos"), item.alias("item")).distinct()


def p5_requests(spark: SparkSession, folder: str) -> DataFrame:
    """The flat table of requests, from nested columns and from payloads alike."""
    wanted = ["survey_number", "disposition", "reason", "input_type", "instruction", "resolves_via"]
    return _flat(spark, folder, "request", wanted, position(F.col("members"), "known_utm").alias("known_utm"))


def _flat(spark: SparkSession, folder: str, entity: str, wanted: list[str], *more: Column) -> DataFrame:
    part = _parts(spark, folder).where(F.col("entity") == entity)
    return part.select("record_id", F.col("parent_pos").alias("report_pos"), "child_pos", *[F.col("members")[m].alias(m.replace(".", "_")) for m in wanted], *more).distinct()


def p5_checks(spark: SparkSession, folder: str) -> DataFrame:
    """The flat table of checks; the evidence comes with payloads only."""
    wanted = ["name", "severity", "detail", "evidence.metrics.gap_m", "evidence.metrics.iou"]
    return _flat(spark, folder, "check", wanted, listed(F.col("members"), "evidence.surveys").alias("evidence_surveys"))


def p5_proposals(spark: SparkSession, folder: str) -> DataFrame:
    """The flat table of proposals."""
    flags = [F.col("members")[f].try_cast("boolean").alias(f) for f in ("is_auto", "regated", "accepted_by_gate")]
    return _flat(spark, folder, "proposal", ["survey_number", "hypothesis", "action", "rationale", "source", "note"], *flags)


def p5_reports(spark: SparkSession, folder: str) -> DataFrame:
    """The flat table of reports: record_id, report_pos, agent, passed and notes (empty where a report has none)."""
    m = F.col("members")
    sent = _parts(spark, folder).where("entity = 'report'")
    return sent.select("record_id", F.col("pos").alias("report_pos"), m["agent"].alias("agent"), m["passed"].try_cast("boolean").alias("passed"), listed(m, "notes").alias("notes")).distinct()


def p5_agent_items(spark: SparkSession, folder: str) -> DataFrame:
    """Every check, request and proposal of agent_reports by the same operator, with fields that SQL can take from the nested columns."""
    part = json_parts(_report_bodies(spark, folder), REPORTS).where(F.col("entity").isin(*CHILDREN.values()))
    m = F.col("members")
    shown = F.when(F.col("entity") == "check", m["severity"]).when(F.col("entity") == "request", m["disposition"]).otherwise(m["action"])
    item = F.when(F.col("entity") == "check", m["name"]).otherwise(m["survey_number"])
    return part.select("record_id", F.col("entity").alias("child_kind"), "child_pos", item.alias("item"), shown.alias("detail"), m["is_auto"].alias("is_auto"), position(m, "known_utm").alias("known_utm")).select("*", F.get("known_utm", F.lit(0)).alias("east"), F.get("known_utm", F.lit(1)).alias("north")).drop("known_utm").distinct()


QUERIES = {"p1_found": p1_found, "p5_found": p5_found, "p5_requests": p5_requests, "p5_reports": p5_reports, "p5_checks": p5_checks, "p5_proposals": p5_proposals, "p5_agent_items": p5_agent_items}

ORACLE = {
    "p5_agent_items": """
WITH c AS (SELECT report_id, unnest(checks) AS e, unnest(range(len(checks))) AS i FROM agent_reports),
r AS (SELECT report_id, unnest(requests) AS e, unnest(range(len(requests))) AS i FROM agent_reports),
p AS (SELECT report_id, unnest(proposals) AS e, unnest(range(len(proposals))) AS i FROM agent_reports)
SELECT DISTINCT report_id AS record_id, 'check' AS child_kind, CAST(i AS INTEGER) AS child_pos, e.name AS item, e.severity AS detail, CAST(NULL AS VARCHAR) AS is_auto, CAST(NULL AS DOUBLE) AS east, CAST(NULL AS DOUBLE) AS north FROM c WHERE e IS NOT NULL
UNION ALL SELECT DISTINCT report_id, 'request', CAST(i AS INTEGER), e.survey_number, e.disposition, NULL, e.known_utm[1], e.known_utm[2] FROM r WHERE e IS NOT NULL
UNION ALL SELECT DISTINCT report_id, 'proposal', CAST(i AS INTEGER), e.survey_number, e.action, CAST(e.is_auto AS VARCHAR), NULL, NULL FROM p WHERE e IS NOT NULL""",
    "p1_found": """
WITH stone AS (
  SELECT DISTINCT stone_id AS id, x, y, upper(regexp_replace(coalesce(crs, 'EPSG:32643'), '\\s', '', 'g')) AS grp
  FROM stones
  WHERE x IS NOT NULL AND y IS NOT NULL AND isfinite(x) AND isfinite(y) AND NOT (x = 0 AND y = 0)
), cell AS (
  SELECT *, floor(x / 0.6) AS cx, floor(y / 0.6) AS cy FROM stone
), probe AS (
  SELECT id, x, y, grp, cx + dx AS cx, cy + dy AS cy FROM cell, (VALUES (-1), (0), (1)) a(dx), (VALUES (-1), (0), (1)) b(dy)
), ring AS (
  SELECT parcel_id AS id, upper(regexp_replace(coalesce(source_crs, 'EPSG:32643'), '\\s', '', 'g')) AS grp,
         list_transform(polygon, lambda p: p.x) AS xs, list_transform(polygon, lambda p: p.y) AS ys
  FROM parcels WHERE len(polygon) >= 3
), box AS (
  SELECT *, list_min(xs) AS x0, list_max(xs) AS x1, list_min(ys) AS y0, list_max(ys) AS y1 FROM ring
), candidate AS (
  SELECT s.id AS stone, b.id AS parcel, s.x, s.y, b.xs, b.ys
  FROM stone s JOIN box b ON s.grp = b.grp AND s.x BETWEEN b.x0 AND b.x1 AND s.y BETWEEN b.y0 AND b.y1
), edge AS (
  SELECT stone, parcel, x, y, xs[i] AS ax, ys[i] AS ay, xs[i % len(xs) + 1] AS bx, ys[i % len(ys) + 1] AS ny
  FROM (SELECT *, unnest(range(1, len(xs) + 1)) AS i FROM candidate)
), side AS (
  SELECT *, (bx - ax) * (y - ay) - (ny - ay) * (x - ax) AS s FROM edge
), inside AS (
  SELECT stone, parcel FROM side GROUP BY stone, parcel, x, y
  HAVING count(*) FILTER ((ay <= y AND ny > y AND s > 0) OR (ny <= y AND ay > y AND s < 0)) % 2 = 1
     AND count(*) FILTER (s = 0 AND x BETWEEN least(ax, bx) AND greatest(ax, bx) AND y BETWEEN least(ay, ny) AND greatest(ay, ny)) = 0
)
SELECT DISTINCT 'near' AS kind, a.id AS key_a, b.id AS key_b
FROM cell a JOIN probe b ON a.cx = b.cx AND a.cy = b.cy AND a.grp = b.grp AND a.id < b.id
WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 0.6
UNION ALL
SELECT DISTINCT 'inside', stone, parcel FROM inside
"""
}
