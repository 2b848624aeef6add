import math
import random

from pyspark.sql import functions as F

from parcelwright.llm.cadastre import name_key, resolve_villages, survey_key, with_shape
from parcelwright.operators.graph import components
from parcelwright.llm.survivors import discover, same_parcel_pairs, survivors

PARCELS = "parcel_id long, survey_number string, village string, lgd_village_code long, polygon array<struct<x double, y double>>, source_crs string, area_ha double, land_use string, source string, captured_at timestamp_ntz, object string, code int"
VILLAGES = "lgd_village_code long, village string, local_name string, taluk string, district string"
SOURCES = "source string, file_kind string, trust int"


def test_survey_keys(spark):
    pairs = [("118/2A", "118/2A"), ("0118 / 2-a", "118/2A"), ("SF.No.118_2 A", "118/2A"), ("S.F.No. 118\\2A", "118/2A"), ("Survey No 118-2a", "118/2A"), ("௧௧௮/2அ", "118/2A"), ("１１８/2A", "118/2A"), ("II8/2A", "118/2A"), ("RS 41S.", "415"), ("S12/1-A1", "512/1A1"), ("9/1-1", "9/1.1"), ("33B", "338"), ("", None), ("--", None), (None, None), ("tank", None)]
    got = spark.createDataFrame(pairs, "s string, want string").select("want", survey_key(F.col("s")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_village_names(spark):
    villages = spark.createDataFrame([(1, "Senyoyaseri", "செந்யோயாசேரி", "a", "b"), (2, "Vadamipallam", None, "a", "b"), (3, "Vadamipallam", None, "c", "b"), (4, "Oradam", None, "a", "b")], VILLAGES)
    names = ["SENYOYA SERI", "Sneyoyaseri", "Senyoya", "செந்யோயாசேரி", "No.2 Senyoyaseri (V)", "Vadampallam", "village", None, "Elsewhere"]
    keyed = spark.createDataFrame([(n,) for n in names], "raw string").select("raw", name_key(F.col("raw")).alias("name"))
    codes = {r.raw: r.codes for r in keyed.join(resolve_villages(keyed, villages), "name", "left").collect()}
    assert all(codes[n] == [1] for n in names[:5]) and codes["Vadampallam"] == [2, 3] and codes["village"] is None and codes["Elsewhere"] is None


def test_shapes(spark):
    rings = [[(0.0, 10.0), (4.0, 10.0), (4.0, 13.0), (0.0, 13.0)], [(10.0, 0.0), (10.0, 4.0), (13.0, 4.0), (13.0, 0.0), (10.0, 0.0)], [(0.0, 1.0), (2.0, 5.0), (0.0, 1.0)], [], None, [(0.0, 10.0), None, (float("nan"), 1.0), (4.0, 10.0), (4.0, 13.0)]]
    got = with_shape(spark.createDataFrame([(i, r) for i, r in enumerate(rings)], "i int, polygon array<struct<x double, y double>>")).orderBy("i").collect()
    for r in got[:2]:
        assert math.isclose(r.cx, 2) and math.isclose(r.cy, 11.5) and math.isclose(r.shape_area, 12)
    assert got[2].shape_area is None and got[3].cx is None and got[4].cx is None and math.isclose(got[5].shape_area, 6)


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100), (None, 3)] + [(rng.randint(200, 300), rng.randint(200, 300)) for _ in range(60)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    nodes = [*range(41), 100, 500, *range(200, 301)]
    got = {r.node: r.label for r in components(spark.createDataFrame([(n,) for n in nodes], "node long"), spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in nodes}


def test_truth_discovery_learns_sources(spark):
    claims = [(o, "f", "right", s) for o in range(20) for s in ("a", "b")] + [(o, "f", "wrong", s) for o in range(20) for s in ("x",)]
    claims += [(50, "f", "good", "a"), (50, "f", "bad", "x"), (51, "f", "tie2", "new"), (51, "f", "tie1", "new"), (52, "f", None, "a"), (None, "f", "v", "a")] + [(50, "f", "bad", "x")] * 10
    truth, weights = discover(spark.createDataFrame(claims, "object long, field string, value string, source string"), spark.createDataFrame([("a", 0.5), ("b", 0.5), ("x", 0.9)], "source string, weight double"))
    best, weight = {r.object: r.value for r in truth.collect()}, {r.source: r.weight for r in weights.collect()}
    assert best[0] == "right" and best[50] == "good" and best[51] == "tie1" and 52 not in best
    assert weight["a"] > weight["x"]


def test_rounds_on_the_driver_and_as_jobs_agree(spark):
    rng = random.Random(4)
    claims = spark.createDataFrame([(rng.randint(0, 40), rng.choice("fg"), rng.choice("uvw"), rng.choice("abcde")) for _ in range(300)], "object long, field string, value string, source string")
    start = spark.createDataFrame([("a", 0.9), ("b", 0.2)], "source string, weight double")
    runs = [discover(claims, start, most_patterns=n) for n in (20_000, 1)]
    shown = [([(r.object, r.field, r.value, round(r.share, 9)) for r in truth.orderBy("object", "field").collect()], [(r.source, round(r.weight, 9)) for r in weights.orderBy("source").collect()]) for truth, weights in runs]
    assert shown[0] == shown[1] and len(shown[0][1]) == 5


def square(x, y, side=60.0, jitter=0.0, swap=False):
    ring = [(x + jitter, y), (x + side, y + jitter), (x + side, y + side), (x, y + side - jitter)]
    return [(b, a) for a, b in ring] if swap else ring


def test_pairs_and_keepers(spark):
    x, y = 250_000.0, 905_000.0
    rows = [
        (1, "12/1", "Oradam", 7, square(x, y), "EPSG:32643", 0.36, "wet", "good", None, "o", 1),
        (2, "12-1", "ORADAM", None, square(x, y, jitter=1.5), None, 0.36, None, "good", None, "o", 1),
        (3, "--", None, None, square(x, y, swap=True), "epsg: 32643", None, None, "poor", None, "o", 1),
        (4, "0012 / 1", "Oradam", 7, None, None, 0.36, None, "poor", None, "o", 1),
        (5, "12/2", "Oradam", 7, square(x + 60, y), "EPSG:32643", 0.36, "wet", "poor", None, "o", 1),
        (6, "12", "Oradam", 7, [(x, y), (x + 120, y), (x + 120, y + 60), (x, y + 60)], "EPSG:32643", 0.72, "wet", "good", None, "o", 1),
        (7, "12/1", "Oradam", 8, square(x + 5000, y), "EPSG:32643", 0.36, "wet", "good", None, "o", 1),
        (8, "99", "Oradam", 7, [], None, None, None, "poor", None, "o", 1),
        (9, "99.", None, 7, None, None, None, None, "good", None, "o", 1),
        (10, None, None, None, None, None, None, None, None, None, "o", 1),
        (11, None, None, None, None, None, None, None, None, None, "o", 1),
        (12, "12/1", "Oradam", 7, square(x, y), "EPSG:32644", 0.36, "wet", "good", None, "o", 1),
        (1, "12/1", "Oradam", 7, square(x, y), "EPSG:32643", 0.36, "wet", "good", None, "o", 1),
        (None, "12/1", "Oradam", 7, square(x, y), "EPSG:32643", 0.36, "wet", "good", None, "o", 1),
    ]
    villages = spark.createDataFrame([(7, "Oradam", None, "t", "d"), (8, "Oradam", None, "u", "d")], VILLAGES)
    sources = spark.createDataFrame([("good", "x", 5), ("poor", "x", 1)], SOURCES)
    frame = spark.createDataFrame([r for r in rows if r[0] != 12], PARCELS)
    got = {tuple(r) for r in same_parcel_pairs(frame, villages, sources).collect()}
    assert got == {(1, 2, 1), (1, 3, 1), (1, 4, 1), (2, 3, 1), (2, 4, 1), (3, 4, 1), (8, 9, 8)}
    left = {r.keeper_id: r for r in survivors(frame, villages, sources).collect()}
    assert left[1].records == 4 and left[1].survey == "12/1" and left[1].lgd_village_code == 7 and left[1].village == "Oradam" and left[1].ring_from == 1
    assert left[10].survey is None and left[10].records == 1 and sum(r.records for r in left.values()) == 11


def test_other_zones_differ(spark):
    rows = [(i, "5", "Oradam", 7, square(250_000.0, 905_000.0), crs, None, None, "good", None, "o", 1) for i, crs in ((1, "EPSG:32643"), (2, "EPSG:32644"))]
    got = same_parcel_pairs(spark.createDataFrame(rows, PARCELS), spark.createDataFrame([(7, "Oradam", None, "t", "d")], VILLAGES), spark.createDataFrame([("good", "x", 5)], SOURCES))
    assert got.collect() == []


def test_near_copies_are_few_nodes_and_empty_tables(spark):
    rng = random.Random(1)
    rows = [(i, "5", "Oradam", 7, square(250_000.0 + rng.random(), 905_000.0 + rng.random()), "EPSG:32643", None, None, "good", None, "o", 1) for i in range(60)]
    villages, sources = spark.createDataFrame([(7, "Oradam", None, "t", "d")], VILLAGES), spark.createDataFrame([("good", "x", 5)], SOURCES)
    got = same_parcel_pairs(spark.createDataFrame(rows, PARCELS), villages, sources)
    assert got.count() == 60 * 59 // 2 and got.select("keeper_id").distinct().collect()[0][0] == 0
    empty = [spark.createDataFrame([], s) for s in (PARCELS, VILLAGES, SOURCES)]
    assert same_parcel_pairs(*empty).collect() == []


def test_records_without_a_zone_join_no_two_zones(spark):
    rows = [(i, "5", "Oradam", 7, square(250_000.0, 905_000.0), crs, None, None, "good", None, "o", 1) for i, crs in ((1, "EPSG:32643"), (2, "EPSG:32644"), (3, None), (4, "EPSG:32643"))]
    rows += [(i, "6", "Oradam", 7, square(260_000.0, 905_000.0), crs, None, None, "good", None, "o", 1) for i, crs in ((11, "EPSG:32643"), (12, None), (13, None))]
    got = same_parcel_pairs(spark.createDataFrame(rows, PARCELS), spark.createDataFrame([(7, "Oradam", None, "t", "d")], VILLAGES), spark.createDataFrame([("good", "x", 5)], SOURCES))
    assert {(r.parcel_id_a, r.parcel_id_b) for r in got.collect()} == {(1, 4), (11, 12), (11, 13), (12, 13)}
