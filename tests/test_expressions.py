import math

import pytest
from pyspark.sql import functions as F

from parcelwright.functions import plane, text


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_texts(spark):
    rows = [("82/2A", "169", "А1", "12.5"), ("SF 000123456", "123", "З", "(45,30)"), (None, None, None, None), ("", "", "", "x")]
    got = values(spark, rows, "a string, b string, c string, d string", text.base_survey(F.col("a")), text.upside_down(F.col("b")), text.latin_label(F.col("c")), text.measured_value(F.col("d")))
    assert got == [("82", "691", "A1", 12.5), ("00012", None, "3", 45.3), (None,) * 4, (None, None, "", None)]


def test_readings(spark):
    got = values(spark, [("(12,5)",), ("0.05",), ("2000",), ("a1",), ("7.",), (None,)], "s string", text.checked_reading(F.col("s")).alias("c"))
    assert [(r[0].normalized, r[0].reason) for r in got] == [("12.5", "ok"), ("0.05", "out_of_range"), ("2000", "out_of_range"), (None, "noise"), ("7", "ok"), (None, "noise")]


def test_labels_and_codes(spark):
    assert [r[0] for r in values(spark, [("A",), ("I",), ("31",), ("32",), ("0",), (None,)], "s string", text.stone_label(F.col("s")))] == [True, False, True, False, False, False]
    assert [r[0] for r in values(spark, [("B-TEMP",), ("r b",), ("X",), (None,), ("rbs",)], "s string", text.boundary_code(F.col("s")))] == [True, True, False, False, True]
    known = F.array(*[F.lit(x) for x in ("110", "1", "10", "784")])
    assert [r[0] for r in values(spark, [("IlO",), ("78-4",), ("x",)], "s string", text.known_survey(F.col("s"), known))] == ["110", "784", None]


def test_coordinates(spark):
    got = values(spark, [("77.1,11.2,0 77.2,11.3 bad 77.3,11.4",)], "s string", text.lon_lat_list(F.col("s")))[0][0]
    assert [(p.x, p.y) for p in got] == [(77.1, 11.2), (77.2, 11.3), (77.3, 11.4)]
    got = values(spark, [("987000.5 641000.25 4",), ("1",), (None,)], "s string", text.northing_easting(F.col("s")))
    assert (got[0][0].x, got[0][0].y) == (641000.25, 987000.5) and got[1][0] is None and got[2][0] is None


def test_segments_and_rings(spark):
    row = [(0.0, 3.0, -1.0, 0.0, 4.0, 0.0)]
    c = [F.col(x) for x in ("px", "py", "ax", "ay", "bx", "by")]
    assert values(spark, row + [(9.0, 4.0, 6.0, 0.0, 6.0, 0.0)], "px double, py double, ax double, ay double, bx double, by double", plane.segment_distance(*c)) == [(3.0,), (5.0,)]
    square = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
    ring = F.col("r")
    got = values(spark, [(square,), (square[:2],), ([],)], "r array<struct<x double, y double>>", plane.ring_area(ring), plane.ring_length(ring), plane.closure_gap(ring), F.size(plane.densified(ring, 3.0)))
    assert got[0] == (100.0, 40.0, 10.0, 12) and got[1][0] == 0.0 and got[1][2] is None and got[2][0] == 0.0


def test_pair_similarity_moves_one_segment_on_the_other(spark):
    names = ["ax", "ay", "bx", "by", "px", "py", "qx", "qy"]
    rows = [(0.0, 0.0, 2.0, 0.0, 5.0, 5.0, 5.0, 9.0), (1.0, 1.0, 1.0, 1.0, 0.0, 0.0, 1.0, 1.0)]
    got = values(spark, rows, ", ".join(f"{n} double" for n in names), plane.pair_similarity(*[F.col(n) for n in names]))
    pose = got[0][0]
    assert math.isclose(pose.angle, math.pi / 2) and pose.scale == 2 and (round(pose.tx, 9), round(pose.ty, 9)) == (5, 5) and got[1][0] is None


def test_utm_against_published_places(spark):
    # the origin of a zone's central meridian, and a point that textbooks give for zone 31
    rows = [(3.0, 0.0, 31, 500000.0, 0.0), (2.2945, 48.8582, 31, 448251.8, 5411932.7)]
    got = values(spark, rows, "lon double, lat double, zone int, e double, n double", plane.to_utm(F.col("lon"), F.col("lat"), F.col("zone")), F.col("e"), F.col("n"))
    for place, e, n in got:
        assert abs(place.x - e) < 0.5 and abs(place.y - n) < 0.5


def test_fingerprints(spark):
    a, b = F.col("a"), F.col("b")
    got = values(spark, [([1.0, 2.26, 3.0], [3.0, 2.0, 1.0]), ([1.0], [1.0, 2.0])], "a array<double>, b array<double>", plane.fingerprint(a), plane.fingerprint_rms(plane.fingerprint(a), plane.fingerprint(b)))
    assert got[0][0].bins == [1.0, 2.5, 3.0] and math.isclose(got[0][1], math.sqrt(0.25 / 3)) and got[1][1] is None


@pytest.mark.parametrize("value,want", [(float("nan"), None), (float("inf"), None), (1.5, 1.5), (None, None)])
def test_finite(spark, value, want):
    assert values(spark, [(value,)], "v double", plane.finite(F.col("v"))) == [(want,)]


def test_labels_checks_and_colours(spark):
    f = lambda *v: [F.lit(float(x)) for x in v]
    row = spark.range(1).select(
        plane.area_check(F.lit(9000.0), F.lit(1.0), 0.08).alias("check"), plane.area_check(F.lit(1.0), F.lit(0.0), 0.1).alias("none"), plane.clamped(F.lit(9.0), 1.5, 6.0).alias("clamped"),
        plane.beside_line(*f(5, 1, 0, 0, 10, 0), 2.0).alias("beside"), plane.label_box(*f(0, 0, 90), F.lit(4), 1.0).alias("box"),
        plane.warped_along(*f(5, 0), tuple(f(0, 0)), tuple(f(10, 0)), tuple(f(0, 2)), tuple(f(10, 4))).alias("warped"), plane.seed_error(*f(0, 0, 10, 0, 100), 0.1).alias("seed"),
        plane.colour_name(*f(0, 0, 1)).alias("blue"), plane.colour_name(*f(0.5, 0.5, 0.5)).alias("grey"), plane.colour_name(*f(0, 0, 0)).alias("black"), text.json_in_text(F.lit('ok: [{"id": 1}] end'), "array<struct<id: int>>").alias("json"),
    ).collect()[0]
    assert abs(row.check.error - 0.1) < 1e-9 and not row.check.ok and row.none is None and row.clamped == 6
    assert (row.beside.x, row.beside.y) == (5, 2) and (round(row.box.x1, 6), round(row.box.y1, 6)) == (0.5, 1.2)
    assert (row.warped.x, row.warped.y) == (5, 3) and abs(row.seed - 2**0.5) < 1e-9
    assert (row.blue, row.grey, row.black) == ("blue", "grey", "black") and row.json[0].id == 1
