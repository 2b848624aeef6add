from pyspark.sql import functions as F
from test_survivors import PARCELS, SOURCES, VILLAGES, square

from parcelwright.llm.cadastre import perimeter
from parcelwright.llm.linking import link, prepare_sketches, wildcards

SKETCHES = "fmb_id long, survey string, header_village string, m1_file string, n_corners int, stated_area_ha double, perimeter_m double, placed_x double, placed_y double, parcel_id string, rule int"
NAN = float("nan")


def test_wildcards_and_perimeter(spark):
    row = spark.createDataFrame([("118/2A", [(0.0, 0.0), (3.0, 0.0), (3.0, 4.0)])], "n string, r array<struct<x double, y double>>").select(wildcards(F.col("n")).alias("w"), perimeter(F.col("r")).alias("p")).collect()[0]
    assert row.w == ["?18/2A", "1?8/2A", "11?/2A"] and abs(row.p - 12) < 1e-9


def test_file_names_and_villages(spark):
    villages = spark.createDataFrame([(7, "Oradam", None, "Palvadi", "Nilavur"), (8, "Oradam", None, "Vilamur", "Nilavur"), (9, "Thirunagar", None, "Vilamur", "Nilavur")], VILLAGES)
    rows = [
        (1, None, None, "m1/NILAVUR_Vilamur_TOradam_118_2A_rev2.dxf", None, None, None, None, None, None, None),
        (2, "12", "Oradam", "NILAVUR-Palvadi-Oradam-12.DXF", None, NAN, NAN, NAN, NAN, None, None),
        (3, "--", "Thirunagr", "x.dxf", None, 0.5, 100.0, 1.0, 2.0, None, None),
        (4, None, "Oradam", None, None, None, None, None, None, None, None),
    ]
    got = {r.fmb_id: r for r in prepare_sketches(spark.createDataFrame(rows, SKETCHES), villages).collect()}
    assert got[1].codes == [8] and got[1].numbers == ["118/2A"] and got[1].mains == ["118"]
    assert got[2].codes == [7] and got[2].area is None and got[2].x is None
    assert got[3].codes == [9] and got[3].numbers == []
    assert sorted(got[4].codes) == [7, 8]


def test_cascade(spark):
    x, y = 250_000.0, 905_000.0
    village = [(7, "Oradam", None, "Palvadi", "Nilavur"), (8, "Vadagar", None, "Vilamur", "Nilavur")]
    wide = [(x + 300, y), (x + 400, y), (x + 400, y + 50), (x + 300, y + 50)]
    parcels = [
        (1, "12/1", "Oradam", 7, square(x, y), "EPSG:32643", 0.36, "wet", "good", None, "o", 1),
        (2, "12/1", "Oradam", 7, square(x, y, jitter=0.1), "EPSG:32643", 0.36, "wet", "poor", None, "o", 1),
        (3, "12/2", "Oradam", 7, square(x + 60, y), "EPSG:32643", 0.36, "wet", "good", None, "o", 1),
        (4, "345", "Oradam", 7, wide, "EPSG:32643", 0.5, "wet", "good", None, "o", 1),
        (5, "12/1", "Vadagar", 8, square(x + 9000, y, side=80.0), "EPSG:32643", 0.64, "wet", "good", None, "o", 1),
        (6, "77", "Oradam", 7, None, None, 0.2, None, "good", None, "o", 1),
    ]
    sketches = [
        (1, "12/1", "Oradam", None, 4, 0.36, 240.0, None, None, None, None),  # both records, and not the other village
        (2, "12", None, None, 4, 0.36, 240.0, x + 85, y + 35, None, None),  # its part is lost, the place tells
        (3, "395", "Oradam", None, 4, 0.50, 300.0, None, None, None, None),  # misread
        (4, None, None, None, 4, 0.64, 320.0, x + 9050, y + 50, None, None),  # only place and size
        (5, "12/1", "Oradam", None, 4, 0.90, 400.0, None, None, None, None),  # another plot by its size
        (6, "12/1", "Oradam", None, 4, 0.36, 240.0, x + 5000, y, None, None),  # another plot by its place
        (7, "99", "Oradam", None, 4, 0.36, 240.0, None, None, None, None),  # not held
        (8, "12", "Oradam", None, 4, 0.36, 240.0, None, None, None, None),  # either part: no match
        (9, "77", "ORADAM", "NILAVUR_Palvadi_Oradam_77.dxf", None, NAN, None, NAN, None, None, None),
        (10, None, None, None, None, None, None, None, None, None, None),
        (1, "12/1", "Oradam", None, 4, 0.36, 240.0, None, None, None, None),
        (None, "12/1", "Oradam", None, 4, 0.36, 240.0, None, None, None, None),
    ]
    args = [spark.createDataFrame(parcels, PARCELS), spark.createDataFrame(village, VILLAGES), spark.createDataFrame([("good", "x", 5), ("poor", "x", 1)], SOURCES)]
    rows = link(spark.createDataFrame(sketches, SKETCHES), *args).collect()
    assert sorted((r.fmb_id, r.parcel_id) for r in rows) == [(1, 1), (1, 2), (2, 3), (3, 4), (4, 5), (9, 6)]
    assert all(0 < r.confidence < 1 for r in rows)


def test_empty_tables(spark):
    empty = [spark.createDataFrame([], s) for s in (SKETCHES, PARCELS, VILLAGES, SOURCES)]
    assert link(*empty).collect() == []


def test_confidence_is_measured_and_a_bad_rule_has_little(spark):
    """A village of plots that differ in size; a rule that takes any plot of the village is tried on labelled sketches and fails."""
    import random

    from parcelwright.llm.linking import Pass, Rule, passes

    rng = random.Random(3)
    parcels, sketches = [], []
    for i in range(120):
        x, y, side = 250_000.0 + 200 * (i % 12), 905_000.0 + 200 * (i // 12), 40.0 + rng.random() * 60
        parcels.append((i, str(100 + i), "Oradam", 7, square(x, y, side=side), "EPSG:32643", side * side / 1e4, "wet", "good", None, "o", 1))
        known = i % 3
        sketches.append((i, str(100 + i) if known != 2 else None, "Oradam", None, 4, side * side / 1e4, 4 * side, x + side / 2 if known else None, y + side / 2 if known else None, None, None))
    sketches.append((999, "777", "Oradam", None, 4, 0.9, 500.0, None, None, None, None))
    anything = Pass(lambda: F.transform("codes", lambda c: c.cast("string")), lambda: F.array(F.col("code").cast("string")), (Rule("village only", lambda: F.lit(True), ("place", "size", "number")),))
    args = [spark.createDataFrame(sketches, SKETCHES), spark.createDataFrame(parcels, PARCELS), spark.createDataFrame([(7, "Oradam", None, "Palvadi", "Nilavur")], VILLAGES), spark.createDataFrame([("good", "x", 5)], SOURCES)]
    rows = {r.fmb_id: r for r in link(*args, cascade=[*passes(), anything]).collect()}
    assert rows[999].rule == "village only" and rows[999].confidence < 0.2
    good = [r for r in rows.values() if r.rule != "village only"]
    assert len(good) == 120 and all(r.parcel_id == r.fmb_id for r in good)
    assert all(r.confidence > 0.9 for r in good if r.rule == "village, number, size")
