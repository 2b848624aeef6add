from parcelwright.llm.survivors import discover, survivors

PARCELS = "parcel_id long, survey_number string, village string, lgd_village_code long, polygon array<struct<x double, y double>>, source_crs string, area_ha double, land_use string, source string, captured_at timestamp_ntz"


def test_the_ring_with_most_votes_survives(spark):
    x, y = 250_000.0, 905_000.0

    def ring(side, dx=0.0):
        return [(x + dx, y), (x + dx + side, y), (x + dx + side, y + side), (x + dx, y + side)]

    # the most trusted source draws the first parcel too wide, three others agree; the second parcel is alone
    rings = [(1, ring(64.5), "best"), (2, ring(60.0), "a"), (3, ring(60.2), "b"), (4, ring(60.1, 0.3), "c"), (5, ring(60.0, 500), "best")]
    rows = [(i, "12/1", "Oradam", 7, r, "EPSG:32643", None, None, s, None) for i, r, s in rings] + [(6, "12/1", "Oradam", 7, None, None, None, None, "a", None)]
    sources = spark.createDataFrame([("best", "x", 3), ("a", "x", 2), ("b", "x", 2), ("c", "x", 2)], "source string, file_kind string, trust int")
    villages = spark.createDataFrame([(7, "Oradam", None, "t", "d")], "lgd_village_code long, village string, local_name string, taluk string, district string")
    got = {r.ring_from: r for r in survivors(spark.createDataFrame(rows, PARCELS), villages, sources).collect()}
    kept = got[2] if 2 in got else got[next(k for k in (3, 4) if k in got)]
    assert 1 not in got and kept.records >= 4 and 0.5 < kept.polygon_support < 1 and [tuple(p) for p in kept.polygon] in [r for _, r, _ in rings[1:4]]
    assert got[5].polygon_support == 1 and len(got[5].polygon) == 4


def test_too_few_rounds_are_an_error(spark):
    claims = spark.createDataFrame([(1, "f", "v", "a"), (1, "f", "w", "b"), (2, "f", "v", "a"), (2, "f", "v", "b")], "object long, field string, value string, source string")
    start = spark.createDataFrame([("a", 0.9)], "source string, weight double")
    try:
        discover(claims, start, rounds=1)
    except RuntimeError:
        return
    raise AssertionError("one round doesn't converge here")
