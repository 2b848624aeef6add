from parcelwright.operators import shapes


def test_short_pieces_and_ends_are_measured(spark):
    segments = spark.createDataFrame([(1, 0.0, 0.0, 1000.0, 0.0), (2, 0.0, 100.0, 1000.0, 100.0), (3, 0.0, 300.0, 0.0, 300.0), (4, 700_000.0, 900_000.0, 700_030.0, 900_040.0)], "sid int, x1 double, y1 double, x2 double, y2 double")
    lines = [(101.0, 0.0, 111.0, 0.0), (105.0, 1.2, 120.0, 1.2), (990.0, -1.0, 1100.0, -1.0)] + [(5.0 + 16 * k, 100.0, 5.0 + 16 * k, 100.0) for k in range(60)] + [(0.0, 300.0, 5.0, 300.0), (700_015.0, 900_020.0, 700_015.0, 900_020.0), (700_030.0, 899_990.0, 699_990.0, 900_020.0)]
    got = {r.sid: r.covered for r in shapes.covered_lengths(segments, spark.createDataFrame(lines, "lx1 double, ly1 double, lx2 double, ly2 double"), 2.0).collect()}
    assert abs(got[1] - (121.6 - 99.0 + 1000 - 990 + 3 ** 0.5)) < 1e-6  # the discs at 120 and 990 reach 1.6 and the root of 3 further
    assert abs(got[2] - 60 * 4.0) < 1e-6 and got[3] == 0.0 and abs(got[4] - 8.0) < 1e-6
