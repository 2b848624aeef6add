import json
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from parcelwright.sources import files, sinks

RING = [[77.0, 11.0], [77.1, 11.0], [77.1, 11.1], [77.0, 11.0]]


def ring_of(row):
    return [[p.x, p.y] for p in row.ring]


def test_geojson_and_back(spark, tmp_path):
    doc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"Survey_No": "12/1", "Village": "Oradam"}, "geometry": {"type": "Polygon", "coordinates": [RING]}},
        {"type": "Feature", "properties": {"survey_no": "13"}, "geometry": {"type": "MultiPolygon", "coordinates": [[RING], [RING[::-1]]]}},
        {"type": "Feature", "properties": {}, "geometry": {"type": "Point", "coordinates": [1, 2]}},
        {"type": "Feature", "properties": None, "geometry": None},
    ]}
    (tmp_path / "a.geojson").write_text(json.dumps(doc, indent=1))
    rows = files.read_geojson(spark, str(tmp_path / "a.geojson")).orderBy("survey", "part").collect()
    assert [(r.survey, r.village, r.part, r.crs) for r in rows] == [("12/1", "Oradam", 0, "EPSG:4326"), ("13", None, 0, "EPSG:4326"), ("13", None, 1, "EPSG:4326")] and ring_of(rows[0]) == RING
    out = [json.loads(r.feature) for r in sinks.features(files.read_geojson(spark, str(tmp_path / "a.geojson")).orderBy("survey", "part"), ["survey", "village"]).collect()]
    assert out[0]["geometry"]["coordinates"] == [RING] and out[1]["properties"] == {"survey": "13", "village": None}
    single = doc["features"][0] | {"crs": {"properties": {"name": "urn:ogc:def:crs:EPSG::32643"}}}
    (tmp_path / "b.geojson").write_text(json.dumps(single))
    assert [r.crs for r in files.read_geojson(spark, str(tmp_path / "b.geojson")).collect()] == ["EPSG:32643"]


KML = """<?xml version="1.0"?><kml><Document>
<Placemark><name>7</name><ExtendedData><Data name="Survey_No"><value>12/1</value></Data></ExtendedData><Polygon><outerBoundaryIs><LinearRing><coordinates>77,11,0 77.1,11 77.1,11.1 77,11</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark>
<Placemark><name>8</name><Polygon><outerBoundaryIs><LinearRing><coordinates>77,11 bad 77.1,11 77.1,11.1 77,11</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark>
<Placemark><name>9</name><Polygon><outerBoundaryIs><LinearRing><coordinates>77,11 77.1,11 77,11</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark>
</Document></kml>"""


def test_kml_and_kmz(spark, tmp_path):
    (tmp_path / "a.kml").write_text(KML)
    with zipfile.ZipFile(tmp_path / "a.kmz", "w") as z:
        z.writestr("readme.txt", "x")
        z.writestr("doc.kml", KML)
    for rows in (files.read_kml(spark, str(tmp_path / "a.kml")), files.read_kmz(spark, str(tmp_path / "a.kmz"))):
        got = {r.survey: ring_of(r) for r in rows.collect()}
        assert got == {"12/1": [[77, 11], [77.1, 11], [77.1, 11.1], [77, 11]], "8": [[77, 11], [77.1, 11], [77.1, 11.1], [77, 11]]}


def test_csv_shapes_and_vertices(spark, tmp_path):
    (tmp_path / "w.csv").write_text('Survey_No,WKT\n12,"POLYGON ((0 0, 4 0, 4 3))"\n13,"POINT (1 1)"\n')
    (tmp_path / "v.csv").write_text("survey,x,y,seq\n1,0,0,1\n1,4,3,3\n1,4,0,2\n2,0,0,1\n1,,3,4\n")
    (tmp_path / "n.csv").write_text("name\n1\n")
    assert [(r.survey, ring_of(r)) for r in files.read_csv_parcels(spark, str(tmp_path / "w.csv")).collect()] == [("12", [[0, 0], [4, 0], [4, 3]])]
    assert [(r.survey, ring_of(r)) for r in files.read_csv_parcels(spark, str(tmp_path / "v.csv")).collect()] == [("1", [[0, 0], [4, 0], [4, 3]])]
    with pytest.raises(ValueError):
        files.read_csv_parcels(spark, str(tmp_path / "n.csv"))


def test_landxml(spark, tmp_path):
    (tmp_path / "a.xml").write_text("""<LandXML xmlns="http://www.landxml.org/schema/LandXML-1.2"><CgPoints><CgPoint name="p1">10 1 5</CgPoint><CgPoint name="p2">10 5</CgPoint></CgPoints>
<Parcels><Parcel name="12/1"><CoordGeom><Line><Start pntRef="p1"/><End pntRef="p2"/></Line><Line><Start pntRef="p2"/><End>14 5</End></Line><Curve><Start>14 5</Start><End pntRef="p1"/></Curve></CoordGeom></Parcel><Parcel name="0"><CoordGeom/></Parcel></Parcels></LandXML>""")
    assert [(r.survey, ring_of(r)) for r in files.read_landxml(spark, str(tmp_path / "a.xml")).collect()] == [("12/1", [[1, 10], [5, 10], [5, 14], [1, 10]])]
    assert {(r.name, r.x, r.y) for r in files.read_landxml_points(spark, str(tmp_path / "a.xml")).collect()} == {("p1", 1.0, 10.0), ("p2", 5.0, 10.0)}


def wkb(ring, order="<"):
    return bytes([order == "<"]) + struct.pack(order + "III", 3, 1, len(ring)) + b"".join(struct.pack(order + "dd", *p) for p in ring)


def test_geoparquet_window(spark, tmp_path):
    small, large = [(0, 0), (1, 0), (1, 1), (0, 0)], [(0, 0), (9, 0), (9, 9), (0, 0)]
    multi = b"\x01" + struct.pack("<II", 6, 2) + wkb(small) + wkb(large, ">")
    assert [tuple(p.values()) for p in files.wkb_ring(multi)] == large
    assert files.wkb_ring(b"\x01\x01\x00") is None and files.wkb_ring(None) is None and files.wkb_ring(wkb(small)[:-3]) is None
    rows = [("1", 7, wkb(small), (0.0, 0.0, 1.0, 1.0)), ("2", 7, wkb(large), (50.0, 50.0, 51.0, 51.0)), ("3", 7, b"?", (0.0, 0.0, 1.0, 1.0))]
    path = str(tmp_path / "p")
    spark.createDataFrame(rows, "survey_number string, lgd_village_code long, geometry binary, bbox struct<xmin: double, ymin: double, xmax: double, ymax: double>").write.parquet(path)
    got = files.read_parcel_window(spark, path, 0.5, 0.5, 0.1)
    assert [r.survey_number for r in got.collect()] == ["1"]
    assert "bbox.xmin" in got._jdf.queryExecution().executedPlan().toString().split("PushedFilters")[1]


DXF = "0\nSECTION\n2\nHEADER\n9\n$X\n0\nENDSEC\n0\nSECTION\n2\nENTITIES\n0\nLWPOLYLINE\n8\nBOUNDARY\n90\n2\n10\n0.0\n20\n1.0\n10\n2.0\n20\n3.0\n0\nTEXT\n8\nSTONES\n10\n5\n20\n6\n1\nA\n50\n90\n0\nPOLYLINE\n8\nCHAIN\n0\nVERTEX\n8\nCHAIN\n10\n7\n20\n8\n0\nVERTEX\n10\n9\n20\n9\n0\nSEQEND\n0\nLINE\n8\nL\n10\n1\n20\n1\n11\n2\n21\n2\n0\nENDSEC\n0\nEOF\n"


def test_drawings(spark, tmp_path):
    (tmp_path / "one.dxf").write_text(DXF)
    (tmp_path / "TWO.DXF").write_text("0\nSECTION\n2\nENTITIES\n0\nPOINT\n8\nP\n10\n1\n20\n2\n0\nENDSEC\n")
    rows = files.read_dxf(spark, str(tmp_path)).orderBy("file", "ord", "at").collect()
    assert [(r.entity, r.layer, r.at, r.x, r.y, r.text, r.rotation) for r in rows] == [("POINT", "P", 0, 1, 2, None, None), ("LWPOLYLINE", "BOUNDARY", 0, 0, 1, None, None), ("LWPOLYLINE", "BOUNDARY", 1, 2, 3, None, None), ("TEXT", "STONES", 0, 5, 6, "A", 90), ("POLYLINE", "CHAIN", 0, 7, 8, None, None), ("POLYLINE", "CHAIN", 1, 9, 9, None, None), ("LINE", "L", 0, 1, 1, None, None), ("LINE", "L", 1, 2, 2, None, None)]


def test_drawing_round_trip_and_reports(spark, tmp_path):
    rows = [("BOUNDARY", [(0.0, 0.0), (4.0, 0.0), (4.0, 3.0)], "12/1", 2.0, 1.0, "v"), ("EMPTY", None, None, None, None, "w")]
    df = spark.createDataFrame(rows, "layer string, ring array<struct<x double, y double>>, text string, x double, y double, village string")
    sinks.write_dxf(df, str(tmp_path / "out"))
    path = next((tmp_path / "out").glob("part-*"))
    back = [tuple(r)[2:7] for r in files.dxf_rows("f", iter(path.read_text().splitlines())) ]
    assert [(e, x, y) for e, _, _, x, y in back] == [("LWPOLYLINE", 0, 0), ("LWPOLYLINE", 4, 0), ("LWPOLYLINE", 4, 3), ("TEXT", 2, 1)]
    assert [(r.corner, r.x, r.y) for r in sinks.corner_rows(df, ["layer"]).orderBy("corner").collect()][1] == (1, "4.000", "0.000")
    total = {r.village: r.records for r in sinks.report(df, ["village"], {"labels": F.count("text")}).collect()}
    assert total == {"v": 1, "w": 1, None: 2}
    sinks.write_geojson(df, str(tmp_path / "g"), ["layer"])
    assert spark.read.text(str(tmp_path / "g")).count() == 2


def test_dispatch_ranks_and_systems(spark, tmp_path):
    (tmp_path / "v.csv").write_text("survey,x,y,seq\n1,77.0,11.0,1\n1,77.4,11.3,3\n1,77.4,11.0,2\n")
    parcels = files.read_parcels(spark, str(tmp_path / "v.csv"))
    assert files.utm_of(parcels) == "EPSG:32643" and files.utm_of(parcels.limit(0)) is None
    assert [r["rank"] for r in files.primary_rings(parcels.select("survey", "ring").unionByName(parcels.selectExpr("survey", "slice(ring, 1, 2) AS ring"))).orderBy("rank").collect()] == [1, 2]
    with pytest.raises(ValueError):
        files.read_parcels(spark, "a.pdf")
    drawing = spark.createDataFrame([("SURVEY NUMBER", "MTEXT", r"{\fArial|b0;82/1}"), ("SURVEY NUMBER", "TEXT", "82"), ("X", "TEXT", "9"), ("SURVEY NUMBER", "TEXT", "none")], "layer string, entity string, text string")
    assert [r.survey for r in files.layer_surveys(drawing).collect()] == ["82"]
    assert [(r.line, r.text) for r in files.text_lines(spark.createDataFrame([(1, "a\n \nb ")], "page int, text string")).collect()] == [(0, "a"), (2, "b")]


def shapefile(rings, surveys):
    parts, points = [], []
    records = b""
    for n, record in enumerate(rings, 1):
        parts, points = [], []
        for ring in record:
            parts.append(len(points))
            points += ring
        body = struct.pack("<i", 5) + struct.pack("<4d", 0, 0, 0, 0) + struct.pack("<ii", len(parts), len(points)) + struct.pack(f"<{len(parts)}i", *parts) + b"".join(struct.pack("<dd", *p) for p in points)
        records += struct.pack(">ii", n, len(body) // 2) + body
    shp = struct.pack(">i", 9994) + b"\0" * 96 + records
    field = b"SURVEY_NO\0\0" + b"C" + b"\0" * 4 + bytes([8, 0]) + b"\0" * 14
    dbf = bytes([3, 1, 1, 1]) + struct.pack("<IHH", len(surveys), 32 + 32 + 1, 9) + b"\0" * 20 + field + b"\x0d" + b"".join(b" " + s.ljust(8).encode() for s in surveys)
    return shp, dbf


def test_shapefile(spark, tmp_path):
    outer, hole, other = [(0.0, 0.0), (0.0, 9.0), (9.0, 9.0), (0.0, 0.0)], [(1.0, 2.0), (2.0, 3.0), (1.0, 3.0), (1.0, 2.0)], [(20.0, 0.0), (20.0, 5.0), (25.0, 5.0), (20.0, 0.0)]
    shp, dbf = shapefile([[outer, hole], [other]], ["12/1", "13"])
    (tmp_path / "a.shp").write_bytes(shp)
    (tmp_path / "a.dbf").write_bytes(dbf)
    (tmp_path / "a.prj").write_text('PROJCS["WGS_1984_UTM_Zone_43N"]')
    (tmp_path / "b.shp").write_bytes(shp)
    (tmp_path / "b.dbf").write_bytes(dbf)
    rows = files.read_shapefile(spark, str(tmp_path / "a.shp")).orderBy("survey").collect()
    assert [(r.survey, r.part, r.crs, len(r.ring)) for r in rows] == [("12/1", 0, "EPSG:32643", 4), ("13", 0, "EPSG:32643", 4)]
    assert files.read_parcels(spark, str(tmp_path / "b.shp")).count() == 2 and files.read_shapefile(spark, str(tmp_path)).count() == 4


def test_aliases_order_and_parts_of_csv(spark, tmp_path):
    (tmp_path / "both.csv").write_text("FIELDNO,lon,lat,easting,northing,vno\n1,77.0,11.0,500000,1200000,1\n1,77.1,11.0,500040,1200000,2\n1,77.1,11.1,500040,1200030,3\n")
    assert [ring_of(r) for r in files.read_csv_parcels(spark, str(tmp_path / "both.csv")).collect()] == [[[500000, 1200000], [500040, 1200000], [500040, 1200030]]]
    (tmp_path / "m.csv").write_text('sy_no,the_geom\n5,"MULTIPOLYGON (((0 0, 4 0, 4 3), (1 1, 2 1, 2 2)), ((9 9, 10 9, 10 10)))"\n')
    assert sorted(ring_of(r) for r in files.read_csv_parcels(spark, str(tmp_path / "m.csv")).collect()) == [[[0, 0], [4, 0], [4, 3]], [[9, 9], [10, 9], [10, 10]]]
    rows = "".join(f"7,{i},{i * i}\n" for i in range(3_000))
    (tmp_path / "o.csv").write_text("survey,x,y\n" + rows)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        ring = files.read_csv_parcels(spark, str(tmp_path / "o.csv")).collect()[0].ring
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [p.x for p in ring] == list(range(3_000))


def test_village_names_of_shapefiles_and_parcels_in_another_system(spark, tmp_path):
    doc = {"type": "Feature", "properties": {"SyNo": "12/1", "village_na": "Oradam"}, "geometry": {"type": "Polygon", "coordinates": [[[76.5, 11.0], [76.5, 11.0], [76.501, 11.0], [76.501, 11.001], [76.5, 11.0]]]}}
    (tmp_path / "a.geojson").write_text(json.dumps(doc))
    row = files.read_parcels(spark, str(tmp_path / "a.geojson"), "EPSG:32643").collect()[0]
    assert (row.survey, row.village, row.crs, len(row.ring)) == ("12/1", "Oradam", "EPSG:32643", 3)
    assert 660_000 < row.ring[0].x < 670_000 and 1_210_000 < row.ring[0].y < 1_220_000
    back = files.reprojected(files.reprojected(spark.createDataFrame([row]), "EPSG:32644"), "EPSG:32643").collect()[0]
    assert back.crs == "EPSG:32643" and all(abs(p.x - q.x) < 1e-3 and abs(p.y - q.y) < 1e-3 for p, q in zip(back.ring, row.ring))
    assert files.read_parcels(spark, str(tmp_path / "a.geojson")).collect()[0].crs == "EPSG:4326"


def test_landxml_system(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<LandXML><CoordinateSystem name="WGS84 / EPSG:32644"/><Parcels><Parcel name="5"><CoordGeom><Line><Start>0 0</Start><End>0 4</End></Line><Line><Start>0 4</Start><End>3 4</End></Line></CoordGeom></Parcel></Parcels></LandXML>')
    assert [(r.survey, r.crs) for r in files.read_landxml(spark, str(tmp_path / "a.xml")).collect()] == [("5", "EPSG:32644")]
