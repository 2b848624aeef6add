"""Readers of parcel and drawing files: GeoJSON, KML and KMZ, CSV, LandXML, GeoParquet windows, DXF."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelwright.functions.text import first_match, lon_lat_list, northing_easting

# Names under which sources give a survey number, a village, a shape, a coordinate or an order, the first that occurs counting.
SURVEY_NAMES = ("survey_no", "surveyno", "survey_number", "sno", "s_no", "sy_no", "syno", "fmb_no", "fmbno", "survey", "lgd_survey", "kide", "field_no", "fieldno")
VILLAGE_NAMES = ("village", "village_na", "vil_name", "villname", "revenue_vi")
X_NAMES = ("easting", "east", "utm_e", "x", "e", "lon", "long", "longitude")
Y_NAMES = ("northing", "north", "utm_n", "y", "n", "lat", "latitude")
ORDER_NAMES = ("seq", "order", "vertex", "vno", "pno", "point_no", "idx", "sort")
SHAPE_NAMES = ("wkt", "geometry", "geom", "the_geom", "wkt_geom")


def named(columns: list[str], aliases: tuple[str, ...]) -> str | None:
    """The column whose lower-case name comes first in ``aliases``."""
    lower = {c.lower(): c for c in columns}
    return next((lower[a] for a in aliases if a in lower), None)


def _by_alias(members: Column, aliases: tuple[str, ...]) -> Column:
    """The first of the aliases that a map has, without regard to case."""
    lowered = F.map_from_entries(F.transform(F.map_entries(members), lambda e: F.struct(F.lower(e["key"]), e["value"])))
    return F.coalesce(*[F.try_element_at(lowered, F.lit(a)) for a in aliases])


def _points(coordinates: Column) -> Column:
    return F.transform(coordinates, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))


def read_geojson_lines(spark: SparkSession, path: str) -> DataFrame:
    """As read_geojson(), for files with one Feature on each line; such files are split among tasks."""
    return read_geojson(spark, path, whole_file=False)


def read_geojson(spark: SparkSession, path: str, whole_file: bool = True) -> DataFrame:
    """survey, village, part, ring, crs of the polygons in GeoJSON files: outer rings, one row for each part.

    A file is a FeatureCollection or a single Feature. Features that aren't polygons have no rows; crs is WGS84 unless named.
    """
    feature = "properties map<string,string>, geometry struct<type: string, coordinates: string>"
    schema = f"type string, crs struct<properties: struct<name: string>>, features array<struct<{feature}>>, {feature}"
    schema = schema.replace("properties map<string,string>, geometry", "properties: map<string,string>, geometry:", 1)
    raw = spark.read.option("multiLine", whole_file).schema(schema).json(path)
    every = F.when(F.col("features").isNotNull(), F.col("features")).otherwise(F.array(F.struct("properties", "geometry")))
    rows = raw.select(F.coalesce(first_match(F.col("crs.properties.name"), r"EPSG:+(?:\d*:)?(\d+)$"), F.lit("4326")).alias("epsg"), F.explode(every).alias("f"))
    one = F.when(F.col("f.geometry.type") == "Polygon", F.array(F.from_json("f.geometry.coordinates", "array<array<array<double>>>"))).when(F.col("f.geometry.type") == "MultiPolygon", F.from_json("f.geometry.coordinates", "array<array<array<array<double>>>>"))
    parts = rows.select(_by_alias(F.col("f.properties"), SURVEY_NAMES).alias("survey"), _by_alias(F.col("f.properties"), VILLAGE_NAMES).alias("village"), F.concat(F.lit("EPSG:"), "epsg").alias("crs"), F.posexplode(one).alias("part", "polygon"))
    return parts.select("survey", "village", "part", _points(F.get("polygon", F.lit(0))).alias("ring"), "crs")


_PLACEMARK = "name string, ExtendedData struct<Data: array<struct<_name: string, value: string>>, SchemaData: struct<SimpleData: array<struct<_name: string, _VALUE: string>>>>, Polygon struct<outerBoundaryIs: struct<LinearRing: struct<coordinates: string>>>, MultiGeometry struct<Polygon: array<struct<outerBoundaryIs: struct<LinearRing: struct<coordinates: string>>>>>"


def read_kml(spark: SparkSession, path: str) -> DataFrame:
    """survey, village, part, ring, crs of the Placemarks in KML files; the survey is a data field, else the name."""
    raw = spark.read.format("xml").option("rowTag", "Placemark").schema(_PLACEMARK).load(path)
    return _placemarks(raw)


def _placemarks(raw: DataFrame) -> DataFrame:
    data = F.transform(F.coalesce("ExtendedData.Data", F.array()), lambda d: F.named_struct(F.lit("key"), F.lower(d["_name"]), F.lit("value"), d["value"]))
    simple = F.transform(F.coalesce("ExtendedData.SchemaData.SimpleData", F.array()), lambda d: F.named_struct(F.lit("key"), F.lower(d["_name"]), F.lit("value"), d["_VALUE"]))
    fields = F.concat(data, simple)
    value_of = lambda name: F.get(F.filter(fields, lambda e: e["key"] == name), F.lit(0))["value"]
    pick = lambda names: F.coalesce(*[value_of(n) for n in names])
    single = F.when(F.col("Polygon").isNotNull(), F.array("Polygon.outerBoundaryIs.LinearRing.coordinates"))
    shapes = F.coalesce(single, F.transform("MultiGeometry.Polygon", lambda p: p["outerBoundaryIs"]["LinearRing"]["coordinates"]))
    parts = raw.select(F.coalesce(pick(SURVEY_NAMES), "name").alias("survey"), pick(VILLAGE_NAMES).alias("village"), F.posexplode(shapes).alias("part", "text"))
    return parts.select("survey", "village", "part", lon_lat_list(F.col("text")).alias("ring"), F.lit("EPSG:4326").alias("crs")).where(F.size("ring") >= 4)


def read_kmz(spark: SparkSession, path: str) -> DataFrame:
    """Like read_kml() for zipped KML: the first .kml of each archive. An archive without one has no rows."""

    def unzip(frames: Iterator) -> Iterator:
        import io
        import re
        import zipfile

        import pandas as pd

        for frame in frames:
            out = []
            for content in frame["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    name = next((n for n in z.namelist() if n.lower().endswith(".kml")), None)
                    if name:
                        text = z.read(name).decode("utf-8", "replace")
                        out += re.findall(r"<Placemark\b.*?</Placemark>", text, re.DOTALL)
            yield pd.DataFrame({"xml": out}, dtype=object)

    texts = spark.read.format("binaryFile").load(path).select("content").mapInPandas(unzip, "xml string")
    return _placemarks(texts.select(F.from_xml("xml", _PLACEMARK).alias("p")).select("p.*"))


def read_csv_parcels(spark: SparkSession, path: str) -> DataFrame:
    """survey, village, ring of CSV files that hold a WKT polygon in each row, or one vertex in each row.

    A MULTIPOLYGON has a row for the outer ring of each part. Vertices without an order column are taken in the order of
    their file: by file, block and place in the block.
    """
    raw = spark.read.option("header", True).csv(path)
    survey, village = named(raw.columns, SURVEY_NAMES), named(raw.columns, VILLAGE_NAMES)
    if survey is None:
        raise ValueError("no column for the survey number")
    place = F.col(village) if village else F.lit(None).cast("string")
    shape = named(raw.columns, SHAPE_NAMES)
    if shape:
        # an outer ring follows two or three opening brackets, a hole only one
        outer = F.explode(F.regexp_extract_all(F.upper(F.col(shape)), F.lit(r"\(\s*\(\s*([^()]+)\)"), F.lit(1)))
        rows = raw.where(F.upper(F.trim(F.col(shape))).rlike(r"^(?:MULTI)?POLYGON")).select(F.col(survey).alias("survey"), place.alias("village"), outer.alias("text"))
        ring = F.transform(F.split("text", ","), lambda p: F.split(F.trim(p), r"\s+"))
        return rows.select("survey", "village", F.transform(ring, lambda p: F.struct(F.get(p, F.lit(0)).cast("double").alias("x"), F.get(p, F.lit(1)).cast("double").alias("y"))).alias("ring"))
    x, y, order = named(raw.columns, X_NAMES), named(raw.columns, Y_NAMES), named(raw.columns, ORDER_NAMES)
    if x is None or y is None:
        raise ValueError("neither a shape nor coordinates")
    in_file = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    at = F.col(order).cast("double") if order else in_file
    vertex = raw.select(F.col(survey).alias("survey"), place.alias("village"), F.struct(at.alias("at"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).alias("v")).where("v.x IS NOT NULL AND v.y IS NOT NULL")
    rings = vertex.groupBy("survey").agg(F.min("village").alias("village"), F.array_sort(F.collect_list("v")).alias("vs"))
    return rings.where(F.size("vs") >= 3).select("survey", "village", F.transform("vs", lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"))).alias("ring"))


def read_landxml(spark: SparkSession, path: str) -> DataFrame:
    """survey, ring and crs (null if none is named) of the parcels in LandXML files: line ends, given directly or as references to survey points."""
    return _landxml_rings(_landxml_rows(spark, path))


def read_landxml_points(spark: SparkSession, path: str) -> DataFrame:
    """name, x, y of the survey points in LandXML files."""
    return _landxml_rows(spark, path).where("kind = 'point'").select("name", "place.x", "place.y")


def _landxml_rows(spark: SparkSession, path: str) -> DataFrame:
    """file, kind ('point' or 'end'), name, at, ref, place of each survey point and line end, in the order of the file."""

    def parse(frames: Iterator) -> Iterator:
        import io
        import re
        import xml.etree.ElementTree as ET

        import pandas as pd

        local = lambda e: e.tag.rsplit("}", 1)[-1].lower()
        for frame in frames:
            out = []
            for file, content in zip(frame["path"], frame["content"]):
                for _, e in ET.iterparse(io.BytesIO(content)):
                    if local(e) == "coordinatesystem":
                        named_by = e.get("epsgCode") or next((m for v in e.attrib.values() for m in re.findall(r"(?:EPSG\D*)(\d{4,5})", v)), None)
                        if named_by:
                            out.append((file, "crs", named_by, 0, None, ""))
                    elif local(e) == "cgpoint" and e.get("name"):
                        out.append((file, "point", e.get("name"), 0, None, e.text or ""))
                    elif local(e) == "parcel":
                        ends = [end for line in e.iter() if local(line) in ("line", "curve", "irregularline") for end in line if local(end) in ("start", "end")]
                        out += [(file, "end", e.get("name"), i, end.get("pntRef"), end.text or "") for i, end in enumerate(ends)]
                        e.clear()
            yield pd.DataFrame(out, columns=["file", "kind", "name", "at", "ref", "text"])

    rows = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, "file string, kind string, name string, at int, ref string, text string")
    return rows.select("file", "kind", "name", "at", "ref", northing_easting(F.col("text")).alias("place"))


def _landxml_rings(rows: DataFrame) -> DataFrame:
    points = rows.where("kind = 'point'").select("file", F.col("name").alias("ref"), F.col("place").alias("known")).dropDuplicates(["file", "ref"])
    ends = rows.where("kind = 'end'").join(points, ["file", "ref"], "left").select("file", "name", "at", F.coalesce("known", "place").alias("p")).where("p IS NOT NULL")
    rings = ends.groupBy("file", "name").agg(F.array_sort(F.collect_list(F.struct("at", "p"))).alias("ps"))
    systems = rows.where("kind = 'crs'").groupBy("file").agg(F.concat(F.lit("EPSG:"), F.min("name")).alias("crs"))
    flat = rings.join(systems, "file", "left").select("name", "crs", F.transform("ps", lambda e: e["p"]).alias("ps"))
    # an end that repeats the one before is no corner
    kept = F.filter("ps", lambda p, i: (i == 0) | (F.abs(p["x"] - F.get("ps", i - 1)["x"]) + F.abs(p["y"] - F.get("ps", i - 1)["y"]) > 1e-6))
    return flat.select(F.col("name").alias("survey"), kept.alias("ring"), "crs").where(F.size("ring") >= 3)


def wkb_ring(content: bytes | None) -> list[dict[str, float]] | None:
    """The outer ring of the largest polygon of a well-known binary; None for other shapes and damaged bytes."""
    if not content:
        return None

    def polygon(at: int) -> tuple[list, int]:
        order = "<" if content[at] == 1 else ">"
        kind, rings = struct.unpack_from(order + "II", content, at + 1)
        if kind % 1000 != 3:
            raise ValueError(kind)
        at, outer = at + 9, []
        width = 8 * (2 + (kind // 1000 in (1, 2, 3)) + (kind // 1000 == 3))
        for i in range(rings):
            (n,) = struct.unpack_from(order + "I", content, at)
            if i == 0:
                outer = [struct.unpack_from(order + "dd", content, at + 4 + k * width) for k in range(n)]
            at += 4 + n * width
        return outer, at

    try:
        order = "<" if content[0] == 1 else ">"
        (kind,) = struct.unpack_from(order + "I", content, 1)
        if kind % 1000 == 3:
            rings = [polygon(0)[0]]
        elif kind % 1000 == 6:
            (n,), at, rings = struct.unpack_from(order + "I", content, 5), 9, []
            for _ in range(n):
                ring, at = polygon(at)
                rings.append(ring)
        else:
            return None
    except (struct.error, ValueError, IndexError):
        return None
    area = lambda r: abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:] + r[:1])))
    best = max((r for r in rings if len(r) >= 3), key=area, default=None)
    return None if best is None else [{"x": x, "y": y} for x, y in best]


def read_parcel_window(spark: SparkSession, path: str, lon: float, lat: float, pad: float) -> DataFrame:
    """survey_number, lgd_village_code, ring of the GeoParquet parcels whose box meets the window around a place.

    The box test is four comparisons of nested fields, which reach the scan, so row groups outside the window aren't read.
    """
    from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

    shape = ArrayType(StructType([StructField("x", DoubleType()), StructField("y", DoubleType())]))

    @F.pandas_udf(shape)
    def decode(content):
        return content.map(wkb_ring)

    near = spark.read.parquet(path).where((F.col("bbox.xmin") <= lon + pad) & (F.col("bbox.xmax") >= lon - pad) & (F.col("bbox.ymin") <= lat + pad) & (F.col("bbox.ymax") >= lat - pad))
    return near.select("survey_number", "lgd_village_code", decode(F.col("geometry").cast("binary")).alias("ring")).where("ring IS NOT NULL")


DXF_ROWS = "file string, ord int, entity string, layer string, at int, x double, y double, text string, rotation double"


def dxf_rows(file: str, lines: Iterator[str]) -> Iterator[tuple]:
    """Rows of a drawing's ENTITIES section, from its pairs of group code and value."""
    section, entity, values, ord_, parent = None, None, [], -1, None

    def finished():
        nonlocal parent
        one = {c: v for c, v in reversed(values)}
        layer, text, turn = one.get(8), one.get(1), one.get(50)
        number = lambda v: float(v) if v is not None else None
        if entity == "LWPOLYLINE":
            xs, ys = [v for c, v in values if c == 10], [v for c, v in values if c == 20]
            for at, (x, y) in enumerate(zip(xs, ys)):
                yield file, ord_, entity, layer, at, float(x), float(y), None, None
        elif entity == "LINE":
            yield file, ord_, entity, layer, 0, number(one.get(10)), number(one.get(20)), None, None
            yield file, ord_, entity, layer, 1, number(one.get(11)), number(one.get(21)), None, None
        elif entity == "POLYLINE":
            parent = [ord_, layer, 0]
        elif entity == "VERTEX" and parent:
            yield file, parent[0], "POLYLINE", parent[1], parent[2], number(one.get(10)), number(one.get(20)), None, None
            parent[2] += 1
        elif entity in ("POINT", "TEXT", "MTEXT", "INSERT", "CIRCLE"):
            yield file, ord_, entity, layer, 0, number(one.get(10)), number(one.get(20)), text, number(turn)

    pairs = iter(lines)
    for code in pairs:
        value = next(pairs, "").strip("\r\n")
        try:
            code = int(code)
        except ValueError:
            continue
        if code == 0:
            if section == "ENTITIES" and entity:
                yield from finished()
            entity, values = value.strip(), []
            if entity == "ENDSEC":
                section = None
            elif section == "ENTITIES" and entity not in ("VERTEX", "SEQEND"):
                ord_ += 1
        elif entity == "SECTION" and code == 2:
            section, entity = value.strip(), None
        elif section == "ENTITIES":
            values.append((code, value.strip() if code != 1 else value))


def read_dxf(spark: SparkSession, path: str, suffix: str = ".dxf") -> DataFrame:
    """Entities of DXF drawings (a file, a folder or a pattern of any file system that Spark reads): DXF_ROWS, a row for each vertex or placed text. A drawing is read by one task."""

    def parse(batches: Iterator) -> Iterator:
        import io

        import pyarrow as pa

        names = [f.split()[0] for f in DXF_ROWS.split(", ")]
        kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}
        types = [kinds[f.split()[1]] for f in DXF_ROWS.split(", ")]
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
        for batch in batches:
            held = []
            for file, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist()):
                for row in dxf_rows(file, io.TextIOWrapper(io.BytesIO(content), encoding="utf-8", errors="replace")):
                    held.append(row)
                    if len(held) == 50_000:
                        yield made(held)
                        held = []
            if held:
                yield made(held)

    files = spark.read.format("binaryFile").load(path).where(F.lower("path").endswith(suffix))
    return files.select("path", "content").mapInArrow(parse, DXF_ROWS)


def read_parcels(spark: SparkSession, path: str, target: str | None = None) -> DataFrame:
    """survey, village, ring, crs of a parcel file by its suffix: GeoJSON, KML, KMZ, shapefile, CSV or LandXML.

    What a format doesn't give is null; CSV and LandXML rings whose coordinates are all degrees are WGS84. With
    ``target`` (a northern UTM system) rings in degrees or in another UTM zone are brought to it. Rings are cleaned (see
    repaired()); those without an area have no rows.
    """
    suffix = path.rsplit(".", 1)[-1].lower()
    readers = {"geojson": read_geojson, "json": read_geojson, "kml": read_kml, "kmz": read_kmz, "shp": read_shapefile, "csv": read_csv_parcels, "xml": read_landxml, "landxml": read_landxml}
    if suffix not in readers:
        raise ValueError(f"no reader for .{suffix}")
    raw = readers[suffix](spark, path)
    for name in ("village", "crs"):
        if name not in raw.columns:
            raw = raw.withColumn(name, F.lit(None).cast("string"))
    degrees = F.forall("ring", lambda p: p["x"].between(-180, 180) & p["y"].between(-90, 90))
    known = raw.withColumns({"ring": repaired(F.col("ring")), "crs": F.coalesce("crs", F.when(degrees, "EPSG:4326"))}).where("ring IS NOT NULL")
    return (reprojected(known, target) if target else known).select("survey", "village", "ring", "crs")


def repaired(ring: Column) -> Column:
    """A ring without unknown and repeated vertices and its closing one; null where fewer than three or no area are left."""
    from parcelwright.functions.plane import finite, ring_area

    there = F.filter(ring, lambda p: p.isNotNull() & finite(p["x"]).isNotNull() & finite(p["y"]).isNotNull())
    once = F.filter(there, lambda p, i: (i == 0) | (p != F.get(there, i - 1)))
    bare = F.when((F.size(once) > 1) & (F.get(once, F.lit(0)) == F.element_at(once, -1)), F.slice(once, 1, F.size(once) - 1)).otherwise(once)
    return F.when((F.size(bare) >= 3) & (ring_area(bare) > 0), bare)


def reprojected(parcels: DataFrame, target: str) -> DataFrame:
    """Rows (ring, crs, ...) with their rings in ``target``, a northern UTM system like EPSG:32643; crs says so. Rings of a system that is neither degrees nor northern UTM stay as they are."""
    from parcelwright.functions.plane import from_utm, to_utm

    name = F.upper(F.regexp_replace("crs", r"\s", ""))
    zone_of = F.when(name.rlike(r"^EPSG:326\d\d$"), F.substring(name, 9, 2).cast("int"))
    zone = F.lit(int(target.strip()[-2:]))
    geographic = name.isin("EPSG:4326", "OGC:CRS84", "CRS84")

    def moved(p: Column) -> Column:
        place = from_utm(p["x"], p["y"], zone_of)
        return to_utm(F.when(geographic, p["x"]).otherwise(place["lon"]), F.when(geographic, p["y"]).otherwise(place["lat"]), zone)

    goes = F.coalesce((geographic | zone_of.isNotNull()) & (name != target.upper().replace(" ", "")), F.lit(False))
    return parcels.withColumns({"ring": F.when(goes, F.transform("ring", moved)).otherwise(F.col("ring")), "crs": F.when(goes, F.lit(target)).otherwise(F.col("crs"))})


def primary_rings(parcels: DataFrame) -> DataFrame:
    """Adds rank to rows of (survey, ring): 1 for the largest ring of each survey, ties by the ring itself."""
    from pyspark.sql import Window

    from parcelwright.functions.plane import ring_area

    sized = parcels.withColumn("_a", ring_area(F.col("ring")))
    return sized.withColumn("rank", F.row_number().over(Window.partitionBy("survey").orderBy(F.col("_a").desc(), F.xxhash64("ring")))).drop("_a")


def utm_of(parcels: DataFrame) -> str | None:
    """The UTM system of the first ring of a table in longitude and latitude, or None if it has none or isn't."""
    from parcelwright.functions.plane import utm_crs

    first = parcels.where(F.size("ring") > 0).select(F.get("ring", F.lit(0)).alias("p")).limit(1)
    row = first.select(F.when(F.col("p.x").between(-180, 180) & F.col("p.y").between(-90, 90), F.when(F.col("p.y") >= 0, utm_crs(F.col("p.x"))).otherwise(utm_crs(F.col("p.x"), False))).alias("crs")).collect()
    return row[0].crs if row else None


def layer_surveys(drawing: DataFrame, layer: str = "SURVEY NUMBER") -> DataFrame:
    """survey: the distinct base numbers of the texts on a layer, without their formatting codes."""
    from parcelwright.functions.text import base_survey

    plain = F.regexp_replace(F.regexp_replace("text", r"\\[A-Za-z][^;\\]*;", ""), r"[{}]", "")
    return drawing.where((F.col("layer") == layer) & F.col("entity").isin("TEXT", "MTEXT")).select(base_survey(plain).alias("survey")).where("survey IS NOT NULL").distinct()


def text_lines(pages: DataFrame) -> DataFrame:
    """page, line, text: the lines of page texts (page, text) that aren't blank, with full confidence."""
    return pages.select("page", F.posexplode(F.split("text", r"\r?\n")).alias("line", "t")).select("page", "line", F.trim("t").alias("text"), F.lit(1.0).alias("confidence")).where("text <> ''")


def shape_rows(shp: bytes, dbf: bytes) -> list[tuple[dict[str, str], int, list[tuple[float, float]]]]:
    """(attributes, part, ring) of each polygon part of a shapefile, holes left out; records without a polygon have none."""
    (count, head, width), names, at = struct.unpack_from("<IHH", dbf, 4), [], 32
    while dbf[at] != 0x0D:
        names.append((dbf[at : at + 11].split(b"\0")[0].decode("ascii", "replace"), dbf[at + 16]))
        at += 32
    records = []
    for i in range(count):
        pos, row = head + i * width + 1, {}
        for name, size in names:
            row[name] = dbf[pos : pos + size].decode("utf-8", "replace").strip()
            pos += size
        records.append(row)
    out, at, i = [], 100, 0
    while at + 8 <= len(shp):
        words = struct.unpack_from(">I", shp, at + 4)[0]
        kind = struct.unpack_from("<I", shp, at + 8)[0]
        if kind in (5, 15, 25) and i < len(records):
            parts, points = struct.unpack_from("<II", shp, at + 44)
            starts = [*struct.unpack_from(f"<{parts}I", shp, at + 52), points]
            flat = struct.unpack_from(f"<{2 * points}d", shp, at + 52 + 4 * parts)
            rings = [[(flat[2 * k], flat[2 * k + 1]) for k in range(a, b)] for a, b in zip(starts, starts[1:])]
            # outer rings run clockwise
            outer = [r for r in rings if sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(r, r[1:] + r[:1])) <= 0]
            out += [(records[i], n, r) for n, r in enumerate(outer or rings)]
        at += 8 + 2 * words
        i += 1
    return out


def read_shapefile(spark: SparkSession, path: str) -> DataFrame:
    """survey, village, part, ring, crs of the polygons in shapefiles (``path``: a .shp file or a folder of them with their .dbf and .prj)."""
    folder = path.rsplit("/", 1)[0] if path.lower().endswith(".shp") else path
    only = path.rsplit("/", 1)[1][:-4] if path.lower().endswith(".shp") else None
    stem, suffix = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    files = spark.read.format("binaryFile").load(folder).select(stem.alias("stem"), suffix.alias("suffix"), "content").where(F.col("suffix").isin("shp", "dbf", "prj"))
    if only:
        files = files.where(F.col("stem") == only)
    sets = files.groupBy("stem").pivot("suffix", ["shp", "dbf", "prj"]).agg(F.first("content")).where("shp IS NOT NULL AND dbf IS NOT NULL")

    def parse(frames: Iterator) -> Iterator:
        import pandas as pd

        for frame in frames:
            out = [(stem, row, part, [{"x": x, "y": y} for x, y in ring]) for stem, shp, dbf in zip(frame["stem"], frame["shp"], frame["dbf"]) for row, part, ring in shape_rows(bytes(shp), bytes(dbf))]
            yield pd.DataFrame(out, columns=["stem", "members", "part", "ring"])

    zone = F.regexp_extract(F.col("prj").cast("string"), r"UTM_[Zz]one_(\d+)N", 1)
    named_crs = F.when(zone != "", F.concat(F.lit("EPSG:326"), F.lpad(zone, 2, "0"))).otherwise("EPSG:4326")
    crs = sets.select("stem", named_crs.alias("crs"))

    rows = sets.select("stem", "shp", "dbf").mapInPandas(parse, "stem string, members map<string,string>, part int, ring array<struct<x: double, y: double>>")
    return rows.join(crs, "stem").select(_by_alias(F.col("members"), SURVEY_NAMES).alias("survey"), _by_alias(F.col("members"), VILLAGE_NAMES).alias("village"), "part", "ring", "crs")
