"""Writers: GeoJSON, corner points, reports, drawings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def features(df: DataFrame, properties: list[str], ring: str = "ring") -> DataFrame:
    """feature: one GeoJSON Feature for each row as text; an open ring is closed, a null ring gives a null geometry."""
    first, last = F.get(ring, F.lit(0)), F.element_at(F.col(ring), -1)
    closed = F.when((first["x"] == last["x"]) & (first["y"] == last["y"]), F.col(ring)).otherwise(F.concat(F.col(ring), F.slice(ring, 1, 1)))
    coordinates = F.array(F.transform(closed, lambda p: F.array(F.round(p["x"], 7), F.round(p["y"], 7))))
    geometry = F.when(F.size(ring) >= 3, F.struct(F.lit("Polygon").alias("type"), coordinates.alias("coordinates")))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), geometry.alias("geometry")), {"ignoreNullFields": "false"}).alias("feature"))


def write_geojson(df: DataFrame, path: str, properties: list[str], ring: str = "ring") -> None:
    """One Feature for each line (newline-delimited GeoJSON), in as many files as the table has partitions."""
    features(df, properties, ring).write.mode("overwrite").text(path)


def corner_rows(df: DataFrame, keys: list[str], ring: str = "ring") -> DataFrame:
    """A row for each corner: keys, corner, x and y with three decimals."""
    at = df.select(*keys, F.posexplode(ring).alias("corner", "p"))
    shown = lambda c: F.format_string("%.3f", c)
    return at.select(*keys, "corner", shown(F.col("p.x")).alias("x"), shown(F.col("p.y")).alias("y"))


def located_corners(df: DataFrame, keys: list[str], zone: Column, ring: str = "ring") -> DataFrame:
    """corner_rows() of rings in a northern UTM zone, with lon and lat of each corner at seven decimals."""
    from parcelwright.functions.plane import from_utm

    at = df.select(*keys, zone.alias("_zone"), F.posexplode(ring).alias("corner", "p"))
    place = from_utm(F.col("p.x"), F.col("p.y"), F.col("_zone"))
    shown = lambda form, c: F.format_string(form, c)
    return at.select(*keys, "corner", shown("%.3f", F.col("p.x")).alias("x"), shown("%.3f", F.col("p.y")).alias("y"), shown("%.7f", place["lon"]).alias("lon"), shown("%.7f", place["lat"]).alias("lat"))


def worklist(df: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """The rows with priority: their place, from 1, in the order of work of their group."""
    from pyspark.sql import Window

    return df.withColumn("priority", F.row_number().over(Window.partitionBy(group).orderBy(*order)))


def staged(df: DataFrame, group: str, order: list[Column], columns: int, step: float) -> DataFrame:
    """The rows with dx, dy: places in a grid of ``columns`` a row, ``step`` apart, where the group's unplaced plots are shown."""
    placed = worklist(df, group, order)
    at = F.col("priority") - 1
    return placed.withColumns({"dx": (at % columns) * step, "dy": -F.floor(at / columns) * step}).drop("priority")


def write_json(df: DataFrame, path: str) -> None:
    """One object for each line."""
    df.write.mode("overwrite").json(path)


def append_manifest(df: DataFrame, path: str) -> None:
    """Adds outcomes to a manifest, which is a table of Parquet files that only grows."""
    df.write.mode("append").parquet(path)


def drawing_edges(df: DataFrame) -> DataFrame:
    """line: as drawing_lines(), a LINE entity for each edge of a ring (layer, ring)."""
    from parcelwright.functions.plane import closed_pairs

    pair = lambda code, c: F.concat(F.lit(f"\n{code}\n"), F.format_string("%.6f", c))
    edge = df.where(F.size("ring") >= 2).select("layer", F.explode(closed_pairs(F.col("ring"))).alias("e"))
    return edge.select(F.concat(F.lit("0\nLINE\n8\n"), F.coalesce("layer", F.lit("0")), pair(10, F.col("e.x1")), pair(20, F.col("e.y1")), pair(11, F.col("e.x2")), pair(21, F.col("e.y2"))).alias("line"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def report(df: DataFrame, group: list[str], measures: dict[str, Column]) -> DataFrame:
    """Counts and measures of each group, with subtotals and the total (nulls in the group columns)."""
    return df.rollup(*group).agg(F.count("*").alias("records"), *[c.alias(n) for n, c in measures.items()])


def drawing_lines(df: DataFrame) -> DataFrame:
    """line: the group codes and values of a drawing's entities (layer, ring, text, x, y), each entity as one value of many lines."""
    head = lambda kind: F.concat(F.lit(f"0\n{kind}\n8\n"), F.coalesce("layer", F.lit("0")))
    pair = lambda code, c: F.concat(F.lit(f"\n{code}\n"), F.format_string("%.6f", c))
    vertices = F.array_join(F.transform("ring", lambda p: F.concat(pair(10, p["x"]), pair(20, p["y"]))), "")
    outline = F.when(F.size("ring") >= 2, F.concat(head("LWPOLYLINE"), F.lit("\n90\n"), F.size("ring").cast("string"), F.lit("\n70\n1"), vertices))
    label = F.when(F.col("text").isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull(), F.concat(head("TEXT"), pair(10, F.col("x")), pair(20, F.col("y")), F.lit("\n40\n1.0\n1\n"), F.col("text")))
    return df.select(F.explode(F.array_compact(F.array(outline, label))).alias("line"))


def write_dxf(df: DataFrame, path: str, edges: bool = False) -> None:
    """One drawing of all rows, outlines as closed polylines or, with ``edges``, as a line for each edge; a drawing is one file, so its rows go through one task as a stream."""
    spark = df.sparkSession
    begin, end = spark.createDataFrame([(0, "0\nSECTION\n2\nENTITIES")], "part int, line string"), spark.createDataFrame([(2, "0\nENDSEC\n0\nEOF")], "part int, line string")
    lines = drawing_lines(df.withColumn("ring", F.lit(None).cast(df.schema["ring"].dataType))).unionByName(drawing_edges(df)) if edges else drawing_lines(df)
    body = lines.select(F.lit(1).alias("part"), "line")
    begin.unionByName(body).unionByName(end).repartition(1).sortWithinPartitions("part").select("line").write.mode("overwrite").text(path)
