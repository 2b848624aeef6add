"""Points near other points, and regions that contain points, over any number of points.

Space is partitioned by k-d splits fitted on a bounded sample. Every point goes to its home cell and, as a halo
copy, to each other cell within the radius; every region goes to the cells its box touches. One shuffle brings a
cell together; a local k-d tree answers the radius query and a plane sweep over the region edges the containment
query. Results stream out in chunks, so a cell's output is never held at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwright.functions.kdtree import KdSplits, chord_of, pairs_within, plane_vectors, points_in_rings, unit_vectors

EARTH_RADIUS = 6_371_008.8  # metres
SAMPLE_ROWS = 200_000  # bound of the sample that the splits are fitted on
CELL_ROWS = 16_384  # points a cell should hold

ROUTED = "grp string, cell int, kind byte, id long, home boolean, x double, y double, xs array<double>, ys array<double>"
FOUND = "kind string, key_a long, key_b long"


def crs_key(crs: Column, default: str = "EPSG:32643") -> Column:
    """One spelling of a CRS: upper case without blanks; null is ``default``."""
    return F.upper(F.regexp_replace(F.coalesce(crs, F.lit(default)), r"\s", ""))


def located(x: Column, y: Column) -> Column:
    """Whether a point has a position: both coordinates finite and not both zero."""
    return x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y) & (F.abs(x) < float("inf")) & (F.abs(y) < float("inf")) & ~((x == 0) & (y == 0))


def fit_splits(points: DataFrame, vectors, cell_rows: int = CELL_ROWS, sample_rows: int = SAMPLE_ROWS) -> KdSplits:
    """k-d splits for ``points(x, y)`` from a Bernoulli sample of about ``sample_rows`` rows at most."""
    rows = points.count()
    share = min(1.0, sample_rows / max(1, rows))
    sample = points.sample(share, seed=7).limit(2 * sample_rows).toPandas()
    return KdSplits.fit(vectors(sample["x"].to_numpy(), sample["y"].to_numpy()), min(-(-rows // cell_rows), max(1, sample_rows // 16)))


def _floats(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _take(values: np.ndarray, counts: np.ndarray, rows: np.ndarray) -> pa.Array:
    """The lists ``rows`` of the ragged array with these ``counts``."""
    begin = np.r_[0, np.cumsum(counts)]
    size = counts[rows]
    ends = np.cumsum(size)
    at = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - size - begin[rows], size)
    return pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(values[at]))


def _route_points(splits: KdSplits, vectors, chord: float):
    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            place = vectors(_floats(batch["x"]), _floats(batch["y"]))
            home = splits.home(place)
            row, cell = splits.reach(place - chord, place + chord)
            n = len(row)
            index = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch["grp"].take(index), pa.array(cell.astype(np.int32)), pa.array(np.zeros(n, np.int8)), batch["id"].take(index), pa.array(home[row] == cell), batch["x"].take(index), batch["y"].take(index), pa.nulls(n, pa.list_(pa.float64())), pa.nulls(n, pa.list_(pa.float64()))],
                names=["grp", "cell", "kind", "id", "home", "x", "y", "xs", "ys"],
            )

    return route


def _route_regions(splits: KdSplits):
    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            xs, ys = batch["xs"], batch["ys"]
            counts = xs.value_lengths().to_numpy()
            x, y = _floats(xs.flatten()), _floats(ys.flatten())
            begin = np.r_[0, np.cumsum(counts)][:-1]
            place = plane_vectors(x, y)
            row, cell = splits.reach(np.minimum.reduceat(place, begin), np.maximum.reduceat(place, begin))
            n, index = len(row), pa.array(row)
            nothing = pa.nulls(n, pa.float64())
            yield pa.RecordBatch.from_arrays(
                [batch["grp"].take(index), pa.array(cell.astype(np.int32)), pa.array(np.ones(n, np.int8)), batch["id"].take(index), pa.array(np.zeros(n, bool)), nothing, nothing, _take(x, counts, row), _take(y, counts, row)],
                names=["grp", "cell", "kind", "id", "home", "x", "y", "xs", "ys"],
            )

    return route


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The sorted rows of a partition, one cell at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        grp, cell = batch["grp"].dictionary_encode().indices.to_numpy(zero_copy_only=False), batch["cell"].to_numpy()
        cuts = np.flatnonzero((grp[1:] != grp[:-1]) | (cell[1:] != cell[:-1])) + 1
        for begin, end in zip([0, *cuts], [*cuts, batch.num_rows]):
            piece = batch.slice(begin, end - begin)
            if held and (held[-1]["cell"][0].as_py(), held[-1]["grp"][0].as_py()) != (piece["cell"][0].as_py(), piece["grp"][0].as_py()):
                yield pa.Table.from_batches(held)
                held = []
            held.append(piece)
    if held:
        yield pa.Table.from_batches(held)


def _answer(vectors, chord: float, near: bool, exact):
    schema = pa.schema([("kind", pa.string()), ("key_a", pa.int64()), ("key_b", pa.int64())])

    def found(kind: str, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([kind] * len(a), pa.string()), pa.array(a), pa.array(b)], schema=schema)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _cells(batches):
            kind = part["kind"].to_numpy()
            stones = part.filter(pa.array(kind == 0))
            ids, x, y, home = (stones[c].to_numpy() for c in ("id", "x", "y", "home"))
            if near:
                for i, j in pairs_within(vectors(x, y), chord):
                    i, j = np.where(ids[i] < ids[j], i, j), np.where(ids[i] < ids[j], j, i)
                    keep = home[i] & (ids[i] != ids[j])
                    if exact is not None:
                        keep &= exact(x[i], y[i], x[j], y[j])
                    if keep.any():
                        yield found("near", ids[i[keep]], ids[j[keep]])
            if (kind == 1).any():
                regions = part.filter(pa.array(kind == 1))
                xs, ys = regions["xs"].combine_chunks(), regions["ys"].combine_chunks()
                counts = xs.value_lengths().to_numpy()
                at_home = np.flatnonzero(home)
                owner = regions["id"].to_numpy()
                for p, r in points_in_rings(x[at_home], y[at_home], np.repeat(np.arange(len(counts)), counts), _floats(xs.flatten()), _floats(ys.flatten())):
                    yield found("inside", ids[at_home[p]], owner[r])

    return answer


def near_and_inside(points: DataFrame, regions: DataFrame | None = None, distance: float | None = None, metric: str = "plane", cell_rows: int = CELL_ROWS, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Pairs of points within ``distance``, and the regions that strictly contain a point.

    ``points``: id long, x double, y double, grp string (points meet only within a group, here a CRS).
    ``regions``: id long, ring array<struct<x, y>>, grp string; null for no containment query.
    ``distance``: null for no radius query. ``metric``: "plane" for straight-line distance of the coordinates as
    stored, or "sphere" for great-circle metres between longitudes (x) and latitudes (y) in degrees, which are
    then compared as unit vectors by their chord (containment is only defined for the plane).

    Result: kind ('near' with key_a < key_b, or 'inside' with the point and the region), key_a, key_b, each row
    once. Points with a null id, without a position (null, NaN, infinite or both zero) have no rows. Rows that
    repeat a point count once; one id at several positions is near what any of its positions is near, but never
    near itself. Null vertices are left out; a ring with fewer than three vertices, or with one that isn't finite,
    contains nothing; an open ring is closed; a point on an edge is outside; an empty table gives no rows. Other
    columns of the inputs are ignored.
    """
    if metric not in ("plane", "sphere"):
        raise ValueError(f"unknown metric {metric!r}")
    if metric == "sphere" and regions is not None:
        raise ValueError("regions are only defined in the plane")
    sphere = metric == "sphere"
    vectors = unit_vectors if sphere else plane_vectors
    chord = 0.0 if distance is None else chord_of(distance, EARTH_RADIUS) if sphere else float(distance)
    placed = points.select(F.col("id").cast("long").alias("id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.coalesce(F.col("grp").cast("string"), F.lit("")).alias("grp"))
    known = placed.where(located(F.col("x"), F.col("y")) & F.col("id").isNotNull())
    splits = fit_splits(known.select("x", "y"), vectors, cell_rows, sample_rows)
    routed = known.distinct().mapInArrow(_route_points(splits, vectors, chord), ROUTED)
    if regions is not None:
        ring = F.filter("ring", lambda p: p["x"].isNotNull() & p["y"].isNotNull())
        finite = ~F.exists("ring", lambda p: F.isnan(p["x"]) | F.isnan(p["y"]) | (F.abs(p["x"]) == float("inf")) | (F.abs(p["y"]) == float("inf")))
        drawn = (
            regions.select(F.col("id").cast("long").alias("id"), F.coalesce(F.col("grp").cast("string"), F.lit("")).alias("grp"), ring.alias("ring"))
            .where(F.col("id").isNotNull() & (F.size("ring") >= 3) & finite)
            .select("grp", "id", F.col("ring.x").cast("array<double>").alias("xs"), F.col("ring.y").cast("array<double>").alias("ys"))
        )
        routed = routed.unionByName(drawn.mapInArrow(_route_regions(splits), ROUTED))
    together = routed.repartition("grp", "cell").sortWithinPartitions("grp", "cell")
    return together.mapInArrow(_answer(vectors, chord * (1 + 1e-12) if sphere else chord, distance is not None, None), FOUND).distinct()


def near_stones(points: DataFrame, distance: float, metric: str = "plane") -> DataFrame:
    """Pairs (key_a < key_b) of ``points`` within ``distance``; see near_and_inside()."""
    return near_and_inside(points, None, distance, metric).select("key_a", "key_b")
