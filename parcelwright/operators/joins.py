"""Joins on distance, overlap, ranges and priority, all of them equi-joins on cells with an exact condition behind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STEPS = (-1, 0, 1)


def cell(c: Column, side: float | Column) -> Column:
    return F.floor(c / side)


def around(df: DataFrame, *cells: str) -> DataFrame:
    """Each row once for every neighbouring cell (3 to the power of the number of ``cells``)."""
    for name in cells:
        df = df.withColumn("_step", F.explode(F.array(*[F.lit(i) for i in STEPS]))).withColumn(name, F.col(name) + F.col("_step")).drop("_step")
    return df


def merged(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join by sorting. Spark's estimates leave out the rows that an explode makes, so it would broadcast what doesn't fit the driver."""
    return left.join(right.hint("merge"), on, how)


def along_cells(df: DataFrame, x1: str, y1: str, x2: str, y2: str, pad: float, side: float | Column) -> DataFrame:
    """Each segment once for every cell (_u, _v) of ``side`` that holds a place within ``pad`` of it (and few others): column by column only the rows that it crosses."""
    low, high = F.least(x1, x2), F.greatest(x1, x2)
    step, run = F.col(x2) - F.col(x1), F.col(y2) - F.col(y1)
    columns = df.withColumn("_u", F.explode(F.sequence(cell(low - pad, side), cell(high + pad, side))))
    at = lambda x: F.when(step == 0, 0.0).otherwise((F.least(high, F.greatest(low, x)) - F.col(x1)) / step)
    p = F.col(y1) + run * at(F.col("_u") * side - pad)
    q = F.col(y1) + run * F.when(step == 0, 1.0).otherwise(at((F.col("_u") + 1) * side + pad))
    return columns.withColumn("_v", F.explode(F.sequence(cell(F.least(p, q) - pad, side), cell(F.greatest(p, q) + pad, side))))


def within(left: DataFrame, right: DataFrame, distance: float, on: list[str] | None = None) -> DataFrame:
    """Pairs of ``left`` (lid, lx, ly) and ``right`` (rid, rx, ry) at most ``distance`` apart, with their gap.

    Both sides agree on the columns ``on``, if there are any. Points without coordinates meet nothing. The right side goes to nine cells, the left to one.
    """
    a = left.where("lx IS NOT NULL AND ly IS NOT NULL").withColumns({"_u": cell(F.col("lx"), distance), "_v": cell(F.col("ly"), distance)})
    b = around(right.where("rx IS NOT NULL AND ry IS NOT NULL").withColumns({"_u": cell(F.col("rx"), distance), "_v": cell(F.col("ry"), distance)}), "_u", "_v")
    return merged(a, b, ["_u", "_v", *(on or [])]).drop("_u", "_v").withColumn("gap", F.hypot(F.col("lx") - F.col("rx"), F.col("ly") - F.col("ry"))).where(F.col("gap") <= distance)


def nearest(left: DataFrame, right: DataFrame, distance: float, k: int = 1, on: list[str] | None = None) -> DataFrame:
    """The ``k`` nearest rows of ``right`` within ``distance`` of each left point (lid, rid, gap, place); ties go to the smaller rid."""
    met = within(left, right, distance, on)
    if k == 1:
        best = met.groupBy("lid").agg(F.min(F.struct("gap", "rid")).alias("b"))
        return best.select("lid", "b.rid", "b.gap", F.lit(1).alias("place"))
    ranked = met.withColumn("place", F.row_number().over(Window.partitionBy("lid").orderBy("gap", "rid")))
    return ranked.where(F.col("place") <= k).select("lid", "rid", "gap", "place")


def none_within(left: DataFrame, right: DataFrame, distance: float) -> DataFrame:
    """The left rows with no right point within ``distance``."""
    return left.join(within(left, right, distance).select("lid").distinct(), "lid", "left_anti")


def band(left: DataFrame, right: DataFrame, lkey: str, rkey: str, width: float, on: list[str] | None = None) -> DataFrame:
    """Pairs whose keys differ by at most ``width`` (and agree on the columns ``on``)."""
    a = left.where(F.col(lkey).isNotNull()).withColumn("_b", cell(F.col(lkey), width))
    b = around(right.where(F.col(rkey).isNotNull()).withColumn("_b", cell(F.col(rkey), width)), "_b")
    return a.join(b, ["_b", *(on or [])]).drop("_b").where(F.abs(F.col(lkey) - F.col(rkey)) <= width)


def boxes_meeting(left: DataFrame, right: DataFrame, side: float) -> DataFrame:
    """Pairs of boxes ``left`` (lid, lx0, ly0, lx1, ly1) and ``right`` (rid, rx0, ...) that meet, each once.

    A box goes to every cell of ``side`` that it touches; a pair is kept in the cell of the lower left corner of its
    common part, so no distinct is needed. ``side`` should be about the size of a box.
    """

    def spread(df: DataFrame, p: str) -> DataFrame:
        us = F.sequence(cell(F.col(f"{p}x0"), side), cell(F.col(f"{p}x1"), side))
        vs = F.sequence(cell(F.col(f"{p}y0"), side), cell(F.col(f"{p}y1"), side))
        sound = df.where((F.col(f"{p}x0") <= F.col(f"{p}x1")) & (F.col(f"{p}y0") <= F.col(f"{p}y1")))
        return sound.withColumn("_u", F.explode(us)).withColumn("_v", F.explode(vs))

    met = merged(spread(left, "l"), spread(right, "r"), ["_u", "_v"])
    low_x, low_y = F.greatest("lx0", "rx0"), F.greatest("ly0", "ry0")
    meets = (low_x <= F.least("lx1", "rx1")) & (low_y <= F.least("ly1", "ry1"))
    return met.where(meets & (cell(low_x, side) == F.col("_u")) & (cell(low_y, side) == F.col("_v"))).drop("_u", "_v")


def first_of(primary: DataFrame, secondary: DataFrame, key: str, value: str) -> DataFrame:
    """One value for each key of either side, the primary's where it has one."""
    a, b = primary.select(key, F.col(value).alias("_a")), secondary.select(key, F.col(value).alias("_b"))
    return a.join(b, key, "full").select(key, F.coalesce("_a", "_b").alias(value), F.when(F.col("_a").isNotNull(), "primary").otherwise("secondary").alias("origin"))


def keep_first(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the first in ``order``. Rows collapse in partial aggregates, so a hot key stays one row per task."""
    rest = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest])
