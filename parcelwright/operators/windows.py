"""Operators over ordered rows: windows of a chain, edges of rings, sessions by gaps, trimmed means, valleys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sliding(df: DataFrame, key: str, order: list[str], value: str, size: int) -> DataFrame:
    """All consecutive windows of ``size`` values of each key: key, start (from 0), window."""
    w = Window.partitionBy(key).orderBy(*order)
    out = df.select(key, (F.row_number().over(w) - 1).alias("start"), F.collect_list(value).over(w.rowsBetween(0, size - 1)).alias("window"))
    return out.where(F.size("window") == size)


def ring_edges(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The edges of rings given as rows (key, order, x, y): at, x, y, next_x, next_y, the last one back to the first."""
    w = Window.partitionBy(key).orderBy(*order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.select(key, (F.row_number().over(w) - 1).alias("at"), "x", "y", F.coalesce(F.lead("x").over(w), F.first("x").over(whole)).alias("next_x"), F.coalesce(F.lead("y").over(w), F.first("y").over(whole)).alias("next_y"))


def sessions(df: DataFrame, key: list[str], order: Column, gap: Column) -> DataFrame:
    """Adds session: it rises by one where ``order`` moves by more than ``gap`` within a key."""
    w = Window.partitionBy(*key).orderBy(order)
    step = order - F.lag(order).over(w)
    return df.withColumn("_new", F.coalesce(step > gap, F.lit(False)).cast("int")).withColumn("session", F.sum("_new").over(w)).drop("_new")


def trimmed_mean(df: DataFrame, key: str, value: str, keep: float = 0.8, least: int = 3) -> DataFrame:
    """Mean of the smallest values of each key: a share of ``keep`` of them (rounded half to even), at least ``least``."""
    w = Window.partitionBy(key)
    ranked = df.where(F.col(value).isNotNull()).withColumns({"_r": F.row_number().over(w.orderBy(value)), "_n": F.count("*").over(w)})
    most = F.greatest(F.lit(least), F.bround(F.col("_n") * keep).cast("int"))
    return ranked.where(F.col("_r") <= most).groupBy(key).agg(F.avg(value).alias("trimmed_mean"), F.count("*").alias("kept"))


def valley(df: DataFrame, key: list[str], value: str, low: float, high: float, least_gap: float, margin: float) -> DataFrame:
    """The lowest gap between neighbouring values of each key: key, threshold (its middle), gap.

    The gap is at least ``least_gap`` wide, its middle lies in [low, high], and the value below it is at most
    ``low`` + ``margin``. Keys without such a gap have no row.
    """
    w = Window.partitionBy(*key).orderBy(value)
    steps = df.where(F.col(value).isNotNull()).select(*key, F.col(value).alias("_a"), F.lead(value).over(w).alias("_b"))
    middle, width = (F.col("_a") + F.col("_b")) / 2, F.col("_b") - F.col("_a")
    found = steps.where((width >= least_gap) & middle.between(low, high) & (F.col("_a") <= low + margin))
    return found.groupBy(*key).agg(F.min(F.struct(middle.alias("threshold"), width.alias("gap"))).alias("v")).select(*key, "v.threshold", "v.gap")


def latest(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in ``order``: the current state of an append-only log."""
    rest = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def page(df: DataFrame, order: list[Column], size: int, number: int = 0) -> DataFrame:
    """A page of a sorted result."""
    return df.orderBy(*order).offset(size * number).limit(size)
