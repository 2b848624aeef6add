"""Least-squares fits as aggregates: transforms between point sets, principal axes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def transform_fit(pairs: DataFrame, key: str, scaled: bool = True, weight: str | None = None) -> DataFrame:
    """The transform that takes (x, y) to (tx, ty) best, for each key: n, angle, scale, shift_x, shift_y, rms.

    Sums about a first point of each key keep the digits of large coordinates; one aggregate gives the mean, a second the fit.
    With fewer than two pairs, or all points in one place, scale is 0 and angle, shift and rms are null. ``scaled``:
    whether the scale is fitted or 1. Pairs with a null count nothing.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    sound = pairs.where("x IS NOT NULL AND y IS NOT NULL AND tx IS NOT NULL AND ty IS NOT NULL").withColumn("w", w)
    centre = sound.groupBy(key).agg(*[(F.sum(F.col("w") * F.col(c)) / F.sum("w")).alias(f"m{c}") for c in ("x", "y", "tx", "ty")], F.count("*").alias("n"))
    d = sound.join(centre, key).select(key, "n", "w", "mx", "my", "mtx", "mty", *[(F.col(c) - F.col(f"m{c}")).alias(f"d{c}") for c in ("x", "y", "tx", "ty")])
    s = lambda e: F.sum(F.col("w") * e)
    dx, dy, ex, ey = (F.col(c) for c in ("dx", "dy", "dtx", "dty"))
    sums = d.groupBy(key).agg(F.first("n").alias("n"), *[F.first(c).alias(c) for c in ("mx", "my", "mtx", "mty")], s(dx * ex + dy * ey).alias("c"), s(dx * ey - dy * ex).alias("s"), s(dx * dx + dy * dy).alias("v"), s(ex * ex + ey * ey).alias("u"), F.sum("w").alias("w"))
    good = (F.col("n") >= 2) & (F.col("v") > 1e-9)
    angle = F.atan2("s", "c")
    scale = F.hypot("c", "s") / F.col("v") if scaled else F.lit(1.0)
    out = sums.where(good).withColumns({"angle": angle, "scale": scale})
    turned_x = F.col("scale") * (F.cos("angle") * F.col("mx") - F.sin("angle") * F.col("my"))
    turned_y = F.col("scale") * (F.sin("angle") * F.col("mx") + F.cos("angle") * F.col("my"))
    rest = F.greatest(F.lit(0.0), F.col("u") + F.col("scale") * F.col("scale") * F.col("v") - 2 * F.col("scale") * F.hypot("c", "s"))
    fitted = out.select(key, "n", "angle", "scale", (F.col("mtx") - turned_x).alias("shift_x"), (F.col("mty") - turned_y).alias("shift_y"), F.sqrt(rest / F.col("w")).alias("rms"))
    empty = sums.where(~good).select(key, "n", *[F.lit(None).cast("double").alias(c) for c in ("angle",)], F.lit(0.0).alias("scale"), *[F.lit(None).cast("double").alias(c) for c in ("shift_x", "shift_y", "rms")])
    return fitted.unionByName(empty)


def principal_axis(points: DataFrame, key: str) -> DataFrame:
    """Centre, principal direction (radians, modulo pi) and aspect of the points (x, y) of each key.

    The aspect is the ratio of the spreads along and across the axis, null where all points lie on one line.
    """
    c = points.groupBy(key).agg(F.count("*").alias("n"), F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"), F.covar_pop("x", "y").alias("cv"))
    half, root = (F.col("vx") + F.col("vy")) / 2, F.sqrt(F.pow((F.col("vx") - F.col("vy")) / 2, F.lit(2.0)) + F.pow("cv", F.lit(2.0)))
    return c.select(key, "n", "cx", "cy", (0.5 * F.atan2(2 * F.col("cv"), F.col("vx") - F.col("vy"))).alias("axis"), F.when(half - root > 1e-9, F.sqrt((half + root) / (half - root))).alias("aspect"))
