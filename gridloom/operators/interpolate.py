"""Interpolation from grids to points and between time nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bilinear(grid: DataFrame, points: DataFrame, value: str, by: list[str], size: float = 1.0) -> DataFrame:
    """Values of a regular grid (lat, lon on multiples of ``size``) at points (point, lat, lon).

    Each point becomes its four corners with weights, then an equi-join; null where a corner is missing.
    """
    i, j = F.floor(F.col("lat") / size), F.floor(F.col("lon") / size)
    a, b = F.col("lat") / size - i, F.col("lon") / size - j
    corner = lambda di, dj: F.struct((i + di).alias("i"), (j + dj).alias("j"), ((a if di else 1 - a) * (b if dj else 1 - b)).alias("w"))
    stencil = points.select("point", F.explode(F.array(*[corner(x, y) for x in (0, 1) for y in (0, 1)])).alias("c")).select("point", "c.*")
    cells = grid.withColumn("i", F.round(F.col("lat") / size).cast("long")).withColumn("j", F.round(F.col("lon") / size).cast("long")).drop("lat", "lon")
    joined = stencil.join(cells, ["i", "j"])
    return joined.groupBy("point", *by).agg(F.when(F.count(value) == 4, F.sum(F.col("w") * F.col(value))).alias(value))


def local_slope(grid: DataFrame, reach: int, value: str, height: str, relief: float, low: float, high: float) -> DataFrame:
    """Slope of a value on terrain in the square around each cell (i, j), clipped; null where the terrain is too flat."""
    step = F.sequence(F.lit(-reach), F.lit(reach))
    around = grid.select("i", "j", value, height).withColumn("di", F.explode(step)).withColumn("dj", F.explode(step)).select((F.col("i") + F.col("di")).alias("i"), (F.col("j") + F.col("dj")).alias("j"), value, height)
    fitted = around.join(grid.select("i", "j"), ["i", "j"]).groupBy("i", "j").agg(F.regr_slope(value, height).alias("slope"), (F.max(height) - F.min(height)).alias("relief"))
    return fitted.withColumn("slope", F.when(F.col("relief") >= relief, F.least(F.greatest("slope", F.lit(low)), F.lit(high))))


def between_nodes(series: DataFrame, at: str, value: str, keys: list[str]) -> DataFrame:
    """Null values filled linearly between the nearest known ones before and after; null outside of them."""
    order = Window.partitionBy(*keys).orderBy(at)
    before, after = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    node = F.when(F.col(value).isNotNull(), F.struct(F.col(at).alias("t"), F.col(value).alias("v")))
    held = series.withColumn("_a", F.last(node, True).over(before)).withColumn("_b", F.first(node, True).over(after))
    share = F.try_divide(F.col(at) - F.col("_a.t"), F.col("_b.t") - F.col("_a.t"))
    return held.withColumn(value, F.coalesce(F.col(value), F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * share)).drop("_a", "_b")


def disaggregate(windows: DataFrame, shape: DataFrame, hours: int, keys: list[str]) -> DataFrame:
    """Hourly amounts of window totals (keys, step, total) by the share of an hourly shape (keys, hour, shape); equal shares where it is dry."""
    hourly = windows.withColumn("hour", F.explode(F.sequence(F.col("step") - hours + 1, F.col("step")))).join(shape, [*keys, "hour"], "left")
    w = Window.partitionBy(*keys, "step")
    all_shape = F.sum(F.coalesce("shape", F.lit(0.0))).over(w)
    share = F.when(all_shape > 1e-6, F.coalesce("shape", F.lit(0.0)) / all_shape).otherwise(1.0 / hours)
    return hourly.withColumn("amount", F.col("total") * share)
