"""From model grids to points: fields at points with elevation-corrected temperatures, and one member's windows.

A grid is rows (i, j, step, fields) on whole numbers of grid spacings, terrain rows (i, j, orog); points are
(point, y, x, elevation) in the same spacings. Everything is an equi-join on cells.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import weather as W
from gridloom.operators import interpolate

LAPSE, RELIEF, SLOPES = -0.0065, 150.0, (-0.0098, 0.004)
TEMPERATURES = ("t2m", "tmax", "tmin", "tmax3", "tmin3")


def corners(points: DataFrame) -> DataFrame:
    """(point, i, j, w): the four cells around each point with their weights."""
    i, j = F.floor("y"), F.floor("x")
    a, b = F.col("y") - i, F.col("x") - j
    corner = lambda di, dj: F.struct((i + di).alias("i"), (j + dj).alias("j"), ((a if di else 1 - a) * (b if dj else 1 - b)).alias("w"))
    return points.select("point", F.explode(F.array(*[corner(p, q) for p in (0, 1) for q in (0, 1)])).alias("c")).select("point", "c.*").where("w > 0")


def at_points(grid: DataFrame, points: DataFrame, fields: list[str], by: list[str]) -> DataFrame:
    """Bilinear values of all fields in one join; a point outside of the grid, or with a missing corner, has nulls or no row."""
    c = corners(points)
    need = c.groupBy("point").agg(F.count("*").alias("_need"))
    g = c.join(grid, ["i", "j"]).groupBy("point", *by).agg(*[F.when(F.count(f) == F.count(F.lit(1)), F.sum(F.col("w") * F.col(f))).alias(f) for f in fields], F.count("*").alias("_n"))
    return g.join(need, "point").select("point", *by, *[F.when(F.col("_n") == F.col("_need"), F.col(f)).alias(f) for f in fields])


def uncovered(points: DataFrame, grid: DataFrame) -> DataFrame:
    """Points with a corner that the grid lacks; a caller that needs all of them checks that this is empty."""
    return corners(points).join(grid.select("i", "j").distinct(), ["i", "j"], "left_anti").select("point").distinct()


def point_values(grid: DataFrame, terrain: DataFrame, points: DataFrame, fields: list[str], lapse: str | float = "std", most: float = 10.0) -> DataFrame:
    """Each field at the points, temperatures corrected for elevation, and the correction.

    ``lapse``: "std" (-6.5 K/km), "local" (the model's own slope of t2m on terrain around each cell, the standard
    one where terrain is too flat), "none", or a number in K/m.
    """
    values = at_points(grid, points, fields, ["step"])
    height = at_points(terrain, points, ["orog"], [])
    v = values.join(height, "point", "left").join(points.select("point", "elevation"), "point")
    if lapse == "local":
        slopes = local_slopes(grid, terrain)
        v = v.join(at_points(slopes, points, ["slope"], ["step"]), ["point", "step"], "left")
    rate = F.lit(0.0) if lapse == "none" else F.col("slope") if lapse == "local" else F.lit(LAPSE if lapse == "std" else float(lapse))
    correction = W.elevation_correction(rate, F.col("elevation") - F.col("orog"), most)
    v = v.withColumn("elevation_correction", correction)
    return v.select("point", "step", *[(F.col(f) + F.col("elevation_correction") if f in TEMPERATURES else F.col(f)).alias(f) for f in fields], "elevation_correction", F.col("orog").alias("model_elevation"))


def local_slopes(grid: DataFrame, terrain: DataFrame, reach: int = 1) -> DataFrame:
    """(i, j, step, slope) of every cell; the standard lapse where the fit is unknown."""
    around = F.explode(F.sequence(F.lit(-reach), F.lit(reach)))
    lit = grid.select("i", "j", "step", "t2m").join(terrain, ["i", "j"])
    spread = lit.withColumn("di", around).withColumn("dj", around).select((F.col("i") + F.col("di")).alias("i"), (F.col("j") + F.col("dj")).alias("j"), "step", "t2m", "orog")
    fitted = spread.join(terrain.select("i", "j"), ["i", "j"]).groupBy("i", "j", "step").agg(F.regr_slope("t2m", "orog").alias("s"), (F.max("orog") - F.min("orog")).alias("relief"))
    return fitted.select("i", "j", "step", F.coalesce(F.when(F.col("relief") >= RELIEF, W.clip(F.col("s"), *SLOPES)), F.lit(LAPSE)).alias("slope"))


def downscale(grid: DataFrame, terrain: DataFrame, points: DataFrame, factors: DataFrame | None = None, lapse: float = LAPSE, most: float = 10.0) -> DataFrame:
    """A model grid as a point series: corrected temperatures, wind and its direction, increments of rain and snow.

    ``grid``: i, j, step, t2m, u10, v10, tp (since the start) and perhaps tmax3, tmin3, gust, tcc, snow; ``factors``:
    point, wind_factor, precip_factor, 1 where unknown. A cloud cover outside of 0..1 raises.
    """
    fields = [f for f in ("t2m", "tmax3", "tmin3", "u10", "v10", "gust", "tp", "tcc", "snow") if f in grid.columns]
    v = point_values(grid, terrain, points, fields, lapse, most)
    v = v.join(factors, "point", "left") if factors is not None else v.withColumn("wind_factor", F.lit(1.0)).withColumn("precip_factor", F.lit(1.0))
    blow, wet = F.coalesce("wind_factor", F.lit(1.0)), F.coalesce("precip_factor", F.lit(1.0))
    order = Window.partitionBy("point").orderBy("step")  # the steps of one run
    grown = lambda c: F.greatest(c - F.coalesce(F.lag(c).over(order), F.lit(0.0)), F.lit(0.0))
    cloud = F.col("tcc") if "tcc" in fields else F.lit(0.0)
    checked = F.when((cloud > 1 + 1e-6) | (cloud < -1e-6), F.raise_error(F.lit("cloud cover must be a fraction"))).otherwise(cloud)
    total, snow = F.col("tp") * wet, F.col("snow") if "snow" in fields else F.lit(0.0)
    return v.select(
        "point", "step", "t2m", *[c for c in ("tmax3", "tmin3") if c in fields], (W.wind_speed(F.col("u10"), F.col("v10")) * blow).alias("wind_speed"), W.wind_direction(F.col("u10"), F.col("v10")).alias("wind_dir"),
        (F.col("u10") * blow).alias("u10"), (F.col("v10") * blow).alias("v10"), *[(F.col("gust") * blow).alias("gust") for _ in [0] if "gust" in fields],
        F.when(total.isNotNull(), grown(total)).alias("precip"), total.alias("precip_accum"), F.when(snow.isNotNull(), grown(snow)).alias("snow"), checked.alias("cloud"), "elevation_correction", "model_elevation",
    )


def on_steps(values: DataFrame, steps: DataFrame, fields: list[str]) -> DataFrame:
    """``values`` (point, step, fields) linear in time at ``steps`` (step); unknown outside of the known steps."""
    asked = values.select("point").distinct().crossJoin(F.broadcast(steps.select("step").distinct()))  # a run has at most some hundred steps
    every = values.select("point", "step", *fields).join(asked.withColumn("_asked", F.lit(True)), ["point", "step"], "full")
    return reduce(lambda df, f: interpolate.between_nodes(df, "step", f, ["point"]), fields, every).where("_asked").drop("_asked")


def member_dataset(day: DataFrame, night: DataFrame, steps: DataFrame, offset: int = 0, cadence: int = 3, gap: int = 3) -> DataFrame:
    """One member on the common grid of 3-hour windows.

    ``day`` and ``night``: point values with the standard and the local lapse (point, step, t2m, tp, u10, v10 and perhaps
    tmax, tmin, snow, gust, tcc); ``steps``: step and is_day; the run began ``offset`` hours earlier. Coarser members are
    interpolated in time and their rain split evenly; their extremes are those of the window's ends.
    """
    have = [f for f in ("tmax", "tmin") if f in day.columns and cadence <= gap]
    temps, others = ["t2m", *have], [f for f in ("tp", "snow", "u10", "v10", "gust", "tcc") if f in day.columns]
    hours = steps.select((F.col("step") + offset).alias("step"))
    hours = hours.union(hours.select(F.col("step") - gap)).distinct()
    zero = [F.lit(0.0).alias(f) if f in ("tp", "snow") else F.lit(None).cast("double").alias(f) for f in [*temps, *others]]
    start = day.select("point").distinct().select("point", F.lit(0).alias("step"), *zero)  # nothing has fallen at the start
    std = on_steps(day.where("step > 0").select("point", "step", *temps, *others).unionByName(start), hours, [*temps, *others])
    loc = on_steps(night.where("step > 0").select("point", "step", *temps), hours, temps).select("point", "step", *[F.col(t).alias(f"n_{t}") for t in temps])
    j = std.join(loc, ["point", "step"], "left")
    before = j.select("point", (F.col("step") + gap).alias("step"), *[F.col(c).alias(f"b_{c}") for c in ("t2m", "n_t2m", *[f for f in ("tp", "snow") if f in others])])
    w = j.join(before, ["point", "step"]).join(F.broadcast(steps.select((F.col("step") + offset).alias("step"), "is_day")), "step")
    pick = lambda c: F.when(F.col("is_day"), F.col(c)).otherwise(F.col(f"n_{c}"))
    t, earlier = pick("t2m"), F.when(F.col("is_day"), F.col("b_t2m")).otherwise(F.col("b_n_t2m"))
    hi, lo = (pick("tmax"), pick("tmin")) if len(have) == 2 else (earlier, earlier)
    grown = lambda c: F.when(F.col(c).isNotNull() & F.col(f"b_{c}").isNotNull(), F.greatest(F.col(c) - F.col(f"b_{c}"), F.lit(0.0)))
    return w.select(
        "point", (F.col("step") - offset).alias("step"), t.alias("t2m"), F.greatest(hi, t).alias("tmax3"), F.least(lo, t).alias("tmin3"), grown("tp").alias("precip"),
        *[grown("snow").alias("snow") for _ in [0] if "snow" in others], "u10", "v10", *[F.col("gust") for _ in [0] if "gust" in others], *[W.clip(F.col("tcc"), 0.0, 1.0).alias("cloud") for _ in [0] if "tcc" in others],
    )


def period_rows(grid: DataFrame, terrain: DataFrame, points: DataFrame, windows: DataFrame, periods: DataFrame, lapse: str | float = "std") -> DataFrame:
    """A run's values at points in each period (as ``observations.period_values``); periods of which nothing is known have no row.

    ``grid``: i, j, step, tmax, tmin, t2m, tp, u10, v10; ``windows``: step, window_start; ``periods``: start_h, end_h, kind.
    """
    from gridloom.operators import observations

    values = point_values(grid, terrain, points, ["tmax", "tmin", "t2m", "tp", "u10", "v10"], lapse)
    p = observations.period_values(values.join(windows, "step"), periods, ["point"])
    return p.where("f_t IS NOT NULL OR f_p IS NOT NULL OR f_w IS NOT NULL")


def model_rows(grid: DataFrame, terrain: DataFrame, points: DataFrame, windows: DataFrame, periods: DataFrame) -> DataFrame:
    """point, start_h, end_h, kind, t, t_std, p and w: temperatures by the standard lapse by day, by the model's own at night."""
    keys = ["point", "start_h", "end_h", "kind"]
    std = period_rows(grid, terrain, points, windows, periods).select(*keys, F.col("f_t").alias("t_std"), F.col("f_p").alias("p"), F.col("f_w").alias("w"))
    local = period_rows(grid, terrain, points, windows, periods, "local").select(*keys, F.col("f_t").alias("_local"))
    both = std.join(local, keys, "left")
    return both.select(*keys, F.when(F.col("kind") == "day", F.col("t_std")).otherwise(F.col("_local")).alias("t"), "t_std", "p", "w")
