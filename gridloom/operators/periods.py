"""Daily and period aggregates of point series with their completeness rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import times
from gridloom.functions import weather as W


def three_hourly(events: DataFrame) -> DataFrame:
    """The events of each user as a 3-hourly point series; ``step`` counts hours from 2024-01-01."""
    start = times.floor_hours(F.col("ts"), 3)
    kind = F.col("event_type")
    s = events.groupBy(F.col("user_id").alias("point"), start.alias("start")).agg(
        F.max("value").alias("tmax3"), F.min("value").alias("tmin3"), F.count("*").alias("n"), F.round(F.sum("value") / 25, 3).alias("precip"),
        F.max(F.when(kind == "view", F.col("value"))).alias("u10"), F.max(F.when(kind == "click", F.col("value"))).alias("v10"),
    )
    hours = (F.unix_timestamp(F.col("start").cast("timestamp")) - 1704067200) / 3600
    return s.withColumn("valid", F.col("start") + F.make_dt_interval(F.lit(0), F.lit(3))).withColumn("step", (hours + 3).cast("int"))


def given(df: DataFrame, name: str, otherwise: Column) -> Column:
    """A column that a series may lack."""
    return F.col(name) if name in df.columns else otherwise


def direction_of_mean(u: str, v: str) -> Column:
    """Direction of the mean vector; unknown if any of the winds is."""
    whole = (F.count(u) == F.count(F.lit(1))) & (F.count(v) == F.count(F.lit(1)))
    return F.when(whole, W.wind_direction(F.avg(u), F.avg(v)))


def to_daily(series: DataFrame, tz: int = 8, gap: int = 3) -> DataFrame:
    """Per point and local day of the window's end the measures that are known, skipping nulls, and the hours covered.

    ``series``: point, valid, t2m, u10, v10, precip and perhaps tmax3, tmin3, snow, cloud, gust; extremes fall back to
    t2m, gusts to the sampled wind, totals of nothing are 0, and the maximum is never below the minimum.
    """
    none = F.lit(0.0)
    s = series.withColumn("_speed", W.wind_speed(F.col("u10"), F.col("v10"))).withColumn("_hi", given(series, "tmax3", given(series, "t2m", F.lit(None).cast("double")))).withColumn("_lo", given(series, "tmin3", given(series, "t2m", F.lit(None).cast("double"))))
    s = s.withColumn("_snow", given(series, "snow", none)).withColumn("_cloud", given(series, "cloud", none)).withColumn("_gust", given(series, "gust", F.col("_speed")))
    d = s.groupBy("point", times.day_of(F.col("valid"), tz).alias("day")).agg(
        F.max("_hi").alias("_max"), F.min("_lo").alias("tmin"), F.avg("t2m").alias("tavg"), F.coalesce(F.sum("precip"), none).alias("precip"), F.coalesce(F.sum("_snow"), none).alias("snow"), F.avg("_cloud").alias("cloud"),
        F.avg("_speed").alias("wind_speed"), F.min("_speed").alias("wind_speed_min"), F.max("_speed").alias("wind_speed_max"), F.max("_gust").alias("wind_gust"), direction_of_mean("u10", "v10").alias("wind_dir"), (F.count("*") * gap).alias("hours"),
    )
    return d.withColumn("tmax", F.when(F.col("_max").isNotNull() & F.col("tmin").isNotNull(), F.greatest("_max", "tmin"))).drop("_max")


def half_days(series: DataFrame, tz: int = 8) -> DataFrame:
    """Rain, snow and cloud of the day and the night of each local day that ``to_daily`` has; a half without windows is unknown.

    ``series``: point, start, valid, precip, snow, cloud. A window counts by its start; hours before 08 belong to the night before.
    """
    kind, date = times.half_of(F.col("start"), tz)
    at = lambda half, c: F.when(F.col("_kind") == half, F.col(c))
    amounts = [F.when(F.count(at(half, "start")) > 0, F.coalesce(F.sum(at(half, c)), F.lit(0.0))).alias(f"{half}_{c}") for half in ("day", "night") for c in ("precip", "snow")]
    halves = series.withColumn("_kind", kind).groupBy("point", date.alias("day")).agg(*amounts, *[F.avg(at(half, "cloud")).alias(f"{half}_cloud") for half in ("day", "night")])
    days = series.select("point", times.day_of(F.col("valid"), tz).alias("day")).distinct()
    return days.join(halves, ["point", "day"], "left")


def period_measures(series: DataFrame, by: list[str], windows: int = 4) -> DataFrame:
    """The twelve measures of a period from its 3-hour windows; unknown unless all windows are there and have the measure."""
    s = series.withColumn("_speed", W.wind_speed(F.col("u10"), F.col("v10"))).withColumn("_hi", given(series, "tmax3", given(series, "t2m", F.lit(None).cast("double")))).withColumn("_lo", given(series, "tmin3", given(series, "t2m", F.lit(None).cast("double"))))
    s = s.withColumn("_snow", given(series, "snow", F.lit(0.0))).withColumn("_cloud", given(series, "cloud", F.lit(0.0))).withColumn("_gust", given(series, "gust", F.col("_speed")))
    s = s.withColumn("_t", given(series, "t2m", F.lit(None).cast("double")))
    full = F.count(F.lit(1)) == windows
    whole = lambda c, agg, name: F.when(full & (F.count(c) == windows), agg(c)).alias(name)
    g = s.groupBy(*by).agg(
        whole("_hi", F.max, "_max"), whole("_lo", F.min, "tmin"), whole("_t", F.avg, "tmean"), whole("precip", F.sum, "precip"), whole("precip", F.max, "precip_3h_max"), whole("_snow", F.sum, "snow"), whole("_cloud", F.avg, "cloud"),
        whole("_speed", F.min, "wind_speed_min"), whole("_speed", F.max, "wind_speed_max"), whole("_speed", F.avg, "wind_speed"), whole("_gust", F.max, "gust"), F.when(full, direction_of_mean("u10", "v10")).alias("wind_dir"),
        F.sort_array(F.collect_list(F.when(F.col("precip") >= 0.1, F.col("start")))).alias("wet"),
    )
    return g.withColumn("tmax", F.when(F.col("_max").isNotNull() & F.col("tmin").isNotNull(), F.greatest("_max", "tmin"))).drop("_max")


def by_period(series: DataFrame, windows: int = 4, tz: int = 8) -> DataFrame:
    """Per point and 12-hour period: measures are known only where all windows are."""
    kind, date = times.half_of(F.col("start"), tz)
    whole = lambda c, agg: F.when(F.count(c) == windows, agg(c))
    return series.groupBy("point", date.alias("day"), kind.alias("kind")).agg(whole("tmax3", F.max).alias("tmax"), whole("tmin3", F.min).alias("tmin"), F.round(whole("precip", F.sum), 3).alias("precip"), F.count("*").alias("windows"))


def majority(df: DataFrame, keys: list[str], value: str, seq: Column) -> DataFrame:
    """Most common non-empty value; of several, the one that came first."""
    counted = df.where(F.col(value).isNotNull() & (F.col(value) != "")).groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(seq).alias("first"))
    return counted.groupBy(*keys).agg(F.max_by(value, F.struct("n", -F.col("first"))).alias(value))


def covers(windows: DataFrame, keys: list[str]) -> DataFrame:
    """Whether intervals (start_h, end_h) cover (from_h, to_h) of their key without a gap; overlaps are fine."""
    w = Window.partitionBy(*keys).orderBy("start_h", "end_h").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max("end_h").over(w), F.col("from_h"))
    marked = windows.withColumn("_ok", F.col("start_h") <= reach)
    return marked.groupBy(*keys).agg((F.bool_and("_ok") & (F.max("end_h") >= F.max("to_h"))).alias("covered"))
