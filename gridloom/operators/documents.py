"""Products as documents: columnar series, hourly curves, whole products as JSON, texts and tables, and views of what is stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import times
from gridloom.functions import weather as W
from gridloom.operators import products

LOCAL = "yyyy-MM-dd'T'HH:00"


def finite(df: DataFrame) -> DataFrame:
    """NaN and infinite numbers as null, as documents hold none."""
    fix = lambda c, t: F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(F.col(c)).cast(t).alias(c)
    return df.select(*[fix(f"`{c}`", t).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes])


def columnar(rows: DataFrame, key: str, order: str, arrays: dict[str, Column]) -> DataFrame:
    """One row for each key with an array for each column, in order; a key's rows are the steps of one product."""
    packed = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), *[c.alias(n) for n, c in arrays.items()]))).alias("_s"))
    return packed.select(key, *[F.col("_s")[n].alias(n) for n in arrays])


def _measures(gap: int, places: dict[str, int], tz: int) -> dict[str, Column]:
    rain, snow, cloud = F.col("precip"), F.coalesce("snow", F.lit(0.0)), F.coalesce("cloud", F.lit(0.0))
    speed, direction = W.wind_speed(F.col("u10"), F.col("v10")), W.wind_direction(F.col("u10"), F.col("v10"))
    r = lambda c, name: F.bround(c, places[name])
    return {
        "lead_h": F.col("step"), "times": F.date_format(F.col("init") + F.make_dt_interval(F.lit(0), F.col("step") + tz), LOCAL),
        "weather": F.when(rain.isNotNull(), W.window_text(rain, snow, cloud, gap)).otherwise("—"), "temp": r(F.col("t2m"), "temp"), "precip": r(rain, "precip"), "snow": r(snow, "snow"), "cloud": F.bround(cloud * 100).cast("int"),
        "wind_dir": F.bround(direction).cast("int"), "wind_name": W.wind_name(direction), "wind_force": F.when(speed.isNotNull(), W.beaufort(speed)), "wind_speed": F.bround(speed, 1), "gust": F.bround("gust", 1), "pop": F.bround("pop").cast("int"),
    }


def series3h(series: DataFrame, issue: Column, hours: int = 72, gap: int = 3, tz: int = 8) -> DataFrame:
    """The public 3-hourly series of each point: windows that end after the issue, for ``hours``.

    ``series``: point, init, step, t2m, precip, snow, cloud, u10, v10, gust, pop. A window that is unknown has nulls and a dash.
    """
    lead = F.timestamp_diff("SECOND", F.col("init"), issue) / 3600.0
    kept = series.where((F.col("step") > lead) & (F.col("step") <= lead + hours))
    return columnar(kept, "point", "step", _measures(gap, {"temp": 1, "precip": 1, "snow": 1}, tz))


def hourly_document(hourly: DataFrame, tz: int = 8) -> DataFrame:
    """The hourly series of each point as arrays; columns as for ``series3h``."""
    return columnar(hourly, "point", "step", _measures(1, {"temp": 1, "precip": 2, "snow": 2}, tz))


def chance_across_cycles(buckets: DataFrame, hours: DataFrame, keys: list[str], width: int = 6, limit: float = 0.1) -> DataFrame:
    """Percent of wet members at each hour (keys, valid) from buckets of several cycles (keys, init, member, start_h, mm): the later bucket counts.

    Hours are matched on valid time; buckets start at multiples of ``width`` hours of their cycle.
    """
    wet = buckets.groupBy(*keys, "init", "start_h").agg((100.0 * F.avg((F.col("mm") >= limit).cast("double"))).alias("pop"))
    ending = F.col("init") + F.make_dt_interval(F.lit(0), F.col("start_h").cast("int"))
    each = wet.withColumn("_b", ending).withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(width)))).withColumn("valid", F.col("_b") + F.make_dt_interval(F.lit(0), F.col("h")))
    newest = each.groupBy(*keys, "valid").agg(F.max_by("pop", F.struct("init", "start_h")).alias("pop"))
    return hours.join(newest, [*keys, "valid"], "left")


def merged_shape(nodes: DataFrame, extra: DataFrame) -> DataFrame:
    """The shape's own steps and its further hours as one series; of a step in both the node counts."""
    both = [c for c in nodes.columns if c in extra.columns]
    new = extra.join(nodes.select("point", "step"), ["point", "step"], "left_anti")
    return nodes.select(*both).unionByName(new.select(*both))


def product(cells: DataFrame, points: DataFrame, issue: Column, tz: int = 8, by: tuple[str, ...] = (), extremes: DataFrame | None = None, series: DataFrame | None = None, alerts: DataFrame | None = None, texts: DataFrame | None = None) -> DataFrame:
    """A JSON document for each county: periods in order with label, county block and cells, the days that refer to them, the points, and what else is given.

    ``cells``: as ``products.cells`` by county, point, date and kind; ``points``: county, point, name, elevation.  ``extremes``
    (point, date, kind, tmax, tmin) take the place of the cells' own where they are known; the maximum is then never below
    the minimum.  ``series``: a row for each point (as ``series3h``); ``alerts``: as ``alerts.conclusions``; ``texts``: as
    ``bulletin``.  ``by`` names the columns that tell counties apart.  A document has at most eleven periods of one county's
    points, which is what a group gathers.
    """
    today = times.day_of(issue, tz)
    one = lambda df: df.withColumn("_all", F.lit(0))
    keys = [*by, "_all"]
    if extremes is not None:
        e = extremes.select(*by, "point", "date", "kind", F.col("tmax").alias("_x"), F.col("tmin").alias("_n"))
        over = cells.join(e, [*by, "point", "date", "kind"], "left").withColumn("tmin", F.coalesce("_n", "tmin")).withColumn("tmax", F.greatest(F.coalesce("_x", "tmax"), "tmin"))
        cells = over.withColumn("temp", F.when(F.col("kind") == "day", F.col("tmax")).otherwise(F.col("tmin"))).select(*cells.columns)
    cells = one(cells)
    at = [*keys, "date", "kind"]
    cols = [c for c in cells.columns if c not in at]
    block = products.county(cells, tuple(keys))
    word = cells.where("weather IS NOT NULL AND weather <> '—'").groupBy(*at, "weather").agg(F.count("*").alias("n"), F.min("point").alias("p"))
    word = word.groupBy(*at).agg(F.max_by("weather", F.struct("n", -F.col("p"))).alias("weather"))
    listed = cells.groupBy(*at).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("cells"))
    p = listed.join(block, at).join(word, at, "left").withColumn("label", products.period_label(F.col("date"), F.col("kind"), today)).withColumn("weekday", F.element_at(F.array(*map(F.lit, times.WEEKDAYS)), F.weekday("date") + 1))
    county = F.struct(F.coalesce("weather", F.lit("—")).alias("weather"), *[c for c in block.columns if c not in at])
    order = Window.partitionBy(*keys).orderBy("date", F.col("kind") != "day")  # a county's eleven rows
    p = p.withColumn("index", F.row_number().over(order) - 1).select(*keys, "index", "date", "kind", "label", "weekday", county.alias("_block"), "cells")
    periods = p.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("index", "date", "kind", "label", "weekday", F.col("_block").alias("county"), "cells"))).alias("periods"))
    place = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("index")))
    d = p.groupBy(*keys, "date", "weekday").agg(place("day").alias("day"), place("night").alias("night"))
    doc = periods.join(d.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("date", "weekday", "day", "night"))).alias("days")), keys)
    lists = {"townships": points.select(*by, "point", "name", "elevation"), "series3h": series, "conclusions": alerts, "text": texts}
    for name, rows in lists.items():
        if rows is not None:
            inner = F.struct(*[c for c in rows.columns if c not in by])
            doc = doc.join(one(rows).groupBy(*keys).agg(F.array_sort(F.collect_list(inner)).alias(name)), keys, "left")
    given = [name for name, rows in lists.items() if rows is not None]
    meta = F.struct(F.lit(2).alias("schema"), *by, F.size("periods").alias("n_periods"), F.coalesce(F.size("townships"), F.lit(0)).alias("n_townships"), issue.alias("issue_time"))
    return doc.select(*by, F.to_json(F.struct(meta.alias("meta"), "periods", "days", *[F.coalesce(F.col(n), F.array()).alias(n) for n in given])).alias("json"))


def bulletin_rows(cells: DataFrame, points: DataFrame) -> DataFrame:
    """The bulletin's line of each point and date, padded, points in order of falling elevation (``place``).

    Weather and wind of day and night as one text, both extremes, the rain of both.
    """
    at = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    have = ("weather", "tmin", "tmax", "wind_text", "wind_name", "force_text")
    d = cells.groupBy("point", "date").agg(*[at(k, c).alias(f"{k}_{c}") for k in ("day", "night") for c in have], F.count_if(F.col("kind") == "day").alias("_d"), F.count_if(F.col("kind") == "night").alias("_n"), F.sum(F.coalesce("precip", F.lit(0.0))).alias("_mm"))
    both, day = (F.col("_d") > 0) & (F.col("_n") > 0), F.col("_d") > 0
    either = lambda c: F.when(day, F.col(f"day_{c}")).otherwise(F.col(f"night_{c}"))
    degrees = lambda c: F.coalesce(F.bround(c).cast("long").cast("string"), F.lit("—"))
    weather = F.when(both & (F.col("day_weather") != F.col("night_weather")), F.concat("day_weather", F.lit("转"), "night_weather")).otherwise(either("weather"))
    temp = F.when(both, F.concat(degrees("night_tmin"), F.lit("～"), degrees("day_tmax"))).when(day, degrees("day_tmax")).otherwise(degrees("night_tmin"))
    turn = F.when(F.col("day_wind_name") == F.col("night_wind_name"), F.col("night_force_text")).otherwise(F.col("night_wind_text"))
    wind = F.when(both & (F.col("day_wind_text") != F.col("night_wind_text")), F.concat("day_wind_text", F.lit("转"), turn)).otherwise(either("wind_text"))
    rain = F.when(F.col("_mm") >= 0.05, F.format_string("%.1f", F.col("_mm") + 1e-9)).otherwise("—")
    left = lambda text, width: products.padded(text, width)
    right = lambda text, width: F.concat(F.repeat(F.lit(" "), F.greatest(F.lit(width) - products.display_width(text), F.lit(0))), text)
    j = d.join(points.select("point", "name", "elevation"), "point")
    height = F.bround(F.coalesce("elevation", F.lit(0.0))).cast("long").cast("string")
    line = F.concat(left(F.col("name"), 12), right(height, 6), F.lit("  "), left(weather, 14), right(temp, 9), F.lit("  "), left(wind, 26), right(rain, 7))
    place = F.row_number().over(Window.partitionBy("date").orderBy(F.desc(F.coalesce("elevation", F.lit(0.0))), "point"))  # a county's points
    return j.select("point", "date", place.alias("place"), line.alias("line"))


def bulletin(rows: DataFrame) -> DataFrame:
    """One text for each date of a bulletin's rows, after its heading."""
    head = F.concat(F.lit("── "), F.month("date").cast("string"), F.lit("月"), F.day("date").cast("string"), F.lit("日 "))
    return rows.groupBy("date").agg(F.array_sort(F.collect_list(F.struct("place", "line"))).alias("l")).select("date", F.concat_ws("\n", head, F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("text"))


def township_table(daily: DataFrame, value: str, width: int = 8) -> DataFrame:
    """One text row for each point with a column for each day: the report's table of one measure."""
    cell = F.lpad(_number(F.col(value), 1, "nan"), width, " ")
    listed = daily.groupBy("point").agg(F.array_sort(F.collect_list(F.struct("day", cell.alias("c")))).alias("s"))
    return listed.select("point", F.array_join(F.transform("s", lambda x: x["c"]), "").alias("line"))


def wind_day_table(daily: DataFrame) -> DataFrame:
    """One text row for each point (name, elevation) with the mean direction and speed of each day; unknown ones are a dash and nan."""
    from gridloom.functions import weather as W

    direction = F.when(F.col("wind_dir").isNotNull(), W.wind_name(F.col("wind_dir"))).otherwise("—")
    cell = F.concat(_right(direction, 6), _right(_number(F.col("wind_speed"), 1, "nan"), 6))
    listed = daily.groupBy("point", "name", "elevation").agg(F.array_sort(F.collect_list(F.struct("day", cell.alias("c")))).alias("s"))  # a point's days
    height = F.lpad(F.format_string("%.0f", F.bround("elevation")), 6, " ")
    return listed.select("point", F.concat(F.rpad("name", 12, " "), height, F.lit("  "), F.array_join(F.transform("s", lambda x: x["c"]), "")).alias("line"))


def _number(value: Column, digits: int, unknown: str) -> Column:
    """A number with so many places; of a null, format_string would print a part of that word."""
    return F.when(value.isNotNull(), F.format_string(f"%.{digits}f", value + 1e-9)).otherwise(unknown)


def _right(text: Column, width: int) -> Column:
    """A text moved to the right of so many characters; a longer one stays whole."""
    return F.concat(F.repeat(F.lit(" "), F.greatest(F.lit(width) - F.char_length(text), F.lit(0))), text)


def score_cells(scores: DataFrame, leads: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """One text for each configuration: errors of maxima and minima, the share within two degrees and of right wet and dry periods, at some leads."""
    number = lambda c, width, digits: _right(_number(F.col(c), digits, "—"), width)
    text = F.concat(F.lit("Tx "), number("tmax_mae", 4, 2), F.lit("/"), number("tmax_within2", 3, 0), F.lit("% Tn "), number("tmin_mae", 4, 2), F.lit(" 晴雨"), number("rain_correct", 3, 0), F.lit("%"))
    cells = scores.where(F.col("lead").isin(*leads)).select("config", "lead", text.alias("c"))
    return cells.groupBy("config").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("lead", "c"))), lambda x: x["c"]), "  ").alias("text"))


def county_table(daily: DataFrame) -> DataFrame:
    """One text row for each day: extremes, rain and wind over the points, hours covered."""
    n = lambda c: F.format_string("%.1f", c + 1e-9)
    d = daily.groupBy("day").agg(F.min("tmin").alias("a"), F.max("tmax").alias("b"), F.avg("precip").alias("c"), F.max("precip").alias("d"), F.avg("wind_speed").alias("e"), F.max("wind_speed_max").alias("f"), F.max("hours").alias("h"))
    return d.select("day", F.concat(F.date_format("day", "MM-dd"), F.lit(" "), n(F.col("a")), F.lit("~"), n(F.col("b")), F.lit(" "), n(F.col("c")), F.lit(" / "), n(F.col("d")), F.lit(" "), n(F.col("e")), F.lit(" / "), n(F.col("f")), F.lit(" "), F.col("h").cast("string"), F.lit("h")).alias("line"))


# ---------------------------------------------------------------- views


def live_periods(periods: DataFrame, now: Column) -> DataFrame:
    """Periods (with ``end``) that have not ended yet."""
    return periods.where(F.col("end") > now)


def township(points: DataFrame, key: Column) -> DataFrame:
    """The first point whose id or name is the key."""
    return points.where((F.col("point").cast("string") == key) | (F.col("name") == key)).orderBy(F.col("point").cast("string") != key, "point").limit(1)


def first_hours(document: DataFrame, arrays: list[str], hours: int, gap: int = 3) -> DataFrame:
    """The first hours of columnar arrays."""
    return document.select(*[F.slice(c, 1, hours // gap).alias(c) if c in arrays else F.col(c) for c in document.columns])


def by_type(alerts: DataFrame, rank: Column) -> DataFrame:
    """One row for each type of alert: the highest level, the earliest of equals, and all its dates."""
    best = F.max_by("level", F.struct(rank, -F.unix_date("date")))
    return alerts.groupBy("type").agg(best.alias("level"), F.array_sort(F.collect_set("date")).alias("dates"))


def best_values(table: DataFrame, by: list[str], value: str, low_is_good: bool = False) -> DataFrame:
    """Marks the best value of each group."""
    agg = F.min if low_is_good else F.max
    return table.withColumn("best", F.coalesce(F.col(value) == agg(value).over(Window.partitionBy(*by)), F.lit(False)))


def freshness(documents: DataFrame, now: Column, most_hours: float = 14.0) -> DataFrame:
    """Age in hours of documents (generated) and whether they are too old to serve."""
    age = F.timestamp_diff("SECOND", F.col("generated"), now) / 3600.0
    return documents.withColumn("age_hours", age).withColumn("stale", age > most_hours)
