"""Product rows: periods of an issue, cells, county blocks, hourly curves and text tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import times
from gridloom.functions import weather as W
from gridloom.operators import periods


def plan(issues: DataFrame, tz: int = 8, days: int = 5, max_lead: int = 144, least_left: int = 6) -> DataFrame:
    """``issues``: init, issue (UTC). The 12-hour periods of each issue with start_lead and end_lead in hours, date, kind and label.

    The current period is skipped when fewer than ``least_left`` hours of it remain. Five days are ten periods from a day on,
    eleven from a night on; those that begin before init or end after ``max_lead`` are left out.
    """
    hour = lambda ts: F.unix_timestamp(ts.cast("timestamp")) / 3600.0 + tz
    begin = F.floor((hour(F.col("issue")) - 8) / 12) * 12 + 8
    first = F.when(begin + 12 - hour(F.col("issue")) < least_left, begin + 12).otherwise(begin)
    p = issues.withColumn("_first", first).withColumn("_n", F.when(F.pmod("_first", F.lit(24)) == 8, 2 * days).otherwise(2 * days + 1))
    p = p.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).withColumn("_s", F.col("_first") + 12 * F.col("k"))
    p = p.withColumn("start_lead", (F.col("_s") - F.round(hour(F.col("init")))).cast("int")).withColumn("end_lead", F.col("start_lead") + 12)
    p = p.where((F.col("start_lead") >= 0) & (F.col("end_lead") <= max_lead))
    kind = F.when(F.pmod("_s", F.lit(24)) == 8, "day").otherwise("night")
    date = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("_s") / 24).cast("int"))
    today = times.day_of(F.col("issue"), tz)
    return p.select("init", "issue", "k", "start_lead", "end_lead", kind.alias("kind"), date.alias("date"), period_label(date, kind, today).alias("label"))


def period_label(date: Column, kind: Column, today: Column) -> Column:
    rel = times.relative_label(date, today)
    return F.when((rel == "昨天") & (kind == "night"), "今天凌晨").otherwise(F.concat(rel, F.when(kind == "day", "白天").otherwise("夜间")))


def cells(series: DataFrame, by: list[str], windows: int = 4, chances: DataFrame | None = None) -> DataFrame:
    """Per point and period (``by`` ends in kind) the measures and words of a product's cell; a measure is unknown unless all windows have it.

    ``series``: by, start, t2m, tmax3, tmin3, precip, snow, cloud, u10, v10, gust; ``chances``: by, pop, pop_moderate, pop_heavy in percent.
    """
    a = periods.period_measures(series, by, windows)
    a = a.join(chances, by, "left") if chances is not None else a.select("*", *[F.lit(None).cast("double").alias(c) for c in ("pop", "pop_moderate", "pop_heavy")])
    known = F.col("wind_dir").isNotNull()
    force = lambda c: F.when(known, W.beaufort(F.col(c)))
    lo, hi = W.beaufort(F.col("wind_speed_min")), W.beaufort(F.col("wind_speed_max"))
    weather = F.when(F.col("precip").isNotNull(), W.half_day_text(F.col("precip"), F.coalesce("snow", F.lit(0.0)), F.col("cloud"))).otherwise("—")
    return a.select(
        *by, weather.alias("weather"), F.when(F.col("kind") == "day", F.col("tmax")).otherwise(F.col("tmin")).alias("temp"), "tmax", "tmin", "tmean", "precip", "precip_3h_max", "snow", "cloud",
        F.when(known, W.wind_text(F.col("wind_dir"), F.col("wind_speed_min"), F.col("wind_speed_max"), F.col("gust"))).otherwise("—").alias("wind_text"),
        F.when(known, W.wind_name(F.col("wind_dir"))).alias("wind_name"), F.bround("wind_dir").alias("wind_dir"), force("wind_speed_min").alias("force_lo"), force("wind_speed_max").alias("force_hi"), F.when(known, W.force_text(lo, hi)).alias("force_text"),
        "wind_speed", "wind_speed_max", "gust", F.when(F.col("gust").isNotNull(), W.beaufort(F.col("gust"))).alias("gust_force"), spans(F.col("wet")).alias("windows"), span_text(F.col("wet")).alias("windows_text"),
        *[F.bround(c).cast("int").alias(c) for c in ("pop", "pop_moderate", "pop_heavy")],
    )


def spans(starts: Column, gap: int = 3, tz: int = 8) -> Column:
    """Sorted window starts (UTC) merged where they touch, as (a, b) in local hours since the epoch."""
    hour = lambda ts: (F.unix_timestamp(ts.cast("timestamp")) / 3600).cast("long") + tz
    none = F.array().cast("array<struct<a:bigint,b:bigint>>")
    one = lambda a, b: F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))

    def add(found: Column, start: Column) -> Column:
        h, last = hour(start), F.try_element_at(found, F.lit(-1))
        grown = F.concat(F.slice(found, 1, F.greatest(F.size(found) - 1, F.lit(0))), F.array(one(last["a"], h + gap)))
        return F.when(last["b"] == h, grown).otherwise(F.array_append(found, one(h, h + gap)))

    return F.aggregate(starts, none, add)


def span_text(starts: Column, gap: int = 3, tz: int = 8) -> Column:
    """The merged windows as clock hours; midnight as an end is 24."""
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    text = F.array_join(F.transform(spans(starts, gap, tz), lambda s: F.concat(two(s["a"] % 24), F.lit("—"), two(F.when(s["b"] % 24 == 0, 24).otherwise(s["b"] % 24)), F.lit("时"))), "、")
    return F.when(text == "", "无").otherwise(text)


def county(cells_: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Extremes over the points of each date and kind, and of each county where ``by`` names its key."""
    return cells_.groupBy(*by, "date", "kind").agg(F.max("tmax").alias("temp_max"), F.min("tmin").alias("temp_min"), F.max("precip").alias("precip_max"), F.avg("precip").alias("precip_mean"), F.max("force_hi").alias("force_max"), F.max("gust_force").alias("gust_force_max"), *[F.max(c).alias(f"{c}_max") for c in ("pop", "pop_moderate", "pop_heavy")])


def day_and_night(cells_: DataFrame, keys: list[str]) -> DataFrame:
    """Day and night of each date in one row, by one aggregate rather than a self-join; the weather of both as one word."""
    at = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    d = cells_.groupBy(*keys).agg(at("day", "weather").alias("day_weather"), at("night", "weather").alias("night_weather"), at("day", "temp").alias("high"), at("night", "temp").alias("low"))
    return d.withColumn("weather", F.coalesce(W.join_halves(F.col("day_weather"), F.col("night_weather")), "day_weather", "night_weather"))


def hourly_curve(nodes: DataFrame, shape: DataFrame, keys: list[str], gap: int = 3) -> DataFrame:
    """Hourly values between nodes (keys, step, v): linear, plus how the hourly shape (keys, hour, shape) departs from its own line between the nodes.

    Without the shape's values the line stands alone. Hours run from the first node on.
    """
    order = Window.partitionBy(*keys).orderBy("step")
    own = shape.select(*keys, F.col("hour").alias("step"), F.col("shape").alias("_g1"))
    n = nodes.join(own, [*keys, "step"], "left")
    n = n.withColumn("_s0", F.lag("step").over(order)).withColumn("_v0", F.lag("v").over(order)).withColumn("_g0", F.lag("_g1").over(order))
    hours = F.when(F.col("_s0").isNull(), F.array("step")).otherwise(F.sequence(F.col("_s0") + 1, F.col("step")))
    h = n.withColumn("hour", F.explode(hours)).join(shape.withColumnRenamed("shape", "_g"), [*keys, "hour"], "left")
    share = (F.col("hour") - F.col("_s0")) / (F.col("step") - F.col("_s0"))
    line = lambda a, b: F.when(F.col("hour") == F.col("step"), b).otherwise(a + (b - a) * share)
    departs = F.when(F.col("hour") == F.col("step"), 0.0).otherwise(F.coalesce(F.col("_g") - line(F.col("_g0"), F.col("_g1")), F.lit(0.0)))
    return h.select(*keys, "hour", (line(F.col("_v0"), F.col("v")) + departs).alias("v"))


def columns_to_rows(docs: DataFrame, key: str, arrays: list[str], size: str) -> DataFrame:
    """Columnar documents as rows; short arrays give nulls."""
    return docs.select(key, F.posexplode(size).alias("k", "_x"), *arrays).select(key, "k", *[F.get(F.col(a), F.col("k")).alias(a) for a in arrays])


def display_width(text: Column) -> Column:
    """Columns on a terminal: characters beyond Latin and punctuation blocks count twice.

    Runs of wide characters are taken out, and twice the length less what is left counts: a negated class takes ten times as long.
    """
    return 2 * F.char_length(text) - F.char_length(F.regexp_replace(text, r"[ᄀ-ᅟ⺀-꓏가-힣豈-﫿︰-﹏＀-｠￠-￦]+", ""))


def padded(text: Column, width: int) -> Column:
    return F.concat(text, F.repeat(F.lit(" "), F.greatest(F.lit(width) - display_width(text), F.lit(0))))


def slug(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\p{L}\p{N}]", "_")


def weights_of(text: Column) -> Column:
    """Map of ``a=0.6,b=0.4``."""
    return F.transform_values(F.str_to_map(text, F.lit(","), F.lit("=")), lambda k, v: F.try_to_number(F.trim(v), F.lit("999.999")).cast("double"))
