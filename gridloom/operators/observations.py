"""Observed and model values of half-day periods, each by one grouped aggregate over reports or hours.

Times are UTC; a night carries the date of its end. A period without any row is absent, one that lacks
what a measure needs has a null there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def later(ts: Column, hours: int) -> Column:
    return ts + F.make_dt_interval(F.lit(0), F.lit(hours))


def at(hour: Column, when, value: Column) -> Column:
    return F.when(hour.isin(*when), value)


def both(hour: Column, when, value: Column) -> Column:
    """Sum of the amounts reported at these hours, all of which are needed."""
    v = at(hour, when, value)
    return F.when(F.count(v) == len(when), F.sum(v))


def strongest(hour: Column, when, value: Column) -> Column:
    """Largest value at these hours, of which one may be missing."""
    v = at(hour, when, value)
    return F.when(F.count(v) >= len(when) - 1, F.max(v))


def observed_periods(reports: DataFrame) -> DataFrame:
    """``reports``: station, time, tx24, tn24, p6, wind_speed, one for each station and time. A report serves one period only."""
    hour = F.hour("time")
    kind = F.when(hour.isin(3, 6, 9, 12), "day").when(hour.isin(18, 21, 0), "night")
    r = reports.where((F.minute("time") == 0) & kind.isNotNull()).withColumn("hour", hour).withColumn("kind", kind).withColumn("date", F.to_date(later(F.col("time"), 6)))
    h, p, w = F.col("hour"), F.col("p6"), F.col("wind_speed")
    g = r.groupBy("station", "date", "kind").agg(
        F.max(F.when(h == 12, F.col("tx24")).when(h == 0, F.col("tn24"))).alias("t"),
        both(h, (6, 12), p).alias("_pd"), both(h, (18, 0), p).alias("_pn"), strongest(h, (3, 6, 9, 12), w).alias("_wd"), strongest(h, (18, 21, 0), w).alias("_wn"),
    )
    day = F.col("kind") == "day"
    return g.select("station", "date", "kind", "t", F.when(day, F.col("_pd")).otherwise(F.col("_pn")).alias("precip"), F.when(day, F.col("_wd")).otherwise(F.col("_wn")).alias("wind"))


def model_periods(hourly: DataFrame, keys: list[str]) -> DataFrame:
    """``hourly``: keys, time, t, p, w. The extreme of 13 hours, the rain of 12, the wind at the report hours; no row without all temperatures.

    Only the hours 00 and 12 belong to two periods, so rows grow by a twelfth.
    """
    hour = F.hour("time")
    slot = lambda kind, shift: F.struct(F.lit(kind).alias("kind"), F.to_date(later(F.col("time"), shift)).alias("date"))
    slots = F.when(hour == 0, F.array(slot("day", 0), slot("night", 0))).when(hour == 12, F.array(slot("day", 0), slot("night", 12))).when(hour < 12, F.array(slot("day", 0))).otherwise(F.array(slot("night", 12)))
    e = hourly.where(F.minute("time") == 0).withColumn("hour", hour).withColumn("s", F.explode(slots)).select(*keys, "s.kind", "s.date", "hour", "t", "p", "w")
    day, h = F.col("kind") == "day", F.col("hour")
    rain = F.when(F.when(day, h != 0).otherwise(h != 12), F.col("p"))
    wind = F.when(F.when(day, h.isin(3, 6, 9, 12)).otherwise(h.isin(18, 21, 0)), F.col("w"))
    g = e.groupBy(*keys, "date", "kind").agg(F.count("t").alias("_n"), F.max("t").alias("_hi"), F.min("t").alias("_lo"), F.when(F.count(rain) == 12, F.sum(rain)).alias("precip"), F.when(F.count(wind) == F.when(day, 4).otherwise(3), F.max(wind)).alias("wind"))
    return g.where("_n = 13").select(*keys, "date", "kind", F.when(day, F.col("_hi")).otherwise(F.col("_lo")).alias("t"), "precip", "wind")


def days_20_20(reports: DataFrame) -> DataFrame:
    """Days from 20 to 20 of UTC+8; the total falls back to the sum of its halves."""
    h = F.col("hour")
    r = reports.where(F.minute("time") == 0).withColumn("hour", F.hour("time")).where((h % 3) == 0).withColumn("date", F.to_date(later(F.col("time"), 9)))
    noon = lambda c: F.max(F.when(h == 12, F.col(c)))
    p, w = F.col("p6"), F.col("wind_speed")
    g = r.groupBy("station", "date").agg(noon("tx24").alias("tmax"), noon("tn24").alias("tmin"), noon("r24").alias("_r24"), both(h, (6, 12), p).alias("precip_day"), both(h, (18, 0), p).alias("precip_night"), strongest(h, (3, 6, 9, 12), w).alias("wind_max_day"), strongest(h, (15, 18, 21, 0), w).alias("wind_max_night"))
    return g.withColumn("precip", F.coalesce("_r24", F.col("precip_day") + F.col("precip_night"))).drop("_r24")


def period_values(samples: DataFrame, periods: DataFrame, keys: list[str]) -> DataFrame:
    """A run's temperature extreme, rain and wind in each period.

    ``samples``: keys, step, window_start, tmax, tmin, t2m, tp (since init), u10, v10; ``periods``: start_h, end_h, kind, whose
    hours are spelled out, so that samples meet them by equality. The extreme comes from windows that cover the period,
    else from at least three samples; rain is what the accumulation grew by; wind is the strongest at the report hours.
    """
    step, s0, s1 = F.col("step"), F.col("start_h"), F.col("end_h")
    j = samples.join(periods.withColumn("step", F.explode(F.sequence(s0, s1))), "step")
    inside = F.col("window_start") >= s0
    day = F.col("kind") == "day"
    extreme = F.when(day, F.col("tmax")).otherwise(F.col("tmin"))
    report = F.when(day, (step - s0).isin(3, 6, 9, 12)).otherwise((step - s0).isin(6, 9, 12))
    pick = lambda c: (F.max(F.when(inside, c)), F.min(F.when(inside, c)))
    hi, lo = pick(extreme)
    g = j.groupBy(*keys, "start_h", "end_h", "kind").agg(
        hi.alias("_hi"), lo.alias("_lo"), F.array_sort(F.collect_set(F.when(inside & extreme.isNotNull(), F.struct(F.col("window_start").cast("long").alias("a"), step.cast("long").alias("b"))))).alias("_w"),
        F.count("t2m").alias("_n"), F.max("t2m").alias("_thi"), F.min("t2m").alias("_tlo"), F.max(F.when(step == s0, F.col("tp"))).alias("_tp0"), F.max(F.when(step == s1, F.col("tp"))).alias("_tp1"), F.max(F.when(report, F.hypot("u10", "v10"))).alias("f_w"),
    )
    reach = F.aggregate("_w", s0.cast("long"), lambda a, w: F.when(w["a"] <= a, F.greatest(a, w["b"])).otherwise(F.lit(None).cast("long")))
    side = lambda a, b: F.when(day, F.col(a)).otherwise(F.col(b))
    t = F.coalesce(F.when(reach >= s1, side("_hi", "_lo")), F.when(F.col("_n") >= 3, side("_thi", "_tlo")))
    before = F.coalesce("_tp0", F.when(s0 == 0, 0.0))
    return g.select(*keys, "start_h", "end_h", "kind", t.alias("f_t"), F.when(F.col("_tp1").isNotNull() & before.isNotNull(), F.greatest(F.col("_tp1") - before, F.lit(0.0))).alias("f_p"), "f_w")


def ensemble_periods(members: DataFrame, periods: DataFrame, keys: list[str], least: int = 10, wet: float = 0.1) -> DataFrame:
    """Share of wet members and mean amount in each period from accumulations (keys, member, step, accum); unknown below ``least`` members."""
    step, s0, s1 = F.col("step"), F.col("start_h"), F.col("end_h")
    j = members.join(periods.withColumn("step", F.explode(F.array_distinct(F.array(s0, s1)))), "step")
    each = j.groupBy(*keys, "start_h", "end_h", "kind", "member").agg((F.max(F.when(step == s1, F.col("accum"))) - F.coalesce(F.max(F.when(step == s0, F.col("accum"))), F.when(s0 == 0, 0.0))).alias("mm"))
    return each.groupBy(*keys, "start_h", "end_h", "kind").agg(F.when(F.count("mm") >= least, F.avg((F.col("mm") >= wet).cast("double"))).alias("f_pop"), F.when(F.count("mm") >= least, F.avg("mm")).alias("f_pens"))


def icon(text: Column, night: Column) -> Column:
    """Class of a weather word; the first that matches counts."""
    has = lambda *words: F.coalesce(text, F.lit("")).rlike("|".join(words))
    return F.when(has("雪"), "snow").when(has("暴雨", "雷", "强降水"), "storm").when(has("大雨", "中雨"), "rain").when(has("雨"), "drizzle").when(has("阴"), "overcast").when(has("多云"), F.when(night, "moon-partly").otherwise("partly")).otherwise(F.when(night, "moon").otherwise("clear"))


def live_alerts(alerts: DataFrame, periods: DataFrame, today: Column, night_types: list[str]) -> DataFrame:
    """Alerts from today on, and those of night types whose night still runs (``periods``: date, kind, ended), by a semi-join."""
    nights = periods.where((F.col("kind") == "night") & ~F.col("ended")).select(F.col("date").alias("_n")).distinct()
    j = alerts.join(F.broadcast(nights), F.col("date") == F.col("_n"), "left")  # nights of one product
    return j.where((F.col("date") >= today) | (F.col("type").isin(*night_types) & F.col("_n").isNotNull())).drop("_n")


def health(state: DataFrame) -> DataFrame:
    """``state``: run, missing (array), calibration_days, obs_days, issues, gap. The warnings of each run that hold."""
    say = [
        F.when(F.size("missing") > 0, F.concat(F.lit("missing members: "), F.array_join("missing", ", "))),
        F.when(F.col("calibration_days").isNull(), "no calibration").when(F.col("calibration_days") >= 2, F.concat(F.lit("calibration is "), F.bround("calibration_days").cast("int").cast("string"), F.lit(" days old"))),
        F.when(F.col("obs_days") > 3, F.concat(F.lit("observations are "), F.bround("obs_days").cast("int").cast("string"), F.lit(" days old"))),
        F.when((F.col("issues") >= 10) & (F.col("gap") > 0.5), F.concat(F.lit("live error exceeds the backtest by "), F.format_number("gap", 1))),
    ]
    return state.select("run", F.array_compact(F.array(*say)).alias("warnings"))
