"""Day and period keys in a local time of fixed offset."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WEEKDAYS = ("周一", "周二", "周三", "周四", "周五", "周六", "周日")


def local(ts: Column, tz: int) -> Column:
    return ts + F.make_dt_interval(F.lit(0), F.lit(tz))


def day_of(valid: Column, tz: int = 8) -> Column:
    """Local date of a window's end."""
    return F.to_date(local(valid, tz))


def half_of(start: Column, tz: int = 8) -> tuple[Column, Column]:
    """('day' or 'night', date) of a window's start: nights begin at 20 and belong to the date of their evening."""
    t = local(start, tz)
    hour = F.hour(t)
    kind = F.when((hour >= 8) & (hour < 20), "day").otherwise("night")
    return kind, F.when(hour < 8, F.date_sub(F.to_date(t), 1)).otherwise(F.to_date(t))


def period_start(ts: Column, tz: int = 8) -> Column:
    """Start of the 12-hour period at 08 or 20 local time."""
    t = local(ts, tz)
    kind, date = half_of(ts, tz)
    return date.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.when(kind == "day", 8).otherwise(20) - tz)


def floor_hours(ts: Column, hours: int) -> Column:
    return F.date_trunc("hour", ts) - F.make_dt_interval(F.lit(0), F.hour(ts) % hours)


def relative_label(date: Column, today: Column) -> Column:
    d = F.datediff(date, today)
    return F.when(d == -1, "昨天").when(d == 0, "今天").when(d == 1, "明天").when(d == 2, "后天").otherwise(F.element_at(F.array(*map(F.lit, WEEKDAYS)), F.weekday(date) + 1))


def run_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMddHH")


def from_stamp(stamp: Column) -> Column:
    """The cycle of a stamp; null unless it is one of the four hours of a valid date."""
    t = F.try_to_timestamp(stamp, F.lit("yyyyMMddHH")).cast("timestamp_ntz")
    return F.when(F.hour(t) % 6 == 0, t)


def age_hours(then: Column, now: Column) -> Column:
    return F.timestamp_diff("SECOND", then, now) / 3600.0


def month_day(date: Column) -> Column:
    return F.date_format(date, "MM-dd")


def tile_name(lat: Column, lon: Column, prefix: str = "", suffix: str = "") -> Column:
    """Key of the one-degree tile that holds a place, such as N28_00_E117_00."""
    a, b = F.floor(lat), F.floor(lon)
    side = lambda v, plus, minus, width: F.concat(F.when(v >= 0, plus).otherwise(minus), F.lpad(F.abs(v).cast("string"), width, "0"), F.lit("_00"))
    return F.concat(F.lit(prefix), side(a, "N", "S", 2), F.lit("_"), side(b, "E", "W", 3), F.lit(suffix))


def day_bounds(init: Column, date: Column, tz: int = 8) -> tuple[Column, Column]:
    """The hours after ``init`` at which a local day begins and ends."""
    start = (F.timestamp_diff("HOUR", F.date_trunc("hour", init), date.cast("timestamp_ntz")) - tz).cast("int")
    return start, start + 24


def cycle_periods(init: Column, days: int = 5, delay_minutes: int = 690) -> Column:
    """Array of (date, kind, start, end): the UTC half days that a cycle's issue covers, a night under the date of its end.

    The first is the one that the issue, ``delay_minutes`` after the cycle, falls in, or the next if less than six hours of it are left.
    """
    issue = init + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(delay_minutes))
    half = floor_hours(issue, 12)
    left = F.timestamp_diff("SECOND", issue, half + F.make_dt_interval(F.lit(0), F.lit(12)))
    start = F.when(left < 6 * 3600, half + F.make_dt_interval(F.lit(0), F.lit(12))).otherwise(half)
    n = F.when(F.hour(start) == 12, 2 * days + 1).otherwise(2 * days)

    def period(k: Column) -> Column:
        a = start + F.make_dt_interval(F.lit(0), (12 * k).cast("int"))
        b = a + F.make_dt_interval(F.lit(0), F.lit(12))
        return F.struct(F.to_date(b).alias("date"), F.when(F.hour(a) == 0, "day").otherwise("night").alias("kind"), a.alias("start"), b.alias("end"))

    return F.transform(F.sequence(F.lit(0), n - 1), period)
