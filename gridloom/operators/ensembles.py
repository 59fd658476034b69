"""Ensembles and members: accumulation, probabilities, windows of hourly values, cycles and what is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import weather as W
from gridloom.operators import align, fitting


def accumulated(buckets: DataFrame, keys: list[str], value: str = "mm") -> DataFrame:
    """Running totals of buckets in order of ``step``; from a missing bucket on the total is unknown."""
    order = Window.partitionBy(*keys).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    gaps = F.sum(F.when(F.col(value).isNull(), 1).otherwise(0)).over(order)
    return buckets.withColumn("accum", F.when(gaps == 0, F.sum(value).over(order)))


def never_falling(series: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Snow from its first step on, never falling."""
    order = Window.partitionBy(*keys).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    based = F.greatest(F.col(value) - F.first(value, True).over(order), F.lit(0.0))
    return series.withColumn("_b", based).withColumn(value, F.max("_b").over(order)).drop("_b")


def window_probability(buckets: DataFrame, periods: DataFrame, keys: list[str], limit: float = 0.1, cell: int = 24) -> DataFrame:
    """Percent of members that reach the limit in a period (keys, from_h, to_h), unknown unless its buckets cover it.

    ``buckets``: keys, member, start_h, end_h, mm. A bucket across the border gives its share. Members are summed
    before they are counted, both on the map side.
    """
    part = F.col("mm") * F.col("overlap") / F.greatest(F.col("end_h") - F.col("start_h"), F.lit(1))
    each = align.overlap_join(buckets, periods, keys, cell).groupBy(*keys, "from_h", "to_h", "member").agg(F.sum(part).alias("mm"), F.sum("overlap").alias("hours"))
    return each.groupBy(*keys, "from_h", "to_h").agg(F.when(F.min("hours") >= F.col("to_h") - F.col("from_h") - 1e-6, 100.0 * F.avg((F.col("mm") >= limit).cast("double"))).alias("pop"), F.count("*").alias("members"))


def hourly_probability(buckets: DataFrame, hours: DataFrame, keys: list[str], shift: int = 0, width: int = 6, limit: float = 0.1) -> DataFrame:
    """Percent of wet members in the bucket that holds each hour (hour - 1, hour] of the deterministic run, ``shift`` hours from the ensemble's; unknown where there is none."""
    wet = buckets.groupBy(*keys, F.floor(F.col("start_h") / width).alias("_b")).agg((100.0 * F.avg((F.col("mm") >= limit).cast("double"))).alias("pop"))
    return hours.withColumn("_b", F.floor((F.col("hour") - shift - 1) / width)).join(wet, [*keys, "_b"], "left").drop("_b")


def mapped_probability(totals: DataFrame, fits: DataFrame, keys: list[str], value: str = "p", least: int = 3) -> DataFrame:
    """Percent of members wet after each one's own quantile map; unknown with fewer than ``least`` members.

    ``fits``: member, kind, fq, oq, one row for each pair and so small; a member without one is taken as it is.
    """
    j = totals.where(F.col(value).isNotNull()).join(F.broadcast(fits.select("member", "kind", "fq", "oq")), ["member", "kind"], "left")
    wet = F.avg((fitting.map_value(F.col(value), F.col("fq"), F.col("oq")) >= 0.1).cast("double"))
    return j.groupBy(*keys).agg(F.when(F.count("*") >= least, 100.0 * wet).alias("pop"), F.count("*").alias("members"))


def scale_windows(series: DataFrame, period: list[str], fits: DataFrame, value: str = "precip") -> DataFrame:
    """Windows scaled so that their period's total becomes its mapped total; periods without rain stay dry."""
    w = Window.partitionBy(*period)
    tot = F.sum(F.coalesce(F.col(value), F.lit(0.0))).over(w)
    j = series.withColumn("_tot", tot).join(F.broadcast(fits.select("kind", "fq", "oq")), "kind", "left")
    factor = F.when(F.col("_tot") > 1e-6, fitting.map_value(F.col("_tot"), F.col("fq"), F.col("oq")) / F.col("_tot")).otherwise(0.0)
    return j.withColumn("factor", factor).withColumn(value, F.col(value) * factor).drop("_tot", "fq", "oq")


def member_windows(hourly: DataFrame, keys: list[str], gap: int = 3) -> DataFrame:
    """Windows of ``gap`` hours ending at each step from hourly values (keys, hour, t, p, gust, cloud, speed, direction).

    Extremes take both ends, so an hour at a border goes to two windows; sums and gusts the hours inside.
    A window lacking an hour, or with a null among what a measure needs, has none.
    """
    end = (F.ceil(F.col("hour") / gap) * gap).cast("int")
    at_end = F.pmod("hour", F.lit(gap)) == 0
    each = hourly.withColumn("step", F.explode(F.when(at_end, F.array(end, end + gap)).otherwise(F.array(end))))
    inside, last = F.col("hour") > F.col("step") - gap, F.col("hour") == F.col("step")
    u, v = W.wind_components(F.col("speed"), F.col("direction"))
    whole = lambda c, agg, n, test: F.when(F.count(F.when(test, F.col(c))) == n, agg(F.when(test, F.col(c))))
    everywhere = F.lit(True)
    w = each.groupBy(*keys, "step").agg(
        F.count("*").alias("_n"), F.max(F.when(last, F.col("t"))).alias("t2m"), whole("t", F.max, gap + 1, everywhere).alias("tmax3"), whole("t", F.min, gap + 1, everywhere).alias("tmin3"),
        whole("p", F.sum, gap, inside).alias("precip"), whole("gust", F.max, gap, inside).alias("gust"), F.max(F.when(last, F.col("cloud") / 100)).alias("cloud"), F.max(F.when(last, u)).alias("u10"), F.max(F.when(last, v)).alias("v10"),
    )
    return w.where(F.col("_n") == gap + 1).drop("_n")


def mean_members(members: DataFrame, keys: list[str], values: list[str], least: int = 3) -> DataFrame:
    """Mean of each measure over the members that have it, unknown with fewer than ``least``."""
    return members.groupBy(*keys).agg(*[F.when(F.count(v) >= least, F.avg(v)).alias(v) for v in values], F.count(values[0]).alias("members"))


def strict_blend(members: DataFrame, keys: list[str], values: list[str], weights: dict[str, float]) -> DataFrame:
    """Weighted sums where every member of ``weights`` is there with a value; other keys are left out, their measures unknown."""
    w = F.try_element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("member"))
    n, total = len(weights), sum(weights.values())
    rows = members.where(F.col("member").isin(*weights)).groupBy(*keys).agg(F.count("*").alias("_n"), *[F.when(F.count(v) == n, F.sum(w / total * F.col(v))).alias(v) for v in values], *[(F.max(v) - F.min(v)).alias(f"{v}_spread") for v in values])
    return rows.where(F.col("_n") == n).drop("_n")


def two_level_extremes(members: DataFrame, period: list[str], value: str) -> DataFrame:
    """Each member's extremes of a period first, then their means."""
    each = members.groupBy(*period, "member").agg(F.max(value).alias("hi"), F.min(value).alias("lo"))
    return each.groupBy(*period).agg(F.avg("hi").alias("hi"), F.avg("lo").alias("lo"), F.count("*").alias("members"))


def chosen_cycle(archive: DataFrame, depth: int, least: int = 2) -> DataFrame:
    """The newest init that at least ``least`` members reach to ``depth`` hours. ``archive``: init, member, max_lead."""
    deep = archive.where(F.col("max_lead") >= depth).groupBy("init").agg(F.countDistinct("member").alias("members"))
    return deep.where(F.col("members") >= least).orderBy(F.desc("init")).limit(1)


def missing_cycles(days: DataFrame, cycles: list[int], members: list[str], archive: DataFrame) -> DataFrame:
    """What of day x cycle x member is not in the archive (init, member). The lists are short literals, so no join makes the product."""
    each = days.select("day", F.explode(F.array(*map(F.lit, cycles))).alias("cycle")).select((F.col("day").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("cycle"))).alias("init"), F.explode(F.array(*map(F.lit, members))).alias("member"))
    return each.join(archive.select("init", "member").distinct(), ["init", "member"], "left_anti")


def bounded(grid: DataFrame, lat_min: float, lat_max: float, lon_min: float, lon_max: float) -> DataFrame:
    """Cells of a box; where lon_min > lon_max it crosses the antimeridian. Literals only, so the scan can use them."""
    lon = F.col("lon").between(lon_min, lon_max) if lon_min <= lon_max else (F.col("lon") >= lon_min) | (F.col("lon") <= lon_max)
    return grid.where(F.col("lat").between(lat_min, lat_max) & lon)


def step_list(every: Column, last: Column, first: Column) -> Column:
    """Multiples of the cadence from ``first`` to ``last``; empty where there are none."""
    lo, hi = (F.ceil(first / every) * every).cast("int"), (F.floor(last / every) * every).cast("int")
    return F.when(lo <= hi, F.sequence(lo, hi, every.cast("int"))).otherwise(F.array().cast("array<int>"))
