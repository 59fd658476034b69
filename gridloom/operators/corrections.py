"""Corrections of point series by period: which period a window belongs to, biases, and rain scaled to its mapped total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import weather as W
from gridloom.operators import fitting


def window_keys(windows: DataFrame, periods: DataFrame, issue_lead: Column, gap: int = 3, start_hour: int = 8, length: int = 12, outside: str = "end") -> DataFrame:
    """kind, lead and k of the period that holds each window (step - gap, step].

    ``windows``: init, step; ``periods``: init, k, kind, start_lead, end_lead, back to back and so found by arithmetic
    and an equi-join; ``issue_lead``: hours from init to the issue; ``start_hour``: local hour of init. A window outside of them takes its kind
    from its start and its lead from its end ("end"), or 1 before the periods and 5 behind them ("edge").
    """
    first = periods.groupBy("init").agg(F.min("start_lead").alias("_first"))  # a row for each run
    begin = F.col("step") - gap
    slot = F.col("_first") + F.floor((begin - F.col("_first")) / length) * length
    w = windows.join(first, "init", "left").withColumn("start_lead", slot.cast("int"))
    found = w.join(periods.select("init", "start_lead", "end_lead", F.col("kind").alias("_kind"), F.col("k")), ["init", "start_lead"], "left")
    inside = F.col("k").isNotNull() & (F.col("step") <= F.col("end_lead"))
    hour = F.pmod(begin + start_hour, F.lit(24))
    own = F.when((hour >= 8) & (hour < 20), "day").otherwise("night")
    lead = lambda end: W.lead_day((end - issue_lead).cast("double"))
    other = lead(F.col("step")) if outside == "end" else F.when(F.col("step") <= F.col("_first"), 1).otherwise(5)
    return found.select(*windows.columns, F.when(inside, F.col("_kind")).otherwise(own).alias("kind"), F.when(inside, lead(F.col("end_lead"))).otherwise(other).cast("int").alias("lead"), F.when(inside, F.col("k")).alias("k"))


def unbiased(rows: DataFrame, bias: DataFrame, measures: list[str]) -> DataFrame:
    """Measures less the bias of their kind and lead (kind, lead, bias), where there is one."""
    told = F.broadcast(bias.select("kind", "lead", F.col("bias").alias("_bias")))  # two kinds by five leads
    j = rows.join(told, ["kind", "lead"], "left")
    return j.select(*[(F.col(c) - F.coalesce("_bias", F.lit(0.0))).alias(c) if c in measures else F.col(c) for c in rows.columns])


def rain_factors(series: DataFrame, period: list[str], maps: DataFrame) -> DataFrame:
    """(period, factor): the mapped total of a period over its total, 0 where it is dry; without a map of its kind the total stands."""
    total = series.groupBy(*period).agg(F.coalesce(F.sum("precip"), F.lit(0.0)).alias("_total"))
    j = total.join(F.broadcast(maps.select("kind", "fq", "oq")), "kind", "left")
    return j.select(*period, F.when(F.col("_total") > 1e-6, fitting.map_value(F.col("_total"), F.col("fq"), F.col("oq")) / F.col("_total")).otherwise(0.0).alias("factor"))


def corrected(series: DataFrame, period: list[str], bias: DataFrame, maps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A point series (period with kind, lead, t2m, tmax3, tmin3, precip, snow) corrected, and the factors of its periods.

    Windows outside of all periods, whose period has a null, keep their rain.
    """
    keys = [c for c in period if c != "kind"]
    inside = series.dropna(subset=keys)
    factors = rain_factors(inside, period, maps)
    return scaled(unbiased(series, bias, ["t2m", "tmax3", "tmin3"]), factors, period), factors


def scaled(series: DataFrame, factors: DataFrame, period: list[str]) -> DataFrame:
    """Rain and snow by the factor of their period, so that 3-hourly and hourly amounts of a period agree."""
    j = series.join(factors, period, "left")
    by = F.coalesce("factor", F.lit(1.0))
    return j.select(*[(F.col(c) * by).alias(c) if c in ("precip", "snow") else F.col(c) for c in series.columns])


def member_chances(members: DataFrame, period: list[str], fits: DataFrame, windows: int = 4, least: int = 3, wet: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """Percentages of wet members by period and by window, each member after its own quantile map.

    ``members``: member, period (with kind), step, precip; ``fits``: member, kind, fq, oq. A member counts where it has a fit and
    all windows of the period; its windows are scaled like its total. Unknown below ``least`` members.
    """
    w = Window.partitionBy("member", *period)  # the windows of one period
    whole = (F.count("precip").over(w) == windows) & (F.count(F.lit(1)).over(w) == windows)
    j = members.join(F.broadcast(fits.select("member", "kind", "fq", "oq")), ["member", "kind"])  # a row for each member and kind
    j = j.withColumn("_ok", whole).withColumn("_total", F.sum("precip").over(w)).where("_ok")
    mapped = fitting.map_value(F.col("_total"), F.col("fq"), F.col("oq"))
    j = j.withColumn("_mapped", mapped).withColumn("_factor", F.when(F.col("_total") > 1e-6, mapped / F.col("_total")).otherwise(0.0))
    share = lambda test: F.when(F.count("*") >= least, 100.0 * F.avg(test.cast("double")))
    each = j.groupBy("member", *period).agg(F.first("_mapped").alias("_mapped"))
    by_period = each.groupBy(*period).agg(share(F.col("_mapped") >= wet).alias("pop"), F.count("*").alias("members"))
    by_window = j.groupBy(*period, "step").agg(share(F.col("precip") * F.col("_factor") >= wet).alias("pop"), F.count("*").alias("members"))
    return by_period, by_window
