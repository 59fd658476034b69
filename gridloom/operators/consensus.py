"""The consensus of several members: training tables, fits, predictions, what was issued, and their scores.

A member table has the keys station, date, kind, lead, init and end, and for each member m the columns m_t, m_p and m_w
(temperature extreme, rain, wind); observations are o_t, o_p and o_w. A calibration is a few tables of a row for each
kind, lead or member, so they are broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import weather as W
from gridloom.operators import calibration as C
from gridloom.operators import fitting, scores

KEYS = ["station", "date", "kind", "lead", "init", "end"]
# Where a station counts as lowland (m), and the limits of moderate and heavy 12-hour rain (mm).
LOWLAND_M = 500.0
MODERATE_MM, HEAVY_MM = 5.0, 15.0


@dataclass(frozen=True)
class Calibration:
    """Fitted tables; a table that is missing, or a row of it, leaves the members' mean as it is."""

    temperature: DataFrame | None = None  # kind, lead, w_<member>, intercept
    night_wind: DataFrame | None = None  # b, mu: one row
    precip: DataFrame | None = None  # kind, fq, oq
    member_maps: DataFrame | None = None  # member, kind, fq, oq
    pop: DataFrame | None = None  # kind, coef: intercept, wet share, log of the mean
    heavy: DataFrame | None = None  # coef, published: one row
    wind: DataFrame | None = None  # kind, factor
    hours: DataFrame | None = None  # lead, hour, bias
    by: tuple[str, ...] = ()  # further keys of all tables and of the rows: ``issue`` where there is a fit for each issue


def lowland(rows: DataFrame, stations: DataFrame) -> DataFrame:
    """Rows of the stations (station, elevation) below the lowland limit."""
    return rows.join(stations.where(F.col("elevation") < LOWLAND_M).select("station"), "station", "left_semi")


def training_table(members: DataFrame, observed: DataFrame, stations: DataFrame, since: Column | None = None, until: Column | None = None) -> DataFrame:
    """Members' rows of lowland stations with what was observed (station, date, kind, o_t, o_p, o_w), if anything; the runs from ``since`` to ``until``."""
    rows = lowland(members, stations)
    rows = rows if since is None else rows.where(F.col("init") >= since)
    rows = rows if until is None else rows.where(F.col("init") <= until)
    return rows.join(observed, ["station", "date", "kind"], "left")


def series_training_table(series: DataFrame, observed: DataFrame, periods: DataFrame, members: list[str]) -> DataFrame:
    """3-hourly rows (keys, valid, hour, m_t3) with the observation at their hour (station, valid, o_t3) and their period's winds."""
    return series.join(observed, ["station", "valid"], "left").join(periods.select(*KEYS, *[f"{m}_w" for m in members]), KEYS, "left")


def period_values(series: DataFrame, periods: DataFrame, value: str, name: str) -> DataFrame:
    """A period's value at each of its 3-hourly rows."""
    return series.join(periods.select(*KEYS, F.col(value).alias(name)), KEYS, "left")


def _maybe(rows: DataFrame, small: DataFrame | None, keys: list[str], columns: dict[str, str]) -> DataFrame:
    """The columns of a small calibration table beside the rows, null where there is none."""
    if small is None:
        return rows.select("*", *[F.lit(None).cast(t).alias(f"_{c}") for c, t in columns.items()])
    told = F.broadcast(small.select(*keys, *[F.col(c).cast(t).alias(f"_{c}") for c, t in columns.items()]))  # a row for each kind, lead or hour, and issue
    return rows.join(told, keys, "left") if keys else rows.join(told, F.lit(True), "left")


def consensus_temperature(rows: DataFrame, cal: Calibration, members: list[str], suffix: str = "t") -> DataFrame:
    """Adds ``_curve``: the weighted mean of the members present with its intercept, at night with the wind's term; ``_intercept`` is kept."""
    r = _maybe(rows, cal.temperature, [*cal.by, "kind", "lead"], {**{f"w_{m}": "double" for m in members}, "intercept": "double"})
    r = _maybe(r, cal.night_wind, [*cal.by], {"b": "double", "mu": "double"})
    base = C.combined([F.col(f"{m}_{suffix}") for m in members], [F.col(f"_w_{m}") for m in members], F.col("_intercept"))
    wind = C.present_mean([F.col(f"{m}_w") for m in members])
    term = F.when(F.col("kind") == "night", C.night_wind_term(F.col("_b"), F.col("_mu"), wind)).otherwise(0.0)
    return r.withColumn("_curve", base + term).drop("_b", "_mu", *[f"_w_{m}" for m in members])


def mapped_members(rows: DataFrame, cal: Calibration, members: list[str]) -> tuple[DataFrame, list[Column]]:
    """Each member's rain after its own quantile map; a member without one as it is."""
    fit = "struct<fq:array<double>,oq:array<double>>"
    by_kind = None
    if cal.member_maps is not None:
        entry = F.struct(F.col("member"), F.struct("fq", "oq").cast(fit).alias("m"))
        by_kind = cal.member_maps.groupBy(*cal.by, "kind").agg(F.map_from_entries(F.collect_list(entry)).alias("maps"))  # a row for each kind
    r = _maybe(rows, by_kind, [*cal.by, "kind"], {"maps": f"map<string,{fit}>"})
    of = lambda m: F.try_element_at(F.col("_maps"), F.lit(m))
    return r, [fitting.map_value(F.col(f"{m}_p"), of(m)["fq"], of(m)["oq"]) for m in members]


def predict(rows: DataFrame, cal: Calibration, members: list[str]) -> DataFrame:
    """``rows`` with the consensus t, p and w, and the probabilities pop, p5 and p15 (0 to 1), each no larger than the one before.

    Means are over the members present. Without a fit of rain's probability the column gefs_pop stands in where the
    table has one, else the share of wet members; limits that are not published are unknown.
    """
    r = consensus_temperature(rows, cal, members)
    r = _maybe(r, cal.precip, [*cal.by, "kind"], {"fq": "array<double>", "oq": "array<double>"})
    r = _maybe(r, cal.wind, [*cal.by, "kind"], {"factor": "double"})
    r = _maybe(r, cal.pop, [*cal.by, "kind"], {"coef": "array<double>"}).withColumnRenamed("_coef", "_pop")
    r = _maybe(r, cal.heavy, [*cal.by], {"coef": "array<double>", "published": "array<double>"})
    r, mapped = mapped_members(r, cal, members)
    r = r.withColumn("_m", F.array(*mapped))
    of = [F.col("_m")[k] for k in range(len(members))]
    wet, amount = C.rain_features(of)
    r = r.withColumn("_wet", wet).withColumn("_lm", amount).withColumn("_heavy_lm", F.log1p(F.least(C.present_mean(of), F.lit(C.CAP_MM)))).withColumn("_moderate", C.present_mean([(m >= MODERATE_MM).cast("double") for m in of]))
    pop = F.col("_pop")
    instead = F.col("gefs_pop") if "gefs_pop" in rows.columns else F.col("_wet")
    any_rain = F.when(pop.isNull(), instead).otherwise(W.logistic(pop[0] + pop[1] * F.col("_wet") + pop[2] * F.col("_lm")))
    c = F.col("_coef")
    slope = c[0] + c[1] * F.col("_heavy_lm") + c[2] * F.col("_wet") + c[3] * F.col("_moderate") + c[4] * (F.col("kind") == "night").cast("double")
    over = lambda k, limit: F.when(F.array_contains("_published", limit), W.logistic(slope + c[k]))
    pop_, p5, p15 = W.ordered_probabilities(any_rain, over(5, MODERATE_MM), over(6, HEAVY_MM))
    rain = fitting.map_value(C.present_mean([F.col(f"{m}_p") for m in members]), F.col("_fq"), F.col("_oq"))
    wind = C.present_mean([F.col(f"{m}_w") for m in members]) * F.coalesce("_factor", F.lit(1.0))
    return r.select(*rows.columns, F.col("_curve").alias("t"), rain.alias("p"), pop_.alias("pop"), p5.alias("p5"), p15.alias("p15"), wind.alias("w"))


def series_temperature(rows: DataFrame, cal: Calibration, members: list[str], hour_bias: bool = False, extreme: str | None = None) -> DataFrame:
    """3-hourly rows (keys, hour, m_t3, m_w) with the curve ``t3``: the period's weights and intercept, at night the wind's term.

    ``hour_bias`` takes the bias of the row's lead and hour in place of the intercept where there is one, and holds the
    curve to the period's extreme in the column ``extreme``.
    """
    r = consensus_temperature(rows, cal, members, "t3")
    curve = F.col("_curve")
    if hour_bias:
        r = _maybe(r, cal.hours, [*cal.by, "lead", "hour"], {"bias": "double"})
        curve = curve + F.when(F.col("_bias").isNotNull(), F.col("_bias") - F.coalesce("_intercept", F.lit(0.0))).otherwise(0.0)
        curve = W.hold_to_extreme(curve, F.col("kind"), F.col(extreme)) if extreme else curve
    return r.select(*rows.columns, curve.alias("t3"))


def hour_biases(rows: DataFrame, cal: Calibration, members: list[str], half_life: float = 20.0, least: int = 30) -> DataFrame:
    """(lead, hour, n, bias): what is left of complete rows after the curve without its intercept, recent ones weighing more."""
    r = consensus_temperature(rows.dropna(subset=["o_t3", *[f"{m}_t3" for m in members]]), cal, members, "t3")
    newest = r.agg(F.max("end").alias("_newest"))  # one row
    r = r.crossJoin(F.broadcast(newest))
    left = F.col("o_t3") - (F.col("_curve") - F.coalesce("_intercept", F.lit(0.0)))
    return C.weighted_bias(r, ["lead", "hour"], left, C.age_weight(F.col("end"), F.col("_newest"), half_life), least)


def fit(rows: DataFrame, members: list[str], now: Column, window_days: int = 60, half_life: float = 20.0, rain_half_life: float = 14.0, nodes: int = 401, least: int = 30, least_night: int = 100, least_rain: int = 60, least_wind: int = 100, least_pop: int = 80, series: DataFrame | None = None, chances: bool = True) -> Calibration:
    """A calibration from the rows whose periods ended before ``now``, at most ``window_days`` ago, recent ones weighing more.

    It is the fit of one issue by ``rolling.fit_issues``.  ``chances``: whether rain's probabilities are fitted as well, which
    runs a job for each Newton step.
    """
    from gridloom.operators import rolling

    settings = rolling.Settings(window_days, half_life, rain_half_life, nodes, least, least_night, least_rain, least_wind, least_pop)
    one = rows.sparkSession.range(1).select(F.array(now.cast("timestamp_ntz")).alias("_issues"))
    cal = rolling.fit_issues(rows, members, one, settings, series, chances)
    tables = {k: v.drop("issue") if isinstance(v, DataFrame) else v for k, v in cal.__dict__.items()}
    return Calibration(**{**tables, "by": ()})


# ---------------------------------------------------------------- what was issued, and scores


def issued_rows(rows: DataFrame, cal: Calibration, members: list[str], issue: Column, run: Column) -> DataFrame:
    """What an issue forecasts, without periods that are mostly over: the members present, the lead from the issue's own time, values to three places."""
    p = predict(rows, cal, members).withColumn("issue", issue).withColumn("run", run)
    p = p.where(F.col("end") > F.col("issue") + F.make_dt_interval(F.lit(0), F.lit(6)))
    hours = F.timestamp_diff("SECOND", F.col("issue"), F.col("end")) / 3600.0
    present = F.array_compact(F.array(*[F.when(F.col(f"{m}_t").isNotNull(), m) for m in sorted(members)]))
    return p.select("run", "issue", "init", present.alias("members"), "station", "date", "kind", "end", W.lead_day(hours).alias("lead"), *[F.bround(c, 3).alias(c) for c in ("t", "p", "pop", "p5", "p15", "w")])


def wind_scores(f: Column, o: Column) -> list[Column]:
    """Mean absolute error, bias and the percentage of equal Beaufort forces."""
    e = f - o
    same = F.when(e.isNotNull(), (W.beaufort(f) == W.beaufort(o)).cast("double") * 100)
    return [F.count(e).alias("wind_n"), F.avg(F.abs(e)).alias("wind_mae"), F.avg(e).alias("wind_bias"), F.avg(same).alias("force_exact")]


def score_table(rows: DataFrame, by: list[str]) -> DataFrame:
    """Scores of t, p and w against o_t, o_p and o_w by the given keys: day maxima, night minima, rain from 0.1 and from 5 mm, wind."""
    at = lambda kind: F.when(F.col("kind") == kind, F.col("t"))
    named = lambda prefix, columns, names: [c.alias(f"{prefix}_{n}") for c, n in zip(columns, names)]
    temps = [*named("tmax", scores.temperature_scores(at("day"), F.col("o_t")), ("n", "mae", "bias", "within2")), *named("tmin", scores.temperature_scores(at("night"), F.col("o_t")), ("n", "mae", "bias", "within2"))]
    table = ("hits", "false_alarms", "misses", "dry", "correct", "threat", "detected", "false_ratio", "frequency_bias")
    rain = [*named("rain", scores.rain_scores(F.col("p"), F.col("o_p"), 0.1, 0.1), table), *named("rain5", scores.rain_scores(F.col("p"), F.col("o_p"), MODERATE_MM, MODERATE_MM), table)]
    return rows.groupBy(*by).agg(*temps, *rain, *wind_scores(F.col("w"), F.col("o_w")))


def live_scores(issued: DataFrame, observed: DataFrame, now: Column, days: int = 30) -> tuple[DataFrame, DataFrame]:
    """Scores by lead of what was issued in the last ``days`` and has ended, and day-1 scores of each month of the whole log."""
    over = issued.where(F.col("end") <= now).join(observed, ["station", "date", "kind"], "left")
    recent = score_table(over.where(F.col("issue") > now - F.make_dt_interval(F.lit(days))), ["lead"])
    first = score_table(over.where("lead = 1").withColumn("month", F.date_format("issue", "yyyy-MM")), ["month"])
    issues = over.groupBy(F.date_format("issue", "yyyy-MM").alias("month")).agg(F.countDistinct("run").alias("issues"))
    return recent, issues.join(first.select("month", "tmax_n", "tmax_mae", "tmin_n", "tmin_mae", "rain_correct"), "month", "left")


def event_scores(rows: DataFrame, f: Column, amount: Column, limit: float, climate: Column, bins: list[tuple[float, float]], least: int = 50, fewest: int = 0) -> DataFrame:
    """Brier score, skill against the frequency ``climate`` and reliability of probabilities for amounts of at least ``limit``.

    One pass of grouping sets: all rows (level 3), bins (level 1) and leads (level 2). Nothing with fewer than ``least``
    rows in all; no skill with fewer than ``fewest`` events, a lead's with fewer than 20 rows or half as many events.
    """
    p = rows.select("lead", f.alias("f"), (amount >= limit).cast("double").alias("o"), climate.alias("c")).where("f IS NOT NULL AND o IS NOT NULL")
    slot = F.coalesce(*[F.when((F.col("f") >= a) & (F.col("f") < b), F.lit(k)) for k, (a, b) in enumerate(bins)])
    p = p.withColumn("bin", slot)
    g = p.groupingSets([[], [F.col("bin")], [F.col("lead")]], F.col("bin"), F.col("lead"))
    g = g.agg(F.count("*").alias("n"), F.sum("o").cast("long").alias("events"), F.avg(F.pow(F.col("f") - F.col("o"), 2)).alias("brier"), F.avg(F.pow(F.col("c") - F.col("o"), 2)).alias("brier_climate"), F.avg("o").alias("observed"), F.grouping_id().cast("int").alias("level"))
    total = g.where("level = 3").select(F.col("n").alias("_n"), F.col("events").alias("_e"))  # one row
    enough = (F.col("_e") >= fewest) & F.when(F.col("level") == 2, False).when(F.col("level") == 1, (F.col("n") >= 20) & (F.col("events") >= fewest / 2)).otherwise(True)
    skill = F.when(enough & (F.col("brier_climate") > 0), 1 - F.col("brier") / F.col("brier_climate"))
    return g.crossJoin(F.broadcast(total)).where(F.col("_n") >= least).select("level", "bin", "lead", "n", "events", "brier", "brier_climate", "observed", skill.alias("skill"))


def evaluate(rows: DataFrame, test_days: int, alpha: float = 0.1, nodes: int = 401, least: int = 60) -> DataFrame:
    """Scores by configuration and lead of the last ``test_days`` dates: the plain mean, and the one corrected by what was known.

    ``rows``: station, date, kind, lead, t, p, w and observations. Temperatures lose the decaying bias of their kind and
    lead known at issue, rain is mapped by a fit on the dates before the cut.
    """
    last = rows.select("date").distinct().orderBy(F.desc("date")).limit(test_days).agg(F.min("date").alias("_cut"))  # one row
    r = rows.crossJoin(F.broadcast(last))
    errors = r.select("kind", "lead", F.col("date").alias("day"), (F.col("t") - F.col("o_t")).alias("e")).dropna()
    fixed = C.online_bias(errors, ["kind"], r.withColumnRenamed("date", "day"), alpha).withColumnRenamed("day", "date")
    maps = fitting.quantile_map(r.where("date < _cut"), ["kind"], "p", "o_p", nodes, least)
    new = _maybe(fixed, maps, ["kind"], {"fq": "array<double>", "oq": "array<double>"})
    new = new.withColumn("t", F.col("t") - F.col("bias")).withColumn("p", fitting.map_value(F.col("p"), F.col("_fq"), F.col("_oq")))
    both = new.select(*r.columns).withColumn("config", F.lit("new")).unionByName(r.withColumn("config", F.lit("raw")))
    return score_table(both.where("date >= _cut"), ["config", "lead"])
