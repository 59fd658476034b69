"""Calibrations for many issues at once, and the rolling backtest that refits before each issue.

A row serves every issue in whose window its period has ended.  Rows are not handed to the issues one by one: what a
fit needs of them is first summed by the end of their period, and those sums, a few for each day, go to the issues.
That works since the weight of a row, which halves with every ``half_life`` days, is a factor of the day and a factor
of the issue, and the latter cancels out of every fit.  Only the fits of rain's probability, whose features depend on
the issue's own quantile maps, see rows for each issue, and of these equal ones are counted first.

Member tables are those of ``consensus``; the backtest wants the columns m_t_std as well, members' temperatures
brought to the station's height by the standard lapse.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import weather as W
from gridloom.operators import calibration as C
from gridloom.operators import consensus as K
from gridloom.operators import fitting, scores


@dataclass(frozen=True)
class Settings:
    """Days of a window, half-lives in days, nodes of quantile maps, and the fewest rows of each fit."""

    window_days: int = 60
    half_life: float = 20.0
    rain_half_life: float = 14.0
    nodes: int = 401
    least: int = 30
    least_night: int = 100
    least_rain: int = 60
    least_wind: int = 100
    least_pop: int = 80


def issues_of(rows: DataFrame, test_days: int, delay_minutes: int = 690) -> DataFrame:
    """One row: the times ``_issues`` of the issues of the last ``test_days``, each ``delay_minutes`` after its run, and ``_first``, the first run's."""
    newest = rows.agg(F.max("init").alias("_newest"))
    late = rows.select("init").distinct().crossJoin(F.broadcast(newest)).where(F.col("init") > F.col("_newest") - F.make_dt_interval(F.lit(test_days)))
    return late.agg(F.array_sort(F.collect_set(F.col("init") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(delay_minutes)))).alias("_issues"), F.min("init").alias("_first"))


def windows_of(issues: DataFrame, days: int):
    """A function that gives rows with ``end`` to the issues whose windows of so many days they end in.

    ``issues`` is one row with the array ``_issues``: days times cycles, a bounded number.
    """
    one = F.broadcast(issues.select("_issues"))
    span = F.make_dt_interval(F.lit(days))

    def windows(rows: DataFrame) -> DataFrame:
        inside = F.filter("_issues", lambda i: (F.col("end") <= i) & (F.col("end") > i - span))
        return rows.crossJoin(one).withColumn("issue", F.explode(inside)).drop("_issues")

    return windows


def _sums(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in rows.columns if c not in (*keys, "end", "issue")])


def _night_wind(r: DataFrame, members: list[str], temperature: DataFrame, windows, least: int) -> DataFrame:
    """Slopes of the night residual for each issue.

    The consensus is linear in the members once it is known which of them are there, so sums by these patterns give the
    sums of any issue's residual.
    """
    there = [F.col(f"{m}_t").isNotNull().cast("int") for m in members]
    x = W.log_wind(C.present_mean([F.col(f"{m}_w") for m in members]))
    rows = r.where("kind = 'night' AND o_t IS NOT NULL").select("lead", "end", F.col("_age").alias("s"), x.alias("x"), F.col("o_t").alias("o"), *[a.alias(f"in_{m}") for a, m in zip(there, members)], *[F.coalesce(f"{m}_t", F.lit(0.0)).alias(f"{m}_t") for m in members])
    rows = rows.where(F.col("x").isNotNull() & F.col("s").isNotNull() & (C.total(F.col(f"in_{m}") for m in members) > 0))
    s, x, o = F.col("s"), F.col("x"), F.col("o")
    parts = {"w": s, "wx": s * x, "wxx": s * x * x, "wo": s * o, "wxo": s * x * o, **{f"w_t_{m}": s * F.col(f"{m}_t") for m in members}, **{f"wx_t_{m}": s * x * F.col(f"{m}_t") for m in members}}
    pattern = [f"in_{m}" for m in members]
    by_day = rows.groupBy("lead", "end", *pattern).agg(F.count("*").alias("n"), *[F.sum(c).alias(k) for k, c in parts.items()])
    sums = _sums(windows(by_day), ["issue", "lead", *pattern])
    told = sums.join(F.broadcast(temperature.where("kind = 'night'").drop("kind", "n")), ["issue", "lead"], "left")
    weight = [F.col(f"in_{m}") * F.coalesce(f"w_{m}", F.lit(0.0)) for m in members]
    den, count = C.total(weight), C.total(F.col(c) for c in pattern)
    share = [F.when(den > 1e-9, w / den).otherwise(F.col(f"in_{m}") / count) for w, m in zip(weight, members)]
    a = F.coalesce("intercept", F.lit(0.0))
    left = lambda o, w, t: F.col(o) - a * F.col(w) - C.total(c * F.col(f"{t}_{m}") for c, m in zip(share, members))
    moments = told.select("issue", "n", "w", "wx", "wxx", left("wo", "w", "w_t").alias("wr"), left("wxo", "wx", "wx_t").alias("wxr"))
    return C.night_slope(_sums(moments, ["issue"]), ["issue"], least)


def _winds(r: DataFrame, members: list[str], windows, least: int) -> DataFrame:
    """Wind factors for each issue and kind that has enough winds that are not calm."""
    f = C.total(F.col(f"{m}_w") for m in members) / len(members)
    both = r.select("kind", "end", f.alias("f"), F.col("o_w").alias("o")).dropna(subset=["f", "o"])
    by_day = both.groupBy("kind", "end").agg(F.count("*").alias("n"), F.sum("f").alias("f"), F.sum("o").alias("o"))
    enough = (F.col("n") >= least) & (F.col("f") / F.col("n") > 0.3)
    return _sums(windows(by_day), ["issue", "kind"]).select("issue", "kind", "n", F.when(enough, W.clip(F.try_divide("o", "f"), 0.6, 1.8)).otherwise(1.0).alias("factor"))


def _hours(series: DataFrame, cal: K.Calibration, members: list[str], windows, least: int) -> DataFrame:
    """Biases of the 3-hourly curve by issue, lead and hour, from sums: the curve without its intercept is linear in the issue's coefficients."""
    x = W.log_wind(C.present_mean([F.col(f"{m}_w") for m in members]))
    rows = series.dropna(subset=["o_t3", *[f"{m}_t3" for m in members]]).where("_age IS NOT NULL").withColumn("_x", F.when(F.col("kind") == "night", x))
    s = F.col("_age")
    parts = {"s": s, "so": s * F.col("o_t3"), "sx": s * F.coalesce("_x", F.lit(0.0)), "sk": s * F.col("_x").isNotNull().cast("int"), **{f"s_{m}": s * F.col(f"{m}_t3") for m in members}}
    by_day = rows.groupBy("kind", "lead", "hour", "end").agg(F.count("*").alias("n"), *[F.sum(c).alias(k) for k, c in parts.items()])
    sums = _sums(windows(by_day), ["issue", "kind", "lead", "hour"])
    told = sums.join(F.broadcast(cal.temperature.drop("n")), ["issue", "kind", "lead"], "left").join(F.broadcast(cal.night_wind.drop("n")), "issue", "left")
    den = C.total(F.coalesce(f"w_{m}", F.lit(0.0)) for m in members)
    share = [F.when(den > 1e-9, F.coalesce(f"w_{m}", F.lit(0.0)) / den).otherwise(1.0 / len(members)) for m in members]
    night = F.coalesce(F.col("b") * (F.col("sx") - F.col("mu") * F.col("sk")), F.lit(0.0))
    left = F.col("so") - C.total(c * F.col(f"s_{m}") for c, m in zip(share, members)) - night
    g = told.select("issue", "lead", "hour", "n", "s", left.alias("r")).groupBy("issue", "lead", "hour").agg(F.sum("n").alias("n"), F.try_divide(F.sum("r"), F.sum("s")).alias("bias"))
    return g.where(F.col("n") >= least)


def chance_rows(r: DataFrame, cal: K.Calibration, members: list[str], windows) -> DataFrame:
    """What the fits of rain's probability see: rows with all members and an observation, given to their issues and mapped by these.

    Equal rows of a period's end, of which the dry ones are most, are one row that counts ``times``; ``over`` is how many of
    the cuts the observation reaches.
    """
    over = C.total((F.col("o_p") >= c).cast("int") for c in C.CUTS)
    whole = r.dropna(subset=["o_p", *[f"{m}_p" for m in members]]).withColumn("over", over)
    equal = whole.groupBy("kind", "end", *[f"{m}_p" for m in members], "over").agg(F.count("*").alias("times"), F.first("_wet_age").alias("weight"))
    mapped, of = K.mapped_members(windows(equal), cal, members)
    mapped = mapped.withColumn("_m", F.array(*of)).drop("_maps", *[f"{m}_p" for m in members])
    return mapped.select("issue", "kind", "over", "times", "weight", "_m")


def _chances(rows: DataFrame, members: list[str], least: int) -> tuple[DataFrame, DataFrame]:
    """Coefficients of the probability of any rain by issue and kind, and of the cuts above by issue.

    The cuts share their slopes over both kinds.  There is no fit for an issue with too few events of the first cut above,
    and a cut with too few events is not published.  A period in which it always or never rained has no finite fit: its
    coefficients are those of the last round, with ``converged`` false.
    """
    spark = rows.sparkSession
    of = [F.col("_m")[k] for k in range(len(members))]
    wet, lm = C.rain_features(of)
    pop = C.logistic_fit(rows.select("issue", "kind", "times", "weight", wet.alias("wet"), lm.alias("lm"), (F.col("over") >= 1).alias("event")), ["issue", "kind"], ["wet", "lm"], "event", "weight", least=least, times="times", strict=False)
    events = [F.sum(F.when(F.col("over") > k, F.col("times")).otherwise(0)).alias(f"e{k}") for k in range(1, len(C.CUTS))]
    counted = rows.groupBy("issue").agg(*events)
    published = F.array_compact(F.array(*[F.when(F.col(f"e{k}") >= C.FEWEST[c], F.lit(c)) for k, c in enumerate(C.CUTS) if k]))
    enough = counted.where(F.col("e1") >= C.FEWEST[C.CUTS[1]]).select("issue", published.alias("published"))
    limit = F.element_at(F.array(F.lit(-1e9), *map(F.lit, C.CUTS)), F.col("over") + 1)  # an amount that reaches as many cuts
    stacked = C.heavy_rows(rows.join(F.broadcast(enough.select("issue")), "issue", "left_semi"), of, F.col("kind") == "night", limit)
    slopes = C.logistic_fit(stacked, ["issue"], ["lm", "wet", "moderate", "night", "above5", "above15"], "event", "weight", least=1, times="times", strict=False)
    pop_table = spark.createDataFrame([(f["issue"], f["kind"], f["coef"], f["converged"]) for f in pop], "issue timestamp_ntz, kind string, coef array<double>, converged boolean")
    heavy_table = spark.createDataFrame([(f["issue"], f["coef"], f["converged"]) for f in slopes], "issue timestamp_ntz, coef array<double>, converged boolean").join(enough, "issue")
    return pop_table, heavy_table


def fit_issues(rows: DataFrame, members: list[str], issues: DataFrame, s: Settings = Settings(), series: DataFrame | None = None, chances: bool = True) -> K.Calibration:
    """Calibrations for all ``issues`` (one row with the array ``_issues``), each from the rows that had ended within its window before it.

    Tables have the key ``issue``.  With the 3-hourly rows ``series`` they hold the biases by hour as well.
    """
    windows = windows_of(issues, s.window_days)
    kept = lambda table: table.persist(StorageLevel.MEMORY_AND_DISK)  # noqa: E731  a few rows for each issue, which later fits and predictions read again
    top = F.broadcast(rows.agg(F.max("end").alias("_top")))  # one row
    aged = lambda df: df.crossJoin(top).withColumn("_age", C.age_weight(F.col("end"), F.col("_top"), s.half_life)).withColumn("_wet_age", C.age_weight(F.col("end"), F.col("_top"), s.rain_half_life)).drop("_top")
    r = aged(rows)
    moments = C.temperature_moments(r, ["kind", "lead", "end"], [f"{m}_t" for m in members], "o_t", F.col("_age"), C.ridge_of(F.col("lead")))
    keys = ["issue", "kind", "lead"]
    weights = C.solved_weights(C.added(windows(moments), keys), keys, [f"{m}_t" for m in members], s.least)
    temperature = kept(weights.select(*keys, "n", *[F.col(f"w_{m}_t").alias(f"w_{m}") for m in members], "intercept"))
    cal = K.Calibration(temperature=temperature, by=("issue",))
    night = kept(_night_wind(r, members, temperature, windows, s.least_night))
    mean = r.withColumn("_f", C.total(F.col(f"{m}_p") for m in members) / len(members))
    precip = kept(fitting.quantile_map(mean, ["kind"], "_f", "o_p", s.nodes, s.least_rain, "_wet_age", windows))
    each = F.inline(F.array(*[F.struct(F.lit(m).alias("member"), F.col(f"{m}_p").alias("f")) for m in members]))
    whole = r.dropna(subset=["o_p", *[f"{m}_p" for m in members]]).select("kind", "end", "o_p", "_wet_age", each)
    maps = kept(fitting.quantile_map(whole, ["member", "kind"], "f", "o_p", s.nodes, s.least_rain, "_wet_age", windows))
    cal = K.Calibration(temperature, night, precip, maps, wind=_winds(r, members, windows, s.least_wind), by=("issue",))
    found = dict(cal.__dict__)
    if chances:
        found["pop"], found["heavy"] = _chances(chance_rows(r, cal, members, windows), members, s.least_pop)
    if series is not None:
        found["hours"] = _hours(aged(series), cal, members, windows, s.least)
    return K.Calibration(**found)


# ---------------------------------------------------------------- backtest


def decaying_biases(rows: DataFrame, error: Column, windows, alpha: float = 0.1) -> DataFrame:
    """(issue, kind, lead, bias): the decaying average of the mean errors of each period end in an issue's window, in order of time."""
    daily = rows.select("kind", "lead", "end", error.alias("_e")).where("_e IS NOT NULL").groupBy("kind", "lead", "end").agg(F.avg("_e").alias("e"))
    listed = windows(daily).groupBy("issue", "kind", "lead").agg(F.array_sort(F.collect_list(F.struct("end", "e"))).alias("s"))  # at most a window's ends
    return listed.select("issue", "kind", "lead", F.aggregate(F.slice("s", 2, F.greatest(F.size("s") - 1, F.lit(0))), F.col("s")[0]["e"], lambda a, x: (1 - alpha) * a + alpha * x["e"]).alias("bias"))


@dataclass(frozen=True)
class Backtest:
    """Forecasts of the tested issues, and the scores made of them."""

    rows: DataFrame  # the member rows with issue, t, p, pop, p5, p15, w, mean_bias_t, raw_t, raw_p, raw_w
    climate: DataFrame  # one row: how often the rain before the first tested run reached each cut, as c0, c1 and c2
    curve: DataFrame | None  # 3-hourly rows with the curve as drawn (current) and with the hours' biases (hour_bias)
    members: tuple[str, ...]

    def known(self, *columns: str) -> Column:
        """Whether all members have the measures, and the observation is there: every configuration is scored on these rows."""
        first = F.col(f"o_{columns[0]}").isNotNull()
        return C.total([first.cast("int"), *[F.col(f"{m}_{c}").isNotNull().cast("int") for m in self.members for c in columns]]) == 1 + len(self.members) * len(columns)

    def configurations(self, single: str) -> DataFrame:
        """A row for each tested row and configuration: the consensus, the mean less its bias, the mean, and one member alone; null where the row does not count."""
        t, p, w = self.known("t", "t_std"), self.known("p"), self.known("w")
        of = lambda name, x, y, z: F.struct(F.lit(name).alias("config"), F.when(t, F.col(x)).alias("t"), F.when(p, F.col(y)).alias("p"), (F.when(w, F.col(z)) if z else F.lit(None).cast("double")).alias("w"))
        four = F.array(of("new", "t", "p", "w"), of("mean_bias", "mean_bias_t", "p", None), of("new_raw", "raw_t", "raw_p", "raw_w"), of("single", f"{single}_t_std", f"{single}_p", f"{single}_w"))
        return self.rows.select("issue", *K.KEYS, "o_t", "o_p", "o_w", F.inline(four))

    def measures(self, single: str) -> DataFrame:
        """Scores of the four configurations by lead, on the same rows."""
        return K.score_table(self.configurations(single), ["config", "lead"])

    def chances(self, cut: int = 0, bins: list[tuple[float, float]] = [(0.0, 0.2), (0.2, 0.5), (0.5, 0.8), (0.8, 1.01)], least: int = 50, fewest: int = 0) -> DataFrame:
        """Scores of the probability of reaching a cut (0: any rain, 1: moderate, 2: heavy), against how often that was so before."""
        rows = self.rows.where(self.known("p")).crossJoin(F.broadcast(self.climate))
        return K.event_scores(rows, F.col(("pop", "p5", "p15")[cut]), F.col("o_p"), C.CUTS[cut], F.col(f"c{cut}"), bins, least, fewest)

    def frost(self, limit: float = 0.0) -> DataFrame:
        """Nights down to the limit by lead: seen, hit and falsely forecast."""
        nights = self.rows.where(self.known("t", "t_std") & (F.col("kind") == "night") & F.col("t").isNotNull())
        return nights.groupBy("lead").agg(F.count("*").alias("n"), *scores.frost_scores(F.col("t"), F.col("o_t"), limit))

    def hours(self) -> DataFrame:
        """Temperature scores of both curves by lead, over all hours (hour null) and by hour, where all members and the observation are there."""
        whole = self.curve.dropna(subset=["o_t3", *[f"{m}_t3" for m in self.members]])
        long = whole.select("lead", "hour", "o_t3", F.inline(F.array(*[F.struct(F.lit(c).alias("config"), F.col(c).alias("t3")) for c in ("current", "hour_bias")])))
        return long.groupingSets([[F.col("config"), F.col("lead")], [F.col("config"), F.col("lead"), F.col("hour")]], F.col("config"), F.col("lead"), F.col("hour")).agg(*scores.temperature_scores(F.col("t3"), F.col("o_t3")))


def backtest(rows: DataFrame, members: list[str], s: Settings = Settings(), test_days: int = 30, series: DataFrame | None = None, delay_minutes: int = 690, alpha: float = 0.1, fewest: int = 10, history_days: int = 20, chances: bool = True) -> Backtest:
    """Forecasts of the issues of the last ``test_days``, each by a calibration of its own from what had ended before it.

    ``rows``: the member table with m_t_std and observations; ``series``: 3-hourly rows, for which the curve is drawn twice.
    Without ``chances`` the probability of rain is the share of wet members.
    Raises where fewer than ``fewest`` issues or less than ``history_days`` before the first of them are there.
    """
    issues = issues_of(rows, test_days, delay_minutes)
    told = issues.crossJoin(rows.agg(F.min("end").alias("_begin"))).select(F.size("_issues").alias("n"), F.coalesce(F.col("_begin") <= F.col("_first") - F.make_dt_interval(F.lit(history_days)), F.lit(False)).alias("enough")).first()
    if told["n"] < fewest or not told["enough"]:
        raise ValueError(f"not enough verified days: {told['n']} issues")
    delay = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(delay_minutes))
    cal = fit_issues(rows, members, issues, s, series, chances)
    times = F.broadcast(issues.select(F.explode("_issues").alias("issue")))
    test = rows.withColumn("issue", F.col("init") + delay).join(times, "issue", "left_semi")
    windows = windows_of(issues, s.window_days)
    mean = lambda c: C.total(F.col(f"{m}_{c}") for m in members) / len(members)
    bias = decaying_biases(rows, mean("t_std") - F.col("o_t"), windows, alpha)
    p = K.predict(test, cal, members).withColumn("raw_t", mean("t_std")).withColumn("raw_p", mean("p")).withColumn("raw_w", mean("w"))
    p = p.join(F.broadcast(bias), ["issue", "kind", "lead"], "left").withColumn("mean_bias_t", F.col("raw_t") - F.coalesce("bias", F.lit(0.0))).drop("bias")
    before = rows.crossJoin(F.broadcast(issues.select("_first"))).where("end < _first AND o_p IS NOT NULL")
    climate = before.agg(*[F.avg((F.col("o_p") >= c).cast("double")).alias(f"c{k}") for k, c in enumerate(C.CUTS)])
    curve = None
    if series is not None:
        drawn = series.withColumn("issue", F.col("init") + delay).join(times, "issue", "left_semi")
        held = K.period_values(drawn, p, "t", "_extreme")
        plain = K.series_temperature(held, cal, members).withColumnRenamed("t3", "current")
        curve = K.series_temperature(plain, cal, members, True, "_extreme").withColumnRenamed("t3", "hour_bias").drop("_extreme")
    return Backtest(p, climate, curve, tuple(members))
