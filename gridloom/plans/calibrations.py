"""Queries of fits, corrections and backtests, each beside its SQL; a user is a station, event types are members."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import weather as W
from gridloom.operators import calibration as C
from gridloom.operators import fitting, scores
from gridloom.plans.catalog import MEMBER_SQL, members, query, rounded, table

NEWEST = "2024-02-05"


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each user and day: two members' forecasts f1 and f2, the observation o (any may be null), kind, lead, init and end."""
    pick = lambda name: F.max(F.when(F.col("member") == name, F.col("t")))
    w = members(spark, sf_dir).groupBy("user_id", "day").agg(pick("view").alias("f1"), pick("click").alias("f2"), pick("purchase").alias("o"))
    w = w.withColumn("lead", (F.col("user_id") % 5 + 1).cast("int")).withColumn("kind", F.when(F.col("user_id") % 2 == 0, "day").otherwise("night"))
    init = F.col("day").cast("timestamp_ntz")
    return w.withColumn("init", init).withColumn("end", init + F.make_dt_interval(F.col("lead")))


ROWS = MEMBER_SQL + """, t AS (SELECT *, CAST(day AS TIMESTAMP) AS init, CAST(day AS TIMESTAMP) + to_days(lead) AS "end" FROM (
  SELECT user_id, day, max(t) FILTER (member = 'view') AS f1, max(t) FILTER (member = 'click') AS f2, max(t) FILTER (member = 'purchase') AS o, CAST(user_id % 5 + 1 AS INT) AS lead, CASE WHEN user_id % 2 = 0 THEN 'day' ELSE 'night' END AS kind FROM m GROUP BY ALL))"""


def fit_sql(rows: str, keys: str, reference: str) -> str:
    """Closed form of the ridge fit of two members: the weight w1 of the first and the intercept a."""
    return f""", fs AS (SELECT {keys}, count(*) AS n, sum(s) AS s, sum(s * d) AS sd, sum(s * d * d) AS sdd, sum(s * r) AS sr, sum(s * d * r) AS sdr FROM (
   SELECT *, pow(0.5, epoch({reference} - "end") / 86400.0 / 20) AS s, (f1 - f2) / 2 AS d, o - (f1 + f2) / 2 AS r FROM {rows} WHERE f1 + f2 + o IS NOT NULL) GROUP BY ALL HAVING count(*) >= 5),
 fw AS (SELECT *, least(greatest((n * sdr * (n / s) - sd * (n / s) * sr * (n / s)) / (n * (sdd * (n / s) + CASE lead WHEN 3 THEN 2.0 WHEN 4 THEN 4.0 WHEN 5 THEN 8.0 ELSE 1.0 END * n) - pow(sd * (n / s), 2)) + 0.5, 0), 1) AS w1 FROM fs),
 fit AS (SELECT *, (sr - (2 * w1 - 1) * sd) / s AS a FROM fw)"""


COMBINED = """CASE WHEN w1 IS NULL THEN coalesce((f1 + f2) / 2, f1, f2) WHEN f1 IS NULL OR f2 IS NULL THEN coalesce(f1, f2) ELSE w1 * f1 + (1 - w1) * f2 END + coalesce(a, 0)"""


def weights(rows: DataFrame) -> DataFrame:
    return C.temperature_weights(rows, ["kind", "lead"], ["f1", "f2"], "o", C.age_weight(F.col("end"), F.lit(NEWEST).cast("timestamp_ntz"), 20.0), C.ridge_of(F.col("lead")), 5)


@query(ROWS + fit_sql("t", "kind, lead", f"TIMESTAMP '{NEWEST}'") + " SELECT kind, lead, n, round(w1, 6) AS w_f1, round(1 - w1, 6) AS w_f2, round(a, 6) AS intercept FROM fit")
def ridge_consensus(spark, sf_dir):
    return rounded(weights(stations(spark, sf_dir)))


def consensus_rows(rows: DataFrame) -> DataFrame:
    j = rows.join(F.broadcast(weights(rows).drop("n")), ["kind", "lead"], "left")  # at most two kinds by five leads
    fitted = F.col("intercept").isNotNull()
    w = [F.when(fitted, F.col(f"w_{m}")).otherwise(1.0) for m in ("f1", "f2")]
    return j.withColumn("consensus", C.combined([F.col("f1"), F.col("f2")], w, F.col("intercept")))


CONSENSUS = ROWS + fit_sql("t", "kind, lead", f"TIMESTAMP '{NEWEST}'") + f", c AS (SELECT t.*, {COMBINED} AS consensus FROM t LEFT JOIN (SELECT kind, lead, w1, a FROM fit) USING (kind, lead))"


@query(CONSENSUS + " SELECT user_id, day, round(consensus, 5) AS t FROM c", dates=True)
def consensus_temperature(spark, sf_dir):
    return consensus_rows(stations(spark, sf_dir)).select("user_id", "day", F.round("consensus", 5).alias("t"))


NIGHT = CONSENSUS + f""", x AS (SELECT *, ln(least(greatest(f2, 0.3), 8)) AS x, o - consensus AS r, pow(0.5, epoch(TIMESTAMP '{NEWEST}' - "end") / 86400.0 / 20) AS w FROM c WHERE kind = 'night' AND f2 + o + consensus IS NOT NULL),
 n AS (SELECT sum(w * x) / sum(w) AS mu, sum(w * r) / sum(w) AS rm, count(*) AS n FROM x)
SELECT round(sum(w * (x - mu) * (r - rm)) / (1.01 * sum(w * pow(x - mu, 2))), 5) AS b, round(max(mu), 6) AS mu, max(n.n) AS n FROM x, n HAVING count(*) >= 5"""


@query(NIGHT)
def night_wind(spark, sf_dir):
    night = consensus_rows(stations(spark, sf_dir)).where("kind = 'night'")
    fit = C.night_wind_fit(night, F.col("o") - F.col("consensus"), F.col("f2"), C.age_weight(F.col("end"), F.lit(NEWEST).cast("timestamp_ntz"), 20.0), 5)
    return fit.select(F.round("b", 5).alias("b"), F.round("mu", 6).alias("mu"), "n")


@query(CONSENSUS + f""" SELECT lead, CAST(user_id % 8 AS INT) AS hour, count(*) AS n, round(sum(w * (o - consensus)) / sum(w), 5) AS bias FROM (SELECT *, pow(0.5, epoch(TIMESTAMP '{NEWEST}' - "end") / 86400.0 / 20) AS w FROM c WHERE o - consensus IS NOT NULL) GROUP BY ALL HAVING count(*) >= 3""")
def hour_bias(spark, sf_dir):
    c = consensus_rows(stations(spark, sf_dir)).withColumn("hour", (F.col("user_id") % 8).cast("int"))
    return C.weighted_bias(c, ["lead", "hour"], F.col("o") - F.col("consensus"), C.age_weight(F.col("end"), F.lit(NEWEST).cast("timestamp_ntz"), 20.0), 3).withColumn("bias", F.round("bias", 5))


@query(ROWS + " SELECT kind, count(f1 + o) AS n, round(CASE WHEN count(f1 + o) >= 5 AND avg(f1) FILTER (o IS NOT NULL) > 0.3 THEN least(greatest(avg(o) FILTER (f1 IS NOT NULL) / avg(f1) FILTER (o IS NOT NULL), 0.6), 1.8) ELSE 1 END, 6) AS factor FROM t GROUP BY kind")
def wind_factor(spark, sf_dir):
    return rounded(C.wind_factors(stations(spark, sf_dir), ["kind"], F.col("f1"), F.col("o"), 5))


BACKTEST = ROWS + """, i AS (SELECT DISTINCT init AS issue FROM t WHERE init > (SELECT max(init) FROM t) - INTERVAL 5 DAY), tr AS (SELECT i.issue, t.* FROM t JOIN i ON "end" <= issue AND "end" > issue - INTERVAL 20 DAY)""" + fit_sql("tr", "issue, kind, lead", "issue") + f""",
 e AS (SELECT issue, kind, lead, "end", avg((f1 + f2) / 2 - o) AS e FROM tr WHERE f1 + f2 + o IS NOT NULL GROUP BY ALL),
 k AS (SELECT *, row_number() OVER (PARTITION BY issue, kind, lead ORDER BY "end") AS k, count(*) OVER (PARTITION BY issue, kind, lead) AS n FROM e),
 bias AS (SELECT issue, kind, lead, sum(e * CASE WHEN k = 1 THEN pow(0.9, n - 1) ELSE 0.1 * pow(0.9, n - k) END) AS bias FROM k GROUP BY ALL),
 z AS (SELECT t.*, {COMBINED} AS consensus, (f1 + f2) / 2 - coalesce(bias, 0) AS mean_bias, (f1 + f2) / 2 AS plain FROM t JOIN i ON init = i.issue LEFT JOIN (SELECT issue, kind, lead, w1, a FROM fit) f USING (issue, kind, lead) LEFT JOIN bias USING (issue, kind, lead))"""


def backtested(spark, sf_dir):
    return C.rolling_backtest(stations(spark, sf_dir), ["f1", "f2"], "o", 5, 20, least=5)


@query(BACKTEST + " SELECT user_id, day, round(consensus, 5) AS consensus, round(mean_bias, 5) AS mean_bias, round(plain, 5) AS plain FROM z", dates=True)
def rolling_forecasts(spark, sf_dir):
    return rounded(backtested(spark, sf_dir).select("user_id", "day", "consensus", "mean_bias", "plain"), 5)


@query(BACKTEST + " SELECT lead, count(*) AS n, round(avg(abs(consensus - o)), 5) AS consensus_mae, round(avg(abs(mean_bias - o)), 5) AS mean_bias_mae, round(avg(abs(plain - o)), 5) AS plain_mae, round(avg(abs(f1 - o)), 5) AS single_mae FROM z WHERE f1 + f2 + o IS NOT NULL GROUP BY lead")
def rolling_backtest_scores(spark, sf_dir):
    same = backtested(spark, sf_dir).dropna(subset=["f1", "f2", "o"])
    mae = lambda c: F.round(F.avg(F.abs(F.col(c) - F.col("o"))), 5)
    return same.groupBy("lead").agg(F.count("*").alias("n"), mae("consensus").alias("consensus_mae"), mae("mean_bias").alias("mean_bias_mae"), mae("plain").alias("plain_mae"), mae("f1").alias("single_mae"))


@query(ROWS + """, d AS (SELECT lead, day, avg(f1 - o) AS e FROM t WHERE f1 + o IS NOT NULL GROUP BY ALL), a AS (SELECT t.user_id, t.day, t.lead, t.f1, d.e, row_number() OVER (PARTITION BY t.user_id, t.day ORDER BY d.day) AS k, count(d.day) OVER (PARTITION BY t.user_id, t.day) AS n
  FROM t LEFT JOIN d ON d.lead = t.lead AND d.day <= t.day - t.lead - 1 WHERE f1 IS NOT NULL)
SELECT user_id, day, round(max(f1) - coalesce(sum(e * CASE WHEN k = 1 THEN pow(0.9, n - 1) ELSE 0.1 * pow(0.9, n - k) END), 0) + 1e-9, 5) AS t FROM a GROUP BY ALL""", dates=True)
def online_bias_asof(spark, sf_dir):
    s = stations(spark, sf_dir)
    errors = s.select("lead", "day", (F.col("f1") - F.col("o")).alias("e")).dropna()
    fixed = C.online_bias(errors, [], s.where("f1 IS NOT NULL").select("user_id", "day", "lead", "f1"), 0.1)
    return fixed.select("user_id", "day", F.round(F.col("f1") - F.col("bias") + 1e-9, 5).alias("t"))  # off the decimal ties


def matched_series(spark, sf_dir) -> DataFrame:
    """Forecast and observed measures of each user and day, some of them missing."""
    s = stations(spark, sf_dir)
    return s.select("user_id", "day", F.col("f1").alias("t2m"), F.col("o").alias("t2m_obs"), (F.col("f2") / 9).alias("wind_speed"), (F.col("o") / 10).alias("wind_speed_obs"), (F.col("f1") / 100).alias("precip"), (F.col("f2") / 30).alias("precip_obs"))


POINT_FIT = ROWS + """, pm AS (SELECT user_id, day, f1 AS t, o AS t_o, f2 / 9 AS w, o / 10 AS w_o, f1 / 100 AS p, f2 / 30 AS p_o FROM t), pf AS (SELECT user_id, count(*) AS n, CASE WHEN count(t + t_o) >= 3 THEN avg(t_o - t) END AS bias,
  CASE WHEN count(w + w_o) >= 3 AND avg(w) FILTER (w_o IS NOT NULL) > 0.1 THEN least(greatest(avg(w_o) FILTER (w IS NOT NULL) / avg(w) FILTER (w_o IS NOT NULL), 1.0 / 3), 3.0) END AS wind_factor,
  CASE WHEN count(p + p_o) >= 3 AND sum(p) FILTER (p_o IS NOT NULL) > 1 THEN least(greatest(sum(p_o) FILTER (p IS NOT NULL) / sum(p) FILTER (p_o IS NOT NULL), 1.0 / 3), 3.0) END AS precip_factor FROM pm GROUP BY user_id)"""


@query(POINT_FIT + " SELECT user_id, n, round(bias, 6) AS bias, round(wind_factor, 6) AS wind_factor, round(precip_factor, 6) AS precip_factor FROM pf")
def point_fit(spark, sf_dir):
    return rounded(fitting.point_fit(matched_series(spark, sf_dir), ["user_id"], 3))


@query(POINT_FIT + """ SELECT user_id, day, round(t + coalesce(bias, 0), 5) AS t2m, t AS t2m_raw, round(w * coalesce(wind_factor, 1), 5) AS wind_speed, round(w, 5) AS wind_speed_raw, round(p * coalesce(precip_factor, 1), 5) AS precip FROM pm JOIN pf USING (user_id)""", dates=True)
def apply_calibration(spark, sf_dir):
    m = matched_series(spark, sf_dir)
    done = fitting.apply_point_fit(m.select("user_id", "day", "t2m", "wind_speed", "precip"), fitting.point_fit(m, ["user_id"], 3), ["user_id"])
    return done.select("user_id", "day", F.round("t2m", 5).alias("t2m"), "t2m_raw", *[F.round(c, 5).alias(c) for c in ("wind_speed", "wind_speed_raw", "precip")])


@query("""SELECT p_partkey, round(CASE WHEN u = 'K' THEN v - 273.15 WHEN f IN ('tp', 'snow') AND u = 'm' THEN v * 1000 WHEN f = 'tcc' AND u = '%' THEN v / 100 WHEN f = 'orog' AND (u LIKE 'm**2%' OR u = 'm2 s-2') THEN v / 9.80665 ELSE v END, 6) AS value FROM (
  SELECT p_partkey, p_retailprice AS v, list_value('tp', 'snow', 'tcc', 'orog', 't2m')[CAST(p_partkey % 5 AS INT) + 1] AS f, trim(list_value('K', ' m ', 'kg m-2', '%', 'm2 s-2', 'm**2 s**-2', 'gpm')[CAST(p_partkey % 7 AS INT) + 1]) AS u FROM part)""")
def unit_conversion(spark, sf_dir):
    pick = lambda words: F.element_at(F.array(*map(F.lit, words)), (F.col("p_partkey") % len(words) + 1).cast("int"))
    field, unit = pick(("tp", "snow", "tcc", "orog", "t2m")), pick(("K", " m ", "kg m-2", "%", "m2 s-2", "m**2 s**-2", "gpm"))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(W.canonical(F.col("p_retailprice"), unit, field), 6).alias("value"))


@query(ROWS + """ SELECT lead, coalesce(hour, -1) AS hour, n, mae, bias FROM (SELECT lead, hour, count(*) AS n, round(avg(abs(f1 - o)), 6) AS mae, round(avg(f1 - o), 6) AS bias FROM (SELECT *, CAST(user_id % 8 AS INT) AS hour FROM t) WHERE f1 + o IS NOT NULL GROUP BY GROUPING SETS ((lead), (lead, hour)))""")
def series_scores(spark, sf_dir):
    s = stations(spark, sf_dir).dropna(subset=["f1", "o"]).withColumn("hour", (F.col("user_id") % 8).cast("int"))
    g = s.groupingSets([[F.col("lead")], [F.col("lead"), F.col("hour")]], F.col("lead"), F.col("hour")).agg(*scores.temperature_scores(F.col("f1"), F.col("o"))[:3])
    return rounded(g.na.fill(-1, ["hour"]).drop("within2"))


@query(ROWS + """ SELECT strftime(init, '%Y-%m') AS month, count(DISTINCT init) AS issues, count(f1 + o) FILTER (kind = 'day') AS day_n, round(avg(abs(f1 - o)) FILTER (kind = 'day'), 6) AS day_mae, round(avg(abs(f1 - o)) FILTER (kind = 'night'), 6) AS night_mae FROM t GROUP BY ALL ORDER BY month DESC LIMIT 12""")
def monthly_history(spark, sf_dir):
    s = stations(spark, sf_dir)
    e = F.abs(F.col("f1") - F.col("o"))
    day, night = F.when(F.col("kind") == "day", e), F.when(F.col("kind") == "night", e)
    g = s.groupBy(F.date_format("init", "yyyy-MM").alias("month")).agg(F.countDistinct("init").alias("issues"), F.count(day).alias("day_n"), F.avg(day).alias("day_mae"), F.avg(night).alias("night_mae"))
    return rounded(g.orderBy(F.desc("month")).limit(12))


@query(ROWS + """, e AS (SELECT avg(pow(f1 - o, 2)) AS a, avg(pow(f2 - o, 2)) AS b FROM t WHERE f1 + f2 + o IS NOT NULL)
SELECT member, round(sqrt(e), 6) AS rmse, round((1 / e) / sum(1 / e) OVER (), 6) AS weight FROM (SELECT 'f1' AS member, a AS e FROM e UNION ALL SELECT 'f2', b FROM e)""")
def skill_weights(spark, sf_dir):
    s = stations(spark, sf_dir).dropna(subset=["f1", "f2", "o"])
    long = s.unpivot(["o"], ["f1", "f2"], "member", "f")
    return rounded(scores.skill_weights(long, "member", F.col("f"), F.col("o")))


def rain_rows(spark, sf_dir) -> DataFrame:
    s = stations(spark, sf_dir).dropna(subset=["f1", "f2", "o"])
    return s.withColumn("p1", F.col("f1") / 10).withColumn("p2", F.col("f2") / 10).withColumn("w", C.age_weight(F.col("end"), F.lit(NEWEST).cast("timestamp_ntz"), 14.0))


@query()
def heavy_rain_slopes(spark, sf_dir):
    """One logit over the cuts of 0.1, 5 and 15 mm with common slopes."""
    names = ["lm", "wet", "moderate", "night", "above5", "above15"]
    r = C.heavy_rows(rain_rows(spark, sf_dir), [F.col("p1"), F.col("p2")], F.col("kind") == "night", F.col("o") / 10)
    fit = C.logistic_fit(r, [], names, "event", "w", least=15)
    return spark.createDataFrame([(n, round(c, 5)) for f in fit for n, c in zip(["intercept", *names], f["coef"])], "term string, coefficient double")
