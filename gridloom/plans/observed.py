"""Queries of observed and model periods, each beside its SQL; ten regions stand for stations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import times
from gridloom.operators import observations as O
from gridloom.plans.catalog import query, rounded, table


def reported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-hourly reports of each region: extremes, 6-hour rain at the main hours (some missing), 24-hour rain at noon of even days, wind."""
    e = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 10).alias("station"), times.floor_hours(F.col("ts"), 3).alias("time"))
    r = e.agg(F.max("value").alias("tx24"), F.min("value").alias("tn24"), F.round(F.sum("value") / 20, 4).alias("p"), F.round(F.max("value") / 16, 6).alias("wind_speed"), F.count("*").alias("n"))
    main = (F.hour("time") % 6 == 0) & (F.col("n") > 2)
    return r.withColumn("p6", F.when(main, F.col("p"))).withColumn("r24", F.when(F.day("time") % 2 == 0, F.col("p")))


REPORTS = """WITH x AS (SELECT user_id % 10 AS station, date_trunc('hour', ts) - to_hours(CAST(hour(ts) % 3 AS INT)) AS time, max(value) AS tx24, min(value) AS tn24, round(sum(value) / 20, 4) AS p, round(max(value) / 16, 6) AS wind, count(*) AS n FROM events GROUP BY ALL),
 r AS (SELECT *, hour(time) AS h, CASE WHEN hour(time) % 6 = 0 AND n > 2 THEN p END AS p6, CASE WHEN day(time) % 2 = 0 THEN p END AS r24 FROM x)"""


@query(REPORTS + """, k AS (SELECT *, CASE WHEN h IN (3, 6, 9, 12) THEN 'day' ELSE 'night' END AS kind, CAST(time + INTERVAL 6 HOUR AS DATE) AS d FROM r WHERE h <> 15)
SELECT station, d AS day, kind, max(CASE h WHEN 12 THEN tx24 WHEN 0 THEN tn24 END) AS t, round(CASE WHEN count(p6) = 2 THEN sum(p6) END, 4) AS precip, CASE WHEN count(wind) >= CASE kind WHEN 'day' THEN 3 ELSE 2 END THEN max(wind) END AS wind FROM k GROUP BY station, d, kind""", dates=True)
def observed_periods(spark, sf_dir):
    o = O.observed_periods(reported(spark, sf_dir)).withColumnRenamed("date", "day")
    return o.withColumn("precip", F.round("precip", 4))


@query(REPORTS + """, k AS (SELECT *, CAST(time + INTERVAL 9 HOUR AS DATE) AS d FROM r), g AS (SELECT station, d AS day, max(tx24) FILTER (h = 12) AS tmax, max(tn24) FILTER (h = 12) AS tmin, max(r24) FILTER (h = 12) AS r24, CASE WHEN count(p6) FILTER (h IN (6, 12)) = 2 THEN sum(p6) FILTER (h IN (6, 12)) END AS a, CASE WHEN count(p6) FILTER (h IN (18, 0)) = 2 THEN sum(p6) FILTER (h IN (18, 0)) END AS b,
  CASE WHEN count(wind) FILTER (h IN (3, 6, 9, 12)) >= 3 THEN max(wind) FILTER (h IN (3, 6, 9, 12)) END AS wind_max_day, CASE WHEN count(wind) FILTER (h IN (15, 18, 21, 0)) >= 3 THEN max(wind) FILTER (h IN (15, 18, 21, 0)) END AS wind_max_night FROM k GROUP BY ALL)
SELECT station, day, tmax, tmin, round(a, 4) AS precip_day, round(b, 4) AS precip_night, wind_max_day, wind_max_night, round(coalesce(r24, a + b), 4) AS precip FROM g""", dates=True)
def days_20_20(spark, sf_dir):
    d = O.days_20_20(reported(spark, sf_dir)).withColumnRenamed("date", "day")
    return d.select("station", "day", "tmax", "tmin", *[F.round(c, 4).alias(c) for c in ("precip_day", "precip_night", "precip")], "wind_max_day", "wind_max_night")


@query("""WITH h AS (SELECT user_id % 2 AS station, date_trunc('hour', ts) AS time, max(value) AS t, round(sum(value), 2) AS p, max(value) FILTER (event_type = 'view') AS w FROM events GROUP BY ALL),
 d AS (SELECT DISTINCT CAST(ts AS DATE) + CAST(k AS INT) AS d FROM events, range(2) r(k)), s AS (SELECT d, kind, CAST(d AS TIMESTAMP) + to_hours(CASE kind WHEN 'day' THEN 0 ELSE -12 END) AS a FROM d, (VALUES ('day'), ('night')) v(kind)),
 j AS (SELECT h.*, d, kind, a FROM h JOIN s ON time >= a AND time <= a + INTERVAL 12 HOUR)
SELECT station, d AS day, kind, CASE kind WHEN 'day' THEN max(t) ELSE min(t) END AS t, CASE WHEN count(p) FILTER (time > a) = 12 THEN round(sum(p) FILTER (time > a), 2) END AS precip,
 CASE WHEN count(w) FILTER (time > a + CASE kind WHEN 'day' THEN INTERVAL 0 HOUR ELSE INTERVAL 3 HOUR END AND hour(time) % 3 = 0) = CASE kind WHEN 'day' THEN 4 ELSE 3 END THEN max(w) FILTER (time > a + CASE kind WHEN 'day' THEN INTERVAL 0 HOUR ELSE INTERVAL 3 HOUR END AND hour(time) % 3 = 0) END AS wind
FROM j GROUP BY station, d, kind, a HAVING count(t) = 13""", dates=True)
def model_periods(spark, sf_dir):
    h = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 2).alias("station"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("time")).agg(F.max("value").alias("t"), F.round(F.sum("value"), 2).alias("p"), F.max(F.when(F.col("event_type") == "view", F.col("value"))).alias("w"))
    m = O.model_periods(h, ["station"]).withColumnRenamed("date", "day")
    return m.withColumn("precip", F.round("precip", 2))


def run_samples(spark, sf_dir) -> DataFrame:
    """Ten regions in runs of 144 hours, one after the other: 3-hour windows, an accumulation in whole numbers, samples of every sixth hour."""
    from pyspark.sql import Window

    s = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 10).alias("point"), times.floor_hours(F.col("ts"), 3).alias("start")).agg(F.max("value").alias("tmax"), F.min("value").alias("tmin"), F.count("*").cast("double").alias("n"))
    k = F.floor((F.unix_timestamp(F.col("start").cast("timestamp")) - 1704067200) / 10800)
    s = s.withColumn("run", F.floor(k / 48)).withColumn("step", (F.pmod(k, F.lit(48)) * 3 + 3).cast("int")).withColumn("window_start", F.col("step") - 3)
    w = Window.partitionBy("point", "run").orderBy("step")  # a run's 48 windows
    return s.withColumn("tp", F.sum("n").over(w)).withColumn("t2m", F.when(F.col("step") % 6 == 0, F.col("tmax"))).withColumn("u10", F.col("tmin")).withColumn("v10", F.lit(0.0))


def run_periods(spark) -> DataFrame:
    return spark.range(12).select((F.col("id") * 12).cast("int").alias("start_h"), (F.col("id") * 12 + 12).cast("int").alias("end_h"), F.when(F.col("id") % 2 == 0, "day").otherwise("night").alias("kind"))


@query("""WITH v AS (SELECT user_id % 10 AS point, CAST(floor((epoch(ts) - 1704067200) / 10800) AS BIGINT) AS w, max(value) AS hi, min(value) AS lo, count(*)::DOUBLE AS n FROM events GROUP BY ALL), x AS (SELECT *, w // 48 AS run, w % 48 * 3 + 3 AS step FROM v), s AS (SELECT *, sum(n) OVER (PARTITION BY point, run ORDER BY step) AS tp FROM x),
 p AS (SELECT k * 12 AS a, CASE WHEN k % 2 = 0 THEN 'day' ELSE 'night' END AS kind FROM range(12) r(k)), j AS (SELECT * FROM s, p WHERE step BETWEEN a AND a + 12)
SELECT point, run, CAST(a AS INT) AS start_h, CAST(a + 12 AS INT) AS end_h, kind, CASE WHEN count(*) FILTER (step > a) = 4 THEN CASE kind WHEN 'day' THEN max(hi) FILTER (step > a) ELSE min(lo) FILTER (step > a) END WHEN count(*) FILTER (step % 6 = 0) >= 3 THEN CASE kind WHEN 'day' THEN max(hi) FILTER (step % 6 = 0) ELSE min(hi) FILTER (step % 6 = 0) END END AS f_t,
 max(tp) FILTER (step = a + 12) - coalesce(max(tp) FILTER (step = a), CASE WHEN a = 0 THEN 0 END) AS f_p, max(abs(lo)) FILTER (step - a IN (6, 9, 12) OR (kind = 'day' AND step - a = 3)) AS f_w FROM j GROUP BY point, run, a, kind""")
def run_period_values(spark, sf_dir):
    return O.period_values(run_samples(spark, sf_dir), run_periods(spark), ["point", "run"])


@query("""WITH v AS (SELECT user_id % 5 AS point, user_id % 30 AS member, CAST(floor((epoch(ts) - 1704067200) / 43200) AS BIGINT) AS w, round(sum(value) / 50, 3) AS mm FROM events GROUP BY ALL), x AS (SELECT *, w // 12 AS run, w % 12 * 12 + 12 AS step FROM v), s AS (SELECT *, round(sum(mm) OVER (PARTITION BY point, run, member ORDER BY step), 3) AS acc FROM x),
 p AS (SELECT k * 12 AS a, CASE WHEN k % 2 = 0 THEN 'day' ELSE 'night' END AS kind FROM range(12) r(k)), m AS (SELECT point, run, a, kind, member, max(acc) FILTER (step = a + 12) - coalesce(max(acc) FILTER (step = a), CASE WHEN a = 0 THEN 0 END) AS mm FROM s, p WHERE step = a OR step = a + 12 GROUP BY point, run, a, kind, member)
SELECT point, run, CAST(a AS INT) AS start_h, CAST(a + 12 AS INT) AS end_h, kind, round(CASE WHEN count(mm) >= 3 THEN avg((mm >= 1.0005)::INT::DOUBLE) FILTER (mm IS NOT NULL) END, 6) AS f_pop, round(CASE WHEN count(mm) >= 3 THEN avg(mm) END, 6) AS f_pens FROM m GROUP BY point, run, a, kind""")
def ensemble_period_rows(spark, sf_dir):
    from pyspark.sql import Window

    k = F.floor((F.unix_timestamp(F.col("ts").cast("timestamp")) - 1704067200) / 43200)
    s = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 5).alias("point"), (F.col("user_id") % 30).alias("member"), F.floor(k / 12).alias("run"), (F.pmod(k, F.lit(12)) * 12 + 12).cast("int").alias("step")).agg(F.round(F.sum("value") / 50, 3).alias("mm"))
    s = s.withColumn("accum", F.round(F.sum("mm").over(Window.partitionBy("point", "run", "member").orderBy("step")), 3))  # a run's 12 steps
    return rounded(O.ensemble_periods(s, run_periods(spark), ["point", "run"], least=3, wet=1.0005))
