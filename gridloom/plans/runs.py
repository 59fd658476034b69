"""Queries of point series and of grids read at points, each beside its SQL; ten regions stand for points, parts for grid cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import times
from gridloom.functions import weather as W
from gridloom.operators import periods, points
from gridloom.operators import products as P
from gridloom.plans.catalog import BEAUFORT_SQL, FLOOR_MOD, HALF, HALF_DATE, ladder_sql, query, rounded, table


def region_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of ten regions as a 3-hourly series with all measures; gusts are missing here and there."""
    kind, date = times.half_of(F.col("start"))
    e = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 10).alias("point"), times.floor_hours(F.col("ts"), 3).alias("start")).agg(F.max("value").alias("hi"), F.min("value").alias("lo"), F.round(F.sum("value"), 2).alias("total"), F.count("*").alias("n"))
    s = e.select("point", "start", (F.col("hi") / 4).alias("tmax3"), (F.col("lo") / 4 - 5).alias("tmin3"), ((F.col("hi") + F.col("lo")) / 8).alias("t2m"), (F.col("total") / 25).alias("precip"), F.when(F.col("n") % 3 == 0, F.col("total") / 60).otherwise(0.0).alias("snow"),
                 F.least(F.col("n") / 8.0, F.lit(1.0)).alias("cloud"), (F.col("hi") / 8).alias("u10"), (F.col("lo") / 8 - 3).alias("v10"), F.when(F.col("n") % 5 != 0, F.col("hi") / 6).alias("gust"))
    return s.withColumn("valid", F.col("start") + F.make_dt_interval(F.lit(0), F.lit(3))).withColumn("kind", kind).withColumn("date", date).withColumn("step", ((F.unix_timestamp(F.col("start").cast("timestamp")) - 1704067200) / 3600 + 3).cast("int"))


REGIONS = f"""WITH e AS (SELECT user_id % 10 AS point, date_trunc('hour', ts) - to_hours(CAST(hour(ts) % 3 AS INT)) AS start, max(value) AS hi, min(value) AS lo, round(sum(value), 2) AS total, count(*) AS n FROM events GROUP BY ALL),
 rs AS (SELECT point, start, hi / 4 AS tmax3, lo / 4 - 5 AS tmin3, (hi + lo) / 8 AS t2m, total / 25 AS precip, CASE WHEN n % 3 = 0 THEN total / 60 ELSE 0.0 END AS snow, least(n / 8.0, 1.0) AS cloud, hi / 8 AS u, lo / 8 - 3 AS v, CASE WHEN n % 5 <> 0 THEN hi / 6 END AS gust, sqrt(hi / 8 * hi / 8 + (lo / 8 - 3) * (lo / 8 - 3)) AS w,
  start + to_hours(3) AS valid, {HALF} AS kind, {HALF_DATE} AS date, CAST((epoch(start) - 1704067200) / 3600 AS INT) + 3 AS step FROM e)"""
DIRECTION = FLOOR_MOD.format("270 - degrees(atan2(avg(v), avg(u)))")


@query(REGIONS + f""" SELECT point, CAST(valid + to_hours(8) AS DATE) AS day, round(greatest(max(tmax3), min(tmin3)) + 1e-9, 5) AS tmax, round(min(tmin3) + 1e-9, 5) AS tmin, round(avg(t2m) + 1e-9, 5) AS tavg, round(sum(precip) + 1e-9, 4) AS precip, round(sum(snow) + 1e-9, 4) AS snow, round(avg(cloud) + 1e-9, 5) AS cloud,
  round(avg(w) + 1e-9, 5) AS wind_speed, round(min(w) + 1e-9, 5) AS wind_speed_min, round(max(w) + 1e-9, 5) AS wind_speed_max, round(max(gust) + 1e-9, 5) AS wind_gust, round({DIRECTION} + 1e-9, 4) AS wind_dir, count(*) * 3 AS hours FROM rs GROUP BY ALL""", dates=True)
def daily_extremes(spark, sf_dir):
    d = periods.to_daily(region_series(spark, sf_dir))
    places = {"precip": 4, "snow": 4, "wind_dir": 4}
    return d.select("point", "day", "hours", *[F.round(F.col(c) + 1e-9, places.get(c, 5)).alias(c) for c in ("tmax", "tmin", "tavg", "precip", "snow", "cloud", "wind_speed", "wind_speed_min", "wind_speed_max", "wind_gust", "wind_dir")])


@query(REGIONS + """, d AS (SELECT DISTINCT point, CAST(valid + to_hours(8) AS DATE) AS day FROM rs), h AS (SELECT point, date, sum(precip) FILTER (kind = 'day') AS day_precip, sum(snow) FILTER (kind = 'day') AS day_snow, avg(cloud) FILTER (kind = 'day') AS day_cloud, sum(precip) FILTER (kind = 'night') AS night_precip, sum(snow) FILTER (kind = 'night') AS night_snow, avg(cloud) FILTER (kind = 'night') AS night_cloud FROM rs GROUP BY ALL)
SELECT d.point, day, round(day_precip + 1e-9, 4) AS day_precip, round(day_snow + 1e-9, 4) AS day_snow, round(day_cloud + 1e-9, 5) AS day_cloud, round(night_precip + 1e-9, 4) AS night_precip, round(night_snow + 1e-9, 4) AS night_snow, round(night_cloud + 1e-9, 5) AS night_cloud FROM d LEFT JOIN h ON d.point = h.point AND d.day = h.date""", dates=True)
def half_day_split(spark, sf_dir):
    h = periods.half_days(region_series(spark, sf_dir))
    return h.select("point", "day", *[F.round(F.col(f"{k}_{c}") + 1e-9, 5 if c == "cloud" else 4).alias(f"{k}_{c}") for k in ("day", "night") for c in ("precip", "snow", "cloud")])


FULL_CELLS = REGIONS + f""", c AS (SELECT point, date, kind, count(*) AS n, max(tmax3) AS hi, min(tmin3) AS tmin, avg(t2m) AS tmean, sum(precip) AS precip, max(precip) AS precip_3h_max, sum(snow) AS snow, avg(cloud) AS cloud, min(w) AS w0, max(w) AS w1, avg(w) AS wind_speed, CASE WHEN count(gust) = 4 THEN max(gust) END AS gust, {DIRECTION} AS dir,
   list_sort(list(CAST(epoch(start) / 3600 AS BIGINT) + 8) FILTER (precip >= 0.1)) AS wet FROM rs GROUP BY ALL),
 f AS (SELECT *, {BEAUFORT_SQL('w0')} AS force_lo, {BEAUFORT_SQL('w1')} AS force_hi, {BEAUFORT_SQL('gust')} AS gf, list_value('北风','东北风','东风','东南风','南风','西南风','西风','西北风')[CAST(floor(dir / 45 + 0.5) AS INT) % 8 + 1] AS wind_name FROM c WHERE n = 4),
 x AS (SELECT *, CASE WHEN force_hi <= 2 THEN '<3级' WHEN force_lo >= force_hi THEN force_hi || '级' ELSE greatest(force_lo, force_hi - 1) || '～' || force_hi || '级' END AS force_text,
   CASE WHEN snow >= 0.1 AND precip - snow >= 0.1 AND precip - snow >= snow * 0.5 THEN '雨夹雪' WHEN snow >= 0.1 THEN {ladder_sql('snow', W.SNOW_12H)} WHEN precip >= 0.1 THEN {ladder_sql('precip', W.RAIN_12H)} ELSE {ladder_sql('cloud', ((0.35, '晴'), (0.75, '多云'), (9, '阴')))} END AS weather,
   list_filter(wet, lambda h: NOT list_contains(wet, h - 3)) AS a, list_transform(list_filter(wet, lambda h: NOT list_contains(wet, h + 3)), lambda h: h + 3) AS b FROM f),
 cells AS (SELECT point, date, kind, weather, CASE kind WHEN 'day' THEN greatest(hi, tmin) ELSE tmin END AS temp, greatest(hi, tmin) AS tmax, tmin, tmean, precip, precip_3h_max, snow, cloud, wind_name || force_text || CASE WHEN gust IS NOT NULL AND gf >= 6 AND gf >= force_hi + 2 THEN '，阵风' || gf || '级' ELSE '' END AS wind_text, wind_name, round_even(dir, 0) AS wind_dir, force_lo, force_hi, force_text, wind_speed, w1 AS wind_speed_max, gust, CASE WHEN gust IS NOT NULL THEN gf END AS gust_force,
   coalesce(nullif(array_to_string(list_transform(range(1, len(a) + 1), lambda i: lpad(CAST(a[i] % 24 AS VARCHAR), 2, '0') || '—' || lpad(CAST(CASE WHEN b[i] % 24 = 0 THEN 24 ELSE b[i] % 24 END AS VARCHAR), 2, '0') || '时'), '、'), ''), '无') AS windows_text, CAST(coalesce(len(a), 0) AS INT) AS n_windows FROM x)"""
MEASURES = ("temp", "tmax", "tmin", "tmean", "precip", "precip_3h_max", "snow", "cloud", "wind_speed", "wind_speed_max", "gust")


def region_cells(spark, sf_dir, chances: DataFrame | None = None) -> DataFrame:
    return P.cells(region_series(spark, sf_dir), ["point", "date", "kind"], chances=chances)


@query(FULL_CELLS + f" SELECT point, date AS day, kind, weather, wind_text, wind_name, wind_dir, force_lo, force_hi, force_text, gust_force, windows_text, n_windows, {', '.join(f'round({c} + 1e-9, 4) AS {c}' for c in MEASURES)} FROM cells", dates=True)
def full_cells(spark, sf_dir):
    c = region_cells(spark, sf_dir).where("tmin IS NOT NULL")
    return c.select("point", F.col("date").alias("day"), "kind", "weather", "wind_text", "wind_name", "wind_dir", "force_lo", "force_hi", "force_text", "gust_force", "windows_text", F.size("windows").alias("n_windows"), *[F.round(F.col(m) + 1e-9, 4).alias(m) for m in MEASURES])


# ---------------------------------------------------------------- grids


def grid(spark, sf_dir) -> DataFrame:
    """Cells of a 6 by 6 grid at two steps from the parts; totals never fall."""
    p = table(spark, sf_dir, "part")
    cell = p.groupBy((F.col("p_partkey") % 6).alias("i"), (F.floor(F.col("p_partkey") / 6) % 6).cast("long").alias("j")).agg(F.max("p_size").alias("a"), F.min("p_size").alias("b"), F.max("p_retailprice").alias("c"))
    steps = F.explode(F.array(F.lit(3), F.lit(6)))
    g = cell.withColumn("step", steps)
    late = F.col("step") / 3
    return g.select("i", "j", "step", (F.col("c") / 100 + late).alias("t2m"), (F.col("c") / 100 + late + 1).alias("tmax3"), (F.col("c") / 100 - late).alias("tmin3"), (F.col("a") / 9.0).alias("u10"), (F.col("b") / 7.0 - 3).alias("v10"), (F.col("a") * late / 4).alias("tp"), (F.col("b") / 50.0).alias("tcc"), (F.col("b") * (3 - late)).alias("snow"), (F.col("a") / 3.0).alias("gust"))


def terrain(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.groupBy((F.col("p_partkey") % 6).alias("i"), (F.floor(F.col("p_partkey") / 6) % 6).cast("long").alias("j")).agg((F.max("p_size") * 12.0).alias("orog"))


def sites(spark, sf_dir) -> DataFrame:
    """Suppliers as points within the grid."""
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("point"), ((F.col("s_suppkey") * 37 % 50) / 10.0).alias("y"), ((F.col("s_suppkey") * 73 % 49) / 10.0).alias("x"), F.abs("s_acctbal").cast("double").alias("elevation"))


GRID = """WITH cell AS (SELECT p_partkey % 6 AS i, p_partkey // 6 % 6 AS j, max(p_size) AS a, min(p_size) AS b, max(p_retailprice) AS c, max(p_size) * 12.0::DOUBLE AS orog FROM part GROUP BY ALL),
 g AS (SELECT i, j, step, orog, c / 100 + step / 3.0::DOUBLE AS t2m, c / 100 + step / 3.0::DOUBLE + 1 AS tmax3, c / 100 - step / 3.0::DOUBLE AS tmin3, a / 9.0::DOUBLE AS u10, b / 7.0::DOUBLE - 3 AS v10, a * step / 12.0::DOUBLE AS tp, b / 50.0::DOUBLE AS tcc, b * (3 - step / 3.0::DOUBLE) AS snow, a / 3.0::DOUBLE AS gust FROM cell, (VALUES (3), (6)) v(step)),
 site AS (SELECT s_suppkey AS point, s_suppkey * 37 % 50 / 10.0::DOUBLE AS y, s_suppkey * 73 % 49 / 10.0::DOUBLE AS x, abs(s_acctbal)::DOUBLE AS elevation FROM supplier),
 near AS (SELECT g1.i, g1.j, g1.step, regr_slope(g2.t2m, g2.orog) AS s, max(g2.orog) - min(g2.orog) AS relief FROM g g1 JOIN g g2 ON g1.step = g2.step AND abs(g1.i - g2.i) <= 1 AND abs(g1.j - g2.j) <= 1 GROUP BY ALL),
 gs AS (SELECT g.*, CASE WHEN relief >= 150 THEN coalesce(least(greatest(s, -0.0098), 0.004), -0.0065) ELSE -0.0065 END AS slope FROM g JOIN near USING (i, j, step)),
 k AS (SELECT site.*, gs.*, (1 - abs(y - i)) * (1 - abs(x - j)) AS w FROM site JOIN gs ON abs(y - i) < 1 AND abs(x - j) < 1),
 v AS (SELECT point, step, elevation, sum(w * t2m) AS t2m, sum(w * tmax3) AS tmax3, sum(w * tmin3) AS tmin3, sum(w * u10) AS u10, sum(w * v10) AS v10, sum(w * tp) AS tp, sum(w * tcc) AS tcc, sum(w * snow) AS snow, sum(w * gust) AS gust, sum(w * orog) AS orog, sum(w * slope) AS slope FROM k GROUP BY ALL HAVING sum(w) > 1 - 1e-9),
 cv AS (SELECT *, least(greatest(-0.0065 * (elevation - orog), -10), 10) AS std, least(greatest(slope * (elevation - orog), -10), 10) AS loc FROM v)"""


@query(GRID + " SELECT point, step, round(t2m + std + 1e-9, 5) AS std, round(t2m + loc + 1e-9, 5) AS local, round(t2m + 1e-9, 5) AS plain, round(loc + 1e-9, 5) AS correction, round(u10 + 1e-9, 5) AS u10 FROM cv")
def point_values(spark, sf_dir):
    g, t, s = grid(spark, sf_dir), terrain(spark, sf_dir), sites(spark, sf_dir)
    read = lambda lapse, *more: points.point_values(g, t, s, ["t2m", "u10"], lapse).select("point", "step", F.round(F.col("t2m") + 1e-9, 5).alias(lapse), *more)
    local = read("local", F.round(F.col("elevation_correction") + 1e-9, 5).alias("correction"), F.round(F.col("u10") + 1e-9, 5).alias("u10"))
    return read("std").join(local, ["point", "step"]).join(read("none").withColumnRenamed("none", "plain"), ["point", "step"])


@query(GRID + f""", f AS (SELECT *, CASE WHEN point % 2 = 0 THEN 1.25 ELSE 1 END AS k, CASE WHEN point % 3 = 0 THEN 0.5 ELSE 1 END AS r FROM cv)
SELECT point, step, round(t2m + std + 1e-9, 5) AS t2m, round(tmax3 + std + 1e-9, 5) AS tmax3, round(sqrt(u10 * u10 + v10 * v10) * k + 1e-9, 5) AS wind_speed, round({FLOOR_MOD.format('270 - degrees(atan2(v10, u10))')} + 1e-9, 4) AS wind_dir, round(gust * k + 1e-9, 5) AS gust, round(tp * r + 1e-9, 5) AS precip_accum,
  round(greatest(tp * r - coalesce(lag(tp * r) OVER o, 0), 0) + 1e-9, 5) AS precip, round(greatest(snow - coalesce(lag(snow) OVER o, 0), 0) + 1e-9, 5) AS snow, round(tcc + 1e-9, 5) AS cloud, round(std + 1e-9, 5) AS elevation_correction FROM f WINDOW o AS (PARTITION BY point ORDER BY step)""")
def downscaled_points(spark, sf_dir):
    s = sites(spark, sf_dir)
    factors = s.select("point", F.when(F.col("point") % 2 == 0, 1.25).alias("wind_factor"), F.when(F.col("point") % 3 == 0, 0.5).alias("precip_factor"))
    d = points.downscale(grid(spark, sf_dir), terrain(spark, sf_dir), s, factors)
    return d.select("point", "step", *[F.round(F.col(c) + 1e-9, 4 if c == "wind_dir" else 5).alias(c) for c in ("t2m", "tmax3", "wind_speed", "wind_dir", "gust", "precip_accum", "precip", "snow", "cloud", "elevation_correction")])


@query(GRID + """, h AS (SELECT point, max(t2m + std) FILTER (step = 3) AS a, max(t2m + std) FILTER (step = 6) AS b, max(t2m + loc) FILTER (step = 3) AS c, max(t2m + loc) FILTER (step = 6) AS d, max(tp) FILTER (step = 3) AS p, max(tp) FILTER (step = 6) AS q, max(tcc) AS cl, max(u10) AS u10 FROM cv GROUP BY point)
SELECT point, 3 AS step, round(a + 1e-9, 5) AS t2m, round(a + 1e-9, 5) AS tmax3, round(a + 1e-9, 5) AS tmin3, round(p + 1e-9, 5) AS precip, round(cl + 1e-9, 5) AS cloud, round(u10 + 1e-9, 5) AS u10 FROM h
UNION ALL SELECT point, 6, round(d + 1e-9, 5), round(greatest(c, d) + 1e-9, 5), round(least(c, d) + 1e-9, 5), round(greatest(q - p, 0) + 1e-9, 5), round(cl + 1e-9, 5), round(u10 + 1e-9, 5) FROM h""")
def member_dataset(spark, sf_dir):
    """A member without extremes of its own, by the standard lapse in the first window, the local one in the second."""
    g, t, s = grid(spark, sf_dir), terrain(spark, sf_dir), sites(spark, sf_dir)
    fields = ["t2m", "tp", "u10", "v10", "tcc"]
    steps = spark.createDataFrame([(3, True), (6, False)], "step int, is_day boolean")
    m = points.member_dataset(points.point_values(g, t, s, fields, "std"), points.point_values(g, t, s, fields, "local"), steps)
    return m.select("point", "step", *[F.round(F.col(c) + 1e-9, 5).alias(c) for c in ("t2m", "tmax3", "tmin3", "precip", "cloud", "u10")])


@query("""WITH v AS (SELECT vec_id, embedding[1]::DOUBLE * 9 AS u, embedding[2]::DOUBLE * 9 AS v, abs(embedding[3]::DOUBLE) * 12 AS s FROM embeddings) SELECT vec_id, round(CASE WHEN sqrt(u * u + v * v) > 1e-6 THEN u * s / sqrt(u * u + v * v) ELSE 0 END, 5) AS u, round(CASE WHEN sqrt(u * u + v * v) > 1e-6 THEN v * s / sqrt(u * u + v * v) ELSE 0 END, 5) AS v FROM v""")
def rescaled_wind(spark, sf_dir):
    x = lambda k: F.col("embedding")[k].cast("double")
    u, v = W.rescaled_wind(x(0) * 9, x(1) * 9, F.abs(x(2)) * 12)
    return rounded(table(spark, sf_dir, "embeddings").select("vec_id", u.alias("u"), v.alias("v")), 5)
