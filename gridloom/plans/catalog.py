"""Queries that exercise every operator on the common tables, each beside the SQL that it must equal.

The events table stands for weather data: a user is a point, 3-hour windows its series, event types are
ensemble members.  Results are rounded where sums depend on their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import times
from gridloom.functions import weather as W
from gridloom.operators import align, fitting, interpolate, periods, scores, windows
from gridloom.sources import reports, stores
from gridloom.streaming import live

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "period_aggregate"


def query(sql: str | None = None, dates: bool = False):
    """Registers a query; ``dates``: its column ``day`` is given as text."""

    def register(f):
        def told(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.withColumn("day", F.col("day").cast("string")) if dates else df

        told.__name__, told.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = told
        if sql:
            ORACLES[f.__name__] = f"SELECT * REPLACE (CAST(CAST(day AS DATE) AS VARCHAR) AS day) FROM ({sql})" if dates else sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.three_hourly(table(spark, sf_dir, "events"))


SERIES = """WITH s AS (
  SELECT user_id AS point, date_trunc('hour', ts) - to_hours(CAST(hour(ts) % 3 AS INT)) AS start, max(value) AS tmax3, min(value) AS tmin3, count(*) AS n, round(sum(value) / 25, 3) AS precip,
    max(value) FILTER (event_type = 'view') AS u10, max(value) FILTER (event_type = 'click') AS v10
  FROM events GROUP BY ALL
), series AS (
  SELECT *, start + to_hours(3) AS valid, CAST((epoch(start) - 1704067200) / 3600 AS INT) + 3 AS step FROM s
)"""
LOCAL = "start + to_hours(8)"
HALF = f"CASE WHEN hour({LOCAL}) >= 8 AND hour({LOCAL}) < 20 THEN 'day' ELSE 'night' END"
HALF_DATE = f"CASE WHEN hour({LOCAL}) < 8 THEN CAST({LOCAL} AS DATE) - 1 ELSE CAST({LOCAL} AS DATE) END"
FLOOR_MOD = "((({0}) % 360) + 360) % 360"


def ladder_sql(x: str, steps, op: str = "<") -> str:
    return "CASE " + " ".join(f"WHEN {x} {op} {b} THEN {w if isinstance(w, int) else repr(w)}" for b, w in steps[:-1]) + f" ELSE {steps[-1][1] if isinstance(steps[-1][1], int) else repr(steps[-1][1])} END"


BEAUFORT_SQL = lambda x: "CASE " + " ".join(f"WHEN {x} <= {b} THEN {k}" for k, b in enumerate(W.BEAUFORT)) + " ELSE 12 END"


# ---------------------------------------------------------------- functions


@query(f"""SELECT vec_id, round(sqrt(u * u + v * v), 6) AS speed, round({FLOOR_MOD.format('270 - degrees(atan2(v, u))')}, 6) AS direction,
  {BEAUFORT_SQL('round(sqrt(u * u + v * v), 6)')} AS force, CAST(floor(({FLOOR_MOD.format('270 - degrees(atan2(v, u))')}) / 22.5 + 0.5) AS BIGINT) % 16 AS sector
FROM (SELECT vec_id, embedding[1]::DOUBLE * 40 AS u, embedding[2]::DOUBLE * 40 AS v FROM embeddings)""")
def wind_vector(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("embedding")[0].cast("double") * 40).alias("u"), (F.col("embedding")[1].cast("double") * 40).alias("v"))
    speed, direction = F.round(W.wind_speed(F.col("u"), F.col("v")), 6), W.wind_direction(F.col("u"), F.col("v"))
    return e.select("vec_id", speed.alias("speed"), F.round(direction, 6).alias("direction"), W.beaufort(speed).alias("force"), W.compass16(direction).cast("long").alias("sector"))


@query(f"""SELECT l_orderkey, l_linenumber, {ladder_sql('l_quantity', W.RAIN_12H)} AS half, {ladder_sql('l_quantity', W.RAIN_24H)} AS full_day, {ladder_sql('l_tax * 100', W.SNOW_12H)} AS snow,
  {ladder_sql('l_discount * 10', ((0.35, '晴'), (0.75, '多云'), (9, '阴')))} AS sky, CASE WHEN l_quantity / 3 < 2.6 THEN '小雨' WHEN l_quantity / 3 < 7.7 THEN '中雨' WHEN l_quantity / 3 < 20 THEN '大雨' ELSE '强降水' END AS rate
FROM lineitem""")
def grade_ladder(spark, sf_dir):
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", W.rain_text(q, 12).alias("half"), W.rain_text(q, 24).alias("full_day"), W.snow_text(F.col("l_tax") * 100, 12).alias("snow"), W.sky_text(F.col("l_discount") * 10).alias("sky"), W.window_text(q, F.lit(0.0), F.lit(0.0), 3).alias("rate"))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity AS rain, l_tax * 100 AS snow, l_discount * 10 AS cloud FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN snow >= 0.1 AND rain - snow >= 0.1 AND rain - snow >= snow * 0.5 THEN '雨夹雪' WHEN snow >= 0.1 THEN """ + ladder_sql("snow", W.SNOW_12H) + " WHEN rain >= 0.1 THEN " + ladder_sql("rain", W.RAIN_12H) + " ELSE " + ladder_sql("cloud", ((0.35, "晴"), (0.75, "多云"), (9, "阴"))) + " END AS weather FROM x")
def half_day_weather(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", W.half_day_text(F.col("l_quantity"), F.col("l_tax") * 100, F.col("l_discount") * 10).alias("weather"))


@query("""SELECT l_orderkey, l_linenumber, CAST(least(5, greatest(1, round_even(date_diff('hour', o_orderdate, l_shipdate) / 24.0 / 20, 0))) AS INT) AS lead, strftime(l_shipdate, '%Y%m%d%H') AS stamp,
  CASE date_diff('day', o_orderdate, l_shipdate) WHEN 0 THEN '今天' WHEN 1 THEN '明天' WHEN 2 THEN '后天' ELSE list_value('周一','周二','周三','周四','周五','周六','周日')[CAST(isodow(l_shipdate) AS INT)] END AS label
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate >= o_orderdate""")
def lead_day_bround(spark, sf_dir):
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).where("l_shipdate >= o_orderdate")
    hours = F.timestamp_diff("HOUR", F.col("o_orderdate"), F.col("l_shipdate")).cast("double")
    return j.select("l_orderkey", "l_linenumber", W.lead_day(hours / 20).alias("lead"), times.run_stamp(F.col("l_shipdate")).alias("stamp"), times.relative_label(F.to_date("l_shipdate"), F.to_date("o_orderdate")).alias("label"))


@query(f"""SELECT vec_id, round(2 * 6371.0088 * asin(sqrt(pow(sin(radians(lat) / 2), 2) + cos(radians(lat)) * pow(sin(radians(lon) / 2), 2))), 3) AS km, round({FLOOR_MOD.format('lon * 9 + 180')} - 180, 6) AS wrapped, round(least(greatest(lat * 0.3, -10), 10), 6) AS correction, round(1 / (1 + exp(-least(greatest(lat, -30), 30))), 6) AS p, round(ln(least(greatest(lat, 0.3), 8)), 6) AS lw
FROM (SELECT vec_id, embedding[1]::DOUBLE * 100 AS lat, embedding[2]::DOUBLE * 100 AS lon FROM embeddings)""")
def scalar_functions(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("embedding")[0].cast("double") * 100).alias("lat"), (F.col("embedding")[1].cast("double") * 100).alias("lon"))
    lat, lon = F.col("lat"), F.col("lon")
    return e.select("vec_id", F.round(W.haversine_km(lat, lon, F.lit(0.0), F.lit(0.0)), 3).alias("km"), F.round(W.wrap_longitude(lon * 9), 6).alias("wrapped"), F.round(W.elevation_correction(F.lit(0.3), lat), 6).alias("correction"), F.round(W.logistic(lat), 6).alias("p"), F.round(W.log_wind(lat), 6).alias("lw"))


# ---------------------------------------------------------------- aggregation


@query(SERIES + f""", p AS (SELECT point, {HALF_DATE} AS day, {HALF} AS kind, CASE WHEN count(tmax3) = 4 THEN max(tmax3) END AS tmax, CASE WHEN count(tmin3) = 4 THEN min(tmin3) END AS tmin, round(CASE WHEN count(precip) = 4 THEN sum(precip) END, 3) AS precip, count(*) AS windows FROM series GROUP BY ALL)
SELECT *, CASE WHEN precip IS NOT NULL THEN {ladder_sql('precip', W.RAIN_12H)} END AS grade FROM p""", dates=True)
def period_aggregate(spark, sf_dir):
    return periods.by_period(series(spark, sf_dir)).withColumn("grade", W.rain_text(F.col("precip"), 12))


@query(SERIES + " SELECT CAST(valid + to_hours(8) AS DATE) AS day, max(tmax3) AS high, min(tmin3) AS low, count(DISTINCT point) AS points FROM series GROUP BY ALL", dates=True)
def county_summary(spark, sf_dir):
    s = series(spark, sf_dir)
    return s.groupBy(times.day_of(F.col("valid")).alias("day")).agg(F.max("tmax3").alias("high"), F.min("tmin3").alias("low"), F.countDistinct("point").alias("points"))


@query("WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY ALL) SELECT user_id, arg_max(event_type, n * 1000000000000 - f) AS event_type FROM c GROUP BY user_id")
def majority_first(spark, sf_dir):
    return periods.majority(table(spark, sf_dir, "events"), ["user_id"], "event_type", F.col("event_id"))


@query(SERIES + """, w AS (SELECT point, step - 3 AS a, CASE WHEN n > 1 THEN step + 3 ELSE step END AS b, (step - 3) // 24 * 24 AS x FROM series),
 h AS (SELECT point, x, unnest(range(a, b)) AS hour FROM w)
SELECT point, x AS from_h, count(DISTINCT hour) FILTER (hour < x + 24) = 24 AS covered FROM h GROUP BY point, x""")
def tiles_cover(spark, sf_dir):
    """Whether windows of three hours, six where there is more than one event, cover their day: hour by hour in the SQL."""
    s = series(spark, sf_dir).select("point", (F.col("step") - 3).alias("start_h"), F.when(F.col("n") > 1, F.col("step") + 3).otherwise(F.col("step")).alias("end_h"))
    d = (F.floor(F.col("start_h") / 24) * 24).cast("int")
    return periods.covers(s.withColumn("from_h", d).withColumn("to_h", d + 24), ["point", "from_h"])


# ---------------------------------------------------------------- joins

MEMBERS = ("view", "click", "purchase")


def members(spark, sf_dir):
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin(*MEMBERS))
    return e.groupBy("user_id", F.to_date("ts").alias("day"), F.col("event_type").alias("member")).agg(F.max("value").alias("t"))


MEMBER_SQL = "WITH m AS (SELECT user_id, CAST(ts AS DATE) AS day, event_type AS member, max(value) AS t FROM events WHERE event_type IN ('view', 'click', 'purchase') GROUP BY ALL)"


@query(MEMBER_SQL + " SELECT a.user_id, a.day, a.t AS f, b.t AS o FROM m a JOIN m b USING (user_id, day) WHERE a.member = 'view' AND b.member = 'click'", dates=True)
def matched_pairs(spark, sf_dir):
    m = members(spark, sf_dir)
    pick = lambda name, to: m.where(F.col("member") == name).select("user_id", "day", F.col("t").alias(to))
    return align.matched(pick("view", "f"), pick("click", "o"), ["user_id", "day"])


@query(MEMBER_SQL + " SELECT user_id, day, max(t) FILTER (member = 'view') AS view_t, max(t) FILTER (member = 'click') AS click_t, max(t) FILTER (member = 'purchase') AS purchase_t FROM m GROUP BY ALL", dates=True)
def member_full_outer(spark, sf_dir):
    m = members(spark, sf_dir)
    return align.members_wide({x: m.where(F.col("member") == x).select("user_id", "day", "t") for x in MEMBERS}, ["user_id", "day"])


BLEND = "SELECT user_id, day, round(CASE WHEN count(t) >= {0} THEN sum(w * t) / sum(w) END, 6) AS t, count(t) AS n_members FROM (SELECT *, CASE member WHEN 'view' THEN 0.5 WHEN 'click' THEN 0.3 ELSE 0.2 END AS w FROM m) GROUP BY ALL"
WEIGHTS = {"view": 0.5, "click": 0.3, "purchase": 0.2}


@query(MEMBER_SQL + BLEND.format(3), dates=True)
def blend_required(spark, sf_dir):
    return align.blend(members(spark, sf_dir), ["user_id", "day"], "t", WEIGHTS, 3).withColumn("t", F.round("t", 6))


@query(MEMBER_SQL + BLEND.format(2), dates=True)
def blend_min_members(spark, sf_dir):
    return align.blend(members(spark, sf_dir), ["user_id", "day"], "t", WEIGHTS, 2).withColumn("t", F.round("t", 6))


OVERLAP = SERIES + """, b AS (SELECT point, step // 6 * 6 AS start_h, step // 6 * 6 + 6 AS end_h, round(sum(precip), 3) AS mm FROM series GROUP BY ALL),
 d AS (SELECT DISTINCT point, (step + 8) // 24 * 24 - 8 AS from_h FROM series)
SELECT point, CAST(from_h AS BIGINT) AS from_h, round(sum(mm * (least(end_h, from_h + 24) - greatest(start_h, from_h)) / 6.0), 6) AS mm, CAST(sum(least(end_h, from_h + 24) - greatest(start_h, from_h)) AS BIGINT) AS hours
FROM b JOIN d USING (point) WHERE start_h < from_h + 24 AND end_h > from_h GROUP BY ALL"""


@query(OVERLAP)
def bucket_overlap(spark, sf_dir):
    s = series(spark, sf_dir)
    six = (F.floor(F.col("step") / 6) * 6).cast("long")
    b = s.groupBy("point", six.alias("start_h")).agg(F.round(F.sum("precip"), 3).alias("mm")).withColumn("end_h", F.col("start_h") + 6)
    d = s.select("point", (F.floor((F.col("step") + 8) / 24) * 24 - 8).cast("long").alias("from_h")).distinct().withColumn("to_h", F.col("from_h") + 24)
    return align.overlap_join(b, d, ["point"], 24).groupBy("point", "from_h").agg(F.round(F.sum(F.col("mm") * F.col("overlap") / 6.0), 6).alias("mm"), F.sum("overlap").cast("long").alias("hours"))


@query("""SELECT p.event_id, p.user_id, v.value AS last_view FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY ALL) v ON p.user_id = v.user_id AND p.ts >= v.ts""")
def asof_lookup(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    views = e.where("event_type = 'view'").groupBy("user_id", F.col("ts").alias("vts")).agg(F.max("value").alias("last_view"))
    return align.as_of(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), views, ["user_id"], "ts", "vts", ["last_view"]).select("event_id", "user_id", "last_view")


@query("""WITH c AS (SELECT p.event_id, v.value, row_number() OVER (PARTITION BY p.event_id ORDER BY abs(epoch_us(p.ts) - epoch_us(v.ts)), v.ts) AS k
  FROM events p JOIN events v ON p.user_id = v.user_id AND v.event_type = 'view' AND abs(epoch_us(p.ts) - epoch_us(v.ts)) <= 5400000000 WHERE p.event_type = 'purchase')
SELECT event_id, value AS near_view FROM c WHERE k = 1""")
def nearest_time(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return align.nearest(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), e.where("event_type = 'view'").select("user_id", "ts", F.col("value").alias("near_view")), ["user_id"], us, us, 5_400_000_000, "near_view").select("event_id", "near_view")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def orphan_keys(spark, sf_dir):
    """Customers without an urgent order."""
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return stores.orphans(table(spark, sf_dir, "customer").select("c_custkey"), urgent, "c_custkey")


# ---------------------------------------------------------------- windows


@query(SERIES + """ SELECT point, step, round(CASE WHEN count(*) OVER w6 = 2 THEN sum(precip) OVER w6 END, 3) AS p6, round(CASE WHEN count(*) OVER w24 = 8 THEN sum(precip) OVER w24 END, 3) AS p24
FROM series WINDOW w6 AS (PARTITION BY point ORDER BY step ROWS 1 PRECEDING), w24 AS (PARTITION BY point ORDER BY step ROWS 7 PRECEDING)""")
def running_sum_alerts(spark, sf_dir):
    r = windows.running_sums(series(spark, sf_dir), {"p6": 2, "p24": 8})
    return r.select("point", "step", F.round("p6", 3).alias("p6"), F.round("p24", 3).alias("p24"))


SPELLS = SERIES + """, f AS (SELECT point, step - 3 AS start_h, step AS end_h, CASE WHEN step - 3 <= lag(step) OVER (PARTITION BY point ORDER BY step) THEN 0 ELSE 1 END AS fresh FROM series WHERE precip >= 0.1),
 g AS (SELECT *, sum(fresh) OVER (PARTITION BY point ORDER BY start_h) AS spell FROM f), spells AS (SELECT point, CAST(spell AS BIGINT) AS spell, min(start_h) AS start_h, max(end_h) AS end_h, count(*) AS pieces FROM g GROUP BY ALL)"""


def wet(spark, sf_dir):
    s = series(spark, sf_dir).where("precip >= 0.1")
    return windows.spells(s.select("point", (F.col("step") - 3).alias("start_h"), F.col("step").alias("end_h")), ["point"])


@query(SPELLS + " SELECT * FROM spells")
def wet_spells(spark, sf_dir):
    return wet(spark, sf_dir)


@query(SPELLS + " SELECT point, day, greatest(start_h, day * 24) AS start_h, least(end_h, day * 24 + 24) AS end_h FROM (SELECT point, start_h, end_h, unnest(range(start_h // 24, (end_h - 1) // 24 + 1)) AS day FROM spells)")
def midnight_split(spark, sf_dir):
    return windows.split_at_midnight(wet(spark, sf_dir)).select("point", "day", "start_h", "end_h")


@query(SERIES + """, h AS (SELECT point, step, tmax3 >= 10 AS hit, sum(CASE WHEN tmax3 >= 10 THEN 0 ELSE 1 END) OVER (PARTITION BY point ORDER BY step) AS g FROM series)
SELECT point, step, CAST(sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER (PARTITION BY point, g ORDER BY step) AS BIGINT) AS run FROM h""")
def consecutive_runs(spark, sf_dir):
    return windows.run_lengths(series(spark, sf_dir), ["point"], "step", F.col("tmax3") >= 10).select("point", "step", "run")


@query(SERIES + " SELECT point, step, greatest(tmax3 - coalesce(lag(tmax3) OVER (PARTITION BY point ORDER BY step), 0), 0) AS increment FROM series")
def increments(spark, sf_dir):
    return windows.increments(series(spark, sf_dir), "tmax3").select("point", "step", "increment")


WORDING = """WITH x AS (SELECT user_id, event_id, event_type, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) THEN 0 ELSE 1 END AS c FROM events),
 y AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM x) SELECT user_id, event_type, min(event_id) AS first, max(event_id) AS last, count(*) AS rows FROM y GROUP BY user_id, g, event_type"""


@query(WORDING)
def same_wording(spark, sf_dir):
    return windows.same_wording(table(spark, sf_dir, "events"), ["user_id"], "event_id", "event_type")


# The same in pieces, as long histories want it: two days or five hundred reports at a time.


@query(ORACLES["running_sum_alerts"])
def running_sums_in_pieces(spark, sf_dir):
    r = windows.running_sums(series(spark, sf_dir), {"p6": 2, "p24": 8}, span=48)
    return r.select("point", "step", F.round("p6", 3).alias("p6"), F.round("p24", 3).alias("p24"))


@query(ORACLES["wet_spells"])
def spells_in_pieces(spark, sf_dir):
    s = series(spark, sf_dir).where("precip >= 0.1")
    return windows.spells(s.select("point", (F.col("step") - 3).alias("start_h"), F.col("step").alias("end_h")), ["point"], span=48)


@query(ORACLES["consecutive_runs"])
def runs_in_pieces(spark, sf_dir):
    return windows.run_lengths(series(spark, sf_dir), ["point"], "step", F.col("tmax3") >= 10, span=48).select("point", "step", "run")


@query(ORACLES["increments"])
def increments_in_pieces(spark, sf_dir):
    return windows.increments(series(spark, sf_dir), "tmax3", span=48).select("point", "step", "increment")


@query(ORACLES["same_wording"])
def wording_in_pieces(spark, sf_dir):
    return windows.same_wording(table(spark, sf_dir, "events"), ["user_id"], "event_id", "event_type", span=500)


@query(SERIES + """, p AS (SELECT point, step, (SELECT arg_max(z.step, z.precip * 1000000 - z.step) FROM series z WHERE z.point = s.point AND z.step <= s.step AND z.step > s.step - 6) AS x FROM series s)
SELECT point, step, CASE WHEN lag(step) OVER (PARTITION BY point ORDER BY step) = step - 3 THEN x ELSE -1 END AS peak_step FROM p""")
def peak_dating(spark, sf_dir):
    from pyspark.sql import Window

    p = windows.peak_in_window(series(spark, sf_dir), 2)
    near = F.lag("step").over(Window.partitionBy("point").orderBy("step")) == F.col("step") - 3
    return p.select("point", "step", F.when(near, F.col("peak_step")).otherwise(-1).alias("peak_step"))


# ---------------------------------------------------------------- interpolation


def grid(spark, sf_dir):
    n, p = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "part")
    return p.groupBy((F.col("p_partkey") % 12).cast("double").alias("lat"), F.col("p_size").cast("double").alias("lon")).agg(F.round(F.avg("p_retailprice"), 2).alias("t"), F.max("p_partkey").cast("double").alias("z"))


GRID = "WITH grid AS (SELECT (p_partkey % 12)::DOUBLE AS lat, p_size::DOUBLE AS lon, round(avg(p_retailprice), 2) AS t, max(p_partkey)::DOUBLE AS z FROM part GROUP BY ALL)"


@query(GRID + """, pts AS (SELECT s_suppkey AS point, (s_suppkey % 10) + 0.25 AS lat, (s_suppkey % 40) + 1.5 AS lon FROM supplier), w AS (
  SELECT point, g.t, (CASE WHEN g.lat = floor(p.lat) THEN 1 - (p.lat - floor(p.lat)) ELSE p.lat - floor(p.lat) END) * (CASE WHEN g.lon = floor(p.lon) THEN 1 - (p.lon - floor(p.lon)) ELSE p.lon - floor(p.lon) END) AS w
  FROM pts p JOIN grid g ON g.lat IN (floor(p.lat), floor(p.lat) + 1) AND g.lon IN (floor(p.lon), floor(p.lon) + 1))
SELECT point, round(CASE WHEN count(*) = 4 THEN sum(w * t) END, 6) AS t FROM w GROUP BY point""")
def bilinear_grid(spark, sf_dir):
    pts = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("point"), (F.col("s_suppkey") % 10 + 0.25).alias("lat"), (F.col("s_suppkey") % 40 + 1.5).alias("lon"))
    return interpolate.bilinear(grid(spark, sf_dir).drop("z"), pts, "t", []).withColumn("t", F.round("t", 6))


@query(GRID + """ SELECT CAST(a.lat AS BIGINT) AS i, CAST(a.lon AS BIGINT) AS j, round(CASE WHEN max(b.z) - min(b.z) >= 150 THEN least(greatest(regr_slope(b.t, b.z), -0.5), 0.5) END, 6) AS slope FROM grid a JOIN grid b ON abs(a.lat - b.lat) <= 1 AND abs(a.lon - b.lon) <= 1 GROUP BY ALL""")
def local_slope(spark, sf_dir):
    g = grid(spark, sf_dir).select(F.col("lat").cast("long").alias("i"), F.col("lon").cast("long").alias("j"), "t", "z")
    return interpolate.local_slope(g, 1, "t", "z", 150, -0.5, 0.5).select("i", "j", F.round("slope", 6).alias("slope"))


@query(SERIES + """, n AS (SELECT point, step, CASE WHEN step % 2 = 0 THEN tmax3 END AS v FROM series),
 h AS (SELECT *, max(CASE WHEN v IS NOT NULL THEN step END) OVER (PARTITION BY point ORDER BY step) AS a, min(CASE WHEN v IS NOT NULL THEN step END) OVER (PARTITION BY point ORDER BY step ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM n)
SELECT h.point, h.step, round(coalesce(h.v, x.v + (y.v - x.v) * (h.step - h.a) / (h.b - h.a)::DOUBLE), 7) AS v FROM h LEFT JOIN n x ON x.point = h.point AND x.step = h.a LEFT JOIN n y ON y.point = h.point AND y.step = h.b""")
def time_lerp(spark, sf_dir):
    s = series(spark, sf_dir).select("point", "step", F.when(F.col("step") % 2 == 0, F.col("tmax3")).alias("v"))
    return interpolate.between_nodes(s, "step", "v", ["point"]).select("point", "step", F.round("v", 7).alias("v"))


@query(SERIES + """, sh AS (SELECT user_id AS point, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) // 3600 - 473352 + 1 AS hour, count(*)::DOUBLE AS shape FROM events GROUP BY ALL),
 x AS (SELECT point, step, precip, unnest(range(step - 2, step + 1)) AS hour FROM series), y AS (SELECT x.*, coalesce(sh.shape, 0) AS shape, sum(coalesce(sh.shape, 0)) OVER (PARTITION BY x.point, x.step) AS a FROM x LEFT JOIN sh USING (point, hour))
SELECT point, step, CAST(hour AS INT) AS hour, round(precip * CASE WHEN a > 0.000001 THEN shape / a ELSE 1.0 / 3 END, 7) AS amount FROM y""")
def disaggregate(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    hour = (F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600) - 473352 + 1).cast("int")
    shape = e.groupBy(F.col("user_id").alias("point"), hour.alias("hour")).agg(F.count("*").cast("double").alias("shape"))
    w = series(spark, sf_dir).select("point", "step", F.col("precip").alias("total"))
    return interpolate.disaggregate(w, shape, 3, ["point"]).select("point", "step", "hour", F.round("amount", 7).alias("amount"))


# ---------------------------------------------------------------- scores

PAIRS = MEMBER_SQL + ", p AS (SELECT a.user_id, a.day, a.t AS f, b.t AS o, CAST(a.user_id % 5 + 1 AS INT) AS lead FROM m a JOIN m b USING (user_id, day) WHERE a.member = 'view' AND b.member = 'click')"


def pairs(spark, sf_dir):
    return matched_pairs(spark, sf_dir).withColumn("lead", (F.col("user_id") % 5 + 1).cast("int"))


def rounded(df: DataFrame, n: int = 6) -> DataFrame:
    return df.select(*[F.round(c, n).alias(c) if t == "double" else c for c, t in df.dtypes])


@query(PAIRS + " SELECT lead, count(*) AS n, round(avg(abs(f - o)), 6) AS mae, round(avg(f - o), 6) AS bias, round(avg(CASE WHEN abs(f - o) <= 2 THEN 100.0 ELSE 0 END), 6) AS within2 FROM p GROUP BY lead")
def temp_scores(spark, sf_dir):
    return rounded(pairs(spark, sf_dir).groupBy("lead").agg(*scores.temperature_scores(F.col("f"), F.col("o"))))


@query(PAIRS + """, c AS (SELECT lead, count(*) FILTER (f >= 30 AND o >= 30) AS a, count(*) FILTER (f >= 30 AND o < 30) AS b, count(*) FILTER (f < 30 AND o >= 30) AS c, count(*) FILTER (f < 30 AND o < 30) AS d FROM p GROUP BY lead)
SELECT lead, a AS hits, b AS false_alarms, c AS misses, d AS dry, round(100.0 * (a + d) / nullif(a + b + c + d, 0), 6) AS correct, round(100.0 * a / nullif(a + b + c, 0), 6) AS threat, round(100.0 * a / nullif(a + c, 0), 6) AS detected, round(100.0 * b / nullif(a + b, 0), 6) AS false_ratio, round(1.0 * (a + b) / nullif(a + c, 0), 6) AS frequency_bias FROM c""")
def rain_contingency(spark, sf_dir):
    return rounded(pairs(spark, sf_dir).groupBy("lead").agg(*scores.rain_scores(F.col("f"), F.col("o"), 30.0, 30.0)))


@query(PAIRS + """, q AS (SELECT lead, least(f / 100, 1.0) AS f, (o >= 20)::INT::DOUBLE AS o FROM p), r AS (SELECT q.*, c.clim, CAST(least(floor(f * 10), 9) AS INT) AS bin FROM q, (SELECT avg(o) AS clim FROM q) c)
SELECT coalesce(bin, -1) AS bin, coalesce(lead, -1) AS lead, count(*) AS n, round(avg(f), 6) AS forecast, round(avg(o), 6) AS frequency, round(avg(pow(f - o, 2)), 6) AS brier, round(1 - avg(pow(f - o, 2)) / nullif(avg(pow(clim - o, 2)), 0), 6) AS skill, grouping(bin, lead)::BIGINT AS level FROM r GROUP BY GROUPING SETS ((), (bin), (lead))""")
def brier_reliability(spark, sf_dir):
    p = pairs(spark, sf_dir)
    return rounded(scores.probability_scores(p, F.least(F.col("f") / 100, F.lit(1.0)), F.col("o") >= 20, ["lead"]).na.fill(-1, ["bin", "lead"]))


@query(PAIRS + " SELECT lead, count(*) FILTER (o <= 5) AS events, count(*) FILTER (o <= 5 AND f <= 5) AS hits, count(*) FILTER (f <= 5 AND o > 5) AS false_alarms, round(avg(f - o) FILTER (o <= 5), 6) AS event_bias FROM p GROUP BY lead")
def frost_scores(spark, sf_dir):
    return rounded(pairs(spark, sf_dir).groupBy("lead").agg(*scores.frost_scores(F.col("f"), F.col("o"), 5.0)))


@query(PAIRS + """, g AS (SELECT * FROM (VALUES (0, 10.0), (1, 20.0), (2, 40.0), (3, 80.0)) v(k, lim)), s AS (SELECT k, lim, avg(((f >= lim) = (o >= 20))::INT) AS correct FROM p, g GROUP BY ALL)
SELECT lim::DOUBLE AS threshold, round(correct, 6) AS correct FROM s ORDER BY s.correct DESC, k LIMIT 1""")
def best_threshold(spark, sf_dir):
    return rounded(scores.best_threshold(pairs(spark, sf_dir), [10, 20, 40, 80], "f", "o", 20.0))


# ---------------------------------------------------------------- fitting


@query(PAIRS + """, q AS (SELECT quantile_cont(f, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS fq, quantile_cont(o, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS oq FROM p),
 x AS (SELECT p.*, fq, oq, least(greatest(len(list_filter(fq, lambda z: z < f)), 1), 10) AS i FROM p, q)
SELECT user_id, day, round(greatest(least(oq[i] + (oq[i + 1] - oq[i]) * least(greatest(coalesce((f - fq[i]) / nullif(fq[i + 1] - fq[i], 0), 0), 0), 1), 1.5 * f), 0), 4) AS mapped FROM x""", dates=True)
def quantile_map(spark, sf_dir):
    p = pairs(spark, sf_dir).withColumn("kind", F.lit("all"))
    m = p.join(F.broadcast(fitting.quantile_map(p, ["kind"], "f", "o", 11, least=1)), "kind", "left")
    return m.select("user_id", "day", F.round(fitting.map_value(F.col("f"), F.col("fq"), F.col("oq")), 4).alias("mapped"))


@query(PAIRS + """, w AS (SELECT lead, f, user_id + 1.0 AS w FROM p), c AS (SELECT lead, f, sum(w) OVER k AS c, first_value(w) OVER k AS w0, sum(w) OVER (PARTITION BY lead) AS t FROM w WINDOW k AS (PARTITION BY lead ORDER BY f, w ROWS UNBOUNDED PRECEDING)),
 a AS (SELECT lead, f, (c - w0) / nullif(t - w0, 0) AS p FROM c), b AS (SELECT *, lead(p) OVER z AS np, lead(f) OVER z AS nf FROM a WINDOW z AS (PARTITION BY lead ORDER BY f, p))
SELECT b.lead, q.prob, round(max(f + coalesce((nf - f) * (q.prob - p) / nullif(np - p, 0), 0)), 4) AS q FROM b, (VALUES (0.1::DOUBLE), (0.5), (0.9)) q(prob) WHERE q.prob >= p AND q.prob < coalesce(np, 2) GROUP BY ALL""")
def weighted_quantile(spark, sf_dir):
    p = pairs(spark, sf_dir).withColumn("w", F.col("user_id") + 1.0)
    return fitting.weighted_quantiles(p, ["lead"], "f", "w", [0.1, 0.5, 0.9]).withColumn("q", F.round("q", 4))


@query(PAIRS + " SELECT lead, round(sum(pow(0.5, date_diff('day', day, nd) / 10.0) * (f - o)) / sum(pow(0.5, date_diff('day', day, nd) / 10.0)), 6) AS bias FROM (SELECT *, max(day) OVER () AS nd FROM p) GROUP BY lead")
def recency_mean(spark, sf_dir):
    p = pairs(spark, sf_dir)
    newest = p.agg(F.max("day").alias("nd"))
    w = fitting.recency_weight(F.col("day"), F.col("nd"), 10.0)
    return p.crossJoin(F.broadcast(newest)).groupBy("lead").agg(F.round(F.sum(w * (F.col("f") - F.col("o"))) / F.sum(w), 6).alias("bias"))


EWMA = PAIRS + """, d AS (SELECT lead, day, avg(f - o) AS e, row_number() OVER (PARTITION BY lead ORDER BY day) AS k FROM p GROUP BY lead, day), n AS (SELECT *, max(k) OVER (PARTITION BY lead) AS n FROM d)
SELECT lead, round(sum(e * CASE WHEN k = 1 THEN pow(0.9, n - 1) ELSE 0.1 * pow(0.9, n - k) END), 6) AS bias, max(n)::INT AS times FROM n GROUP BY lead"""


@query(EWMA)
def ewma_bias(spark, sf_dir):
    return rounded(fitting.ewma_bias(pairs(spark, sf_dir).withColumn("e", F.col("f") - F.col("o")), ["lead"], "day", "e", 0.1))


# ---------------------------------------------------------------- stores and products


@query("SELECT event_id, user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS k FROM events) WHERE k = 1")
def upsert_last_wins(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    return stores.last_wins(e, ["user_id", "event_type"], [F.col("event_id")])


@query("SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def retention(spark, sf_dir):
    return stores.retained(table(spark, sf_dir, "events"), "ts", 7).select("event_id")


@query("SELECT o_custkey, o_orderkey, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders) WHERE place <= 3")
def index_newest(spark, sf_dir):
    return stores.newest(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey", "place")


@query(SERIES + " SELECT point, string_agg(step::VARCHAR, ',' ORDER BY step) AS steps, string_agg(tmax3::VARCHAR, ',' ORDER BY step) AS highs FROM series WHERE step <= 72 GROUP BY point")
def columnar_series(spark, sf_dir):
    s = series(spark, sf_dir).where("step <= 72")
    packed = s.groupBy("point").agg(F.array_sort(F.collect_list(F.struct("step", "tmax3"))).alias("s"))
    return packed.select("point", F.array_join(F.transform("s", lambda x: x["step"].cast("string")), ",").alias("steps"), F.array_join(F.transform("s", lambda x: x["tmax3"].cast("string")), ",").alias("highs"))


@query("SELECT event_type, sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS total FROM events GROUP BY event_type")
def json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("total"))


# ---------------------------------------------------------------- streaming forms, run as batch on the same code


@query("SELECT time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '2024-01-01') AS start, event_type, max(value) AS high, min(value) AS low, count(*) AS n FROM events GROUP BY ALL")
def stream_tumbling(spark, sf_dir):
    return live.tumbling(table(spark, sf_dir, "events"))


@query("""WITH x AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 3 HOUR THEN 0 ELSE 1 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), y AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM x)
SELECT min(ts) AS start, user_id, count(*) AS n, max(value) AS high FROM y GROUP BY user_id, g""")
def stream_session(spark, sf_dir):
    return live.sessions(table(spark, sf_dir, "events"))


@query("SELECT (time_bucket(INTERVAL 3 HOUR, ts, TIMESTAMP '2024-01-01') - to_hours(CAST(3 * k AS INT))) AS start, event_type, max(value) AS high, count(*) AS n FROM events, range(8) r(k) GROUP BY ALL")
def stream_sliding(spark, sf_dir):
    return live.sliding(table(spark, sf_dir, "events"))


@query("""WITH r AS (SELECT CAST(54400 + user_id % 10 AS VARCHAR) AS wmo, date_trunc('hour', ts) AS time, CAST(round(max(value)) AS BIGINT) % 400 AS t, count(*) AS n, min(event_id) AS k FROM events GROUP BY ALL)
SELECT wmo, strftime(time, '%Y-%m-%d %H:%M') AS time, round(CASE WHEN k % 3 = 0 THEN -t ELSE t END / 10.0::DOUBLE, 1) AS t, (k % 37 * 10)::DOUBLE AS wind_dir, (t % 30)::DOUBLE AS wind_speed, CASE WHEN k % 4 = 0 THEN 0.0 ELSE CASE WHEN k % 1000 = 990 THEN 0.05 WHEN k % 1000 > 990 THEN (k % 1000 - 990) / 10.0 ELSE k % 1000 END END::DOUBLE AS p6, CASE WHEN n > 1 THEN n END::INT AS ww FROM r""")
def report_decode(spark, sf_dir):
    """Coded reports of each region and hour with events, made of the table and read again; one line in ten is cut off and is no report.

    A report's group for the weather has two digits, so a count is told by as many reports as it has pairs of digits, the lowest first.
    """
    two, three = (lambda c: F.lpad(c.cast("string"), 2, "0")), (lambda c: F.lpad(c.cast("string"), 3, "0"))
    r = table(spark, sf_dir, "events").groupBy((54400 + F.col("user_id") % 10).cast("string").alias("wmo"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("time"))
    r = r.agg((F.round(F.max("value")).cast("long") % 400).alias("t"), F.count("*").alias("n"), F.min("event_id").alias("k"))
    r = r.withColumn("part", F.explode(F.sequence(F.lit(0), F.expr("(length(CAST(n AS STRING)) - 1) div 2").cast("int"))))
    k, t, n = F.col("k"), F.col("t"), F.col("n")
    pair = F.lpad(n.cast("string"), 20, "0").substr(19 - 2 * F.col("part"), F.lit(2))
    groups = [F.lit("AAXX"), F.concat(F.date_format("time", "ddHH"), F.lit("1")), F.col("wmo"), F.when(k % 4 == 0, "32970").otherwise("12970"), F.concat(F.lit("5"), two(k % 37), two(t % 30)), F.concat(F.lit("1"), F.when(k % 3 == 0, "1").otherwise("0"), three(t)), F.when(k % 4 != 0, F.concat(F.lit("6"), three(k % 1000), F.lit("1"))), F.when(n > 1, F.concat(F.lit("7"), pair, F.lit("00")))]
    line = F.concat(F.col("wmo"), F.date_format("time", ",yyyy,MM,dd,HH,mm,"), F.concat_ws(" ", *groups), F.lit("="))
    lines = r.select("part", F.explode(F.when(k % 10 == 0, F.array(line, F.substring(line, 1, 12))).otherwise(F.array(line))).alias("line"))
    told = reports.decode_reports(lines, ("part",)).withColumn("ww", F.col("ww") * F.expr("CAST(rpad('1', 1 + 2 * part, '0') AS BIGINT)"))
    first = lambda c: F.max(F.when(F.col("part") == 0, F.col(c))).alias(c)
    return told.groupBy("wmo", F.date_format("time", "yyyy-MM-dd HH:mm").alias("time")).agg(*[first(c) for c in ("t", "wind_dir", "wind_speed", "p6")], F.sum("ww").cast("int").alias("ww"))


from gridloom.plans import archives, backtests, calibrations, consensus, documents, observed, places, products, runs, stored  # noqa: E402, F401  (they register their queries)
