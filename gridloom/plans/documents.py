"""Queries of corrections, documents, texts, stores and catalogues, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import times
from gridloom.functions import weather as W
from gridloom.operators import alerts as A
from gridloom.operators import corrections as X
from gridloom.operators import documents as D
from gridloom.operators import periods
from gridloom.plans.catalog import BEAUFORT_SQL, FLOOR_MOD, ladder_sql, query, rounded, table
from gridloom.plans.runs import FULL_CELLS, REGIONS, region_cells, region_series
from gridloom.sources import messages, stores

# ---------------------------------------------------------------- corrections


def runs_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A run a day at 00 UTC: windows to 72 hours, and five periods from the twelfth hour on."""
    init = table(spark, sf_dir, "events").select(F.to_date("ts").cast("timestamp_ntz").alias("init")).distinct()
    steps = init.select("init", F.explode(F.sequence(F.lit(3), F.lit(84), F.lit(3))).alias("step"))
    k = F.explode(F.sequence(F.lit(0), F.lit(4)))
    p = init.select("init", k.alias("k")).select("init", "k", (F.col("k") * 12 + 12).alias("start_lead"), (F.col("k") * 12 + 24).alias("end_lead"), F.when(F.col("k") % 2 == 0, "night").otherwise("day").alias("kind"))
    return steps, p


@query("""WITH i AS (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events), s AS (SELECT d, CAST(step AS INT) AS step FROM i, range(3, 85, 3) r(step))
SELECT CAST(d AS VARCHAR) AS init, step, CASE WHEN step - 3 >= 12 AND step <= 72 THEN CASE WHEN ((step - 3) // 12) % 2 = 1 THEN 'night' ELSE 'day' END WHEN (step + 5) % 24 BETWEEN 8 AND 19 THEN 'day' ELSE 'night' END AS kind,
  CAST(CASE WHEN step - 3 >= 12 AND step <= 72 THEN least(5, greatest(1, round_even(((step - 3) // 12 * 12 + 12 - 11.5) / 24, 0))) WHEN step <= 12 THEN 1 ELSE 5 END AS INT) AS lead, CAST(CASE WHEN step - 3 >= 12 AND step <= 72 THEN (step - 3) // 12 - 1 END AS INT) AS k FROM s""")
def window_keys(spark, sf_dir):
    w, p = runs_of(spark, sf_dir)
    k = X.window_keys(w, p, F.lit(11.5), outside="edge")
    return k.select(F.date_format("init", "yyyy-MM-dd").alias("init"), "step", "kind", "lead", "k")


FQ, OQ = [0.0, 4.0, 20.0, 60.0], [0.0, 2.0, 24.0, 50.0]
MAP = "greatest(least(CASE WHEN {0} > 60 THEN {0} * 50 / 60 WHEN {0} <= 4 THEN {0} * 0.5 WHEN {0} <= 20 THEN 2 + ({0} - 4) / 16 * 22 ELSE 24 + ({0} - 20) / 40 * 26 END, 1.5 * {0}), 0)"


def correction(spark) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame([("day", 1, 0.5), ("night", 2, -1.25)], "kind string, lead int, bias double"), spark.createDataFrame([("day", FQ, OQ)], "kind string, fq array<double>, oq array<double>")


LEADS = REGIONS + f""", z AS (SELECT *, CAST(day(date) % 5 + 1 AS INT) AS lead, sum(precip) OVER (PARTITION BY point, date, kind) AS tot FROM rs), fc AS (SELECT *, CASE WHEN tot > 1e-6 THEN CASE kind WHEN 'day' THEN {MAP.format('tot')} ELSE tot END / tot ELSE 0 END AS f, CASE WHEN kind = 'day' AND lead = 1 THEN 0.5 WHEN kind = 'night' AND lead = 2 THEN -1.25 ELSE 0 END AS b FROM z)"""


@query(LEADS + " SELECT point, step, round(t2m - b + 1e-9, 5) AS t2m, round(tmax3 - b + 1e-9, 5) AS tmax3, round(precip * f + 1e-9, 5) AS precip, round(snow * f + 1e-9, 5) AS snow FROM fc")
def corrected_series(spark, sf_dir):
    s = region_series(spark, sf_dir).withColumn("lead", (F.day("date") % 5 + 1).cast("int"))
    c, _ = X.corrected(s, ["point", "date", "kind"], *correction(spark))
    return c.select("point", "step", *[F.round(F.col(x) + 1e-9, 5).alias(x) for x in ("t2m", "tmax3", "precip", "snow")])


@query(LEADS + """, f1 AS (SELECT DISTINCT point, date, kind, f FROM fc), h AS (SELECT user_id % 10 AS point, date_trunc('hour', ts) AS hour, round(sum(value), 2) AS mm FROM events GROUP BY ALL), hk AS (SELECT point, hour, mm, hour - to_hours(CAST(hour(hour) % 3 AS INT)) AS start FROM h)
SELECT hk.point, hk.hour, round(hk.mm * f + 1e-9, 4) AS precip FROM hk JOIN rs ON rs.point = hk.point AND rs.start = hk.start JOIN f1 ON f1.point = rs.point AND f1.date = rs.date AND f1.kind = rs.kind""")
def corrected_hours(spark, sf_dir):
    """Hourly amounts by the factors of the 3-hourly series."""
    s = region_series(spark, sf_dir).withColumn("lead", (F.day("date") % 5 + 1).cast("int"))
    period = ["point", "date", "kind"]
    _, factors = X.corrected(s, period, *correction(spark))
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    kind, date = times.half_of(times.floor_hours(F.col("hour"), 3))
    h = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 10).alias("point"), hour.alias("hour")).agg(F.round(F.sum("value"), 2).alias("precip")).withColumn("kind", kind).withColumn("date", date)
    return X.scaled(h, factors, period).select("point", "hour", F.round(F.col("precip") + 1e-9, 4).alias("precip"))


@query(f"""WITH s AS (SELECT user_id % 3 AS point, event_type AS member, date_trunc('hour', ts) - to_hours(CAST(hour(ts) % 3 AS INT)) AS start, round(sum(value) / 25, 3) AS mm FROM events GROUP BY ALL), k AS (SELECT *, CAST(start AS DATE) AS date, CASE WHEN hour(start) < 12 THEN 'day' ELSE 'night' END AS kind FROM s),
 t AS (SELECT *, count(*) OVER w AS n, sum(mm) OVER w AS tot FROM k WINDOW w AS (PARTITION BY point, member, date, kind)), f AS (SELECT *, CASE kind WHEN 'day' THEN {MAP.format('tot')} ELSE tot * 0.4 END AS mapped FROM t WHERE n = 4 AND member <> 'signup')
SELECT point, date AS day, kind, -1 AS hour, round(CASE WHEN count(DISTINCT member) >= 3 THEN 100.0 * count(DISTINCT member) FILTER (mapped >= 8) / count(DISTINCT member) END, 4) AS pop, count(DISTINCT member) AS members FROM f GROUP BY ALL
UNION ALL SELECT point, date, kind, CAST(hour(start) AS INT), round(CASE WHEN count(*) >= 3 THEN 100.0 * avg((CASE WHEN tot > 1e-6 THEN mm * mapped / tot ELSE 0 END >= 8)::INT) END, 4), count(*) FROM f GROUP BY ALL""", dates=True)
def member_chances(spark, sf_dir):
    start = times.floor_hours(F.col("ts"), 3)
    s = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 3).alias("point"), F.col("event_type").alias("member"), start.alias("start")).agg(F.round(F.sum("value") / 25, 3).alias("precip"))
    s = s.withColumn("date", F.to_date("start")).withColumn("kind", F.when(F.hour("start") < 12, "day").otherwise("night")).withColumn("step", F.hour("start"))
    names = ("view", "click", "purchase", "error")
    fits = spark.createDataFrame([(m, "day", FQ, OQ) for m in names] + [(m, "night", [0.0, 1000.0], [0.0, 400.0]) for m in names], "member string, kind string, fq array<double>, oq array<double>")
    a, b = X.member_chances(s, ["point", "date", "kind"], fits, wet=8.0)
    both = a.withColumn("hour", F.lit(-1)).select("point", "date", "kind", "hour", "pop", "members").unionByName(b.withColumn("hour", F.col("step")).select("point", "date", "kind", "hour", "pop", "members"))
    return both.select("point", F.col("date").alias("day"), "kind", "hour", F.round("pop", 4).alias("pop"), "members")


# ---------------------------------------------------------------- columnar documents

WORDS = f"CASE WHEN snow >= 0.1 AND precip - snow >= 0.1 THEN '雨夹雪' WHEN snow >= 0.1 THEN '雪' WHEN precip >= 0.1 THEN CASE WHEN precip / {{0}} < 2.6 THEN '小雨' WHEN precip / {{0}} < 7.7 THEN '中雨' WHEN precip / {{0}} < 20 THEN '大雨' ELSE '强降水' END ELSE {ladder_sql('cloud', ((0.35, '晴'), (0.75, '多云'), (9, '阴')))} END"
DIR = FLOOR_MOD.format("270 - degrees(atan2(v, u))")


@query(REGIONS + f""", k AS (SELECT *, {WORDS.format(3)} AS word, {BEAUFORT_SQL('w')} AS force, {DIR} AS dir FROM rs WHERE step > 6 AND step <= 78)
SELECT point, string_agg(CAST(step AS VARCHAR), ',' ORDER BY step) AS lead_h, string_agg(strftime(valid + to_hours(8), '%Y-%m-%dT%H:00'), ',' ORDER BY step) AS times, string_agg(word, ',' ORDER BY step) AS weather, string_agg(CAST(force AS VARCHAR), ',' ORDER BY step) AS force, string_agg(list_value('北风','东北风','东风','东南风','南风','西南风','西风','西北风')[CAST(floor(dir / 45 + 0.5) AS INT) % 8 + 1], ',' ORDER BY step) AS wind,
  count(gust) AS gusts, string_agg(CAST(CAST(round_even(cloud * 100, 0) AS INT) AS VARCHAR), ',' ORDER BY step) AS cloud FROM k GROUP BY point""")
def series_document(spark, sf_dir):
    """72 hours from an issue at the sixth hour of the first day."""
    s = region_series(spark, sf_dir).withColumn("init", F.lit("2024-01-01").cast("timestamp_ntz")).withColumn("pop", F.lit(None).cast("double"))
    d = D.series3h(s, F.lit("2024-01-01 06:00:00").cast("timestamp_ntz"), 72)
    join = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return d.select("point", join("lead_h").alias("lead_h"), join("times").alias("times"), join("weather").alias("weather"), join("wind_force").alias("force"), join("wind_name").alias("wind"), F.size(F.array_compact("gust")).cast("long").alias("gusts"), join("cloud").alias("cloud"))


@query("""WITH h AS (SELECT user_id % 10 AS point, CAST((epoch(date_trunc('hour', ts)) - 1704067200) / 3600 AS INT) + 1 AS step, round(sum(value) / 25, 2) AS precip, max(value) AS hi FROM events GROUP BY ALL), k AS (SELECT *, 0.0 AS snow, least(hi / 200, 1) AS cloud FROM h)
SELECT point, count(*) AS hours, string_agg(""" + WORDS.format(1) + """, ',' ORDER BY step) AS weather, strftime(TIMESTAMP '2024-01-01 08:00:00' + to_hours(max(step)), '%Y-%m-%dT%H:00') AS last FROM k GROUP BY point""")
def hourly_document(spark, sf_dir):
    hour = ((F.unix_timestamp(F.date_trunc("hour", "ts")) - 1704067200) / 3600).cast("int") + 1
    h = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 10).alias("point"), hour.alias("step")).agg(F.round(F.sum("value") / 25, 2).alias("precip"), F.max("value").alias("hi"))
    n = F.lit(None).cast("double")
    h = h.select("point", "step", F.lit("2024-01-01").cast("timestamp_ntz").alias("init"), F.col("hi").alias("t2m"), "precip", F.lit(0.0).alias("snow"), F.least(F.col("hi") / 200, F.lit(1.0)).alias("cloud"), F.lit(1.0).alias("u10"), F.lit(1.0).alias("v10"), n.alias("gust"), n.alias("pop"))
    d = D.hourly_document(h)
    return d.select("point", F.size("lead_h").cast("long").alias("hours"), F.array_join("weather", ",").alias("weather"), F.element_at("times", -1).alias("last"))


@query("""WITH b AS (SELECT user_id % 5 AS point, CAST(ts AS DATE) AS init, event_type AS member, CAST(hour(ts) // 6 * 6 AS BIGINT) AS start_h, round(sum(value), 2) AS mm FROM events GROUP BY ALL), c AS (SELECT * FROM b UNION ALL SELECT point, init - 1, member, start_h + 24, mm * 0.5 FROM b WHERE start_h < 12),
 w AS (SELECT point, init, start_h, 100.0 * avg((mm >= 30)::INT) AS pop FROM c GROUP BY ALL), v AS (SELECT *, CAST(init AS TIMESTAMP) + to_hours(CAST(start_h + h AS INT)) AS valid FROM w, range(1, 7) r(h)), hrs AS (SELECT DISTINCT user_id % 5 AS point, date_trunc('hour', ts) AS valid FROM events)
SELECT hrs.point, hrs.valid, round(arg_max(pop, epoch(init::TIMESTAMP) * 1000 + start_h), 5) AS pop FROM hrs LEFT JOIN v ON v.point = hrs.point AND v.valid = hrs.valid GROUP BY ALL""")
def chance_across_cycles(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    b = e.groupBy((F.col("user_id") % 5).alias("point"), F.to_date("ts").cast("timestamp_ntz").alias("init"), F.col("event_type").alias("member"), (F.floor(F.hour("ts") / 6) * 6).cast("long").alias("start_h")).agg(F.round(F.sum("value"), 2).alias("mm"))
    older = b.where("start_h < 12").withColumn("init", F.col("init") - F.make_dt_interval(F.lit(1))).withColumn("start_h", F.col("start_h") + 24).withColumn("mm", F.col("mm") * 0.5)
    hours = e.select((F.col("user_id") % 5).alias("point"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("valid")).distinct()
    return rounded(D.chance_across_cycles(b.unionByName(older), hours, ["point"], limit=30.0), 5)


def regions(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("point")).distinct().select("point", F.concat(F.lit("镇"), F.col("point")).alias("name"), (F.col("point") * 37 % 90 * 10.0).alias("elevation"))


@query(FULL_CELLS + """, m AS (SELECT date, kind, weather, count(*) AS n, min(point) AS p FROM cells GROUP BY ALL), mw AS (SELECT date, kind, arg_max(weather, n * 1000 - p) AS weather FROM m GROUP BY ALL)
SELECT c.date AS day, c.kind, mw.weather, count(*) AS cells, round(max(temp) + 1e-9, 4) AS warmest, max(force_hi) AS force_max, CAST(dense_rank() OVER (ORDER BY c.date, c.kind) - 1 AS INT) AS place FROM cells c JOIN mw USING (date, kind) GROUP BY c.date, c.kind, mw.weather""", dates=True)
def product_document(spark, sf_dir):
    """A product as JSON, read back."""
    cells = region_cells(spark, sf_dir).where("tmin IS NOT NULL")
    doc = D.product(cells, regions(spark, sf_dir), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    shape = "periods array<struct<index:int,date:string,kind:string,label:string,county:struct<weather:string,force_max:int>,cells:array<struct<point:bigint,temp:double>>>>"
    p = doc.select(F.explode(F.from_json("json", shape)["periods"]).alias("p")).select("p.*")
    return p.select(F.col("date").alias("day"), "kind", "county.weather", F.size("cells").cast("long").alias("cells"), F.round(F.array_max(F.transform("cells", lambda c: c["temp"])) + 1e-9, 4).alias("warmest"), "county.force_max", F.col("index").alias("place"))


@query(FULL_CELLS + """, o AS (SELECT *, point % 2 AS county, CASE WHEN point % 4 = 0 THEN greatest(tmax + 1, tmin) ELSE greatest(tmax, tmin) END AS hi FROM cells), w AS (SELECT *, CASE kind WHEN 'day' THEN hi ELSE tmin END AS warm FROM o), m AS (SELECT county, date, kind, weather, count(*) AS n, min(point) AS p FROM w GROUP BY ALL), mw AS (SELECT county, date, kind, arg_max(weather, n * 1000 - p) AS weather FROM m GROUP BY ALL),
 t AS (SELECT county, count(DISTINCT point) AS points FROM w GROUP BY county)
SELECT w.county, w.date AS day, w.kind, mw.weather, count(*) AS cells, round(max(warm) + 1e-9, 4) AS warmest, CAST(dense_rank() OVER (PARTITION BY w.county ORDER BY w.date, w.kind) - 1 AS INT) AS place, max(t.points) AS series, 'county ' || w.county AS text FROM w JOIN mw USING (county, date, kind) JOIN t ON t.county = w.county GROUP BY w.county, w.date, w.kind, mw.weather""", dates=True)
def county_products(spark, sf_dir):
    """A product for each of two counties, with extremes of other origin, a series for each point and a text, read back."""
    county = (F.col("point") % 2).alias("county")
    cells = region_cells(spark, sf_dir).where("tmin IS NOT NULL").select("*", county)
    warmer = cells.where("point % 4 = 0").select("county", "point", "date", "kind", (F.col("tmax") + 1).alias("tmax"), F.lit(None).cast("double").alias("tmin"))
    points = regions(spark, sf_dir).select("*", county)
    series = cells.groupBy("county", "point").agg(F.array_sort(F.collect_list("precip")).alias("precip"))  # a county's periods
    texts = cells.select("county").distinct().select("county", F.concat(F.lit("county "), F.col("county").cast("string")).alias("text"))
    doc = D.product(cells, points, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), by=("county",), extremes=warmer, series=series, texts=texts)
    shape = "periods array<struct<index:int,date:string,kind:string,county:struct<weather:string>,cells:array<struct<temp:double>>>>, series3h array<struct<point:bigint>>, text array<struct<text:string>>"
    d = doc.select("county", F.from_json("json", shape).alias("d"))
    p = d.select(F.col("county").alias("of"), F.size("d.series3h").cast("long").alias("series"), F.col("d.text")[0]["text"].alias("text"), F.explode("d.periods").alias("p"))
    return p.select(F.col("of").alias("county"), F.col("p.date").alias("day"), "p.kind", "p.county.weather", F.size("p.cells").cast("long").alias("cells"), F.round(F.array_max(F.transform("p.cells", lambda c: c["temp"])) + 1e-9, 4).alias("warmest"), F.col("p.index").alias("place"), "series", "text")


WIDTH = "(length({0}) + length(regexp_replace({0}, '[^ᄀ-ᅟ⺀-꓏가-힣豈-﫿︰-﹏＀-｠￠-￦]', '', 'g')))"
PAD = lambda x, n: f"({x} || repeat(' ', greatest({n} - {WIDTH.format('(' + x + ')')}, 0)::INT))"
RPAD = lambda x, n: f"(repeat(' ', greatest({n} - {WIDTH.format('(' + x + ')')}, 0)::INT) || {x})"


@query(FULL_CELLS + """, pv AS (SELECT point, date, max(weather) FILTER (kind = 'day') AS dw, max(weather) FILTER (kind = 'night') AS nw, max(tmax) FILTER (kind = 'day') AS hi, max(tmin) FILTER (kind = 'night') AS lo, max(wind_text) FILTER (kind = 'day') AS dt, max(wind_text) FILTER (kind = 'night') AS nt, max(wind_name) FILTER (kind = 'day') AS dn, max(wind_name) FILTER (kind = 'night') AS nn, max(force_text) FILTER (kind = 'night') AS nf, sum(precip) AS mm FROM cells GROUP BY ALL),
 tx AS (SELECT point, date, '镇' || point AS name, CAST(CAST(round_even(point * 37 % 90 * 10.0, 0) AS BIGINT) AS VARCHAR) AS height, CASE WHEN dw <> nw THEN dw || '转' || nw ELSE coalesce(dw, nw) END AS weather, CASE WHEN dw IS NOT NULL AND nw IS NOT NULL THEN CAST(round_even(lo, 0) AS BIGINT) || '～' || CAST(round_even(hi, 0) AS BIGINT) ELSE CAST(CAST(round_even(coalesce(hi, lo), 0) AS BIGINT) AS VARCHAR) END AS temp,
   CASE WHEN dt <> nt THEN dt || '转' || CASE WHEN dn = nn THEN nf ELSE nt END ELSE coalesce(dt, nt) END AS wind, CASE WHEN mm >= 0.05 THEN printf('%.1f', mm + 1e-9) ELSE '—' END AS rain FROM pv)
SELECT point, date AS day, CAST(row_number() OVER (PARTITION BY date ORDER BY point * 37 % 90 DESC, point) AS INT) AS place, """ + " || ".join([PAD("name", 12), RPAD("height", 6), "'  '", PAD("weather", 14), RPAD("temp", 9), "'  '", PAD("wind", 26), RPAD("rain", 7)]) + " AS line FROM tx", dates=True)
def bulletin_lines(spark, sf_dir):
    b = D.bulletin_rows(region_cells(spark, sf_dir).where("tmin IS NOT NULL"), regions(spark, sf_dir))
    return b.select("point", F.col("date").alias("day"), "place", "line")


DAILY = REGIONS + ", dd AS (SELECT point, CAST(valid + to_hours(8) AS DATE) AS day, greatest(max(tmax3), min(tmin3)) AS tmax, min(tmin3) AS tmin, sum(precip) AS precip, avg(w) AS ws, max(w) AS wx, count(*) * 3 AS hours FROM rs GROUP BY ALL)"


@query(DAILY + " SELECT point, string_agg(lpad(printf('%.1f', tmax + 1e-9), 8, ' '), '' ORDER BY day) AS line FROM dd GROUP BY point")
def township_lines(spark, sf_dir):
    return D.township_table(periods.to_daily(region_series(spark, sf_dir)), "tmax")


@query(DAILY + " SELECT CAST(day AS VARCHAR) AS day, strftime(day, '%m-%d') || ' ' || printf('%.1f', min(tmin) + 1e-9) || '~' || printf('%.1f', max(tmax) + 1e-9) || ' ' || printf('%.1f', avg(precip) + 1e-9) || ' / ' || printf('%.1f', max(precip) + 1e-9) || ' ' || printf('%.1f', avg(ws) + 1e-9) || ' / ' || printf('%.1f', max(wx) + 1e-9) || ' ' || max(hours) || 'h' AS line FROM dd GROUP BY day")
def county_lines(spark, sf_dir):
    return D.county_table(periods.to_daily(region_series(spark, sf_dir))).withColumn("day", F.col("day").cast("string"))


# ---------------------------------------------------------------- stores


@query(REGIONS + " SELECT 'blend' AS source, '2024010100' AS run_init, point, step, valid, round(t2m + 1e-9, 5) AS t2m, round(precip + 1e-9, 5) AS precip FROM rs")
def store_frame(spark, sf_dir):
    s = region_series(spark, sf_dir).withColumn("init", F.lit("2024-01-01").cast("timestamp_ntz"))
    f = stores.to_frame(s, "blend")
    return f.select("source", "run_init", "point", "step", F.col("valid_time").alias("valid"), F.round(F.col("t2m") + 1e-9, 5).alias("t2m"), F.round(F.col("precip") + 1e-9, 5).alias("precip"))


@query(REGIONS + " SELECT 'a' AS member, point, step, tmax3 AS v, gust AS g FROM rs UNION ALL SELECT 'b', point, step, tmin3, NULL FROM rs")
def stacked_members(spark, sf_dir):
    s = region_series(spark, sf_dir)
    return stores.stacked({"a": s.select("point", "step", F.col("tmax3").alias("v"), F.col("gust").alias("g")), "b": s.select("point", "step", F.col("tmin3").alias("v"))}).select("member", "point", "step", "v", "g")


@query("""WITH st AS (SELECT user_id, event_type, ts, value, event_id FROM events WHERE event_id % 3 <> 0), nw AS (SELECT user_id, event_type, ts, value + 1 AS value, event_id FROM events WHERE event_id % 3 <> 1), u AS (SELECT *, 0 AS n FROM st UNION ALL SELECT *, 1 FROM nw),
 k AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY n DESC, event_id DESC) AS r FROM u) SELECT user_id, event_type, event_id, round(value, 4) AS value FROM k WHERE r = 1 AND ts >= TIMESTAMP '2024-01-10'""")
def archive_update(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "value", "event_id")
    u = stores.updated(e.where("event_id % 3 <> 0"), e.where("event_id % 3 <> 1").withColumn("value", F.col("value") + 1), ["user_id", "event_type"], "event_id", "ts", F.lit("2024-01-10").cast("timestamp_ntz"))
    return u.select("user_id", "event_type", "event_id", F.round("value", 4).alias("value"))


@query("""WITH st AS (SELECT user_id, max(ts) AS t FROM events WHERE event_type = 'signup' GROUP BY ALL) SELECT u.user_id, greatest(coalesce(t - INTERVAL 24 HOUR, TIMESTAMP '2024-01-03'), TIMESTAMP '2024-01-03') AS fetch_from FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN st USING (user_id)""")
def fetch_due(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return stores.due(e.select("user_id").distinct(), e.where("event_type = 'signup'"), "user_id", "ts", 24, F.lit("2024-01-03").cast("timestamp_ntz"))


@query("SELECT user_id, max(ts) AS latest FROM events GROUP BY user_id")
def latest_report(spark, sf_dir):
    return stores.latest(table(spark, sf_dir, "events"), "ts", ["user_id"])


@query("""WITH a AS (SELECT user_id, event_type AS k, max(value) AS v FROM events WHERE day(ts) < 15 GROUP BY ALL), b AS (SELECT user_id, event_type AS k, max(value) AS v FROM events WHERE day(ts) >= 15 GROUP BY ALL)
SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.k, b.k) AS k, coalesce(b.v, a.v) AS v FROM a FULL JOIN b ON a.user_id = b.user_id AND a.k = b.k""")
def merged_calibration(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    of = lambda df, name: df.groupBy("user_id", "event_type").agg(F.max("value").alias("v")).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "v"))).alias(name))
    j = of(e.where(F.day("ts") < 15), "l").join(of(e.where(F.day("ts") >= 15), "r"), "user_id", "full")
    return j.select("user_id", F.explode(stores.merged_maps(F.col("l"), F.col("r"))).alias("k", "v"))


RUN_FILES = "WITH f AS (SELECT o_orderkey AS file, o_custkey % 20 AS county, o_orderdate AS generated, o_orderkey AS run, CAST(o_orderkey % 3 AS INT) AS schema, o_orderkey % 7 AS first FROM orders), h AS (SELECT DISTINCT l_orderkey AS file FROM lineitem WHERE l_linenumber = 4)"


@query(RUN_FILES + ", k AS (SELECT *, row_number() OVER (PARTITION BY county ORDER BY generated DESC, run DESC) AS place FROM f) SELECT k.county, k.file, CAST(place AS INT) AS place, h.file IS NOT NULL AS hourly, place = 1 AS latest FROM k LEFT JOIN h ON h.file = k.file WHERE place <= 5")
def run_index(spark, sf_dir):
    f, h = run_files(spark, sf_dir)
    return stores.index_of(f, h, 5).select("county", "file", "place", "hourly", "latest")


def run_files(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders")
    f = o.select(F.col("o_orderkey").alias("file"), (F.col("o_custkey") % 20).alias("county"), F.col("o_orderdate").alias("generated"), F.col("o_orderkey").alias("run"), (F.col("o_orderkey") % 3).cast("int").alias("schema"), (F.col("o_orderkey") % 7).alias("first"))
    return f, table(spark, sf_dir, "lineitem").where("l_linenumber = 4").select(F.col("l_orderkey").alias("file")).distinct()


@query(RUN_FILES + " SELECT w.run, EXISTS (SELECT 1 FROM f JOIN h USING (file) WHERE f.run = w.run AND f.county = w.county AND f.first = w.first AND f.schema = 2) AS is_current FROM (SELECT run, county, first FROM f UNION ALL SELECT -run, county, first FROM f) w")
def current_documents(spark, sf_dir):
    f, h = run_files(spark, sf_dir)
    stored = f.join(h.withColumn("_h", F.lit(True)), "file", "left").withColumn("hourly", F.coalesce("_h", F.lit(False)))
    wanted = f.select("run", "county", "first").unionByName(f.select((-F.col("run")).alias("run"), "county", "first"))
    return stores.current(wanted, stored, 2).select("run", "is_current")


# ---------------------------------------------------------------- catalogues and times


@query("""WITH n AS (SELECT DISTINCT date_trunc('hour', ts) AS now FROM events), c AS (SELECT now, CAST(CAST(now AS DATE) - CAST(b AS INT) AS TIMESTAMP) + to_hours(h) AS init FROM n, range(3) r(b), (VALUES (0), (6), (12), (18)) v(h)), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY now ORDER BY init DESC) AS INT) AS place FROM c WHERE now - init >= INTERVAL 2 HOUR)
SELECT now, init, place FROM k""")
def candidate_runs(spark, sf_dir):
    n = table(spark, sf_dir, "events").select(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("now")).distinct()
    return messages.candidate_runs(n).select("now", "init", "place")


@query("""WITH n AS (SELECT DISTINCT date_trunc('hour', ts) AS now FROM events), c AS (SELECT now, CAST(CAST(now AS DATE) - CAST(b AS INT) AS TIMESTAMP) + to_hours(h) AS init FROM n, range(3) r(b), (VALUES (0), (6), (12), (18)) v(h)), cat AS (SELECT DISTINCT CAST(CAST(ts AS DATE) AS TIMESTAMP) + to_hours(CAST(hour(ts) // 6 * 6 AS INT)) AS init FROM events WHERE value >= 60)
SELECT now, max(init) AS init FROM c SEMI JOIN cat USING (init) WHERE now - init >= INTERVAL 2 HOUR GROUP BY now""")
def latest_run(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    n = e.select(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("now")).distinct()
    return messages.latest_run(messages.candidate_runs(n), e.select(times.floor_hours(F.col("ts"), 6).alias("init"), F.col("value").alias("step")), 60)


@query("""WITH i AS (SELECT DISTINCT date_trunc('hour', ts) - to_hours(CAST(hour(ts) % 6 AS INT)) AS init FROM events), a AS (SELECT init, CASE WHEN (init + INTERVAL 690 MINUTE) < time_bucket(INTERVAL 12 HOUR, init + INTERVAL 690 MINUTE, TIMESTAMP '2024-01-01') + INTERVAL 361 MINUTE THEN time_bucket(INTERVAL 12 HOUR, init + INTERVAL 690 MINUTE, TIMESTAMP '2024-01-01') ELSE time_bucket(INTERVAL 12 HOUR, init + INTERVAL 690 MINUTE, TIMESTAMP '2024-01-01') + INTERVAL 12 HOUR END AS s FROM i),
 p AS (SELECT init, s + to_hours(CAST(12 * k AS INT)) AS start FROM a, range(11) r(k) WHERE k < 10 OR hour(s) = 12)
SELECT init, start, CAST(CAST(start + INTERVAL 12 HOUR AS DATE) AS VARCHAR) AS date, CASE WHEN hour(start) = 0 THEN 'day' ELSE 'night' END AS kind FROM p""")
def cycle_periods(spark, sf_dir):
    i = table(spark, sf_dir, "events").select(times.floor_hours(F.col("ts"), 6).alias("init")).distinct()
    p = i.select("init", F.explode(times.cycle_periods(F.col("init"))).alias("p"))
    return p.select("init", "p.start", F.col("p.date").cast("string").alias("date"), "p.kind")


@query("""SELECT o_orderkey, CAST(date_diff('hour', CAST(o_orderdate AS TIMESTAMP), CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 6 AS INT) AS TIMESTAMP)) - 8 AS INT) AS from_h, CAST(date_diff('hour', CAST(o_orderdate AS TIMESTAMP), CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 6 AS INT) AS TIMESTAMP)) + 16 AS INT) AS to_h, strftime(o_orderdate, '%m-%d') AS md,
  'x_' || CASE WHEN o_custkey % 120 >= 60 THEN 'N' ELSE 'S' END || lpad(CAST(abs(o_custkey % 120 - 60) AS VARCHAR), 2, '0') || '_00_' || CASE WHEN o_orderkey % 360 >= 180 THEN 'E' ELSE 'W' END || lpad(CAST(abs(o_orderkey % 360 - 180) AS VARCHAR), 3, '0') || '_00' AS tile, round(date_diff('second', CAST(o_orderdate AS TIMESTAMP), TIMESTAMP '2002-01-01') / 3600.0, 4) AS age FROM orders""")
def time_and_tile_keys(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    init = F.col("o_orderdate").cast("timestamp_ntz")
    a, b = times.day_bounds(init, F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 6).cast("int")))
    tile = times.tile_name(F.col("o_custkey") % 120 - 60 + 0.5, F.col("o_orderkey") % 360 - 180 + 0.25, "x_")
    return o.select("o_orderkey", a.alias("from_h"), b.alias("to_h"), times.month_day(F.col("o_orderdate")).alias("md"), tile.alias("tile"), F.round(times.age_hours(init, F.lit("2002-01-01").cast("timestamp_ntz")), 4).alias("age"))


@query("""WITH m AS (SELECT p_partkey % 40 AS file, CASE p_partkey // 40 % 4 WHEN 0 THEN '2t' WHEN 1 THEN '10fg3' WHEN 2 THEN '10fg' ELSE 'tp' END AS param, CASE WHEN p_partkey % 11 = 0 THEN 'pl' ELSE 'sfc' END AS lev, p_size AS o, p_partkey AS n FROM part), s AS (SELECT file, param, arg_min(o, o * 1000000 + n) AS o, arg_min(n, o * 1000000 + n) AS n FROM m WHERE lev = 'sfc' GROUP BY ALL), f AS (SELECT DISTINCT file FROM m),
 g AS (SELECT f.file, coalesce(a.o, b.o) AS o, coalesce(a.n, b.n) AS n, CASE WHEN a.o IS NOT NULL THEN '10fg' WHEN b.o IS NOT NULL THEN '10fg3' END AS param FROM f LEFT JOIN s a ON a.file = f.file AND a.param = '10fg' LEFT JOIN s b ON b.file = f.file AND b.param = '10fg3')
SELECT f.file, 't2m' AS field, s.param, s.o::BIGINT AS "offset", s.n::BIGINT AS length FROM f LEFT JOIN s ON s.file = f.file AND s.param = '2t' UNION ALL SELECT file, 'gust', param, o, n FROM g WHERE param IS NOT NULL""")
def json_index_fields(spark, sf_dir):
    """JSON lines of an index: a required field, and an optional one with a name to fall back on."""
    p = table(spark, sf_dir, "part")
    names = F.array(F.lit("2t"), F.lit("10fg3"), F.lit("10fg"), F.lit("tp"))
    line = F.to_json(F.struct(F.element_at(names, (F.floor(F.col("p_partkey") / 40) % 4 + 1).cast("int")).alias("param"), F.when(F.col("p_partkey") % 11 == 0, "pl").otherwise("sfc").alias("levtype"), F.col("p_size").alias("_offset"), F.col("p_partkey").alias("_length")))
    lines = p.select((F.col("p_partkey") % 40).alias("file"), line.alias("line")).unionByName(p.select((F.col("p_partkey") % 40).alias("file"), F.lit("{broken").alias("line")))
    return messages.select_fields(messages.json_index(lines), {"t2m": ["2t"], "gust": ["10fg", "10fg3"]}, ["t2m"])


@query("""WITH h AS (SELECT user_id % 10 AS station, date_trunc('hour', ts) AS time, max(value) FILTER (event_type = 'view') AS a1, max(value) FILTER (event_type = 'click') AS a2 FROM events GROUP BY ALL)
SELECT station, strftime(time, '%Y-%m-%dT%H:%M') AS time, 1 AS lead, a1 AS t FROM h UNION ALL SELECT station, strftime(time, '%Y-%m-%dT%H:%M'), 2, a2 FROM h""")
def previous_run_rows(spark, sf_dir):
    """Documents with an array for each lead, made of the events, as rows."""
    name = F.col("event_type")
    h = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 10).alias("station"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("time")).agg(F.max(F.when(name == "view", F.col("value"))).alias("a1"), F.max(F.when(name == "click", F.col("value"))).alias("a2"))
    s = h.groupBy("station").agg(F.array_sort(F.collect_list(F.struct("time", "a1", "a2"))).alias("s"))  # a station's document
    take = lambda f: F.transform("s", f)
    hourly = F.struct(take(lambda x: F.date_format(x["time"], "yyyy-MM-dd'T'HH:mm")).alias("time"), take(lambda x: x["a1"]).alias("t_previous_day1"), take(lambda x: x["a2"]).alias("t_previous_day2"))
    docs = s.select("station", F.to_json(F.struct(hourly.alias("hourly"))).alias("json"))
    return messages.previous_runs(docs, ["t"], [1, 2]).select("station", "time", "lead", "t")


PLACES = [*messages.TOWNSHIP_KINDS, "村"]  # all that count, and one that does not


@query("""WITH s AS (SELECT s_suppkey, trim(s_name) AS name FROM supplier WHERE s_suppkey % 7 <> 6)
SELECT name, CAST(s_suppkey % 50 AS DOUBLE) AS lat, CAST(s_suppkey % 90 + 0.5 AS DOUBLE) AS lon FROM s""")
def place_rows(spark, sf_dir):
    """Places of a query service's answer: those of township kinds, each name once."""
    s = table(spark, sf_dir, "supplier")
    value = lambda c: F.struct(c.alias("value"))
    kind = F.element_at(F.array(*map(F.lit, PLACES)), (F.col("s_suppkey") % 7 + 1).cast("int"))
    point = F.concat(F.lit("Point("), F.format_string("%.1f", F.col("s_suppkey") % 90 + 0.5), F.lit(" "), (F.col("s_suppkey") % 50).cast("string"), F.lit(")"))
    binding = F.struct(value(F.concat(F.lit(" "), F.col("s_name"))).alias("label"), value(kind).alias("kind"), value(point).alias("coord"))
    docs = s.groupBy(F.lit(1)).agg(F.flatten(F.array_sort(F.collect_list(F.array(binding, binding)))).alias("bindings")).select(F.to_json(F.struct(F.struct("bindings").alias("results"))).alias("json"))  # one answer
    return messages.place_rows(docs)


@query("""WITH c AS (SELECT p_partkey % 30 AS a, p_partkey // 30 % 10 AS b, max(p_retailprice) AS v, max(p_size) AS z FROM part GROUP BY ALL) SELECT a AS lat, (CASE WHEN b * 36 >= 180 THEN b * 36 - 360 ELSE b * 36 END)::DOUBLE AS lon, round(v / 4 - 273.15, 5) AS t2m, round(v / 4 - 273.15, 5) AS tmax3, round(z::DOUBLE * 1000, 5) AS tp, round(v / 9.80665, 5) AS orog FROM c""")
def normalised_fields(spark, sf_dir):
    c = table(spark, sf_dir, "part").groupBy((F.col("p_partkey") % 30).alias("lat"), (F.floor(F.col("p_partkey") / 30) % 10 * 36).cast("double").alias("lon")).agg(F.max("p_retailprice").alias("v"), F.max("p_size").cast("double").alias("z"))
    one = lambda field, unit, value: F.struct(F.lit(field).alias("field"), F.lit(unit).alias("unit"), value.alias("value"))
    f = c.select("lat", "lon", F.lit(3).alias("step"), F.explode(F.array(one("t2m", "K", F.col("v") / 4), one("tp", "m", F.col("z")), one("orog", "m2 s-2", F.col("v")))).alias("x")).select("lat", "lon", "step", "x.*")
    return messages.normalised(f).select("lat", "lon", *[F.round(c, 5).alias(c) for c in ("t2m", "tmax3", "tp", "orog")])


@query("SELECT user_id, median(g) AS gap, min(g) AS cadence FROM (SELECT user_id, step - lag(step) OVER (PARTITION BY user_id ORDER BY step) AS g FROM (SELECT DISTINCT user_id, CAST(epoch(date_trunc('hour', ts)) / 3600 AS BIGINT) AS step FROM events)) GROUP BY user_id")
def step_gaps(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", (F.unix_timestamp(F.date_trunc("hour", "ts")) / 3600).cast("long").alias("step"))
    return messages.step_gap(e, ["user_id"])


# ---------------------------------------------------------------- views


@query("""WITH a AS (SELECT event_type AS type, CAST(ts AS DATE) AS date, CASE WHEN max(value) >= 200 THEN '红色' WHEN max(value) >= 150 THEN '橙色' ELSE '蓝色' END AS level FROM events GROUP BY ALL)
SELECT type, arg_max(level, CASE level WHEN '红色' THEN 4 WHEN '橙色' THEN 3 ELSE 1 END * 100000 - epoch(date::TIMESTAMP) / 86400) AS level, count(DISTINCT date) AS dates, CAST(min(date) AS VARCHAR) AS first FROM a GROUP BY type""")
def alert_types(spark, sf_dir):
    v = F.max("value")
    a = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("type"), F.to_date("ts").alias("date")).agg(F.when(v >= 200, "红色").when(v >= 150, "橙色").otherwise("蓝色").alias("level"))
    t = D.by_type(a, A.level_rank(F.col("level")))
    return t.select("type", "level", F.size("dates").cast("long").alias("dates"), F.col("dates")[0].cast("string").alias("first"))


@query("SELECT l_orderkey, l_linenumber, coalesce(l_quantity = max(l_quantity) OVER (PARTITION BY l_orderkey), FALSE) AS best FROM lineitem")
def best_of_group(spark, sf_dir):
    return D.best_values(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_quantity").select("l_orderkey", "l_linenumber", "best")


@query("SELECT o_orderkey, round(date_diff('second', CAST(o_orderdate AS TIMESTAMP), TIMESTAMP '1998-01-01') / 3600.0, 3) AS age_hours, date_diff('second', CAST(o_orderdate AS TIMESTAMP), TIMESTAMP '1998-01-01') / 3600.0 > 14 AS stale, CAST(o_orderdate AS TIMESTAMP) + INTERVAL 12 HOUR > TIMESTAMP '1998-01-01' AS live FROM orders")
def freshness(spark, sf_dir):
    now = F.lit("1998-01-01").cast("timestamp_ntz")
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp_ntz").alias("generated"))
    live = D.live_periods(o.select("o_orderkey", (F.col("generated") + F.make_dt_interval(F.lit(0), F.lit(12))).alias("end")), now).select("o_orderkey", F.lit(True).alias("_l"))
    d = D.freshness(o, now).join(live, "o_orderkey", "left")
    return d.select("o_orderkey", F.round("age_hours", 3).alias("age_hours"), "stale", F.coalesce("_l", F.lit(False)).alias("live"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity = 25 THEN NULL ELSE l_quantity / nullif(l_quantity - 25, 0) END AS ratio, CASE WHEN l_linenumber <> 2 THEN l_tax END AS tax FROM lineitem")
def finite_values(spark, sf_dir):
    q = F.col("l_quantity").cast("double")
    r = F.when(q == 25, float("nan")).otherwise(q / F.nullif(q - 25, F.lit(0.0)))
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", r.alias("ratio"), F.when(F.col("l_linenumber") == 2, float("inf")).otherwise(F.col("l_tax").cast("double")).alias("tax"))
    return D.finite(d)


@query("SELECT min(lat) - 0.5 AS lat_min, max(lat) + 0.5 AS lat_max, min(lon) - 0.5 AS lon_min, max(lon) + 0.5 AS lon_max FROM (SELECT embedding[1]::DOUBLE AS lat, embedding[2]::DOUBLE AS lon FROM embeddings)")
def padded_box(spark, sf_dir):
    p = table(spark, sf_dir, "embeddings").select(F.col("embedding")[0].cast("double").alias("lat"), F.col("embedding")[1].cast("double").alias("lon"))
    return messages.around(p, 0.5)
