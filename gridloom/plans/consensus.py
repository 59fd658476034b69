"""Queries of the consensus, each beside its SQL; ten regions are stations, event types members and observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import calibration as C
from gridloom.operators import consensus as K
from gridloom.plans.catalog import BEAUFORT_SQL, query, rounded, table

MEMBERS = ["a", "b", "c"]
NAMES = {"view": "a", "click": "b", "purchase": "c", "error": "o"}


def member_table(spark: SparkSession, sf_dir: str, observations: bool = True) -> DataFrame:
    """Three members' extremes, rain and wind for each region, day and half, with observations; any may be missing."""
    kind = F.when(F.hour("ts") < 12, "day").otherwise("night")
    name = F.col("event_type")
    e = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 10).alias("station"), F.to_date("ts").alias("date"), kind.alias("kind"))
    e = e.agg(*[x for k, m in NAMES.items() for x in (F.max(F.when(name == k, F.col("value"))).alias(f"_{m}"), F.min(F.when(name == k, F.col("value"))).alias(f"{m}_p"))])
    e = e.select("station", "date", "kind", ((F.day("date") + F.col("station")) % 5 + 1).cast("int").alias("lead"), *[x for m in NAMES.values() for x in ((F.col(f"_{m}") / 10).alias(f"{m}_t"), (F.col(f"{m}_p") / 4).alias(f"{m}_p"), (F.col(f"_{m}") / 40).alias(f"{m}_w"))])
    init = F.col("date").cast("timestamp_ntz")
    e = e.withColumn("init", init).withColumn("end", init + F.make_dt_interval(F.col("lead")))
    return e if observations else e.drop("o_t", "o_p", "o_w")


TABLE = """WITH x AS (SELECT user_id % 10 AS station, CAST(ts AS DATE) AS date, CASE WHEN hour(ts) < 12 THEN 'day' ELSE 'night' END AS kind, """ + ", ".join(f"max(value) FILTER (event_type = '{k}') / 10 AS {m}_t, min(value) FILTER (event_type = '{k}') / 4 AS {m}_p, max(value) FILTER (event_type = '{k}') / 40 AS {m}_w" for k, m in NAMES.items()) + """ FROM events GROUP BY ALL),
 y AS (SELECT *, CAST((day(date) + station) % 5 + 1 AS INT) AS lead, CAST(date AS TIMESTAMP) AS init FROM x), mt AS (SELECT *, init + to_days(lead) AS "end" FROM y)"""
MEAN = lambda c: f"(coalesce(a_{c}, 0) + coalesce(b_{c}, 0) + coalesce(c_{c}, 0)) / nullif((a_{c} IS NOT NULL)::INT + (b_{c} IS NOT NULL)::INT + (c_{c} IS NOT NULL)::INT, 0)"

# A fit in closed form: with the intercept taken out by centring, two weights remain to be solved for.
RIDGE_OF = "CASE lead WHEN 3 THEN 2.0 WHEN 4 THEN 4.0 WHEN 5 THEN 8.0 ELSE 1.0 END"
FITTED = """, newest AS (SELECT max("end") AS top FROM mt), z AS (SELECT kind, lead, pow(0.5, epoch(top - "end") / 86400.0 / 20) AS s, a_t - (a_t + b_t + c_t) / 3 AS x1, b_t - (a_t + b_t + c_t) / 3 AS x2, o_t - (a_t + b_t + c_t) / 3 AS r FROM mt, newest WHERE a_t + b_t + c_t + o_t IS NOT NULL),
 k0 AS (SELECT kind, lead, count(*) AS n, sum(s) AS s, sum(s * x1) / sum(s) AS m1, sum(s * x2) / sum(s) AS m2, sum(s * r) / sum(s) AS mr FROM z GROUP BY ALL HAVING count(*) >= 5),
 k1 AS (SELECT kind, lead, n, m1, m2, mr, n / k0.s * sum(z.s * (x1 - m1) * (x1 - m1)) + """ + RIDGE_OF + """ * n AS p, n / k0.s * sum(z.s * (x1 - m1) * (x2 - m2)) AS q, n / k0.s * sum(z.s * (x2 - m2) * (x2 - m2)) + """ + RIDGE_OF + """ * n AS v, n / k0.s * sum(z.s * (x1 - m1) * (r - mr)) AS g, n / k0.s * sum(z.s * (x2 - m2) * (r - mr)) AS h FROM z JOIN k0 USING (kind, lead) GROUP BY kind, lead, n, k0.s, m1, m2, mr),
 k2 AS (SELECT *, greatest((g * v - h * q) / (p * v - q * q) + 1.0 / 3, 0) AS u1, greatest((h * p - g * q) / (p * v - q * q) + 1.0 / 3, 0) AS u2, greatest(1.0 / 3 - (g * v - h * q) / (p * v - q * q) - (h * p - g * q) / (p * v - q * q), 0) AS u3 FROM k1),
 fit AS (SELECT kind, lead, n, u1 / (u1 + u2 + u3) AS w1, u2 / (u1 + u2 + u3) AS w2, u3 / (u1 + u2 + u3) AS w3, mr - (u1 * m1 + u2 * m2 - u3 * (m1 + m2)) / (u1 + u2 + u3) AS a0 FROM k2)"""
WINDS = """, wf AS (SELECT kind, count(f + o_w) AS n, CASE WHEN count(f + o_w) >= 5 AND avg(f) FILTER (o_w IS NOT NULL) > 0.3 THEN least(greatest(avg(o_w) FILTER (f IS NOT NULL) / avg(f) FILTER (o_w IS NOT NULL), 0.6), 1.8) ELSE 1 END AS factor FROM (SELECT *, (a_w + b_w + c_w) / 3 AS f FROM mt) GROUP BY kind)"""


def fitted(spark, sf_dir) -> K.Calibration:
    return K.fit(member_table(spark, sf_dir), MEMBERS, F.lit("2099-01-01").cast("timestamp_ntz"), 40000, 20.0, 14.0, 11, 5, 5, 5, 5, chances=False)


@query(TABLE + FITTED + " SELECT kind, lead, n, round(w1, 6) AS w_a, round(w2, 6) AS w_b, round(w3, 6) AS w_c, round(a0, 5) AS intercept FROM fit")
def consensus_fit(spark, sf_dir):
    return fitted(spark, sf_dir).temperature.select("kind", "lead", "n", *[F.round(f"w_{m}", 6).alias(f"w_{m}") for m in MEMBERS], F.round("intercept", 5).alias("intercept"))


NIGHT = """, base AS (SELECT mt.*, CASE WHEN w1 IS NULL OR coalesce(w1 * (a_t IS NOT NULL)::INT, 0) + coalesce(w2 * (b_t IS NOT NULL)::INT, 0) + coalesce(w3 * (c_t IS NOT NULL)::INT, 0) <= 1e-9 THEN """ + MEAN("t") + """ ELSE (w1 * coalesce(a_t, 0) + w2 * coalesce(b_t, 0) + w3 * coalesce(c_t, 0)) / (w1 * (a_t IS NOT NULL)::INT + w2 * (b_t IS NOT NULL)::INT + w3 * (c_t IS NOT NULL)::INT) END + coalesce(a0, 0) AS t0 FROM mt LEFT JOIN fit USING (kind, lead)),
 nx AS (SELECT ln(least(greatest(""" + MEAN("w") + """, 0.3), 8)) AS x, o_t - t0 AS r, pow(0.5, epoch(top - "end") / 86400.0 / 20) AS w FROM base, newest WHERE kind = 'night' AND """ + MEAN("w") + """ + o_t + t0 IS NOT NULL),
 nm AS (SELECT sum(w * x) / sum(w) AS mu, sum(w * r) / sum(w) AS rm FROM nx HAVING count(*) >= 5), nb AS (SELECT sum(w * (x - mu) * (r - rm)) / (1.01 * sum(w * (x - mu) * (x - mu))) AS b, max(mu) AS mu FROM nx, nm),
 tt AS (SELECT base.*, t0 + CASE WHEN kind = 'night' THEN coalesce(b * (ln(least(greatest(""" + MEAN("w") + """, 0.3), 8)) - mu), 0) ELSE 0 END AS t FROM base LEFT JOIN nb ON TRUE)"""


@query(TABLE + FITTED + NIGHT + WINDS + f" SELECT station, date AS day, tt.kind, round(t + 1e-9, 5) AS t, round({MEAN('w')} * coalesce(factor, 1) + 1e-9, 5) AS w FROM tt LEFT JOIN wf ON tt.kind = wf.kind", dates=True)
def fit_and_predict(spark, sf_dir):
    """Temperatures and winds by a fit on the same rows."""
    p = K.predict(member_table(spark, sf_dir), fitted(spark, sf_dir), MEMBERS)
    return p.select("station", F.col("date").alias("day"), "kind", F.round(F.col("t") + 1e-9, 5).alias("t"), F.round(F.col("w") + 1e-9, 5).alias("w"))


FQ, OQ = [0.0, 2.0, 10.0, 40.0], [0.0, 1.0, 12.0, 30.0]
GIVEN_SQL = "CASE WHEN {0} IS NULL THEN NULL ELSE greatest(least(CASE WHEN {0} > 40 THEN {0} * 0.75 WHEN {0} <= 2 THEN {0} * 0.5 WHEN {0} <= 10 THEN 1 + ({0} - 2) / 8 * 11 ELSE 12 + ({0} - 10) / 30 * 18 END, 1.5 * {0}), 0) END"


def given(spark) -> K.Calibration:
    """A calibration of fixed numbers: all kinds of terms, with gaps."""
    frame = spark.createDataFrame
    return K.Calibration(
        temperature=frame([("day", 1, 0.5, 0.3, 0.2, 0.7), ("night", 1, 0.0, 0.0, 1.0, -0.4), ("day", 2, 1.0, 0.0, 0.0, 0.1)], "kind string, lead int, w_a double, w_b double, w_c double, intercept double"),
        night_wind=frame([(0.6, 0.9)], "b double, mu double"),
        precip=frame([("day", FQ, OQ)], "kind string, fq array<double>, oq array<double>"),
        member_maps=frame([(m, k, FQ, OQ) for m in "ab" for k in ("day", "night")], "member string, kind string, fq array<double>, oq array<double>"),
        pop=frame([("day", [-1.0, 1.5, 0.8])], "kind string, coef array<double>"),
        heavy=frame([([-2.0, 1.1, 0.4, 0.9, 0.2, -0.5, -1.5], [5.0])], "coef array<double>, published array<double>"),
        wind=frame([("night", 1.2)], "kind string, factor double"),
        hours=frame([(1, 8, 0.9), (2, 11, -0.3)], "lead int, hour int, bias double"),
    )


GIVEN_T = f"""CASE WHEN kind = 'night' AND lead = 1 AND c_t IS NOT NULL THEN c_t WHEN kind = 'day' AND lead = 2 AND a_t IS NOT NULL THEN a_t WHEN kind = 'day' AND lead = 1 THEN (0.5 * coalesce(a_t, 0) + 0.3 * coalesce(b_t, 0) + 0.2 * coalesce(c_t, 0)) / nullif(0.5 * (a_t IS NOT NULL)::INT + 0.3 * (b_t IS NOT NULL)::INT + 0.2 * (c_t IS NOT NULL)::INT, 0) ELSE {MEAN('t')} END
  + CASE WHEN kind = 'day' AND lead = 1 THEN 0.7 WHEN kind = 'night' AND lead = 1 THEN -0.4 WHEN kind = 'day' AND lead = 2 THEN 0.1 ELSE 0 END + CASE WHEN kind = 'night' THEN coalesce(0.6 * (ln(least(greatest({MEAN('w')}, 0.3), 8)) - 0.9), 0) ELSE 0 END"""
PREDICTED = TABLE + f""", mp AS (SELECT *, {GIVEN_SQL.format('a_p')} AS qa, {GIVEN_SQL.format('b_p')} AS qb, c_p AS qc, {MEAN('p')} AS pm, {MEAN('w')} AS wm, {GIVEN_T} AS t FROM mt),
 ft AS (SELECT *, list_avg(list_filter([qa, qb, qc], lambda v: v IS NOT NULL)) AS mean, list_avg(list_transform(list_filter([qa, qb, qc], lambda v: v IS NOT NULL), lambda v: (v >= 0.1)::INT)) AS wet, list_avg(list_transform(list_filter([qa, qb, qc], lambda v: v IS NOT NULL), lambda v: (v >= 5)::INT)) AS moderate FROM mp),
 pr AS (SELECT *, CASE WHEN mean IS NULL THEN NULL WHEN kind = 'day' THEN 1 / (1 + exp(-least(greatest(-1 + 1.5 * wet + 0.8 * ln(1 + mean), -30), 30))) ELSE wet END AS pop, CASE WHEN mean IS NOT NULL THEN 1 / (1 + exp(-least(greatest(-2 + 1.1 * ln(1 + least(mean, 10)) + 0.4 * wet + 0.9 * moderate + 0.2 * (kind = 'night')::INT - 0.5, -30), 30))) END AS h5 FROM ft),
 pv AS (SELECT *, CASE kind WHEN 'day' THEN {GIVEN_SQL.format('pm')} ELSE pm END AS p, least(h5, pop) AS p5, CAST(NULL AS DOUBLE) AS p15, wm * CASE kind WHEN 'night' THEN 1.2 ELSE 1 END AS w FROM pr)"""


@query(PREDICTED + " SELECT station, date AS day, kind, " + ", ".join(f"round({c} + 1e-9, 5) AS {c}" for c in ("t", "p", "pop", "p5", "w")) + ", p15 FROM pv", dates=True)
def predict_rows(spark, sf_dir):
    p = K.predict(member_table(spark, sf_dir), given(spark), MEMBERS)
    return p.select("station", F.col("date").alias("day"), "kind", *[F.round(F.col(c) + 1e-9, 5).alias(c) for c in ("t", "p", "pop", "p5", "w")], "p15")


def curve_rows(spark, sf_dir) -> DataFrame:
    """3-hourly rows of each period: the members' extremes bent by the hour."""
    m = member_table(spark, sf_dir).withColumn("hour", F.explode(F.array(F.lit(8), F.lit(11), F.lit(14))))
    bend = F.col("hour") / 4.0
    return m.select(*K.KEYS, "hour", *[(F.col(f"{x}_t") - bend).alias(f"{x}_t3") for x in MEMBERS], *[f"{x}_w" for x in MEMBERS], (F.col("o_t") - bend * 2).alias("o_t3"))


CURVE = TABLE + f""", s0 AS (SELECT *, {GIVEN_T} AS full_t FROM mt), s3 AS (SELECT s0.*, hour, full_t - hour / 4.0::DOUBLE AS cur, CASE WHEN kind = 'day' AND lead = 1 THEN 0.7 WHEN kind = 'night' AND lead = 1 THEN -0.4 WHEN kind = 'day' AND lead = 2 THEN 0.1 ELSE 0 END AS icpt, CASE WHEN lead = 1 AND hour = 8 THEN 0.9 WHEN lead = 2 AND hour = 11 THEN -0.3 END AS hb FROM s0, (VALUES (8), (11), (14)) v(hour)),
 s4 AS (SELECT *, cur + CASE WHEN hb IS NOT NULL THEN hb - icpt ELSE 0 END AS fixed FROM s3)"""


@query(CURVE + " SELECT station, date AS day, kind, hour, round(cur + 1e-9, 5) AS current, round(CASE kind WHEN 'day' THEN least(fixed, full_t) ELSE greatest(fixed, full_t) END + 1e-9, 5) AS by_hour FROM s4", dates=True)
def series_curve(spark, sf_dir):
    """The curve as drawn and with the hours' own biases, held to the period's extreme, which is looked up by period."""
    cal, rows = given(spark), curve_rows(spark, sf_dir)
    extremes = K.predict(member_table(spark, sf_dir), cal, MEMBERS).withColumnRenamed("t", "extreme")
    held = K.period_values(rows, extremes, "extreme", "extreme")
    a = K.series_temperature(held, cal, MEMBERS).withColumnRenamed("t3", "current")
    b = K.series_temperature(a, cal, MEMBERS, True, "extreme")
    return b.select("station", F.col("date").alias("day"), "kind", "hour", F.round(F.col("current") + 1e-9, 5).alias("current"), F.round(F.col("t3") + 1e-9, 5).alias("by_hour"))


@query(CURVE + """, nn AS (SELECT max("end") AS top FROM s3 WHERE a_t + b_t + c_t + o_t IS NOT NULL) SELECT lead, hour, count(*) AS n, round(sum(pow(0.5, epoch(top - "end") / 86400.0 / 20) * (o_t - hour / 2.0 - (cur - icpt))) / sum(pow(0.5, epoch(top - "end") / 86400.0 / 20)) + 1e-9, 5) AS bias FROM s3, nn WHERE a_t + b_t + c_t + o_t IS NOT NULL GROUP BY lead, hour HAVING count(*) >= 5""")
def hour_bias_fit(spark, sf_dir):
    h = K.hour_biases(curve_rows(spark, sf_dir), given(spark), MEMBERS, least=5)
    return h.select("lead", "hour", "n", F.round(F.col("bias") + 1e-9, 5).alias("bias"))


@query(TABLE + """, low AS (SELECT station FROM mt GROUP BY station HAVING station * 100 < 500), ob AS (SELECT station, date, kind, o_t FROM mt WHERE o_t IS NOT NULL AND station % 2 = 0)
SELECT mt.station, mt.date AS day, mt.kind, mt.a_t, ob.o_t FROM mt JOIN low ON mt.station = low.station LEFT JOIN ob ON ob.station = mt.station AND ob.date = mt.date AND ob.kind = mt.kind WHERE mt.init >= TIMESTAMP '2024-01-05'""", dates=True)
def training_rows(spark, sf_dir):
    m = member_table(spark, sf_dir)
    stations = m.select("station").distinct().withColumn("elevation", F.col("station") * 100.0)
    observed = m.where("o_t IS NOT NULL AND station % 2 = 0").select("station", "date", "kind", "o_t", "o_p", "o_w")
    t = K.training_table(m.drop("o_t", "o_p", "o_w"), observed, stations, since=F.lit("2024-01-05").cast("timestamp_ntz"))
    return t.select("station", F.col("date").alias("day"), "kind", "a_t", "o_t")


ISSUED = PREDICTED + """, iss AS (SELECT *, init + INTERVAL 18 HOUR AS issue, strftime(init, '%Y%m%d') AS run, CAST(least(5, greatest(1, round_even(epoch("end" - init - INTERVAL 18 HOUR) / 86400.0, 0))) AS INT) AS il FROM pv WHERE "end" > init + INTERVAL 24 HOUR)"""


def issued(spark, sf_dir) -> DataFrame:
    m = member_table(spark, sf_dir)
    return K.issued_rows(m.drop("o_t", "o_p", "o_w"), given(spark), MEMBERS, F.col("init") + F.make_dt_interval(F.lit(0), F.lit(18)), F.date_format("init", "yyyyMMdd"))


@query(ISSUED + """ SELECT run, station, date AS day, kind, il AS lead, array_to_string(list_filter([CASE WHEN a_t IS NOT NULL THEN 'a' END, CASE WHEN b_t IS NOT NULL THEN 'b' END, CASE WHEN c_t IS NOT NULL THEN 'c' END], lambda v: v IS NOT NULL), ',') AS members, round(round_even(t, 3) + 1e-9, 2) AS t, round(round_even(p, 3) + 1e-9, 2) AS p, round(round_even(pop, 3) + 1e-9, 2) AS pop FROM iss""", dates=True)
def issued_rows(spark, sf_dir):
    i = issued(spark, sf_dir)
    return i.select("run", "station", F.col("date").alias("day"), "kind", "lead", F.array_join("members", ",").alias("members"), *[F.round(F.col(c) + 1e-9, 2).alias(c) for c in ("t", "p", "pop")])


TEMPS = lambda prefix, kind, f: f"count({f} - o_t) FILTER (kind = '{kind}') AS {prefix}_n, round(avg(abs({f} - o_t)) FILTER (kind = '{kind}') + 1e-9, 4) AS {prefix}_mae"


@query(TABLE + f""" SELECT lead, {TEMPS('tmax', 'day', 'a_t')}, {TEMPS('tmin', 'night', 'a_t')}, count(*) FILTER (a_p >= 5 AND o_p >= 5) AS rain5_hits, count(*) FILTER (a_p >= 5 AND o_p < 5) AS rain5_false_alarms, round(100.0 * count(*) FILTER (a_p >= 0.1 AND o_p >= 0.1) / nullif(count(*) FILTER (a_p + o_p IS NOT NULL AND (a_p >= 0.1 OR o_p >= 0.1)), 0) + 1e-9, 4) AS rain_threat,
  round(avg(abs(a_w - o_w)) + 1e-9, 4) AS wind_mae, round(avg(CASE WHEN a_w + o_w IS NOT NULL THEN 100.0 * ({BEAUFORT_SQL('a_w')} = {BEAUFORT_SQL('o_w')})::INT END) + 1e-9, 4) AS force_exact FROM mt GROUP BY lead""")
def score_table(spark, sf_dir):
    m = member_table(spark, sf_dir).select("*", F.col("a_t").alias("t"), F.col("a_p").alias("p"), F.col("a_w").alias("w"))
    s = K.score_table(m, ["lead"]).select("lead", "tmax_n", "tmax_mae", "tmin_n", "tmin_mae", "rain5_hits", "rain5_false_alarms", "rain_threat", "wind_mae", "force_exact")
    return s.select(*[F.round(F.col(c) + 1e-9, 4).alias(c) if t == "double" else c for c, t in s.dtypes])


@query(ISSUED + """, ov AS (SELECT il AS lead, kind, run, issue, o_t, round_even(t, 3) AS t FROM iss WHERE "end" <= TIMESTAMP '2024-01-28'), rec AS (SELECT * FROM ov WHERE issue > TIMESTAMP '2024-01-18')
SELECT 'lead ' || lead AS part, count(DISTINCT run) FILTER (FALSE) AS issues, count(t - o_t) FILTER (kind = 'day') AS tmax_n, round(avg(abs(t - o_t)) FILTER (kind = 'day'), 2) AS tmax_mae FROM rec GROUP BY lead
UNION ALL SELECT strftime(issue, '%Y-%m'), count(DISTINCT run), count(t - o_t) FILTER (kind = 'day' AND lead = 1), round(avg(abs(t - o_t)) FILTER (kind = 'day' AND lead = 1), 2) FROM ov GROUP BY 1""")
def live_scores(spark, sf_dir):
    observed = member_table(spark, sf_dir).select("station", "date", "kind", "o_t", "o_p", "o_w")
    recent, months = K.live_scores(issued(spark, sf_dir), observed, F.lit("2024-01-28").cast("timestamp_ntz"), 10)
    a = recent.select(F.concat(F.lit("lead "), F.col("lead")).alias("part"), F.lit(0).cast("long").alias("issues"), "tmax_n", F.round("tmax_mae", 2).alias("tmax_mae"))
    return a.unionByName(months.select(F.col("month").alias("part"), "issues", F.coalesce("tmax_n", F.lit(0)).alias("tmax_n"), F.round("tmax_mae", 2).alias("tmax_mae")))


@query(TABLE + """, q AS (SELECT lead, least(a_p / 20, 1.0) AS f, (o_p >= 1)::INT::DOUBLE AS o, 0.4 AS c FROM mt WHERE a_p + o_p IS NOT NULL), b AS (SELECT *, CASE WHEN f < 0.2 THEN 0 WHEN f < 0.5 THEN 1 WHEN f < 0.8 THEN 2 ELSE 3 END AS bin FROM q),
 g AS (SELECT bin, lead, grouping(bin, lead)::INT AS level, count(*) AS n, sum(o)::BIGINT AS events, avg((f - o) * (f - o)) AS brier, avg((c - o) * (c - o)) AS bc, avg(o) AS observed FROM b GROUP BY GROUPING SETS ((), (bin), (lead)))
SELECT level, coalesce(bin, -1) AS bin, coalesce(lead, -1) AS lead, n, events, round(brier + 1e-9, 5) AS brier, round(observed + 1e-9, 5) AS observed, round(CASE WHEN level <> 2 AND (SELECT events FROM g WHERE level = 3) >= 10 AND bc > 0 AND (level = 3 OR n >= 20 AND events >= 5) THEN 1 - brier / bc END + 1e-9, 5) AS skill FROM g WHERE (SELECT n FROM g WHERE level = 3) >= 30""")
def event_scores(spark, sf_dir):
    m = member_table(spark, sf_dir)
    s = K.event_scores(m, F.when(F.col("a_p").isNotNull(), F.least(F.col("a_p") / 20, F.lit(1.0))), F.col("o_p"), 1.0, F.lit(0.4), [(0.0, 0.2), (0.2, 0.5), (0.5, 0.8), (0.8, 1.01)], 30, 10).na.fill(-1, ["bin", "lead"])
    return s.select("level", "bin", "lead", "n", "events", *[F.round(F.col(c) + 1e-9, 5).alias(c) for c in ("brier", "observed", "skill")])


@query(TABLE + """, cut AS (SELECT min(date) AS cut FROM (SELECT DISTINCT date FROM mt ORDER BY date DESC LIMIT 8)), de AS (SELECT kind, lead, date, avg(a_t - o_t) AS e FROM mt WHERE a_t + o_t IS NOT NULL GROUP BY ALL),
 st AS (SELECT mt.station, mt.date, mt.kind, mt.lead, mt.a_t, mt.o_t, de.e, row_number() OVER w AS k, count(de.e) OVER (PARTITION BY mt.station, mt.date, mt.kind) AS n FROM mt LEFT JOIN de ON de.kind = mt.kind AND de.lead = mt.lead AND de.date <= mt.date - mt.lead - 1 WINDOW w AS (PARTITION BY mt.station, mt.date, mt.kind ORDER BY de.date)),
 fx AS (SELECT station, date, kind, lead, max(a_t) - coalesce(sum(e * CASE WHEN k = 1 THEN pow(0.9, n - 1) ELSE 0.1 * pow(0.9, n - k) END), 0) AS t, max(a_t) AS raw, max(o_t) AS o_t FROM st GROUP BY ALL)
SELECT 'new' AS config, lead, round(avg(abs(t - o_t)) FILTER (kind = 'day') + 1e-9, 4) AS tmax_mae, round(avg(t - o_t) FILTER (kind = 'night') + 1e-9, 4) AS tmin_bias FROM fx, cut WHERE date >= cut GROUP BY lead UNION ALL SELECT 'raw', lead, round(avg(abs(raw - o_t)) FILTER (kind = 'day') + 1e-9, 4), round(avg(raw - o_t) FILTER (kind = 'night') + 1e-9, 4) FROM fx, cut WHERE date >= cut GROUP BY lead""")
def evaluated_configs(spark, sf_dir):
    m = member_table(spark, sf_dir).select("station", "date", "kind", "lead", F.col("a_t").alias("t"), F.col("a_p").alias("p"), F.col("a_w").alias("w"), "o_t", "o_p", "o_w")
    e = K.evaluate(m, 8, nodes=11, least=5)
    return e.select("config", "lead", F.round(F.col("tmax_mae") + 1e-9, 4).alias("tmax_mae"), F.round(F.col("tmin_bias") + 1e-9, 4).alias("tmin_bias"))
