"""Queries of the rolling backtest and of fitted rain chances, each beside its SQL; ten regions are stations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import calibration as C
from gridloom.operators import consensus as K
from gridloom.operators import rolling as R
from gridloom.plans.calibrations import NEWEST, ROWS, rain_rows
from gridloom.plans.catalog import BEAUFORT_SQL, query
from gridloom.plans.consensus import MEAN, MEMBERS, RIDGE_OF, TABLE, curve_rows, member_table

SETTINGS = R.Settings(window_days=18, nodes=11, least=5, least_night=10, least_rain=8, least_wind=8, least_pop=8)
DAYS, FIRST = 9, 5


def station_rows(spark, sf_dir) -> DataFrame:
    """The member table with rain lessened, so that it is dry often, and members brought to the station's height: two of them half a degree warmer."""
    m = member_table(spark, sf_dir)
    less = lambda c: F.when(F.col(c).isNotNull(), F.greatest(F.col(c) - 2, F.lit(0.0))).alias(c)
    return m.select(*[less(c) if c.endswith("_p") else c for c in m.columns], (F.col("a_t") + 0.5).alias("a_t_std"), (F.col("b_t") + 0.5).alias("b_t_std"), F.col("c_t").alias("c_t_std"))


def tested(spark, sf_dir, chances: bool = True, curve: bool = False) -> R.Backtest:
    rows = station_rows(spark, sf_dir)
    return R.backtest(rows, MEMBERS, SETTINGS, DAYS, curve_rows(spark, sf_dir) if curve else None, fewest=FIRST, history_days=FIRST, chances=chances)


# The same by a fit for each issue: every row once for each issue in whose window its period ended.
LESS = ", ".join(f"CASE WHEN {m}_p IS NOT NULL THEN greatest({m}_p - 2, 0) END AS {m}_p" for m in "abco")
ISSUES = TABLE + f""", st AS (SELECT * REPLACE ({LESS}), a_t + 0.5 AS a_s, b_t + 0.5 AS b_s, c_t AS c_s, init + INTERVAL 690 MINUTE AS own FROM mt), i AS (SELECT DISTINCT own AS issue FROM st WHERE init > (SELECT max(init) FROM st) - INTERVAL {DAYS} DAY),
 tr AS (SELECT issue, st.* FROM st JOIN i ON "end" <= issue AND "end" > issue - INTERVAL 18 DAY)"""
FITS = """, z AS (SELECT issue, kind, lead, pow(0.5, epoch(issue - "end") / 86400.0 / 20) AS s, a_t - (a_t + b_t + c_t) / 3 AS x1, b_t - (a_t + b_t + c_t) / 3 AS x2, o_t - (a_t + b_t + c_t) / 3 AS r FROM tr WHERE a_t + b_t + c_t + o_t IS NOT NULL),
 k0 AS (SELECT issue, kind, lead, count(*) AS n, sum(s) AS s, sum(s * x1) / sum(s) AS m1, sum(s * x2) / sum(s) AS m2, sum(s * r) / sum(s) AS mr FROM z GROUP BY ALL HAVING count(*) >= 5),
 k1 AS (SELECT issue, kind, lead, n, m1, m2, mr, n / k0.s * sum(z.s * (x1 - m1) * (x1 - m1)) + """ + RIDGE_OF + """ * n AS p, n / k0.s * sum(z.s * (x1 - m1) * (x2 - m2)) AS q, n / k0.s * sum(z.s * (x2 - m2) * (x2 - m2)) + """ + RIDGE_OF + """ * n AS v, n / k0.s * sum(z.s * (x1 - m1) * (r - mr)) AS g, n / k0.s * sum(z.s * (x2 - m2) * (r - mr)) AS h FROM z JOIN k0 USING (issue, kind, lead) GROUP BY issue, kind, lead, n, k0.s, m1, m2, mr),
 k2 AS (SELECT *, greatest((g * v - h * q) / (p * v - q * q) + 1.0 / 3, 0) AS u1, greatest((h * p - g * q) / (p * v - q * q) + 1.0 / 3, 0) AS u2, greatest(1.0 / 3 - (g * v - h * q) / (p * v - q * q) - (h * p - g * q) / (p * v - q * q), 0) AS u3 FROM k1),
 fit AS (SELECT issue, kind, lead, u1 / (u1 + u2 + u3) AS w1, u2 / (u1 + u2 + u3) AS w2, u3 / (u1 + u2 + u3) AS w3, mr - (u1 * m1 + u2 * m2 - u3 * (m1 + m2)) / (u1 + u2 + u3) AS a0 FROM k2)"""
PRESENT = "coalesce(w1 * (a_t IS NOT NULL)::INT, 0) + coalesce(w2 * (b_t IS NOT NULL)::INT, 0) + coalesce(w3 * (c_t IS NOT NULL)::INT, 0)"
BASE = f"CASE WHEN {PRESENT} <= 1e-9 THEN {MEAN('t')} ELSE (w1 * coalesce(a_t, 0) + w2 * coalesce(b_t, 0) + w3 * coalesce(c_t, 0)) / ({PRESENT}) END + coalesce(a0, 0)"
LOG_WIND = f"ln(least(greatest({MEAN('w')}, 0.3), 8))"
NIGHTS = f""", nx AS (SELECT tr.issue, {LOG_WIND} AS x, o_t - ({BASE}) AS r, pow(0.5, epoch(tr.issue - "end") / 86400.0 / 20) AS w FROM tr LEFT JOIN fit USING (issue, kind, lead) WHERE kind = 'night' AND {MEAN('w')} + o_t + {MEAN('t')} IS NOT NULL),
 nm AS (SELECT issue, sum(w * x) / sum(w) AS mu, sum(w * r) / sum(w) AS rm FROM nx GROUP BY issue HAVING count(*) >= 10), nb AS (SELECT issue, sum(w * (x - mu) * (r - rm)) / (1.01 * sum(w * (x - mu) * (x - mu))) AS b, max(mu) AS mu FROM nx JOIN nm USING (issue) GROUP BY issue)"""
BIASES = """, e AS (SELECT issue, kind, lead, "end", avg((a_s + b_s + c_s) / 3 - o_t) AS e FROM tr WHERE a_s + b_s + c_s + o_t IS NOT NULL GROUP BY ALL),
 ek AS (SELECT *, row_number() OVER (PARTITION BY issue, kind, lead ORDER BY "end") AS k, count(*) OVER (PARTITION BY issue, kind, lead) AS n FROM e),
 eb AS (SELECT issue, kind, lead, sum(e * CASE WHEN k = 1 THEN pow(0.9, n - 1) ELSE 0.1 * pow(0.9, n - k) END) AS bias FROM ek GROUP BY ALL)"""
WIND = """, wf AS (SELECT issue, kind, CASE WHEN count(*) >= 8 AND avg(f) > 0.3 THEN least(greatest(avg(o_w) / avg(f), 0.6), 1.8) ELSE 1 END AS factor FROM (SELECT *, (a_w + b_w + c_w) / 3 AS f FROM tr) WHERE f + o_w IS NOT NULL GROUP BY ALL)"""


def maps_sql(name: str, keys: str, rows: str) -> str:
    """Weighted quantiles of f and o on eleven nodes for each key, as lists: rows in order of value, then weight."""

    def side(x: str) -> str:
        return f""", {name}_{x}c AS (SELECT {keys}, {x} AS v, sum(s) OVER k AS c, first_value(s) OVER k AS w0, sum(s) OVER (PARTITION BY {keys}) AS t FROM {name}_r WINDOW k AS (PARTITION BY {keys} ORDER BY {x}, s ROWS UNBOUNDED PRECEDING)),
 {name}_{x}a AS (SELECT {keys}, v, coalesce((c - w0) / nullif(t - w0, 0), 0) AS p FROM {name}_{x}c), {name}_{x}b AS (SELECT *, lead(p) OVER z AS np, lead(v) OVER z AS nv FROM {name}_{x}a WINDOW z AS (PARTITION BY {keys} ORDER BY p, v)),
 {name}_{x}q AS (SELECT {keys}, k, max(v + coalesce((nv - v) * (k / 10.0::DOUBLE - p) / nullif(np - p, 0), 0)) AS q FROM {name}_{x}b, range(11) r(k) WHERE (k / 10.0::DOUBLE >= p - 1e-12) AND k / 10.0::DOUBLE < coalesce(np - 1e-12, 2) GROUP BY ALL),
 {name}_{x} AS (SELECT {keys}, list(q ORDER BY k) AS {x}q FROM {name}_{x}q GROUP BY ALL)"""

    return f", {name}_r AS ({rows}), {name}_n AS (SELECT {keys} FROM {name}_r GROUP BY ALL HAVING count(*) >= 8)" + side("f") + side("o") + f", {name} AS (SELECT * FROM {name}_n JOIN {name}_f USING ({keys}) JOIN {name}_o USING ({keys}))"


def mapped_sql(x: str, fq: str = "fq", oq: str = "oq") -> str:
    i = f"least(greatest(len(list_filter({fq}, lambda z: z < {x})), 1), 10)"
    inside = f"{oq}[{i}] + ({oq}[{i} + 1] - {oq}[{i}]) * least(greatest(coalesce(({x} - {fq}[{i}]) / nullif({fq}[{i} + 1] - {fq}[{i}], 0), 0), 0), 1)"
    return f"CASE WHEN {x} IS NULL OR {fq} IS NULL THEN {x} ELSE greatest(least(CASE WHEN {fq}[11] > 0 AND {x} > {fq}[11] THEN {x} * least(greatest({oq}[11] / {fq}[11], 0.5), 3.0) ELSE {inside} END, 1.5 * {x}), 0) END"


RAIN_WEIGHT = 'pow(0.5, epoch(issue - "end") / 86400.0 / 14)'
PRECIP = maps_sql("pm", "issue, kind", f"SELECT issue, kind, (a_p + b_p + c_p) / 3 AS f, o_p AS o, {RAIN_WEIGHT} AS s FROM tr WHERE a_p + b_p + c_p + o_p IS NOT NULL")
FORECASTS = ISSUES + FITS + NIGHTS + BIASES + WIND + PRECIP + f""", y1 AS (SELECT st.*, issue, {BASE} + CASE WHEN kind = 'night' THEN coalesce(b * ({LOG_WIND} - mu), 0) ELSE 0 END AS t, (a_s + b_s + c_s) / 3 - coalesce(bias, 0) AS mb, (a_s + b_s + c_s) / 3 AS raw, {MEAN('w')} * coalesce(factor, 1) AS w, {MEAN('p')} AS mp, fq, oq
  FROM st JOIN i ON own = issue LEFT JOIN fit USING (issue, kind, lead) LEFT JOIN nb USING (issue) LEFT JOIN eb USING (issue, kind, lead) LEFT JOIN wf USING (issue, kind) LEFT JOIN pm USING (issue, kind)),
 fc AS (SELECT *, {mapped_sql('mp')} AS p FROM y1),
 cf AS (SELECT f.*, c.* FROM (SELECT *, a_t + b_t + c_t + o_t IS NOT NULL AS kt, a_p + b_p + c_p + o_p IS NOT NULL AS kp, a_w + b_w + c_w + o_w IS NOT NULL AS kw FROM fc) f, LATERAL (VALUES
  ('new', CASE WHEN kt THEN f.t END, CASE WHEN kp THEN f.p END, CASE WHEN kw THEN f.w END), ('mean_bias', CASE WHEN kt THEN mb END, CASE WHEN kp THEN f.p END, NULL),
  ('new_raw', CASE WHEN kt THEN raw END, CASE WHEN kp THEN (a_p + b_p + c_p) / 3 END, CASE WHEN kw THEN (a_w + b_w + c_w) / 3 END), ('single', CASE WHEN kt THEN a_s END, CASE WHEN kp THEN a_p END, CASE WHEN kw THEN a_w END)) c(config, ct, cp, cw))"""


def temps(prefix: str, kind: str) -> str:
    at = f"FILTER (kind = '{kind}')"
    return f"count(ct - o_t) {at} AS {prefix}_n, round(avg(abs(ct - o_t)) {at} + 1e-9, 3) AS {prefix}_mae, round(avg(ct - o_t) {at} + 1e-9, 3) AS {prefix}_bias, round(avg(CASE WHEN abs(ct - o_t) <= 2 THEN 100.0 WHEN ct - o_t IS NOT NULL THEN 0.0 END) {at} + 1e-9, 3) AS {prefix}_within2"


def rain(prefix: str, limit: float) -> str:
    n = lambda f, o: f"count(*) FILTER (cp {f} {limit} AND o_p {o} {limit})"
    a, b, c, d = n(">=", ">="), n(">=", "<"), n("<", ">="), n("<", "<")
    div = lambda x, y: f"round({x} / nullif({y}, 0) + 1e-9, 3)"
    return f"{a} AS {prefix}_hits, {b} AS {prefix}_false_alarms, {c} AS {prefix}_misses, {d} AS {prefix}_dry, " + ", ".join(f"{x} AS {prefix}_{k}" for k, x in (("correct", div(f"100.0 * ({a} + {d})", f"{a} + {b} + {c} + {d}")), ("threat", div(f"100.0 * {a}", f"{a} + {b} + {c}")), ("detected", div(f"100.0 * {a}", f"{a} + {c}")), ("false_ratio", div(f"100.0 * {b}", f"{a} + {b}")), ("frequency_bias", div(f"1.0 * ({a} + {b})", f"{a} + {c}"))))


def thirds(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(F.col(c) + 1e-9, 3).alias(c) if t == "double" else c for c, t in df.dtypes])


@query(FORECASTS + f""" SELECT config, lead, {temps('tmax', 'day')}, {temps('tmin', 'night')}, {rain('rain', 0.1)}, {rain('rain5', 5.0)},
  count(cw - o_w) AS wind_n, round(avg(abs(cw - o_w)) + 1e-9, 3) AS wind_mae, round(avg(cw - o_w) + 1e-9, 3) AS wind_bias, round(avg(CASE WHEN cw + o_w IS NOT NULL THEN 100.0 * ({BEAUFORT_SQL('cw')} = {BEAUFORT_SQL('o_w')})::INT END) + 1e-9, 3) AS force_exact FROM cf GROUP BY config, lead""")
def rolling_measures(spark, sf_dir):
    """Scores of four configurations on the same rows, each issue by fits of its own: temperature, rain and wind by lead."""
    return thirds(tested(spark, sf_dir, chances=False).measures("a"))


@query(FORECASTS + """ SELECT lead, count(*) AS n, count(*) FILTER (o_t <= 4) AS events, count(*) FILTER (o_t <= 4 AND t <= 4) AS hits, count(*) FILTER (o_t > 4 AND t <= 4) AS false_alarms, round(avg(t - o_t) FILTER (o_t <= 4) + 1e-9, 3) AS event_bias FROM fc WHERE kind = 'night' AND a_t + b_t + c_t + o_t + t IS NOT NULL GROUP BY lead""")
def rolling_frost(spark, sf_dir):
    """Cold nights, here up to 4 degrees, which the tables' values seldom fall below."""
    return thirds(tested(spark, sf_dir, chances=False).frost(limit=4.0))


CURVES = FORECASTS + f""", s3 AS (SELECT st.*, issue, hour, a_t - hour / 4.0::DOUBLE AS a3, b_t - hour / 4.0::DOUBLE AS b3, c_t - hour / 4.0::DOUBLE AS c3, o_t - hour / 2.0::DOUBLE AS o3 FROM tr st, (VALUES (8), (11), (14)) v(hour)),
 hb AS (SELECT issue, lead, hour, count(*) AS n, sum(s * r) / sum(s) AS bias FROM (SELECT s3.issue, lead, hour, pow(0.5, epoch(s3.issue - "end") / 86400.0 / 20) AS s, o3 - (CASE WHEN w1 IS NULL THEN (a3 + b3 + c3) / 3 ELSE w1 * a3 + w2 * b3 + w3 * c3 END + CASE WHEN kind = 'night' THEN coalesce(b * ({LOG_WIND} - mu), 0) ELSE 0 END) AS r
  FROM s3 LEFT JOIN fit USING (issue, kind, lead) LEFT JOIN nb ON nb.issue = s3.issue WHERE a3 + b3 + c3 + o3 IS NOT NULL) GROUP BY ALL HAVING count(*) >= 5),
 c1 AS (SELECT fc.*, v.hour, fc.t - v.hour / 4.0::DOUBLE AS cur, o_t - v.hour / 2.0::DOUBLE AS o3, hb.bias AS hb, coalesce(a0, 0) AS icpt FROM fc CROSS JOIN (VALUES (8), (11), (14)) v(hour) LEFT JOIN hb ON hb.issue = fc.issue AND hb.lead = fc.lead AND hb.hour = v.hour LEFT JOIN fit ON fit.issue = fc.issue AND fit.kind = fc.kind AND fit.lead = fc.lead),
 c2 AS (SELECT *, CASE kind WHEN 'day' THEN least(cur + CASE WHEN hb IS NOT NULL THEN hb - icpt ELSE 0 END, t) ELSE greatest(cur + CASE WHEN hb IS NOT NULL THEN hb - icpt ELSE 0 END, t) END AS held FROM c1 WHERE a_t + b_t + c_t + o_t IS NOT NULL),
 c3 AS (SELECT c2.lead, c2.hour, o3, c.* FROM c2, LATERAL (VALUES ('current', cur), ('hour_bias', held)) c(config, f))"""


@query(CURVES + " SELECT config, lead, coalesce(hour, -1) AS hour, count(*) AS n, round(avg(abs(f - o3)) + 1e-9, 3) AS mae, round(avg(f - o3) + 1e-9, 3) AS bias, round(avg(CASE WHEN abs(f - o3) <= 2 THEN 100.0 ELSE 0.0 END) + 1e-9, 3) AS within2 FROM c3 GROUP BY GROUPING SETS ((config, lead), (config, lead, hour))")
def rolling_curves(spark, sf_dir):
    """Scores of the 3-hourly curve as drawn and with the hours' own biases."""
    return thirds(tested(spark, sf_dir, chances=False, curve=True).hours()).na.fill(-1, ["hour"])


# ---------------------------------------------------------------- chances of rain


def newton_sql(rows: str, keys: str, least: int, rounds: int = 12) -> str:
    """Logistic regressions on x1 and x2 by Newton steps written out one after the other, three equations solved by Cramer's rule; ``rows``: keys, x1, x2, y, s."""
    sql = f", nr0 AS ({rows}), nr AS (SELECT *, s / avg(s) OVER (PARTITION BY {keys}) AS v, count(*) OVER (PARTITION BY {keys}) AS n FROM nr0), c0 AS (SELECT {keys}, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2 FROM nr WHERE n >= {least} GROUP BY ALL)"
    for k in range(rounds):
        sql += f""", q{k} AS (SELECT {keys}, b0, b1, b2, x1, x2, y, v, 1 / (1 + exp(-least(greatest(b0 + b1 * x1 + b2 * x2, -30), 30))) AS p FROM nr JOIN c{k} USING ({keys})),
 h{k} AS (SELECT {keys}, b0, b1, b2, sum(v * (p - y)) AS g0, sum(v * (p - y) * x1) + b1 AS g1, sum(v * (p - y) * x2) + b2 AS g2, sum(v * p * (1 - p)) AS a, sum(v * p * (1 - p) * x1) AS b, sum(v * p * (1 - p) * x2) AS c, sum(v * p * (1 - p) * x1 * x1) + 1 AS d, sum(v * p * (1 - p) * x1 * x2) AS e, sum(v * p * (1 - p) * x2 * x2) + 1 AS f FROM q{k} GROUP BY {keys}, b0, b1, b2),
 d{k} AS (SELECT *, a * (d * f - e * e) - b * (b * f - e * c) + c * (b * e - d * c) AS det FROM h{k}),
 c{k + 1} AS (SELECT {keys}, b0 - (g0 * (d * f - e * e) - b * (g1 * f - e * g2) + c * (g1 * e - d * g2)) / det AS b0, b1 - (a * (g1 * f - g2 * e) - g0 * (b * f - e * c) + c * (b * g2 - g1 * c)) / det AS b1, b2 - (a * (d * g2 - e * g1) - b * (b * g2 - g1 * c) + g0 * (b * e - d * c)) / det AS b2 FROM d{k})"""
    return sql + f", logit AS (SELECT * FROM c{rounds})"


EACH = " UNION ALL ".join(f"SELECT '{m}' AS member, issue, kind, {m}_p AS f, o_p AS o, {RAIN_WEIGHT} AS s FROM tr WHERE a_p + b_p + c_p + o_p IS NOT NULL" for m in MEMBERS)
CHANCES = ISSUES + maps_sql("mm", "member, issue, kind", EACH) + """, ml AS (SELECT issue, kind, """ + ", ".join(f"max(fq) FILTER (member = '{m}') AS {m}f, max(oq) FILTER (member = '{m}') AS {m}o" for m in MEMBERS) + """ FROM mm GROUP BY ALL)"""
MAPPED = ", ".join(f"{mapped_sql(f'{m}_p', f'{m}f', f'{m}o')} AS {m}q" for m in MEMBERS)
SHARE = "((aq >= 0.1)::INT + (bq >= 0.1)::INT + (cq >= 0.1)::INT) / 3.0::DOUBLE"
POP = CHANCES + f", tm AS (SELECT *, {MAPPED} FROM tr LEFT JOIN ml USING (issue, kind) WHERE a_p + b_p + c_p + o_p IS NOT NULL)" + newton_sql(f"SELECT issue, kind, {SHARE} AS x1, ln(1 + (aq + bq + cq) / 3) AS x2, (o_p >= 0.1)::INT AS y, {RAIN_WEIGHT} AS s FROM tm", "issue, kind", 8)


POP_ROWS = ", ".join(f"{mapped_sql(f'{m}_p', f'{m}f', f'{m}o')} AS {m}q" for m in MEMBERS)


@query(POP + f""", tp AS (SELECT st.*, issue, {POP_ROWS} FROM st JOIN i ON own = issue LEFT JOIN ml USING (issue, kind)), tq AS (SELECT *, list_filter([aq, bq, cq], lambda v: v IS NOT NULL) AS q FROM tp),
 tw AS (SELECT *, list_avg(list_transform(q, lambda v: (v >= 0.1)::INT)) AS x1, ln(1 + list_avg(q)) AS x2 FROM tq)
SELECT station, date AS day, kind, round(CASE WHEN b0 IS NULL OR x1 IS NULL THEN x1 ELSE 1 / (1 + exp(-least(greatest(b0 + b1 * x1 + b2 * x2, -30), 30))) END, 3) AS pop FROM tw LEFT JOIN logit USING (issue, kind)""", dates=True)
def rolling_pop(spark, sf_dir):
    """The probability of any rain of each tested row, by quantile maps and logistic fits of its own issue."""
    rows = tested(spark, sf_dir).rows
    return rows.select("station", F.col("date").alias("day"), "kind", F.round("pop", 3).alias("pop"))


@query(ROWS + newton_sql(f"""SELECT user_id, day, kind, ((f1 / 10 >= 0.1)::INT + (f2 / 10 >= 0.1)::INT) / 2.0::DOUBLE AS x1, ln(1 + (f1 / 10 + f2 / 10) / 2) AS x2, (o / 10 >= 5)::INT AS y, pow(0.5, epoch(TIMESTAMP '{NEWEST}' - "end") / 86400.0 / 14) AS s FROM t WHERE f1 + f2 + o IS NOT NULL""", "kind", 5)
       + " SELECT user_id, CAST(day AS VARCHAR) AS day, round(1 / (1 + exp(-least(greatest(b0 + b1 * x1 + b2 * x2, -30), 30))), 5) AS pop FROM nr0 JOIN logit USING (kind)")
def rain_probability(spark, sf_dir):
    """Logistic probability of at least 5 mm from two members."""
    r = rain_rows(spark, sf_dir)
    wet, lm = C.rain_features([F.col("p1"), F.col("p2")])
    r = r.withColumn("wet", wet).withColumn("lm", lm).withColumn("event", F.col("o") / 10 >= 5)
    fits = C.logistic_fit(r, ["kind"], ["wet", "lm"], "event", "w", least=5)
    coef = spark.createDataFrame([(f["kind"], f["coef"]) for f in fits], "kind string, coef array<double>")
    z = F.col("coef")[0] + F.col("coef")[1] * F.col("wet") + F.col("coef")[2] * F.col("lm")
    return r.join(F.broadcast(coef), "kind").select("user_id", F.substring(F.col("day").cast("string"), 1, 10).alias("day"), F.round(1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-30.0)), F.lit(30.0)))), 5).alias("pop"))
