"""Fits against dense ones, and the words and boundaries of products."""

import math
import time

import numpy as np
from pyspark.sql import functions as F

from gridloom.operators import alerts, calibration, ensembles, products
from gridloom.plans import catalog


def dense_logit(x, y, s, l2=1.0):
    x, s = np.column_stack([np.ones(len(y)), x]), s / s.mean()
    w, pen = np.zeros(x.shape[1]), l2 * np.r_[0.0, np.ones(x.shape[1] - 1)]
    for _ in range(200):
        p = 1 / (1 + np.exp(-x @ w))
        w = w - np.linalg.solve((x * (s * p * (1 - p))[:, None]).T @ x + np.diag(pen), x.T @ (s * (p - y)) + pen * w)
    return w


def test_logistic_fit_equals_a_dense_one(spark):
    g = np.random.default_rng(1)
    x, s = g.normal(size=(300, 2)), g.uniform(0.2, 2, 300)
    y = (g.uniform(size=300) < 1 / (1 + np.exp(-(0.5 + x @ [1.0, -2.0])))).astype(float)
    key = np.where(np.arange(300) % 3 == 0, "a", "b")
    rows = [(str(k), float(a), float(b), float(e), float(w)) for k, (a, b), e, w in zip(key, x, y, s)] + [("a", None, 1.0, 1.0, 1.0), ("few", 0.0, 0.0, 1.0, 1.0)]
    fits = calibration.logistic_fit(spark.createDataFrame(rows, "k string, a double, b double, y double, s double"), ["k"], ["a", "b"], "y", "s")
    assert sorted(f["k"] for f in fits) == ["a", "b"]
    for f in fits:
        m = key == f["k"]
        assert f["n"] == m.sum() and np.allclose(f["coef"], dense_logit(x[m], y[m], s[m]), atol=1e-5)


def test_heavy_rows_share_slopes(spark):
    df = spark.createDataFrame([(2.0, 8.0, 6.0, "night"), (None, 0.0, 0.0, "day")], "a double, b double, o double, kind string")
    r = calibration.heavy_rows(df, [F.col("a"), F.col("b")], F.col("kind") == "night", F.col("o")).collect()
    got = {(x.kind, x.cut): (x.event, x.above5, x.above15, round(x.lm, 6), x.wet, x.moderate) for x in r}
    assert got["night", 5.0] == (1.0, 1.0, 0.0, round(math.log1p(5.0), 6), 1.0, 0.5)
    assert got["night", 15.0][0] == 0.0 and got["day", 0.1][3:] == (0.0, 0.0, 0.0)


def test_three_member_weights_equal_a_dense_fit(spark):
    g = np.random.default_rng(2)
    truth = g.normal(15, 5, 80)
    f = truth[:, None] + g.normal(0, 1, (80, 3)) + [1.0, -0.5, 0.0]
    s = 0.5 ** (np.arange(80) / 20)
    rows = [("day", 1, *map(float, r), float(t), float(w)) for r, t, w in zip(f, truth, s)]
    df = spark.createDataFrame(rows, "kind string, lead int, a double, b double, c double, o double, s double")
    got = calibration.temperature_weights(df, ["kind", "lead"], ["a", "b", "c"], "o", F.col("s"), calibration.ridge_of(F.col("lead"))).first()
    w = s / s.mean()
    mean = f.mean(axis=1)
    x = np.column_stack([np.ones(80), (f - mean[:, None])[:, :2]])
    beta = np.linalg.solve((x * w[:, None]).T @ x + np.diag([0.0, 80.0, 80.0]), (x * w[:, None]).T @ (truth - mean))
    want = np.array([beta[1] + 1 / 3, beta[2] + 1 / 3, 1 / 3 - beta[1] - beta[2]])
    assert want.min() > 0 and np.allclose([got.w_a, got.w_b, got.w_c], want)
    assert math.isclose(got.intercept, np.average(truth - f @ want, weights=w), rel_tol=1e-9)


def test_missing_members_drop_out(spark):
    df = spark.createDataFrame([(1.0, 3.0), (None, 3.0), (None, None)], "a double, b double")
    c = calibration.combined([F.col("a"), F.col("b")], [F.lit(0.75), F.lit(0.25)], F.lit(0.5))
    z = calibration.combined([F.col("a"), F.col("b")], [F.lit(1.0), F.lit(0.0)], F.lit(None).cast("double"))
    assert [tuple(r) for r in df.select(c.alias("c"), z.alias("z")).collect()] == [(2.0, 1.0), (3.5, 3.0), (None, None)]


def test_alert_levels(spark):
    days = spark.createDataFrame([("2024-07-0%d" % d, t) for d, t in ((1, 35.0), (2, 36.0), (3, 35.5), (4, None), (5, 36.0), (6, 41.0), (7, 20.0))], "date string, temp_max double").withColumn("date", F.to_date("date"))
    assert [r.level for r in alerts.heat(days).orderBy("date").collect()] == ["关注", "关注", "黄色", "黄色", "红色"]
    rain = spark.createDataFrame([("p", 3 * k, "2024-07-0%d" % (1 + k // 8), mm) for k, mm in enumerate([0.0, 20.0, 35.0, None, 0.0, 0.0, 0.0, 0.0, 60.0])], "point string, step int, date string, precip double").withColumn("date", F.to_date("date"))
    assert [(str(r.date), r.level, r.amount) for r in alerts.rain(rain).orderBy("date").collect()] == [("2024-07-01", "黄色", 55), ("2024-07-02", "橙色", 60)]
    night = spark.createDataFrame([("2024-01-01", "night", 9.0, 0.0, 0.0, 1.0, 8, 6), ("2024-01-01", "day", 9.0, -1.0, 0.0, 1.0, None, None)], "date string, kind string, temp_max double, temp_min double, precip_max double, precip_mean double, force_max int, gust_force_max int").withColumn("date", F.to_date("date"))
    got = {(r.type, r.level) for r in alerts.conclusions(night, rain.limit(0)).collect()}
    assert got == {("大风", "黄色"), ("霜冻", "关注")}


def test_headline_words(spark):
    cells = spark.createDataFrame([(p, d, w) for d, ws in (("2024-09-30", "小雨 中雨 多云"), ("2024-10-01", "小雨 中雨 晴"), ("2024-10-02", "晴 晴 大雨"), ("2024-10-03", "晴 晴 晴")) for p, w in enumerate(ws.split())], "point int, date string, weather string").withColumn("date", F.to_date("date"))
    said = [r.text for r in alerts.clauses(alerts.rain_grades(cells)).orderBy("first").collect()]
    assert said == ["9月30日—10月1日有小雨，局地中雨", "10月2日局地有大雨"]
    periods = spark.createDataFrame([("2024-09-30", "day", 20.5, 10.0), ("2024-09-30", "night", 15.0, 7.5)], "date string, kind string, temp_max double, temp_min double").withColumn("date", F.to_date("date"))
    none = spark.createDataFrame([], "type string, date date, level string, amount long")
    assert alerts.headline("城区今天白天晴", alerts.rain_grades(cells), periods, none).first()[0] == "城区今天白天晴；之后9月30日—10月1日有小雨，局地中雨；10月2日局地有大雨；全县最高气温20℃，夜间最低8℃。"
    assert alerts.headline("全县", alerts.rain_grades(cells.limit(0)), periods.limit(0), none).first()[0] == "全县；之后无明显降水。"


def test_texts(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(products.display_width(F.lit("今天ab"))) == 6 and one(products.padded(F.lit("今"), 4)) == "今  "
    assert one(products.slug(F.lit("a b/今"))) == "a_b_今" and one(products.weights_of(F.lit("ifs=0.6,gfs=0.4"))) == {"ifs": 0.6, "gfs": 0.4}
    starts = F.array(*[F.lit(f"2024-01-01 {h:02d}:00:00").cast("timestamp_ntz") for h in (0, 3, 9, 13)])
    assert one(products.span_text(starts)) == "08—14时、17—20时、21—24时" and one(products.span_text(F.slice(starts, 1, 0))) == "无"


def test_plan_starts_with_the_next_period_when_little_is_left(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:00", "2024-01-01 06:30:00"), ("2024-01-01 18:00:00", "2024-01-01 18:00:00")], "init string, issue string").select(*[F.col(c).cast("timestamp_ntz").alias(c) for c in ("init", "issue")])
    p = products.plan(df).orderBy("init", "k").collect()
    first, second = [[r for r in p if r.init.hour == h] for h in (0, 18)]
    assert (len(first), first[0].kind, first[0].start_lead, first[0].label) == (11, "night", 12, "今天夜间")
    assert (len(second), second[0].kind, second[0].label, second[0].start_lead) == (10, "day", "今天白天", 6)  # the night began before init


def test_buckets_without_cover_are_unknown(spark):
    b = spark.createDataFrame([("p", m, s, s + 6, 1.0) for m in "ab" for s in (0, 6) if (m, s) != ("b", 6)], "point string, member string, start_h long, end_h long, mm double")
    w = spark.createDataFrame([("p", 0, 6), ("p", 3, 9)], "point string, from_h long, to_h long")
    assert {r.from_h: r["pop"] for r in ensembles.window_probability(b, w, ["point"]).collect()} == {0: 100.0, 3: None}


def test_windows_need_every_hour(spark):
    h = spark.createDataFrame([(1, k, float(k), 1.0, None if k == 5 else 2.0, 40.0, 2.0, 180.0) for k in range(0, 8) if k != 7], "point int, hour int, t double, p double, gust double, cloud double, speed double, direction double")
    got = {r.step: (r.t2m, r.tmax3, r.tmin3, r.precip, r.gust, round(r.v10, 6)) for r in ensembles.member_windows(h, ["point"]).collect()}
    assert got == {3: (3.0, 3.0, 0.0, 3.0, 2.0, 2.0), 6: (6.0, 6.0, 3.0, 3.0, None, 2.0)}


def test_empty_tables(spark):
    b = spark.createDataFrame([], "point string, member string, start_h long, end_h long, mm double")
    assert ensembles.two_level_extremes(b, ["point"], "mm").count() == 0
    assert calibration.logistic_fit(b, ["point"], ["mm"], "mm") == []
    assert len(catalog.QUERIES) > 90


def test_weighted_quantiles_equal_dense_ones(spark):
    from gridloom.operators import fitting

    g = np.random.default_rng(3)
    v, w, probs = np.round(g.exponential(2, 500), 1) * (g.uniform(size=500) > 0.4), g.uniform(0.1, 3, 500), np.linspace(0, 1, 41)
    rows = [("k", float(a), float(b)) for a, b in zip(v, w)] + [("one", 5.0, 2.0), ("none", None, 1.0), ("same", 1.0, 1.0), ("same", 1.0, 2.0)]
    got = {(r.k, round(r.prob, 6)): r.q for r in fitting.weighted_quantiles(spark.createDataFrame(rows, "k string, v double, w double"), ["k"], "v", "w", list(probs)).collect()}
    order = np.lexsort((w, v))
    cum = np.cumsum(w[order])
    want = np.interp(probs, (cum - w[order][0]) / (cum[-1] - w[order][0]), v[order])
    assert np.allclose([got["k", round(float(p), 6)] for p in probs], want)
    assert {got["one", round(float(p), 6)] for p in probs} == {5.0} and {got["same", round(float(p), 6)] for p in probs} == {1.0} and len(got) == 123


def test_display_width_costs_little_more_than_a_scan(spark):
    row = F.lpad(F.col("id").cast("string"), 4, "0")  # else the texts are constants, whose widths the planner works out once
    lines = spark.range(0, 1000, 1, 4).select(F.repeat(F.concat(row, F.lit(" Wind NW 5 m/s, überall Nebel")), 1200).alias("latin"), F.repeat(F.concat(row, F.lit("今天 ab😀")), 3).alias("mixed"), F.when(F.col("id") < 0, row).alias("none"))
    found = lines.select(*[products.display_width(F.col(c)).alias(c) for c in lines.columns]).distinct().collect()
    assert [tuple(r) for r in found] == [(39_600, 36, None)]

    def least(column):
        took = []
        for _ in range(3):
            began = time.perf_counter()
            lines.select(column).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        return min(took)

    scan = least(F.char_length(F.regexp_replace("latin", "[\u4e00-\u9fff]+", "")))
    assert least(products.display_width(F.col("latin"))) < 5 * scan + 0.3
