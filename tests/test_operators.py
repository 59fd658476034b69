"""Boundaries, nulls and ties of operators that the common tables do not reach."""

import math

from pyspark.sql import functions as F

from gridloom.functions import weather as W
from gridloom.operators import align, fitting, interpolate, periods, scores, windows
from gridloom.sources import reports, stores
from gridloom.streaming import live


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_ladders(spark):
    text = lambda v: one(spark, W.rain_text(F.lit(v), 12))
    assert [text(v) for v in (0.05, 0.1, 4.9, 5.0, 14.9, 15.0, 30.0, 70.0)] == ["无降水", "小雨", "小雨", "中雨", "中雨", "大雨", "暴雨", "大暴雨"]
    rate = lambda v: one(spark, W.window_text(F.lit(v), F.lit(0.0), F.lit(0.0), 1))
    assert [rate(v) for v in (0.1, 2.5, 2.6, 7.6, 7.7, 19.9, 20.0)] == ["小雨", "小雨", "中雨", "中雨", "大雨", "大雨", "强降水"]
    assert [one(spark, W.sky_text(F.lit(v))) for v in (0.3, 0.4, 0.7, 0.8)] == ["晴", "多云", "多云", "阴"]
    assert one(spark, W.beaufort(F.lit(math.nan))) == 0 and one(spark, W.beaufort(F.lit(40.0))) == 12
    assert one(spark, W.rain_range(F.lit("小雨"), F.lit("中雨"))) == "小到中雨"
    assert one(spark, W.wind_text(F.lit(45.0), F.lit(1.0), F.lit(5.0), F.lit(14.0))) == "东北风2～3级，阵风7级"


def test_probabilities_stay_ordered(spark):
    a, b, c = W.ordered_probabilities(F.lit(30.0), F.lit(50.0), F.lit(40.0))
    assert spark.range(1).select(a.alias("a"), b.alias("b"), c.alias("c")).first() == (30.0, 30.0, 30.0)
    assert one(spark, W.ordered_probabilities(F.lit(None).cast("double"), F.lit(50.0), F.lit(60.0))[2]) == 50.0


def test_lead_days_round_halves_to_even(spark):
    assert [one(spark, W.lead_day(F.lit(h))) for h in (12.5, 36.0, 60.0, 130.0)] == [1, 2, 2, 5]


def test_overlap_join_is_exact(spark):
    a = spark.createDataFrame([("x", 0, 6), ("x", 6, 30), ("y", 5, 5)], "k string, start_h long, end_h long")
    b = spark.createDataFrame([("x", 4, 28), ("x", 30, 54)], "k string, from_h long, to_h long")
    got = {(r.start_h, r.from_h, r.overlap) for r in align.overlap_join(a, b, ["k"], 24).collect()}
    assert got == {(0, 4, 2), (6, 4, 22)}


def test_majority_ties_take_the_first(spark):
    df = spark.createDataFrame([(1, "b", 1), (1, "a", 2), (1, "a", 3), (1, "b", 4), (1, None, 5)], "k int, v string, s int")
    assert periods.majority(df, ["k"], "v", F.col("s")).first().v == "b"


def test_disaggregation_conserves_totals(spark):
    w = spark.createDataFrame([("p", 3, 6.0), ("p", 6, 1.0)], "k string, step int, total double")
    shape = spark.createDataFrame([("p", 1, 1.0), ("p", 2, 2.0), ("p", 3, 0.0)], "k string, hour int, shape double")
    got = {r.hour: r.amount for r in interpolate.disaggregate(w, shape, 3, ["k"]).collect()}
    assert got[1] == 2.0 and got[2] == 4.0 and abs(got[4] - 1 / 3) < 1e-12


def test_empty_denominators_are_null(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "f double, o double")
    r = df.agg(*scores.rain_scores(F.col("f"), F.col("o"), 30.0, 30.0)).first()
    assert r.threat is None and r.correct == 100.0


def test_running_sums_count_nulls_as_zero(spark):
    df = spark.createDataFrame([("p", 3, 1.0), ("p", 6, None), ("p", 9, 2.0)], "point string, step int, precip double")
    assert [r.s for r in windows.running_sums(df, {"s": 2}).orderBy("step").collect()] == [None, 1.0, 2.0]


def test_upsert_and_log(spark, tmp_path):
    old = spark.createDataFrame([("a", 1, 1.0)], "k string, seq int, v double")
    new = spark.createDataFrame([("a", 0, 2.0), ("a", 1, 3.0), ("b", 0, None)], "k string, seq int, v double")
    assert {(r.k, r.v) for r in stores.upsert(old, new, ["k"], "seq").collect()} == {("a", 3.0), ("b", None)}
    log = spark.createDataFrame([("r1", "2024-01-30", 1), ("r1", "2024-02-02", 2)], "run string, issue string, seq int")
    stores.append_log(log, str(tmp_path / "log"))
    assert stores.load_log(spark.read.parquet(str(tmp_path / "log")), "2024-02-01", ["run"], "seq").count() == 1


def test_codes(spark):
    assert [one(spark, reports.rain_code(F.lit(c))) for c in ("000", "007", "990", "993", "/12")] == [0.0, 7.0, 0.05, 0.3, None]
    lines = spark.createDataFrame([("12345,2024,01,01,06,00,AAXX 01061 12345 32970 50304 11035 21105 69922 333 10123=",), ("junk",), (None,)], "line string")
    r = reports.decode_reports(lines).collect()
    assert len(r) == 1 and (r[0].t, r[0].td, r[0].tx24, r[0].wind_speed, r[0].p12) == (-3.5, -10.5, 12.3, 4.0, 0.2)


def test_message_index(spark):
    lines = spark.createDataFrame([("f", "1:0:d=2024:APCP:surface:0-6 hour acc:"), ("f", "2:100:d=2024:APCP:surface:3-6 hour acc:"), ("f", "3:250:d=2024:TMP:2 m:6 hour fcst:")], "file string, line string")
    picked = {r["var"]: (r.offset, r.length) for r in reports.pick_messages(reports.message_index(lines), ["APCP"]).collect()}
    assert picked == {"APCP": (0, 100), "TMP": (250, None)}


def test_ewma_states_end_in_the_bias(spark):
    df = spark.createDataFrame([(1, "2024-01-0%d" % d, float(d)) for d in (1, 2, 3)], "k int, t string, e double").withColumn("t", F.to_timestamp("t").cast("timestamp_ntz"))
    last = fitting.ewma_states(df, ["k"], "t", "e", 0.5).orderBy(F.desc("t")).first().bias
    assert last == fitting.ewma_bias(df, ["k"], "t", "e", 0.5).first().bias == 2.25


def test_stream_equals_batch(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").repartition(3)
    e.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = live.drain(spark, live.tumbling(stream).withColumn("start", F.col("start").cast("string")), "tumbled", "complete", str(tmp_path / "c"))
    want = live.tumbling(e).withColumn("start", F.col("start").cast("string"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_as_of_reaches_over_empty_cells(spark):
    l = spark.createDataFrame([("a", "2024-01-05 10:00:00"), ("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 05:00:00"), ("b", "2024-01-05 00:00:00"), (None, "2024-01-05 00:00:00"), ("a", None)], "k string, t string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    r = spark.createDataFrame([("a", "2024-01-01 05:00:00", 1), ("a", "2024-01-02 00:00:00", 2), (None, "2024-01-01 00:00:00", 3), ("b", "2024-01-05 00:00:01", 4)], "k string, u string, v int").withColumn("u", F.col("u").cast("timestamp_ntz"))
    got = {(x.k, x.t and x.t.strftime("%d %H")): x.v for x in align.as_of(l, r, ["k"], "t", "u", ["v"]).collect()}
    assert got == {("a", "05 10"): 2, ("a", "01 00"): None, ("a", "01 05"): 1, ("b", "05 00"): None, (None, "05 00"): None, ("a", None): None}
    assert align.as_of(l, r.limit(0), ["k"], "t", "u", ["v"]).count() == 6
