"""Reports of fixed width, tiled windows and the rules of live views."""

import datetime as dt

from pyspark.sql import functions as F

from gridloom.operators import observations as O
from gridloom.sources import reports


def isd(temperature, wind, remark=""):
    head = "0000" + "54511" + "0" + "99999"
    line = list((head + "202401010600").ljust(105))
    line[60:63], line[65:69], line[69:70], line[87:92], line[92:93] = wind[:3], wind[3:7], "1", temperature, "1"
    return "".join(line) + remark


def test_fixed_width_records(spark):
    body = "54511 32970 50304 11035 21105 333 20123="
    lines = [isd("+0123", "1800030"), isd("+9999", "9999999", f"REMSYN{len(body):03d}{body}"), isd("-0050", "9990000", "REMSYN004BUFR"), "short", None]
    r = sorted(reports.parse_isd(spark.createDataFrame([(x,) for x in lines], "line string")).collect(), key=lambda x: x.t)
    assert [(x.wmo, x.t, x.wind_speed, x.wind_dir) for x in r] == [("54511", -5.0, 0.0, None), ("54511", -3.5, 4.0, 30.0), ("54511", 12.3, 3.0, 180.0)]
    assert r[1].tn24 == 12.3 and r[0].time == dt.datetime(2024, 1, 1, 6)


def test_overlapping_windows_cover_and_gaps_do_not(spark):
    s = spark.createDataFrame([("a", 6, 0, 5.0), ("a", 12, 4, 7.0), ("b", 6, 0, 5.0), ("b", 12, 9, 7.0)], "point string, step int, window_start int, tmax double")
    for c in ("tmin", "t2m", "tp", "u10", "v10"):
        s = s.withColumn(c, F.lit(None).cast("double"))
    p = spark.createDataFrame([(0, 12, "day")], "start_h int, end_h int, kind string")
    assert {r.point: r.f_t for r in O.period_values(s, p, ["point"]).collect()} == {"a": 7.0, "b": None}


def test_icons(spark):
    words = ["雨夹雪", "大暴雨", "中雨", "小雨", "阴", "多云", "晴", None]
    df = spark.createDataFrame([(k, w) for k, w in enumerate(words)], "k int, w string")
    got = [tuple(r) for r in df.orderBy("k").select(O.icon(F.col("w"), F.lit(False)), O.icon(F.col("w"), F.lit(True))).collect()]
    assert [g[0] for g in got] == ["snow", "storm", "rain", "drizzle", "overcast", "partly", "clear", "clear"] and [g[1] for g in got[5:]] == ["moon-partly", "moon", "moon"]


def test_live_alerts_and_health(spark):
    a = spark.createDataFrame([("霜冻", "2024-01-01"), ("大风", "2024-01-01"), ("大风", "2024-01-02")], "type string, date string")
    p = spark.createDataFrame([("2024-01-01", "night", False), ("2024-01-01", "day", True)], "date string, kind string, ended boolean")
    assert sorted(tuple(r) for r in O.live_alerts(a, p, F.lit("2024-01-02"), ["霜冻"]).collect()) == [("大风", "2024-01-02"), ("霜冻", "2024-01-01")]
    h = spark.createDataFrame([("ok", [], 0.5, 1.0, 20, 0.1), ("bad", ["gfs"], None, 4.0, 20, 0.7)], "run string, missing array<string>, calibration_days double, obs_days double, issues int, gap double")
    got = {r.run: r.warnings for r in O.health(h).collect()}
    assert got["ok"] == [] and got["bad"] == ["missing members: gfs", "no calibration", "observations are 4 days old", "live error exceeds the backtest by 0.7"]
