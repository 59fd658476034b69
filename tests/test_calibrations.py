"""Calibrations that are kept and held on to; texts of scores and winds; a product with all its parts."""

import json
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gridloom.operators import documents as D
from gridloom.operators.consensus import Calibration
from gridloom.sources import calibrations


def some(spark, intercept=0.5, rows=1):
    temperature = spark.createDataFrame([("day", 1, 1.0, intercept)] * rows, "kind string, lead int, w_a double, intercept double")
    return Calibration(temperature=temperature, wind=spark.createDataFrame([("day", 1.1)], "kind string, factor double"))


def test_a_calibration_is_made_kept_and_held(spark, tmp_path):
    path, calls, now = str(tmp_path / "cal"), [], datetime(2024, 5, 1, 6)

    def make(result):
        def f():
            calls.append(result)
            if isinstance(result, Exception):
                raise result
            return result

        return f

    value = lambda cal: None if cal is None else cal.temperature.first().intercept
    assert calibrations.newest(spark, path) is None
    assert calibrations.refreshed(spark, path, make(OSError("no archive")), now) is None
    assert calibrations.refreshed(spark, path, make(some(spark, rows=0)), now) is None  # nothing fitted is no calibration
    first = calibrations.refreshed(spark, path, make(some(spark, 0.5)), now)
    assert value(first) == 0.5 and first.wind.count() == 1 and first.precip is None
    n = len(calls)
    assert value(calibrations.refreshed(spark, path, make(some(spark, 9.0)), now + timedelta(hours=23))) == 0.5 and len(calls) == n
    assert value(calibrations.refreshed(spark, path, make(some(spark, 2.0)), now + timedelta(days=1))) == 2.0
    later = now + timedelta(days=1)
    assert value(calibrations.refreshed(spark, path, make(RuntimeError("late")), later + timedelta(days=6.9))) == 2.0
    assert calibrations.refreshed(spark, path, make(RuntimeError("late")), later + timedelta(days=7)) is None


def test_score_cells_and_winds(spark):
    rows = [("new", 1, 0.956, 94.4, 0.83, 91.0), ("new", 3, None, None, 1.0, 80.6), ("new", 2, 9.0, 9.0, 9.0, 9.0), ("one", 1, 12.345, 100.0, 1.5, None)]
    scores = spark.createDataFrame(rows, "config string, lead int, tmax_mae double, tmax_within2 double, tmin_mae double, rain_correct double")
    assert {r.config: r.text for r in D.score_cells(scores).collect()} == {"new": "Tx 0.96/ 94% Tn 0.83 晴雨 91%  Tx    —/  —% Tn 1.00 晴雨 81%", "one": "Tx 12.35/100% Tn 1.50 晴雨  —%"}
    daily = spark.createDataFrame([("p", "East", 61.5, date(2024, 1, 2), None, None), ("p", "East", 61.5, date(2024, 1, 1), 180.0, 3.25)], "point string, name string, elevation double, day date, wind_dir double, wind_speed double")
    line = D.wind_day_table(daily).first().line
    assert line == "East        " + "    62  " + "    南风   3.3" + "     —   nan"


def test_product_of_one_county_without_keys(spark):
    cells = spark.createDataFrame([(1, date(2024, 7, 1), "day", "晴", 30.0, 20.0, 30.0, 0.0, 3, 4, None, None, None), (1, date(2024, 7, 1), "night", "小雨", 25.0, 18.0, 18.0, 1.0, 2, 3, 50, None, None)], "point int, date date, kind string, weather string, tmax double, tmin double, temp double, precip double, force_hi int, gust_force int, pop int, pop_moderate int, pop_heavy int")
    points = spark.createDataFrame([(1, "one", 60.0)], "point int, name string, elevation double")
    alerts = spark.createDataFrame([("高温", date(2024, 7, 1), "关注", 35, "c", "d")], "type string, date date, level string, amount int, criterion string, detail string")
    extremes = spark.createDataFrame([(1, date(2024, 7, 1), "day", 10.0, None)], "point int, date date, kind string, tmax double, tmin double")
    doc = json.loads(D.product(cells, points, F.lit(datetime(2024, 7, 1)), alerts=alerts, extremes=extremes).first().json)
    assert [p["index"] for p in doc["periods"]] == [0, 1] and doc["days"][0]["night"] == 1 and doc["conclusions"][0]["level"] == "关注"
    assert doc["periods"][0]["cells"][0]["temp"] == 20.0  # the other maximum, but not below the minimum
    assert doc["meta"]["n_townships"] == 1 and "series3h" not in doc
    assert D.product(cells.limit(0), points, F.lit(datetime(2024, 7, 1))).count() == 0
