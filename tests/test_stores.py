"""What is written and read again, and the smaller functions of sources, documents and times."""

import glob
import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from gridloom.functions import times
from gridloom.functions import weather as W
from gridloom.operators import consensus as K
from gridloom.operators import documents as D
from gridloom.operators import points as P
from gridloom.plans import stored
from gridloom.sources import messages, reports, stores

SF = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_a_run_is_replaced_alone_and_a_broken_file_costs_itself(spark, tmp_path):
    path = str(tmp_path / "runs")
    stores.write_store([stored.run_frames(spark, SF, "view"), stored.run_frames(spark, SF, "click")], path)
    before = set(glob.glob(f"{path}/*/*/*.parquet"))
    stores.write_store([stored.run_frames(spark, SF, "view").where("run_init = '2024010500'")], path)
    after = set(glob.glob(f"{path}/*/*/*.parquet"))
    assert {p.split("/")[-3:-1].__repr__() for p in before ^ after} == {"['source=view', 'run_init=2024010500']"}
    rows = stores.read_store(spark, path, stored.SCHEMA)
    n, lost = rows.count(), rows.where("source = 'click' AND run_init = '2024010300'").count()
    for p in glob.glob(f"{path}/source=click/run_init=2024010300/*.parquet"):
        with open(p, "r+b") as f:
            f.truncate(20)
    assert lost and stores.read_store(spark, path, stored.SCHEMA).count() == n - lost
    stores.write_store([stored.run_frames(spark, SF, "view").where("run_init = '2024010500'")], path, replace=False)
    assert stores.read_store(spark, path, stored.SCHEMA).where("source = 'view'").count() > rows.where("source = 'view'").count()
    with pytest.raises(ValueError):
        stores.write_store([], path)


def test_bucketed_tables_join_without_an_exchange(spark):
    plan = stored.bucketed_join(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_publishing_again_by_force_and_points_and_documents(spark, tmp_path):
    path, make = str(tmp_path / "docs"), lambda n: lambda: spark.createDataFrame([(n,)], "n int")
    assert [stores.publish_once(spark, make(1), path, "r", "f"), stores.publish_once(spark, make(2), path, "r", "f"), stores.publish_once(spark, make(3), path, "r", "f", force=True)] == [True, False, True]
    assert [r.n for r in spark.read.schema("n int").json(f"{path}/run=r").collect()] == [3]
    points = spark.createDataFrame([("b", "二", 1.0, 2.0, 3.0, None), ("a", "一", 4.0, 5.0, 6.0, "c")], "id string, name string, lat double, lon double, elevation_m double, parent string")
    stores.save_points(points, str(tmp_path / "points"))
    assert sorted(map(tuple, reports.points_csv(spark, str(tmp_path / "points")).collect())) == sorted(map(tuple, points.collect()))
    assert stores.read_or_none(spark, str(tmp_path / "nothing"), "n int") is None and stores.read_or_none(spark, f"{path}/run=r", "n int").count() == 1


def test_steps_fields_and_hourly_documents(spark):
    rows = spark.createDataFrame([(3, 1.0), (6, 2.0), (9, 3.0)], "step int, v double")
    assert [r.v for r in messages.step_subset(rows, [3, 9]).orderBy("step").collect()] == [1.0, 3.0]
    with pytest.raises(ValueError, match=r"\[12\]"):
        messages.step_subset(rows, [3, 12])
    lines = [("f", json.dumps({"param": "2t", "levtype": "sfc", "_offset": 5, "_length": 7})), ("g", json.dumps({"param": "10fg", "levtype": "sfc", "_offset": 0, "_length": 2})), ("g", "no json")]
    chosen = messages.select_fields(messages.json_index(spark.createDataFrame(lines, "file string, line string")), {"t2m": ["2t"], "gust": ["10fg"]}, ["t2m"])
    assert [tuple(r) for r in messages.lacking(chosen).collect()] == [("g", "t2m")]
    doc = {"hourly": {"time": ["2024-01-01T00:00", "2024-01-01T01:00"], "t_ifs": [1.0, None], "p_ifs": [0.1, 0.2], "t_gfs": [None, None], "p_gfs": [5.0, 6.0]}}
    got = reports.hourly_json(spark.createDataFrame([("x", json.dumps(doc))], "point string, json string"), ["ifs", "gfs"], ["t", "p"]).collect()
    assert sorted(map(tuple, got)) == [("x", "ifs", "2024-01-01T00:00", 1.0, 0.1), ("x", "ifs", "2024-01-01T01:00", None, 0.2)]


def test_views_and_shapes(spark):
    points = spark.createDataFrame([(1, "east"), (2, "west"), (3, "2")], "point long, name string")
    assert [r.point for r in D.township(points, F.lit("west")).collect()] == [2] and [r.point for r in D.township(points, F.lit("2")).collect()] == [2] and D.township(points, F.lit("no")).count() == 0
    doc = spark.createDataFrame([("c", [1.0, 2.0, 3.0, 4.0], [5])], "county string, t array<double>, n array<int>")
    assert D.first_hours(doc, ["t"], 6).first() == ("c", [1.0, 2.0], [5])
    nodes, extra = spark.createDataFrame([("p", 3, 1.0), ("p", 6, 2.0)], "point string, step int, v double"), spark.createDataFrame([("p", 6, 9.0), ("p", 4, 8.0), ("q", 3, 7.0)], "point string, step int, v double")
    assert sorted(map(tuple, D.merged_shape(nodes, extra).collect())) == [("p", 3, 1.0), ("p", 4, 8.0), ("p", 6, 2.0), ("q", 3, 7.0)]
    rows = spark.createDataFrame([(date(2024, 7, 1), 2, "low"), (date(2024, 7, 1), 1, "high")], "date date, place int, line string")
    assert D.bulletin(rows).first().text == "── 7月1日 \nhigh\nlow"
    assert one(spark, W.shape_hours(F.array(F.lit(3), F.lit(6)), 2, 6)) == [2, 4, 5]


def test_stamps_and_periods(spark):
    assert [one(spark, times.from_stamp(F.lit(x))) for x in ("2024010106", "2024010107", "2024023000", "junk")] == [datetime(2024, 1, 1, 6), None, None, None]
    at = lambda h: one(spark, times.period_start(F.lit(datetime(2024, 1, 1, h)).cast("timestamp_ntz")))
    assert [at(0), at(11), at(12), at(23)] == [datetime(2024, 1, 1, 0), datetime(2024, 1, 1, 0), datetime(2024, 1, 1, 12), datetime(2024, 1, 1, 12)]


def test_points_without_a_cell_and_series_rows(spark):
    grid = spark.createDataFrame([(i, j) for i in range(3) for j in range(3)], "i int, j int")
    points = spark.createDataFrame([("in", 0.5, 1.5), ("out", 2.5, 2.5)], "point string, y double, x double")
    assert [r.point for r in P.uncovered(points, grid).collect()] == ["out"]
    key = (datetime(2024, 1, 1),)
    keys = "station string, date date, kind string, lead int, init timestamp_ntz, end timestamp_ntz"
    k = ("s", date(2024, 1, 1), "day", 1, *key, *key)
    series = spark.createDataFrame([(*k, datetime(2024, 1, 1, 3), 11, 5.0), (*k, datetime(2024, 1, 1, 6), 14, 6.0)], keys + ", valid timestamp_ntz, hour int, a_t3 double")
    observed = spark.createDataFrame([("s", datetime(2024, 1, 1, 6), 7.0)], "station string, valid timestamp_ntz, o_t3 double")
    periods = spark.createDataFrame([(*k, 2.5)], keys + ", a_w double")
    assert [(r.hour, r.o_t3, r.a_w) for r in K.series_training_table(series, observed, periods, ["a"]).orderBy("hour").collect()] == [(11, None, 2.5), (14, 7.0, 2.5)]


def test_model_rows_take_the_local_lapse_at_night(spark):
    """Terrain rises by 100 m a column and the model cools by 0.9 K with it; the point stands 100 m above the model."""
    cells = [(i, j, s) for i in range(5) for j in range(5) for s in range(3, 25, 3)]
    grid = spark.createDataFrame([(i, j, s, *[20.0 - 0.9 * j + s / 10] * 3, float(s), 3.0, 4.0) for i, j, s in cells], "i int, j int, step int, tmax double, tmin double, t2m double, tp double, u10 double, v10 double")
    terrain = spark.createDataFrame([(i, j, 100.0 * j) for i in range(5) for j in range(5)], "i int, j int, orog double")
    points = spark.createDataFrame([("p", 2.0, 2.0, 300.0)], "point string, y double, x double, elevation double")
    windows = spark.createDataFrame([(s, s - 3) for s in range(3, 25, 3)], "step int, window_start int")
    periods = spark.createDataFrame([(0, 12, "day"), (12, 24, "night"), (24, 36, "day")], "start_h int, end_h int, kind string")
    got = {(r.start_h, r.kind): r for r in P.model_rows(grid, terrain, points, windows, periods).collect()}
    day, night = got[0, "day"], got[12, "night"]
    assert day.t == day.t_std and abs(day.t - (20 - 1.8 + 1.2 - 0.65)) < 1e-9 and day.p == 12.0 and day.w == 5.0
    assert abs(night.t_std - (20 - 1.8 + 1.5 - 0.65)) < 1e-9 and abs(night.t - (20 - 1.8 + 1.5 - 0.9)) < 1e-9 and night.p == 12.0
    assert (24, "day") not in got
