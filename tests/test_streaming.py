"""Streams over several batches against the same rows at once."""

import glob
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gridloom.operators import fitting
from gridloom.streaming import live

EVENTS = "/root/testdata/sf0.001/events.parquet"


def plain(df, *times):
    return sorted(map(tuple, df.select(*[F.col(c).cast("string") if c in times else F.col(c) for c in df.columns]).collect()))


@pytest.fixture(scope="module")
def arrivals(spark, tmp_path_factory):
    """Events in three files, a batch each, in order of time but for those of odd users, which come twelve hours late."""
    path = str(tmp_path_factory.mktemp("arrivals") / "in")
    known = spark.read.parquet(EVENTS)
    come = known.withColumn("at", F.col("ts") + F.make_dt_interval(F.lit(0), (F.col("user_id") % 2 * 12).cast("int")))
    for low, high in (("2024-01-01", "2024-01-11"), ("2024-01-11", "2024-01-21"), ("2024-01-21", "2025-01-01")):
        come.where((F.col("at") >= low) & (F.col("at") < high)).drop("at").coalesce(1).write.mode("append").parquet(path)
    assert spark.read.parquet(path).count() == known.count()
    return path, known.schema


def stream_of(spark, arrivals):
    return spark.readStream.schema(arrivals[1]).option("maxFilesPerTrigger", 1).parquet(arrivals[0])


@pytest.mark.parametrize("form", ["sliding", "sessions"])
def test_stream_equals_batch(spark, arrivals, tmp_path, form):
    op = getattr(live, form)
    got = live.drain(spark, op(stream_of(spark, arrivals)).withColumn("start", F.col("start").cast("string")), form, "complete", str(tmp_path))
    assert plain(got) == plain(op(spark.read.parquet(arrivals[0])), "start")


def test_rows_behind_the_watermark_are_left_out(spark, tmp_path):
    """A session that comes days after the watermark has passed it is dropped; one within the delay is not."""
    shape, into = "ts timestamp_ntz, user_id long, event_type string, value double", str(tmp_path / "in")
    for at in ("2024-01-01 00:00:00", "2024-01-09 12:00:00", "2024-01-09 00:00:00", "2024-01-02 00:00:00"):
        spark.createDataFrame([(datetime.fromisoformat(at), 1, "view", 1.0)], shape).coalesce(1).write.mode("append").parquet(into)
    stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(into)
    got = live.drain(spark, live.sessions(stream).withColumn("start", F.col("start").cast("string")), "late", "complete", str(tmp_path / "c"))
    assert [r.start[8:13] for r in got.orderBy("start").collect()] == ["01 00", "09 00", "09 12"]


def errors(spark, n=24):
    start = datetime(2024, 1, 1)
    rows = [(k, start + timedelta(hours=h), None if h % 7 == 3 else float((h * 5 + len(k)) % 11) - 4) for h in range(n) for k in ("a", "bb")]
    return spark.createDataFrame(rows, "key string, ts timestamp, e double")


def test_decayed_bias_over_batches(spark, tmp_path):
    """The state goes on from batch to batch and ends where the average over all rows ends; a null error does not count."""
    rows, folder = errors(spark), tmp_path / "in"
    for part in range(3):
        rows.where(F.hour("ts").between(part * 8, part * 8 + 7)).coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    got = live.drain(spark, live.decayed_bias(stream, 0.3), "decayed", "update", str(tmp_path / "c")).groupBy("key").agg(F.max("times").alias("times"), F.max_by("bias", "times").alias("bias"))
    known = rows.where("e IS NOT NULL")
    want = {r.key: r.bias for r in fitting.ewma_bias(known, ["key"], "ts", "e", 0.3).collect()}
    for r in got.collect():
        assert r.times == known.where(F.col("key") == r.key).count()
        assert abs(r.bias - want[r.key]) < 1e-9


def test_upsert_stream_keeps_the_last_report(spark, tmp_path):
    """A late correction replaces the first report, a stream that is started again adds only what is new."""
    shape = "station long, hour int, seq int, value double"
    into, store, mark = (str(tmp_path / x) for x in ("in", "store", "mark"))
    batches = [[(1, 0, 1, 1.0), (2, 0, 1, 2.0)], [(1, 0, 2, 9.0), (3, 0, 1, 3.0)], [(2, 1, 1, 4.0), (2, 0, 2, None)]]

    def run():
        live.upsert_stream(spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(into), store, ["station", "hour"], "seq", mark).awaitTermination()
        return sorted(map(tuple, live.upserted(spark, store, shape).drop("bucket").collect()))

    for b in batches[:2]:
        spark.createDataFrame(b, shape).coalesce(1).write.mode("append").parquet(into)
    assert run() == [(1, 0, 2, 9.0), (2, 0, 1, 2.0), (3, 0, 1, 3.0)]
    files = lambda: {p for p in glob.glob(f"{store}/bucket=*/version=*/*.parquet")}
    first = files()
    assert run() == [(1, 0, 2, 9.0), (2, 0, 1, 2.0), (3, 0, 1, 3.0)] and files() == first
    spark.createDataFrame(batches[2], shape).coalesce(1).write.mode("append").parquet(into)
    assert run() == [(1, 0, 2, 9.0), (2, 0, 2, None), (2, 1, 1, 4.0), (3, 0, 1, 3.0)]
    assert first <= files() and len({p.split("version=")[0] for p in files() - first}) <= 2  # two keys, two buckets at most


def test_upsert_stream_that_breaks_off_in_a_batch(spark, tmp_path, monkeypatch):
    """A batch that has written its buckets but is not done is not read, and is run again from what was before it."""
    shape = "station long, seq int, value double"
    into, store, mark = (str(tmp_path / x) for x in ("in", "store", "mark"))
    stream = lambda: live.upsert_stream(spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(into), store, ["station"], "seq", mark, buckets=4).awaitTermination()
    read = lambda: sorted(map(tuple, live.upserted(spark, store, shape).drop("bucket").collect()))
    assert read() == []
    spark.createDataFrame([(k, 1, 1.0) for k in range(6)], shape).coalesce(1).write.mode("append").parquet(into)
    stream()
    spark.createDataFrame([(2, 2, 5.0), (9, 1, 7.0)], shape).coalesce(1).write.mode("append").parquet(into)
    real = type(spark).range
    monkeypatch.setattr(type(spark), "range", lambda *a, **k: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(Exception, match="gone"):
        stream()
    monkeypatch.setattr(type(spark), "range", real)
    assert read() == [(k, 1, 1.0) for k in range(6)]
    stream()
    assert read() == sorted([(k, 1, 1.0) for k in range(6) if k != 2] + [(2, 2, 5.0), (9, 1, 7.0)])


def test_corrected_bias_with_late_days_corrections_and_expiry(spark, tmp_path):
    into, alpha, keep = str(tmp_path / "in"), 0.25, 4
    day = lambda n: datetime(2024, 1, 1) + timedelta(days=n, hours=6)
    batches = [
        [("a", day(0), 1.0), ("a", day(2), 3.0), ("b", day(0), 8.0)], [("a", day(1), 2.0), ("a", day(2), -3.0), ("a", None, 9.0), ("a", day(3), None)],
        [("a", day(n), float(n)) for n in range(3, 9)], [("a", day(0), 99.0), ("a", day(8), 0.5)], [("a", day(50), 1.0)], [("a", day(51), 1.0)],
    ]
    for b in batches:
        spark.createDataFrame(b, "key string, ts timestamp, e double").coalesce(1).write.mode("append").parquet(into)
    name, value = live.STATE_STORE
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        stream = spark.readStream.schema("key string, ts timestamp, e double").option("maxFilesPerTrigger", 1).parquet(into)
        got = live.drain(spark, live.corrected_bias(stream, alpha, keep), "corrected", "update", str(tmp_path / "c")).collect()
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)

    def fold(values):
        bias = values[0]
        for e in values[1:]:
            bias = (1 - alpha) * bias + alpha * e
        return bias

    third = [1.0, 2.0, -3.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0]
    told = [(r.days, round(r.bias, 9)) for r in got if r.key == "a" and not r.closed]
    expected = [[1.0, 3.0], [1.0, 2.0, -3.0], third, [*third[:-1], 0.5]]  # day 0 is folded by then, day 8 is not
    assert told[:4] == [(len(v), round(fold(v), 9)) for v in expected]
    closed = {r.key: (r.days, r.bias) for r in got if r.closed}
    assert closed["b"] == (1, 8.0)


def test_first_arrival_of_a_key(spark, tmp_path):
    """A key that comes again within the delay, in its batch or a later one, is left out."""
    shape, into = "ts timestamp_ntz, event_id long, value double", str(tmp_path / "in")
    for rows in ([("2024-01-01 00:00:00", 1, 1.0), ("2024-01-01 06:00:00", 1, 2.0)], [("2024-01-01 09:00:00", 1, 3.0), ("2024-01-01 08:00:00", 2, 4.0)], [("2024-01-01 10:00:00", 2, 5.0)]):
        spark.createDataFrame([(datetime.fromisoformat(t), i, v) for t, i, v in rows], shape).coalesce(1).write.mode("append").parquet(into)
    stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(into)
    got = live.drain(spark, live.deduplicated(stream, ["event_id"]).select("event_id", "value"), "firsts", "append", str(tmp_path / "c"))
    assert sorted(r.event_id for r in got.collect()) == [1, 2]
