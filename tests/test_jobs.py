"""The jobs over growing input, broken runs and odd rows."""

import hashlib
import os
import re
import subprocess
import sys
import unicodedata
from collections import defaultdict
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from gridloom.operators import align
from jobs import bulletin_archive, observation_archive
from jobs.common import write

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def plain(df):
    return sorted((tuple(r) for r in df.select(sorted(df.columns)).collect()), key=repr)


def parts(folder):
    return {os.path.join(d, f) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


@pytest.fixture(scope="module")
def events(spark):
    return spark.read.parquet(f"{SF}/events.parquet")


def late_and_corrected(events):
    """The second arrival: what is newer, some of the old that is late, and corrections of the first arrival."""
    first = events.where("ts < '2024-01-15' AND user_id % 7 <> 3")
    corrections = first.where("event_id % 11 = 0").withColumn("value", F.col("value") + 100).withColumn("event_id", F.col("event_id") + 1_000_000)
    return first, events.where("NOT (ts < '2024-01-15' AND user_id % 7 <> 3)").unionByName(corrections)


def test_observations_two_runs_over_growing_input(spark, events, tmp_path):
    first, second = late_and_corrected(events)
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    first.repartition(2).write.parquet(source)
    one = observation_archive.run(spark, source, out, mark, files_per_batch=1)
    assert one["read"] == one["reports"] == first.count() and one["batches"] == 2
    early = parts(f"{out}/records")
    second.where("ts >= '2024-01-10'").coalesce(1).write.mode("append").parquet(source)
    two = observation_archive.run(spark, source, out, mark)
    assert two["read"] == second.where("ts >= '2024-01-10'").count() and two["batches"] == 1  # what is new, and nothing else
    kept = {p for p in early & parts(f"{out}/records")}
    assert kept and all("day=2024-01-0" in p or "day=2023-12-31" in p for p in kept)  # untouched days were not written again
    second.where("ts < '2024-01-10'").coalesce(1).write.mode("append").parquet(source)
    observation_archive.run(spark, source, out, mark)
    before = parts(out)
    assert observation_archive.run(spark, source, out, mark) == {"batches": 0, "read": 0, "reports": 0, "records": 0}
    assert parts(out) == before
    whole = first.unionByName(second).select(*[f.split()[0] for f in observation_archive.REPORTS.split(", ")]).withColumn("batch", F.lit(0))
    expected = observation_archive.records_of(whole, 8)
    found = observation_archive.records(spark, out)
    assert plain(found) == plain(expected) and found.where("tmax > 100").count() > 0
    once = observation_archive.run(spark, source, str(tmp_path / "out2"), str(tmp_path / "mark2"))
    assert once["read"] == first.count() + second.count()
    assert plain(observation_archive.records(spark, str(tmp_path / "out2"))) == plain(expected)


@pytest.mark.parametrize("table", ["reports", "records"])
def test_observations_broken_off_and_run_again(spark, events, tmp_path, monkeypatch, table):
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    first, second = late_and_corrected(events)
    first.coalesce(1).write.parquet(source)
    observation_archive.run(spark, source, out, mark)
    second.coalesce(1).write.mode("append").parquet(source)

    def failing(rows, path, by):
        n = write(rows, path, by)
        if path.endswith(table):
            raise OSError("the machine went away")
        return n

    monkeypatch.setattr(observation_archive, "write", failing)
    with pytest.raises(Exception, match="went away"):
        observation_archive.run(spark, source, out, mark)
    monkeypatch.setattr(observation_archive, "write", write)
    observation_archive.run(spark, source, out, mark)
    whole = first.unionByName(second).withColumn("batch", F.lit(0))
    assert plain(observation_archive.records(spark, out)) == plain(observation_archive.records_of(whole, 8))
    stored = spark.read.schema(observation_archive.STORED).parquet(f"{out}/reports")
    assert stored.count() == first.count() + second.count()  # nothing twice


def test_observations_odd_rows(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, day string, batch string"
    t = datetime(2024, 1, 1, 3)
    rows = [(1, t, 1, "view", None, "x", "y"), (2, None, 1, "view", 1.0, "x", "y"), (3, t, None, "view", 1.0, None, None), (4, t, 1, None, 1.0, None, None), (5, t, 2, "view", 5.0, "", ""), (5, t, 2, "view", 5.0, "", "")]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(source)
    done = observation_archive.run(spark, source, out, str(tmp_path / "mark"))
    assert done == {"batches": 1, "read": 6, "reports": 3, "records": 2}
    assert [(r.point, r.reports, r.kind, str(r.day)) for r in observation_archive.records(spark, out).orderBy("point").collect()] == [(1, 1, "day", "2024-01-01"), (2, 1, "day", "2024-01-01")]
    empty = str(tmp_path / "empty")
    spark.createDataFrame([], schema).write.parquet(empty)
    assert observation_archive.run(spark, empty, str(tmp_path / "out3"), str(tmp_path / "mark3"))["reports"] == 0
    valueless = str(tmp_path / "valueless")
    spark.read.parquet(source).drop("value").write.parquet(valueless)
    with pytest.raises(ValueError, match="lacks the columns value"):
        observation_archive.run(spark, valueless, out, str(tmp_path / "mark4"))


# ---------------------------------------------------------------- bulletins


def width(line):
    return sum(2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in line)


def plain_archive(rows, limit, keep):
    blank = " \t\n\x0b\x0c\r"
    texts = {}
    for i, body, lang, source in rows:
        if i is None:
            continue
        office = re.sub(r"[\W_]", "_", "unknown" if source is None else source)
        body = body or ""
        key = hashlib.sha256(re.sub("[ \t\n\x0b\x0c\r]+", " ", body).strip(" ").lower().encode()).hexdigest()
        lines = body.split("\n")
        heading = next((x.strip(blank) for x in lines if x.strip(blank)), "")
        row = (key, lang or "", i, lang, len(lines), max(map(width, lines)), sum(width(x) > limit for x in lines), heading, office)
        texts[office, i] = max(texts.get((office, i), row), row)
    share = defaultdict(list)
    for r in texts.values():
        share[r[0]].append(r[2])
    out = []
    for (office, i), r in texts.items():
        place = 1 + sum(o == office and k > i for o, k in texts)
        place = place if place <= keep else None
        out.append((len(share[r[0]]), i, min(share[r[0]]), r[7], r[3], None if place is None else place == 1, r[4], office, place, r[6], r[5], r[0]))
    return sorted(out, key=repr)


BULLETINS = [
    (1, "  \n 今天白天多云\n气温 12 ℃", "zh", "county one"), (2, "今天白天多云  气温 12 ℃ ", "zh", "county-two"), (3, None, None, None), (4, "", "en", "county one"), (5, "Fog\tand  RAIN\r\n", "en", "county one"), (6, "fog and rain", "en", "b"),
    (6, "fog and rain", "en", "b"), (6, "another text of the same id", "en", "b"), (None, "no id", "en", "b"), (7, "宽" * 60 + "\n" + "x" * 90 + "\n" + "y" * 80, "zh", "b"), (8, "z" * 100_000, "en", "b"), (9, "wide ａ", "en", "b"), (10, "9", "en", "b"),
]


def test_bulletins_as_plain_and_again(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(*r, 1, "o") for r in BULLETINS], "doc_id long, text string, lang string, source string, lines int, office string").write.parquet(source)
    wrote = bulletin_archive.run(spark, source, out, keep=3)
    expected = plain_archive(BULLETINS, 80, 3)
    assert plain(bulletin_archive.archive(spark, out)) == expected
    assert wrote["texts"] == wrote["wordings"] == len(expected)
    assert bulletin_archive.run(spark, source, out, keep=3) == wrote
    assert plain(bulletin_archive.archive(spark, out)) == expected
    more = [(11, "FOG and rain", "en", "b")]  # one office comes anew: its rows are replaced, those of others stay
    again = str(tmp_path / "again")
    spark.createDataFrame(more, "doc_id long, text string, lang string, source string").write.parquet(again)
    bulletin_archive.run(spark, again, out, keep=3)
    assert plain(bulletin_archive.archive(spark, out)) == plain_archive([r for r in BULLETINS if r[3] != "b"] + more, 80, 3)


def test_bulletins_without_rows(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([], "doc_id long, text string, lang string, source string").write.parquet(source)
    assert bulletin_archive.run(spark, source, str(tmp_path / "out")) == {"texts": 0, "wordings": 0, "newest": 0}


def test_lookup_keeps_common_keys_where_they_are(spark):
    rows = spark.range(3500).select("id", F.when(F.col("id") < 3000, 7).otherwise(F.col("id") % 50 + 10).alias("k"))
    table = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    found = align.lookup(rows, table, ["k"], "n", frequent=3)
    assert plain(found.select("id", "k", "n", "least")) == plain(rows.join(table, "k").select("id", "k", "n", "least"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") >= 2


@pytest.mark.parametrize("job, table, marked", [("observation_archive", "events", True), ("bulletin_archive", "documents", False)])
def test_command_line(job, table, marked, tmp_path):
    paths = ["--source", f"{SF}/{table}.parquet", "--output", str(tmp_path / "out"), *(["--checkpoint", str(tmp_path / "mark")] if marked else [])]
    done = subprocess.run([sys.executable, "-m", f"jobs.{job}", *paths], cwd=ROOT, capture_output=True, text=True, timeout=300, env=os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] pyspark-shell"})
    assert done.returncode == 0, done.stderr[-2000:]
    assert "read" in done.stderr and parts(tmp_path / "out")
