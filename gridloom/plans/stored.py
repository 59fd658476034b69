"""Queries of what is written and read again: archives of runs, joins of bucketed tables, documents published once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.plans.catalog import query, table
from gridloom.sources import stores

SCHEMA = "init_time timestamp_ntz, point long, step int, valid_time timestamp_ntz, t2m double, source string, run_init string"


def run_frames(spark, sf_dir, kind: str) -> DataFrame:
    """One event type as a source: a run a day, its regions' largest value by hour."""
    e = table(spark, sf_dir, "events").where(F.col("event_type") == kind)
    s = e.groupBy(F.to_date("ts").cast("timestamp_ntz").alias("init"), (F.col("user_id") % 10).alias("point"), F.hour("ts").alias("step")).agg(F.max("value").alias("t2m"))
    return stores.to_frame(s, kind)


RUNS = """WITH r AS (SELECT event_type AS source, strftime(ts, '%Y%m%d00') AS run_init, user_id % 10 AS point, CAST(hour(ts) AS INT) AS step, max(value) AS t2m FROM events WHERE event_type IN ('view', 'click') GROUP BY ALL),
 n AS (SELECT * REPLACE (t2m + CASE WHEN source = 'view' AND run_init = '2024010500' THEN 100 ELSE 0 END AS t2m) FROM r WHERE NOT (source = 'view' AND run_init = '2024010500' AND step >= 12))"""


@query(RUNS + " SELECT * FROM n")
def run_archive(spark, sf_dir):
    """An archive of two sources; one run is then written anew, warmer and shorter, and all others stay as they are."""
    path = f"{stores.shared_folder(spark)}/runs-{uuid.uuid4().hex}"
    stores.write_store([run_frames(spark, sf_dir, "view"), run_frames(spark, sf_dir, "click")], path)
    again = run_frames(spark, sf_dir, "view").where("run_init = '2024010500' AND step < 12").withColumn("t2m", F.col("t2m") + 100)
    stores.write_store([again], path)
    return stores.read_store(spark, path, SCHEMA).select("source", "run_init", "point", "step", "t2m")


def bucketed_tables(spark, sf_dir) -> tuple[str, str]:
    names = tuple(f"{kind}_runs_{uuid.uuid4().hex}" for kind in ("view", "click"))
    for kind, name in zip(("view", "click"), names):
        stores.write_bucketed(run_frames(spark, sf_dir, kind), name, f"{stores.shared_folder(spark)}/{name}", 8, ["point", "valid_time"], ["point", "valid_time"])
    return names


@query("SELECT v.user_id % 10 AS point, strftime(date_trunc('hour', v.ts), '%Y-%m-%d %H') AS hour, max(v.value) AS a, max(c.value) AS b FROM events v JOIN events c ON c.event_type = 'click' AND c.user_id % 10 = v.user_id % 10 AND date_trunc('hour', c.ts) = date_trunc('hour', v.ts) WHERE v.event_type = 'view' GROUP BY ALL")
def bucketed_join(spark, sf_dir):
    """Two sources by point and hour, from tables that are dealt out by these: the join moves no rows."""
    a, b = bucketed_tables(spark, sf_dir)
    j = spark.table(a).select("point", "valid_time", F.col("t2m").alias("a")).join(spark.table(b).select("point", "valid_time", F.col("t2m").alias("b")).hint("merge"), ["point", "valid_time"])
    return j.select("point", F.date_format("valid_time", "yyyy-MM-dd HH").alias("hour"), "a", "b")


@query("SELECT strftime(date_trunc('week', ts), '%Y%m%d00') AS run, CAST(user_id % 10 AS BIGINT) AS point, count(*) AS n, round(max(value), 2) AS high FROM events GROUP BY ALL")
def published_documents(spark, sf_dir):
    """Documents of weekly runs, published once: the second attempt, which would say otherwise, writes nothing."""
    path = f"{stores.shared_folder(spark)}/published-{uuid.uuid4().hex}"
    e = table(spark, sf_dir, "events").withColumn("run", F.date_format(F.date_trunc("week", "ts"), "yyyyMMdd00"))
    for (run,) in sorted(e.select("run").distinct().collect()):  # a run for each week
        docs = e.where(F.col("run") == run).groupBy((F.col("user_id") % 10).alias("point")).agg(F.count("*").alias("n"), F.round(F.max("value"), 2).alias("high"))
        stores.publish_once(spark, lambda: docs, path, run, run)  # noqa: B023  made at once
        stores.publish_once(spark, lambda: docs.withColumn("n", F.lit(-1)), path, run, run)  # noqa: B023
    return spark.read.schema("point long, n long, high double, run string, first string, schema int").json(path).select("run", "point", "n", "high")
