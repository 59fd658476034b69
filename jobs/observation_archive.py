"""Keeps an archive of station reports, and the half-day records made of them, up to date from files as they arrive.

    python -m jobs.observation_archive --source DIR --output DIR --checkpoint DIR [--config FILE]

Each run takes the files that no earlier run has taken (a file stream with a checkpoint) and ends when they are done.

``output/reports`` (by day and batch) holds the reports as they came, without those that lack a station, a kind or
a time.  A batch writes only its own partitions, so one that broke off is written again the same.  ``output/records``
(by day) holds a row for each station and half day, made of all reports of that day, of which a later report of the
same station, kind and time replaces an earlier one.  Only the days that a batch touches are made anew, and always
from the reports, so late and corrected reports count, and a run that breaks off between the two tables leaves
nothing wrong behind: the next run writes both again.

The day of a report is that of its half day, so nights, which end in the morning, never need two days.
"""

from __future__ import annotations

import logging
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import times
from gridloom.functions import weather as W
from gridloom.operators import periods
from gridloom.sources import stores
from jobs.common import main, write

log = logging.getLogger("observation_archive")

REPORTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"
STORED = f"{REPORTS}, day date, batch long"
RECORDS = "point long, kind string, tmax double, tmin double, precip double, windows long, reports long, latest timestamp_ntz, grade string, day date"


def reports_of(rows: DataFrame, tz: int) -> DataFrame:
    """The reports that can be placed, with the local day of their half day."""
    named = rows.select(*[F.col(f.split()[0]).cast(f.split()[1]) for f in REPORTS.split(", ")])
    day = times.half_of(times.floor_hours(F.col("ts"), 3), tz)[1]
    return named.dropna(subset=["ts", "user_id", "event_type"]).withColumn("day", day)


def records_of(reports: DataFrame, tz: int) -> DataFrame:
    """A record for each station and half day: extremes and rain where all its windows are there, and how many reports it has."""
    last = stores.last_wins(reports, ["user_id", "event_type", "ts"], [F.col("batch"), F.col("event_id")])
    kind, day = times.half_of(times.floor_hours(F.col("ts"), 3), tz)
    counts = last.groupBy(F.col("user_id").alias("point"), day.alias("day"), kind.alias("kind")).agg(F.count(F.lit(1)).alias("reports"), F.max("ts").alias("latest"))
    halves = periods.by_period(periods.three_hourly(last), tz=tz).join(counts, ["point", "day", "kind"])
    return halves.withColumn("grade", W.rain_text(F.col("precip"), 12)).select(*[f.split()[0] for f in RECORDS.split(", ")])


def as_pattern(path: str) -> str:
    """A path as a pattern that matches it alone: file streams take a single file by pattern only."""
    bare = path.rstrip("/")
    return bare if set(bare) & set("*?[{\\") else f"{bare[:-1]}[{bare[-1]}]"


def run(spark: SparkSession, source: str, output: str, checkpoint: str, tz: int = 8, files_per_batch: int = 1000) -> dict[str, int]:
    """Takes what is new in ``source``; gives the numbers of batches, of rows read and of rows written to both tables.

    ``source`` is a folder of Parquet files (a single file will do) with the columns of ``REPORTS``; others are not read.
    """
    total = {"batches": 0, "read": 0, "reports": 0, "records": 0}
    known = set(spark.read.parquet(source).columns)
    lacking = [f for f in REPORTS.split(", ") if f.split()[0] not in known]
    if lacking:
        raise ValueError(f"{source} lacks the columns {', '.join(lacking)}")
    arriving = spark.readStream.schema(REPORTS).option("maxFilesPerTrigger", files_per_batch).parquet(as_pattern(source))

    def take(batch: DataFrame, number: int) -> None:
        here = batch.sparkSession
        kept = write(reports_of(batch, tz).withColumn("batch", F.lit(number).cast("long")), f"{output}/reports", ["day", "batch"])
        if not kept:
            log.info("batch %d: no reports that can be placed", number)
            return
        stored = here.read.schema(STORED).parquet(f"{output}/reports")
        days = [r.day for r in stored.where(F.col("batch") == number).select("day").distinct().collect()]  # a calendar's worth at most
        made = write(records_of(stored.where(F.col("day").isin(days)), tz), f"{output}/records", ["day"])
        total["batches"], total["reports"], total["records"] = total["batches"] + 1, total["reports"] + kept, total["records"] + made
        log.info("batch %d: %d reports of %d days written to %s/reports, %d records to %s/records", number, kept, len(days), output, made, output)

    query = arriving.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    total["read"] = sum(p.numInputRows for p in query.recentProgress)
    log.info("read %d new rows of %s in %d batches", total["read"], source, total["batches"])
    return total


def records(spark: SparkSession, output: str) -> DataFrame:
    """The half-day records as they stand."""
    return spark.read.schema(RECORDS).parquet(f"{output}/records")


if __name__ == "__main__":
    main(run, __doc__, f"{os.path.dirname(os.path.abspath(__file__))}/observation_archive.json", ("source", "output", "checkpoint"))
