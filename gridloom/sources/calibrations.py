"""Calibrations that are kept: written by the time they were made, taken again while they are young, held on to when a new fit fails."""

from __future__ import annotations

import logging
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.consensus import Calibration

log = logging.getLogger("gridloom.calibrations")
STAMP = "%Y%m%d%H%M%S"


class NotCalibrated(RuntimeError):
    """There is nothing to fit yet: no forecasts with their observations."""


def keep(spark: SparkSession, cal: Calibration, path: str, made: datetime) -> None:
    """Writes the tables of a calibration; its stamp is listed only when all of them are there."""
    tables = {k: v for k, v in cal.__dict__.items() if isinstance(v, DataFrame)}
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{made.strftime(STAMP)}/{name}")
    spark.createDataFrame([(made.strftime(STAMP), sorted(tables))], "stamp string, tables array<string>").write.mode("append").parquet(f"{path}/_made")


def newest(spark: SparkSession, path: str) -> tuple[datetime, Calibration] | None:
    """The calibration made last, with its time."""
    try:
        made = spark.read.schema("stamp string, tables array<string>").parquet(f"{path}/_made")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    last = made.agg(F.max(F.struct("stamp", "tables")).alias("m")).first().m
    if last is None:
        return None
    return datetime.strptime(last.stamp, STAMP), Calibration(**{t: spark.read.parquet(f"{path}/{last.stamp}/{t}") for t in last.tables})


def refreshed(spark: SparkSession, path: str, make: Callable[[], Calibration], now: datetime, most_days: float = 1.0, hold_days: float = 7.0) -> Calibration | None:
    """The calibration in force: one made less than ``most_days`` ago, else a new one, which is kept; where that fails, the last one up to ``hold_days``, else none.

    A new calibration without any temperature fit is no calibration.
    """
    have = newest(spark, path)
    age = now - have[0] if have else None
    if have and age < timedelta(days=most_days):
        return have[1]
    try:
        cal = make()
        if cal.temperature is None or cal.temperature.isEmpty():
            raise NotCalibrated("no forecasts with observations")
        keep(spark, cal, path, now)
        return newest(spark, path)[1]
    except Exception:  # whatever fails, forecasts go on
        log.exception("the calibration of %s could not be made", now)
        return have[1] if have and age < timedelta(days=hold_days) else None
