"""What the jobs share: their command line, their configuration and counts of what is written."""

from __future__ import annotations

import argparse
import json
import logging
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SETTINGS = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true"}


def write(rows: DataFrame, path: str, by: list[str]) -> int:
    """Replaces the partitions that ``rows`` has, and no others; gives the number of rows.

    The rows are dealt out by partition, and what one partition has too much of goes to further tasks.
    """
    seen = Observation()
    counted = rows.hint("rebalance", *by).observe(seen, F.count(F.lit(1)).alias("rows"))
    counted.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    return seen.get["rows"]


def main(run: Callable, doc: str, config: str, paths: tuple[str, ...], argv: list[str] | None = None) -> None:
    """The command line of a job: its paths, and a JSON file with the rest of its arguments."""
    args = argparse.ArgumentParser(description=doc.splitlines()[0])
    for name in paths:
        args.add_argument(f"--{name}", required=True, help="a path that Spark reads or writes")
    args.add_argument("--config", default=config, help="JSON file of the job's parameters")
    given = vars(args.parse_args(argv))
    with open(given.pop("config"), encoding="utf-8") as f:
        parameters = json.load(f)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    builder = SparkSession.builder.appName(os.path.basename(config).removesuffix(".json"))
    spark = builder.config(map=SETTINGS).getOrCreate()
    try:
        run(spark, **given, **parameters)
    finally:
        spark.stop()
