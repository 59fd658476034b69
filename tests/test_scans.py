"""Scans in pieces give what one sort gives, and no piece holds a key's whole history."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from gridloom.operators import scans, windows


@pytest.fixture(scope="module")
def series(spark):
    rng = random.Random(8)
    rows = [(p, s, rng.choice([None, 0.0, 0.2, 3.0, 40.0]), rng.choice("abb")) for p, n in (("hot", 900), ("b", 40), ("c", 1), (None, 30)) for s in sorted(rng.sample(range(3, 9000, 3), n))]
    return spark.createDataFrame(rows, "point string, step int, precip double, word string").repartition(3).persist()


def plain(df):
    return sorted((tuple(r) for r in df.select(sorted(df.columns)).collect()), key=repr)


@pytest.mark.parametrize("span", [24, 500, 10**6])
def test_equal_to_one_sort(series, span):
    for op in (
        lambda s: windows.running_sums(series, {"p6": 2, "p24": 8, "p1": 1}, span=s), lambda s: windows.peak_in_window(series, 3, span=s), lambda s: windows.increments(series, "precip", span=s),
        lambda s: windows.run_lengths(series, ["point"], "step", F.col("precip") > 0.1, span=s), lambda s: windows.same_wording(series, ["point"], "step", "word", span=s),
        lambda s: windows.spells(series.select("point", F.col("step").alias("start_h"), (F.col("step") + F.when(F.col("word") == "a", 600).otherwise(5)).alias("end_h")), ["point"], span=s),
    ):
        assert plain(op(span)) == plain(op(None))
    assert windows.running_sums(series.limit(0), {"p6": 2}, span=span).count() == 0


def test_pieces_are_small(spark):
    """A point of a million rows is sorted in pieces of a few thousand."""
    rows = spark.range(1_000_000).select(F.lit("p").alias("point"), (F.col("id") * 3).alias("step"), (F.col("id") % 7).cast("double").alias("precip"))
    cells = scans.in_cells(rows, "step", 3000)
    assert cells.groupBy("_cell").count().agg(F.max("count")).first()[0] == 1000
    placed = scans.ranked(cells, ["point"], ["step"])
    sums = scans.over_last(placed, ["point"], 8, {"n": lambda f: F.count(F.lit(1)).over(f), "p24": lambda f: F.sum("precip").over(f)})
    got = sums.agg(F.count("*").alias("rows"), F.sum("p24").alias("total"), F.min("n").alias("least"), F.max("_rank").alias("last")).first()
    expected = rows.withColumn("p", F.sum("precip").over(Window.partitionBy("point").orderBy("step").rowsBetween(-7, 0))).agg(F.sum("p")).first()[0]
    assert tuple(got) == (1_000_000, expected, 1, 1_000_000)
