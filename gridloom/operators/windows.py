"""Running sums, spells and their splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators import scans


def _last_rows(series: DataFrame, values: dict[str, tuple[int, object]], span: float | None, order: str = "step", keys: tuple[str, ...] = ("point",)) -> DataFrame:
    """Adds values over the last n rows of a key: name -> (n, function of the frame); in pieces of ``span`` where one is given."""
    if span is None:
        w = Window.partitionBy(*keys).orderBy(order)
        return series.select("*", *[f(w.rowsBetween(1 - n, 0)).alias(name) for name, (n, f) in values.items()])
    out = scans.ranked(scans.in_cells(series, order, span), list(keys), [order])
    for n in sorted({n for n, _ in values.values()}):
        out = scans.over_last(out, list(keys), n, {name: f for name, (m, f) in values.items() if m == n})
    return out.select(*series.columns, *values)


def running_sums(series: DataFrame, spans: dict[str, int], value: str = "precip", span: float | None = None) -> DataFrame:
    """Sums over so many consecutive rows of a point, nulls as 0, null until a window is full.

    ``span``: a length of steps; where it is given no point's whole history is sorted in one task (see ``scans``).
    """
    total = lambda n: lambda frame: F.when(F.count(F.lit(1)).over(frame) == n, F.sum(F.coalesce(F.col(value), F.lit(0.0))).over(frame))
    return _last_rows(series, {name: (n, total(n)) for name, n in spans.items()}, span)


def peak_in_window(series: DataFrame, n: int, value: str = "precip", span: float | None = None) -> DataFrame:
    """Step of the wettest row among the last n, the first of equals."""
    wettest = F.max_by("step", F.struct(F.coalesce(F.col(value), F.lit(0.0)), -F.col("step")))
    return _last_rows(series, {"peak_step": (n, lambda frame: wettest.over(frame))}, span)


def increments(series: DataFrame, total: str, span: float | None = None) -> DataFrame:
    """What an accumulation grew by, never below 0; the first row counts from 0."""
    first = lambda frame: F.when(F.count(F.lit(1)).over(frame) > 1, F.first(total).over(frame))
    before = _last_rows(series, {"_before": (2, first)}, span)
    return before.withColumn("increment", F.greatest(F.col(total) - F.coalesce("_before", F.lit(0.0)), F.lit(0.0))).drop("_before")


def spells(rows: DataFrame, keys: list[str], start: str = "start_h", end: str = "end_h", span: float | None = None) -> DataFrame:
    """Intervals that touch or overlap, merged; in pieces of ``span`` hours where it is given."""
    if span is None:
        order = Window.partitionBy(*keys).orderBy(start, end)
        reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
        flagged = rows.withColumn("_new", F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0))
        numbered = flagged.withColumn("spell", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    else:
        reached = scans.carried(scans.in_cells(rows, start, span), keys, {"_reach": (F.col(end), "max")}, [start, end], before=True)
        new = F.when(F.col("_reach").isNull() | (F.col(start) > F.col("_reach")), 1).otherwise(0)
        numbered = scans.carried(reached.withColumn("_new", new), keys, {"spell": (F.col("_new"), "sum")}, [start, end])
    return numbered.groupBy(*keys, "spell").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("pieces"))


def split_at_midnight(intervals: DataFrame, start: str = "start_h", end: str = "end_h") -> DataFrame:
    """Pieces of intervals in hours, by day of 24 hours."""
    day = F.explode(F.sequence(F.floor(F.col(start) / 24), F.floor((F.col(end) - 1) / 24)))
    cut = intervals.withColumn("day", day)
    return cut.withColumn(start, F.greatest(start, F.col("day") * 24)).withColumn(end, F.least(end, (F.col("day") + 1) * 24))


def run_lengths(rows: DataFrame, keys: list[str], order: str, test, span: float | None = None) -> DataFrame:
    """Length of the run of consecutive rows that pass the test, up to each row; 0 where it fails; in pieces of ``span`` where it is given."""
    if span is None:
        w = Window.partitionBy(*keys).orderBy(order)
        grouped = rows.withColumn("_hit", test).withColumn("_group", F.sum(F.when(F.col("_hit"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        inner = Window.partitionBy(*keys, "_group").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return grouped.withColumn("run", F.sum(F.when(F.col("_hit"), 1).otherwise(0)).over(inner)).drop("_hit", "_group")
    # a run is as long as the last row that failed is back
    placed = scans.ranked(scans.in_cells(rows, order, span), keys, [order])
    failed = F.when(~F.coalesce(test, F.lit(False)), F.col("_rank"))
    since = scans.carried(placed, keys, {"_failed": (failed, "max")}, [order])
    return since.withColumn("run", F.col("_rank") - F.coalesce("_failed", F.lit(0))).select(*rows.columns, "run")


def same_wording(rows: DataFrame, keys: list[str], order: str, word: str, span: float | None = None) -> DataFrame:
    """Consecutive rows with the same word, grouped; in pieces of ``span`` where it is given."""
    if span is None:
        w = Window.partitionBy(*keys).orderBy(order)
        changed = F.when(F.lag(word).over(w).eqNullSafe(F.col(word)), 0).otherwise(1)
        numbered = rows.withColumn("_c", changed).withColumn("_g", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    else:
        placed = scans.ranked(scans.in_cells(rows, order, span), keys, [order])
        known = lambda frame: F.when(F.count(F.lit(1)).over(frame) > 1, F.first(F.struct(word)).over(frame))
        told = scans.over_last(placed, keys, 2, {"_b": known})
        changed = F.when(F.col("_b").isNotNull() & F.col(f"_b.{word}").eqNullSafe(F.col(word)), 0).otherwise(1)
        numbered = scans.carried(told.withColumn("_c", changed), keys, {"_g": (F.col("_c"), "sum")}, ["_rank"])
    return numbered.groupBy(*keys, "_g", word).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("rows")).drop("_g")
