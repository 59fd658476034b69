"""Joins that line forecasts, observations and periods up."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def matched(forecast: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """Inner equi-join; Catalyst picks the strategy."""
    return forecast.join(observed, keys, "inner")


def members_wide(members: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Full outer alignment of tables with the same columns; each value column is named <member>_<column>."""
    tables = [t.select(*keys, *[F.col(c).alias(f"{m}_{c}") for c in t.columns if c not in keys]) for m, t in members.items()]
    return reduce(lambda a, b: a.join(b, keys, "full"), tables)


def blend(members: DataFrame, keys: list[str], value: str, weights: dict[str, float], least: int) -> DataFrame:
    """Weighted mean over the members present, renormalised; null where fewer than ``least`` have a value."""
    w = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("member")), F.lit(0.0))
    there = F.when(F.col(value).isNotNull(), w)
    return members.groupBy(*keys).agg(F.when(F.count(value) >= least, F.try_divide(F.sum(there * F.col(value)), F.sum(there))).alias(value), F.count(value).alias("n_members"))


def overlap_join(a: DataFrame, b: DataFrame, keys: list[str], cell: int) -> DataFrame:
    """Pairs of half-open intervals (start_h, end_h) and (from_h, to_h) of equal keys that overlap, with the overlap.

    Both sides are put into cells of ``cell`` hours, so it is an equi-join; a pair is kept in the cell where
    its overlap begins.
    """
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(lo / cell), F.floor((hi - 1) / cell)))
    left = a.where("end_h > start_h").withColumn("_cell", cells(F.col("start_h"), F.col("end_h")))
    right = b.where("to_h > from_h").withColumn("_cell", cells(F.col("from_h"), F.col("to_h")))
    begin, end = F.greatest("start_h", "from_h"), F.least("end_h", "to_h")
    return left.join(right, [*keys, "_cell"]).where((begin < end) & (F.floor(begin / cell) == F.col("_cell"))).withColumn("overlap", end - begin).drop("_cell")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, values: list[str], cell_hours: int = 24) -> DataFrame:
    """Each left row with the values of the latest right row at or before it, by sorts instead of a range join.

    Rows are sorted within a key's cells of ``cell_hours``, so a hot key is spread over its cells; what a cell
    inherits is the last right row of the cells before, a table of one row for each key and cell.  Left rows
    with null keys or times are kept and find nothing; of right rows at the same time one is taken.
    """
    hold = [F.col(right_time).alias("_held"), *[F.col(v) for v in values]]
    r = right.dropna(subset=[*keys, right_time]).select(*keys, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.struct(*hold).alias("_right"), F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType).alias("_left"))
    l = left.select(*keys, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(r.schema["_right"].dataType).alias("_right"), F.struct("*").alias("_left"))
    both = r.unionByName(l).withColumn("_cell", F.floor(F.unix_timestamp(F.col("_t").cast("timestamp")) / (3600 * cell_hours)))
    cells = both.groupBy(*keys, "_cell").agg(F.max_by("_right", F.when(F.col("_right").isNotNull(), F.col("_t"))).alias("_end"))
    before = F.last("_end", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1))
    carried = cells.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_cell").alias("_c"), before.alias("_carried"))
    same = reduce(lambda x, y: x & y, [F.col("_cell").eqNullSafe(F.col("_c")), *[F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]])
    w = Window.partitionBy(*keys, "_cell").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    last = both.withColumn("_last", F.last("_right", ignorenulls=True).over(w)).where("_side = 1").join(carried, same, "left").withColumn("_last", F.coalesce("_last", "_carried"))
    return last.select("_left.*", *[F.col(f"_last.{v}").alias(v) for v in values], F.col("_last._held").alias("as_of"))


def nearest(left: DataFrame, right: DataFrame, keys: list[str], left_time: Column, right_time: Column, most: float, value: str) -> DataFrame:
    """The right value nearest in time within ``most`` seconds; ties go to the earlier one.

    Times are cut into cells of that width, and each left row looks into three of them.
    """
    l = left.withColumn("_lt", left_time).withColumn("_id", F.monotonically_increasing_id()).withColumn("_cell", F.explode(F.array(*[F.floor(left_time / most) + k for k in (-1, 0, 1)])))
    r = right.select(*keys, right_time.alias("_rt"), F.floor(right_time / most).alias("_cell"), F.col(value).alias("_v"))
    near = l.join(r, [*keys, "_cell"]).where(F.abs(F.col("_lt") - F.col("_rt")) <= most)
    cols = [c for c in left.columns]
    return near.groupBy(*cols, "_id").agg(F.min_by("_v", F.struct(F.abs(F.col("_lt") - F.col("_rt")), F.col("_rt"))).alias(value)).drop("_id")


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, frequent: int = 50_000) -> DataFrame:
    """Inner join of ``rows`` with a table of one row for each key, whose ``weight`` is how many of the rows have the key.

    Keys that more than one in ``frequent`` of the rows have, so at most that many, are broadcast, and their rows stay
    where they are; the others, of which none is large, are dealt out.  So no key, however common, fills a task.
    """
    total = table.agg(F.sum(weight)).first()[0] or 0
    bound = max(total // frequent, 1000)
    often, seldom = table.where(F.col(weight) >= bound), table.where(F.col(weight) < bound)
    rest = rows.join(F.broadcast(often.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(often), keys).unionByName(rest.join(seldom, keys))
