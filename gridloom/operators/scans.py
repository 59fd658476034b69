"""Scans over long series in pieces: no key's whole history is sorted in one task.

Rows of a key are cut into cells by their place in order (a step, an hour), so that a cell's rows are a bounded number
as long as places are few times repeated.  A running value is taken within the cells, and what a cell adds up to, one row
for each, is handed on to the cells behind it: sums and maxima combine in any grouping.  Windows over the last n rows
work on blocks of equal numbers of rows, each with a halo of the n - 1 rows before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_cells(rows: DataFrame, place: Column | str, span: float) -> DataFrame:
    """Adds ``_cell``, the piece of length ``span`` that the place is in."""
    at = F.col(place) if isinstance(place, str) else place
    return rows.withColumn("_cell", F.floor(at / span))


def carried(rows: DataFrame, keys: list[str], values: dict[str, tuple[Column, str]], order: list, before: bool = False) -> DataFrame:
    """Adds running values over rows with ``_cell``: name -> (value, "sum" or "max"), the row included, or only those ``before`` it.

    Sums begin at 0; maxima of nothing are null.
    """
    kinds = {"sum": F.sum, "max": F.max}
    cells = rows.groupBy(*keys, "_cell").agg(*[kinds[k](v).alias(f"_{n}_cell") for n, (v, k) in values.items()])
    earlier = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)  # a row for each cell
    named = {c: f"_of_{k}" for k, c in enumerate([*keys, "_cell"])}
    cells = cells.select(*[F.col(c).alias(n) for c, n in named.items()], *[kinds[k](f"_{n}_cell").over(earlier).alias(f"_{n}_carry") for n, (_, k) in values.items()])
    inside = Window.partitionBy(*keys, "_cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    met = rows.select("*", *[kinds[k](v).over(inside).alias(f"_{n}_own") for n, (v, k) in values.items()])
    met = met.join(cells, [F.col(c).eqNullSafe(F.col(n)) for c, n in named.items()], "left")
    both = {n: F.coalesce(f"_{n}_own", F.lit(0)) + F.coalesce(f"_{n}_carry", F.lit(0)) if k == "sum" else F.greatest(f"_{n}_own", f"_{n}_carry") for n, (_, k) in values.items()}
    return met.select(*rows.columns, *[c.alias(n) for n, c in both.items()])


def ranked(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Adds ``_rank``, counting a key's rows with ``_cell`` from 1 in order."""
    return carried(rows, keys, {"_rank": (F.lit(1), "sum")}, order)


def over_last(rows: DataFrame, keys: list[str], n: int, values: dict[str, Column | object], block: int = 4096) -> DataFrame:
    """Adds values over the last ``n`` rows of a key, of rows with ``_rank``: name -> function of the window's frame.

    The frame holds fewer rows at the beginning of a key only.
    """
    block = max(block, n)
    at = F.col("_rank") - 1
    here = F.floor(at / block)
    ahead = (at % block) >= block - (n - 1)
    copies = F.when(ahead, F.array(F.struct(here.alias("_block"), F.lit(False).alias("_halo")), F.struct((here + 1).alias("_block"), F.lit(True).alias("_halo")))).otherwise(F.array(F.struct(here.alias("_block"), F.lit(False).alias("_halo"))))
    spread = rows.select("*", F.inline(copies))
    frame = Window.partitionBy(*keys, "_block").orderBy("_rank").rowsBetween(1 - n, 0)
    told = spread.select("*", *[f(frame).alias(name) for name, f in values.items()])
    return told.where("NOT _halo").drop("_block", "_halo")
