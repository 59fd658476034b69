"""Scores of forecasts against observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def temperature_scores(f: Column, o: Column) -> list[Column]:
    e = f - o
    return [F.count(e).alias("n"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias"), F.avg(F.when(F.abs(e) <= 2, 100.0).when(e.isNotNull(), 0.0)).alias("within2")]


def rain_scores(f: Column, o: Column, f_limit: float, o_limit: float) -> list[Column]:
    """Contingency table and its scores; null where a denominator is 0."""
    known = f.isNotNull() & o.isNotNull()
    n = lambda test: F.count_if(known & test)
    a, b, c, d = n((f >= f_limit) & (o >= o_limit)), n((f >= f_limit) & (o < o_limit)), n((f < f_limit) & (o >= o_limit)), n((f < f_limit) & (o < o_limit))
    div = F.try_divide
    return [a.alias("hits"), b.alias("false_alarms"), c.alias("misses"), d.alias("dry"), div(100.0 * (a + d), a + b + c + d).alias("correct"), div(100.0 * a, a + b + c).alias("threat"), div(100.0 * a, a + c).alias("detected"), div(100.0 * b, a + b).alias("false_ratio"), div(1.0 * (a + b), a + c).alias("frequency_bias")]


def probability_scores(df: DataFrame, f: Column, event: Column, by: list[str], bins: int = 10) -> DataFrame:
    """Brier score, skill against the overall frequency, and reliability, over all rows, by bin and by each of ``by``: one pass of grouping sets."""
    p = df.select(*by, f.alias("f"), event.cast("double").alias("o")).where("f IS NOT NULL AND o IS NOT NULL")
    base = p.agg(F.avg("o").alias("clim"))
    rows = p.crossJoin(F.broadcast(base)).withColumn("bin", F.least(F.floor(F.col("f") * bins), F.lit(bins - 1)).cast("int"))
    sets = [[], ["bin"], *[[b] for b in by]]
    cols = ["bin", *by]
    out = rows.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in cols])
    brier, ref = F.avg(F.pow(F.col("f") - F.col("o"), 2)), F.avg(F.pow(F.col("clim") - F.col("o"), 2))
    return out.agg(F.count("*").alias("n"), F.avg("f").alias("forecast"), F.avg("o").alias("frequency"), brier.alias("brier"), (1 - F.try_divide(brier, ref)).alias("skill"), F.grouping_id().cast("long").alias("level"))


def frost_scores(f: Column, o: Column, limit: float = 0.0) -> list[Column]:
    event, said = o <= limit, f <= limit
    return [F.count_if(event).alias("events"), F.count_if(event & said).alias("hits"), F.count_if(said & ~event).alias("false_alarms"), F.avg(F.when(event, f - o)).alias("event_bias")]


def best_threshold(pairs: DataFrame, grid: list[float], f: str, o: str, o_limit: float) -> DataFrame:
    """The threshold of the highest share correct; of equals the first of the grid."""
    cases = pairs.withColumn("t", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(t)).alias("limit")) for k, t in enumerate(grid)])))
    cases = cases.select(f, o, F.col("t.k").alias("k"), F.col("t.limit").alias("threshold"))
    scored = cases.groupBy("k", "threshold").agg(F.avg(((F.col(f) >= F.col("threshold")) == (F.col(o) >= o_limit)).cast("double")).alias("share"))
    return scored.agg(F.max_by("threshold", F.struct("share", -F.col("k"))).alias("threshold"), F.max("share").alias("correct"))


def skill_weights(pairs: DataFrame, member: str, f: Column, o: Column) -> DataFrame:
    """Root mean squared error of each member and weights by its inverse square, summing to 1; a member without error takes none."""
    from pyspark.sql import Window

    mse = pairs.select(member, F.pow(f - o, 2).alias("_e")).groupBy(member).agg(F.avg("_e").alias("_mse"))  # one row for each member
    inverse = F.coalesce(F.try_divide(F.lit(1.0), F.col("_mse")), F.lit(0.0))
    return mse.select(member, F.sqrt("_mse").alias("rmse"), F.try_divide(inverse, F.sum(inverse).over(Window.partitionBy())).alias("weight"))
