"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle


def components(links: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(id, component) of every id in ``links`` (a, b); a component is named by its smallest id.

    Null ends and loops are left out; an empty table has no components.  Each round joins links with every
    id's smallest neighbour; the number of rounds grows with the logarithm of the largest component, and only
    two numbers of a round come to the driver.  If the edges still change in the last round, it raises.
    """
    edges = settle(links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    before = None
    for _ in range(most_rounds):
        # large star: all larger neighbours of an id go to its smallest neighbour or itself
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b").distinct()
        # small star: smaller neighbours of an id, and the id, go to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(least, "a").select("a", "b", "least")
        star = small.select(F.col("b").alias("a"), F.col("least").alias("b")).union(small.select("a", F.col("least").alias("b"))).where("a <> b").distinct()
        edges = settle(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            break
        before = now
    else:
        raise RuntimeError(f"components still change after {most_rounds} rounds")
    leaves = edges.select(F.col("b").alias("id"), F.col("a").alias("component"))
    return leaves.union(edges.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())
