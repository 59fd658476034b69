"""Queries of shapes and rasters, each beside its SQL: suppliers have L-shaped areas with a hole, parts are the cells of a raster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import geometry as G
from gridloom.plans.catalog import query, table

# An L of side 4 without its north-eastern quarter, and a hole of half a degree in its south-western one.
CORNERS = [(0, 0), (4, 0), (4, 2), (2, 2), (2, 4), (0, 4)]
HOLE = [(0.75, 0.75), (0.75, 1.25), (1.25, 1.25), (1.25, 0.75)]


def shapes(spark, sf_dir) -> DataFrame:
    """Each supplier's area as GeoJSON text, read back as rings."""
    x, y = F.col("s_suppkey") % 29 + 0.25, F.col("s_suppkey") % 37 + 0.25
    ring = lambda corners: F.array(*[F.array(x + a, y + b) for a, b in [*corners, corners[0]]])
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(ring(CORNERS), ring(HOLE)).alias("coordinates"))).alias("g"))
    return s.select("s_suppkey", G.rings_of(F.col("g")).alias("rings"))


@query("SELECT s_suppkey, s_suppkey % 37 + 3.25::DOUBLE AS lat, s_suppkey % 29 + 1.25::DOUBLE AS lon FROM supplier")
def interior_points(spark, sf_dir):
    return G.interior_points(G.edges_of(shapes(spark, sf_dir), ["s_suppkey"], "rings"), ["s_suppkey"])


@query("""WITH c AS (SELECT (p_partkey // 80 % 96) / 2.0::DOUBLE + 0.25 AS lat, (p_partkey % 80) / 2.0::DOUBLE + 0.25 AS lon, max(p_retailprice) AS v FROM part GROUP BY ALL), s AS (SELECT s_suppkey, s_suppkey % 29 + 0.25::DOUBLE AS x, s_suppkey % 37 + 0.25::DOUBLE AS y FROM supplier),
 j AS (SELECT s_suppkey, v FROM s JOIN c ON lon - x > 0 AND lon - x < 4 AND lat - y >= 0 AND lat - y < 4 AND (lon - x < 2 OR lat - y < 2) AND NOT (lon - x >= 0.75 AND lon - x <= 1.25 AND lat - y >= 0.75 AND lat - y < 1.25))
SELECT s_suppkey, count(*) AS n, round(avg(v), 4) AS mean FROM j GROUP BY s_suppkey""")
def area_means(spark, sf_dir):
    """Mean over the raster's centres inside; those on a western or eastern edge do not count, those on a southern one do."""
    p = F.col("p_partkey")
    cells = table(spark, sf_dir, "part").groupBy(((F.floor(p / 80) % 96) / 2 + 0.25).alias("lat"), ((p % 80) / 2 + 0.25).alias("lon")).agg(F.max("p_retailprice").alias("value"))
    raster = G.raster_rows(cells, 0.5, 5.0)
    m = G.area_means(G.edges_of(shapes(spark, sf_dir), ["s_suppkey"], "rings"), ["s_suppkey"], raster, 0.5, 5.0)
    return m.withColumn("mean", F.round("mean", 4))
