"""Polygons as edges: interior points by a scan line, and means of rasters over areas by scan lines, with built-in functions.

A polygon's edges are rows (id, part, x1, y1, x2, y2); holes are edges like others, since a point is inside where a line
to it crosses an odd number of them.  Rasters are rows of cells: band and column of a square tile, the latitude of the
cells' centres, and the cells that are known by their place in the tile's row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rings_of(geometry: Column) -> Column:
    """Polygons of a GeoJSON geometry's text, each an array of rings of points; null for other types, empty ones left out."""
    ring = "array<array<array<double>>>"
    kind = F.get_json_object(geometry, "$.type")
    one = F.from_json(geometry, f"coordinates {ring}")["coordinates"]
    many = F.from_json(geometry, f"coordinates array<{ring}>")["coordinates"]
    polygons = F.when(kind == "Polygon", F.array(one)).when(kind == "MultiPolygon", many)
    return F.filter(polygons, lambda p: F.size(p) > 0)


def edges_of(shapes: DataFrame, keys: list[str], rings: str) -> DataFrame:
    """One row for each edge of the polygons (``rings`` as of ``rings_of``): keys, part, x1, y1, x2, y2.  Rings that are not closed are closed; edges of no length go."""
    r = shapes.select(*keys, F.posexplode(rings).alias("part", "_p")).select(*keys, "part", F.explode("_p").alias("_r")).where(F.size("_r") > 2)
    pair = F.transform(F.sequence(F.lit(0), F.size("_r") - 1), lambda k: F.struct(F.get("_r", k).alias("a"), F.get("_r", (k + 1) % F.size("_r")).alias("b")))
    e = r.select(*keys, "part", F.explode(pair).alias("e"))
    e = e.select(*keys, "part", F.get("e.a", F.lit(0)).alias("x1"), F.get("e.a", F.lit(1)).alias("y1"), F.get("e.b", F.lit(0)).alias("x2"), F.get("e.b", F.lit(1)).alias("y2"))
    return e.where("x1 <> x2 OR y1 <> y2")


def crossing(y: Column) -> Column:
    """Where an edge crosses the line at y, null where it does not; an end on the line counts as above it."""
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    return F.when((y1 > y) != (y2 > y), x1 + (y - y1) / (y2 - y1) * (x2 - x1))


def sections(crossings: Column) -> Column:
    """Sorted crossings of a line as the sections (a, b) that lie inside."""
    pairs = F.sequence(F.lit(0), F.floor(F.size(crossings) / 2).cast("int") - 1)
    return F.when(F.size(crossings) > 1, F.transform(pairs, lambda k: F.struct(F.get(crossings, 2 * k).alias("a"), F.get(crossings, 2 * k + 1).alias("b"))))


def interior_points(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, lat, lon): a point inside of each shape, the middle of the widest section of a scan line.

    A part's line runs halfway between the corners next below (or at) and next above the middle of its height, so that it
    meets no corner.  Shapes without an area have none.
    """
    part = [*keys, "part"]
    corners = edges.select(*part, F.col("y1").alias("y"))
    middle = corners.groupBy(*part).agg(((F.min("y") + F.max("y")) / 2).alias("_c"))
    near = corners.join(middle, part).groupBy(*part).agg(F.max(F.when(F.col("y") <= F.col("_c"), F.col("y"))).alias("_lo"), F.min(F.when(F.col("y") > F.col("_c"), F.col("y"))).alias("_hi"))
    lines = near.select(*part, ((F.col("_lo") + F.col("_hi")) / 2).alias("_y"))
    met = edges.join(lines, part).select(*part, "_y", crossing(F.col("_y")).alias("_x")).where("_x IS NOT NULL")
    cut = met.groupBy(*part, "_y").agg(sections(F.array_sort(F.collect_list("_x"))).alias("_s"))  # a line's crossings of one part
    wide = cut.select(*keys, "part", "_y", F.explode("_s").alias("s")).select(*keys, "part", "_y", (F.col("s.b") - F.col("s.a")).alias("_w"), ((F.col("s.a") + F.col("s.b")) / 2).alias("_m"))
    best = F.max_by(F.struct(F.col("_y").alias("lat"), F.col("_m").alias("lon")), F.struct("_w", -F.col("part"), -F.col("_m")))
    return wide.groupBy(*keys).agg(best.alias("p")).select(*keys, "p.lat", "p.lon")


def raster_rows(cells: DataFrame, step: float, tile: float = 1.0) -> DataFrame:
    """Rows of a raster from its cells (lat, lon, value; the centres): band, column, lat, cells.  ``tile`` is a tile's side, a multiple of ``step``.

    Cells without a value are left out; a row holds those of one tile's width.
    """
    known = cells.where(F.col("value").isNotNull() & ~F.isnan("value"))
    at = F.round(F.pmod(F.col("lon"), F.lit(tile)) / step - 0.5).cast("int")
    named = known.select(F.floor(F.col("lat") / tile).alias("band"), F.floor(F.col("lon") / tile).alias("column"), "lat", F.struct(at.alias("i"), F.col("value").cast("double").alias("v")).alias("c"))
    return named.groupBy("band", "column", "lat").agg(F.array_sort(F.collect_list("c")).alias("cells"))


def area_means(edges: DataFrame, keys: list[str], raster: DataFrame, step: float, tile: float = 1.0) -> DataFrame:
    """(keys, n, mean) of the raster's cells whose centres lie in each shape; of those that its bounds touch where it holds no centre.

    Edges are dealt to the tiles' bands that they pass and meet the rows of these by equality; a row's sections are then
    looked up in the tiles that they pass.  Whole shapes or tiles are never gathered, only a line's crossings.  Shapes
    beyond the raster have no row.
    """
    floor = lambda c: F.floor(c / tile)
    lines = raster.select("band", "lat").distinct()
    bands = edges.withColumn("band", F.explode(F.sequence(floor(F.least("y1", "y2")), floor(F.greatest("y1", "y2")))))
    met = bands.join(lines, "band").select(*keys, "band", "lat", crossing(F.col("lat")).alias("_x")).where("_x IS NOT NULL")
    cut = met.groupBy(*keys, "band", "lat").agg(sections(F.array_sort(F.collect_list("_x"))).alias("_s")).select(*keys, "band", "lat", F.explode("_s").alias("s"))
    bounds = edges.groupBy(*keys).agg(F.min("x1").alias("xa"), F.max("x1").alias("xb"), F.min("y1").alias("ya"), F.max("y1").alias("yb"))
    half = step / 2
    touched = bounds.withColumn("band", F.explode(F.sequence(floor(F.col("ya") - half), floor(F.col("yb") + half)))).join(lines, "band").where((F.col("lat") > F.col("ya") - half) & (F.col("lat") < F.col("yb") + half))
    around = touched.select(*keys, "band", "lat", F.struct((F.col("xa") - half).alias("a"), (F.col("xb") + half).alias("b")).alias("s"))
    both = cut.withColumn("_in", F.lit(True)).unionByName(around.withColumn("_in", F.lit(False)))
    tiles = both.withColumn("column", F.explode(F.sequence(floor(F.col("s.a")), floor(F.col("s.b")))))
    lon = lambda c: F.col("column") * tile + (c["i"] + 0.5) * step
    inside = F.filter("cells", lambda c: (lon(c) > F.col("s.a")) & (lon(c) < F.col("s.b")))
    hit = tiles.join(raster, ["band", "column", "lat"]).select(*keys, "_in", inside.alias("c"))
    sums = hit.select(*keys, "_in", F.size("c").alias("n"), F.aggregate("c", F.lit(0.0), lambda a, c: a + c["v"]).alias("v"))
    of = lambda test, c: F.sum(F.when(test, F.col(c)))
    g = sums.groupBy(*keys).agg(*[of(test, c).alias(f"{c}_{name}") for name, test in (("in", F.col("_in")), ("near", ~F.col("_in"))) for c in ("n", "v")])
    few = F.coalesce(F.col("n_in"), F.lit(0)) == 0
    n = F.when(few, F.col("n_near")).otherwise(F.col("n_in"))
    return g.select(*keys, n.alias("n"), (F.when(few, F.col("v_near")).otherwise(F.col("v_in")) / n).alias("mean")).where("n > 0")
