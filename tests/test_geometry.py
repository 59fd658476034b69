"""Interior points and area means against plain crossings; tables of points."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from gridloom.operators import geometry as G
from gridloom.sources import reports


def inside(polygons, x, y):
    hits = 0
    for rings in polygons:
        for ring in rings:
            for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
                if (y1 > y) != (y2 > y) and x1 + (y - y1) / (y2 - y1) * (x2 - x1) > x:
                    hits += 1
    return hits % 2 == 1


def star(rng, x, y, size, corners):
    return [(x + size * rng.uniform(0.4, 1) * math.cos(2 * math.pi * k / corners), y + size * rng.uniform(0.4, 1) * math.sin(2 * math.pi * k / corners)) for k in range(corners)]


def some_shapes(seed=4):
    rng = random.Random(seed)
    out = {}
    for k in range(12):
        x, y = rng.uniform(-3, 3), rng.uniform(-3, 3)
        hole = [(x + a, y + b) for a, b in ((0.1, 0.1), (-0.15, 0.1), (-0.1, -0.2), (0.1, -0.1))]
        polygon = [star(rng, x, y, rng.uniform(0.8, 2.5), rng.randrange(5, 11)), hole]
        out[f"s{k}"] = [polygon] if k % 3 else [polygon, [[(x + 6, y), (x + 7, y), (x + 7, y + 1)]]]
    out["L"] = [[[(0, 0), (3, 0), (3, 1), (1, 1), (1, 3), (0, 3)]]]
    out["tiny"] = [[[(0.02, 0.02), (0.06, 0.02), (0.04, 0.05)]]]  # no cell's centre inside
    return out


def geometry(polygons, closed=True):
    rings = [[[list(p) for p in (ring + ring[:1] if closed else ring)] for ring in rings] for rings in polygons]
    return {"type": "Polygon", "coordinates": rings[0]} if len(rings) == 1 else {"type": "MultiPolygon", "coordinates": rings}


@pytest.fixture(scope="module")
def edges(spark):
    rows = [(i, json.dumps(geometry(p, closed=len(i) % 2 == 0)), 1) for i, p in some_shapes().items()]
    rows += [("none", None, 1), ("empty", json.dumps({"type": "Polygon", "coordinates": []}), 1), ("line", json.dumps({"type": "LineString", "coordinates": [[0, 0], [1, 1]]}), 1), ("flat", json.dumps({"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [2, 0], [0, 0]]]}), 1)]
    frame = spark.createDataFrame(rows, "id string, g string, part int")
    return G.edges_of(frame.select("id", G.rings_of(F.col("g")).alias("rings")), ["id"], "rings").persist()


def test_points_lie_inside(edges):
    found = {r.id: (r.lon, r.lat) for r in G.interior_points(edges, ["id"]).collect()}
    shapes = some_shapes()
    assert set(found) == set(shapes)
    assert all(inside(shapes[i], *found[i]) for i in shapes)
    assert found["L"] == (0.5, 2.0)


@pytest.mark.parametrize("tile", [1.0, 2.0])
def test_area_means_as_plain(spark, edges, tile):
    rng, step = random.Random(9), 0.125
    cells = [(round(a * step + step / 2, 6), round(o * step + step / 2, 6), None if rng.random() < 0.1 else float("nan") if rng.random() < 0.05 else rng.uniform(0, 900)) for a in range(-48, 48) for o in range(-48, 90)]
    raster = G.raster_rows(spark.createDataFrame(cells, "lat double, lon double, value double"), step, tile)
    found = {r.id: (r.n, r.mean) for r in G.area_means(edges, ["id"], raster, step, tile).collect()}
    known = [c for c in cells if c[2] is not None and c[2] == c[2]]
    for i, polygons in some_shapes().items():
        hit = [v for lat, lon, v in known if inside(polygons, lon, lat)]
        if not hit:
            xs, ys = zip(*[p for rings in polygons for ring in rings for p in ring])
            hit = [v for lat, lon, v in known if min(xs) - step / 2 < lon < max(xs) + step / 2 and min(ys) - step / 2 < lat < max(ys) + step / 2]
        assert (found.get(i) is None) == (not hit) and (not hit or (found[i][0] == len(hit) and abs(found[i][1] - sum(hit) / len(hit)) < 1e-6)), i
    assert found["s1"][0] > 50


def test_geojson_of_polygons_and_points(spark, tmp_path):
    shapes = some_shapes()
    features = [
        {"type": "Feature", "properties": {"adcode": 341822, "name": "east"}, "geometry": geometry(shapes["L"])}, {"type": "Feature", "properties": {"NAME": "north", "code": "n7"}, "geometry": geometry(shapes["s0"])},
        {"type": "Feature", "properties": {}, "geometry": {"type": "Point", "coordinates": [118.5, 30.25]}}, {"type": "Feature", "properties": {"name": "nowhere"}, "geometry": None}, {"type": "Feature", "properties": None, "geometry": geometry(shapes["s1"])},
    ]
    path = tmp_path / "places.json"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": features}), encoding="utf-8")
    points, edges = reports.points_geojson(spark, str(path))
    got = {r.id: r for r in points.collect()}
    assert {i: r.name for i, r in got.items()} == {"341822": "east", "0001": "north", "0002": "feature_2", "0004": "feature_4"}
    assert (got["0002"].lat, got["0002"].lon) == (30.25, 118.5) and inside(shapes["s0"], got["0001"].lon, got["0001"].lat)
    assert edges.select("id").distinct().count() == 3
    assert "n7" in [r.id for r in reports.points_geojson(spark, str(path), id_field="code")[0].collect()]
    path.write_text('{"features": []}', encoding="utf-8")
    with pytest.raises(reports.BadTable):
        reports.points_geojson(spark, str(path))


def test_point_tables_are_checked(spark, tmp_path):
    path = tmp_path / "points.csv"
    path.write_text("﻿id,name,lat,lon,elevation_m,parent\n a1 , 东 镇 ,30.1,118.2, 60 ,\nb2,West,29.9,118.0,,county\n", encoding="utf-8")
    points = reports.points_csv(spark, str(path))
    assert [tuple(r) for r in points.orderBy("id").collect()] == [("a1", "东 镇", 30.1, 118.2, 60.0, None), ("b2", "West", 29.9, 118.0, None, "county")]
    with pytest.raises(reports.BadTable, match="b2"):
        reports.checked_points(points)
    assert reports.checked_points(points.where("id = 'a1'")).count() == 1
    path.write_text("id,name,lat,lon,elevation_m,parent\n", encoding="utf-8")
    with pytest.raises(reports.BadTable, match="no points"):
        reports.points_csv(spark, str(path))
