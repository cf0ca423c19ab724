"""Boundaries by full and border cells, and joins whose cells are dense, against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from waymark.functions import geo
from waymark.operators import spatial


def star(rng, x, y, least, most, n):
    """A ring without self-intersections around (x, y)."""
    turns = sorted(rng.random() * 2 * math.pi for _ in range(n))
    return [(x + r * math.cos(t), y + r * math.sin(t)) for t, r in ((t, least + rng.random() * (most - least)) for t in turns)]


def covers(rings, px, py):
    inside = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            if abs((x2 - x1) * (py - y1) - (px - x1) * (y2 - y1)) <= 1e-12 and min(x1, x2) <= px <= max(x1, x2) and min(y1, y2) <= py <= max(y1, y2):
                return True
            if (y1 > py) != (y2 > py) and px < x1 + (py - y1) * (x2 - x1) / (y2 - y1):
                inside = not inside
    return inside


@pytest.mark.parametrize("size", [0.07, 0.5, 30.0])
def test_random_polygons_with_holes(spark, size):
    rng = random.Random(int(size * 100))
    areas = []
    for k in range(12):
        x, y = rng.uniform(-3, 3), rng.uniform(-3, 3)
        areas.append((k, [star(rng, x, y, 1.0, 2.0, rng.randint(8, 40)), star(rng, x, y, 0.2, 0.6, rng.randint(5, 9))]))
    square = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]
    areas.append((50, [square, [(0.5, 0.5), (1.5, 0.5), (1.0, 1.0)]]))
    points = [(f"p{k}", rng.uniform(-5, 5), rng.uniform(-5, 5)) for k in range(600)]
    points += [(f"v{k}", *p) for k, p in enumerate(areas[0][1][0] + areas[3][1][1] + square)] + [(f"g{i}{j}", i / 2, j / 2) for i in range(-2, 6) for j in range(-2, 6)]
    want = {(i, a) for i, px, py in points for a, rings in areas if covers(rings, px, py)}
    df = spark.createDataFrame(points, "_id string, lon double, lat double")
    polygons = spark.createDataFrame(areas, "area_id int, rings array<array<struct<x: double, y: double>>>")
    got = [(r._id, r.area_id) for r in spatial.point_in_polygon(df, polygons, size).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 300


def test_border_rows_follow_edges(spark):
    """Halving the cells of a large polygon doubles the rows of its edges; it does not square them."""
    rng = random.Random(3)
    polygons = spark.createDataFrame([(1, [star(rng, 0, 0, 9.0, 10.0, 300)])], "area_id int, rings array<array<struct<x: double, y: double>>>")
    rows = {size: spatial.cover(polygons, size)[0].count() for size in (0.4, 0.2, 0.1)}
    assert rows[0.2] < 2.2 * rows[0.4] and rows[0.1] < 2.2 * rows[0.2]
    full = spatial.cover(polygons, 0.1)[1].count()
    assert full > 10 * rows[0.1] / 3


@pytest.mark.parametrize("most", [10, 1_000_000])
def test_dense_cells_are_parted(spark, monkeypatch, most):
    monkeypatch.setattr(spatial.spread, "__defaults__", (most,))
    rng = random.Random(5)
    docs = [(f"d{k}", 33.3 + rng.random() / 1000, 44.3 + rng.random() / 1000) for k in range(300)] + [(f"e{k}", 33 + rng.random(), 44 + rng.random()) for k in range(300)]
    asks = [(k, 33.3 + rng.random() / 100, 44.3 + rng.random() / 100, 500.0 + k) for k in range(20)]
    p = spark.createDataFrame(docs, "_id string, lat double, lon double")
    q = spark.createDataFrame(asks, "query_id int, q_lat double, q_lon double, radius double")
    every = q.join(p, F.lit(True)).where(geo.haversine(F.col("q_lat"), F.col("q_lon"), F.col("lat"), F.col("lon")) <= F.col("radius"))
    got = [(r.query_id, r._id) for r in spatial.radius_join(q, p, most=1000.0).collect()]
    assert sorted(got) == sorted((r.query_id, r._id) for r in every.collect()) and len(got) > 100
    roads = spark.createDataFrame([(k, [(44.3 + rng.random() / 100, 33.3 + rng.random() / 100), (44.3 + rng.random() / 100, 33.3 + rng.random() / 100)]) for k in range(40)], "road_id int, line array<struct<x: double, y: double>>")
    segs = spatial.segments(roads)
    x, y = spatial.closest_point(F.col("lon"), F.col("lat"), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    near = p.join(segs, F.lit(True)).withColumn("far", geo.haversine(F.col("lat"), F.col("lon"), y, x)).where("far <= 300").groupBy("_id").agg(F.min(F.struct("far", "road_id")).alias("m"))
    snapped = {r._id: r.road_id for r in spatial.nearest_line(p, segs, 300.0).collect()}
    assert snapped == {r._id: r.m.road_id for r in near.collect()} and len(snapped) > 100


def test_parts_hold_no_more_than_their_share(spark):
    rows = spark.range(5000).select(F.col("id").alias("_id"), F.when(F.col("id") < 4000, 1).otherwise(F.col("id")).alias("cx"))
    small = spark.createDataFrame([(1, "a"), (1, "b"), (4500, "c")], "cx long, name string")
    large, copied = spatial.spread(rows, small, ["cx"], "_id", 100)
    assert large.groupBy("cx", "part").count().agg(F.max("count")).first()[0] < 200
    assert copied.count() == 2 * 40 + 1
    assert large.join(copied, ["cx", "part"]).count() == 8001
