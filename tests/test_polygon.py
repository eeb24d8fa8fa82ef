"""Polygons as a table against ray casting on every pair."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import lattice, polygon

POINTS, CORNERS = "item int, x double, y double", "polygon_id int, ord int, x double, y double"


def holds(corners, px, py, eps=1e-9):
    """By a plain loop over all edges."""
    hits, on = 0, False
    for (x0, y0), (x1, y1) in zip(corners, corners[1:] + corners[:1], strict=True):
        dx, dy = x1 - x0, y1 - y0
        length = math.hypot(dx, dy)
        if not length:
            on |= math.hypot(px - x0, py - y0) <= eps
            continue
        across, along = (px - x0) * dy - (py - y0) * dx, (px - x0) * dx + (py - y0) * dy
        on |= abs(across) <= eps * length and -eps * length <= along <= length * length + eps * length
        hits += (y0 > py) != (y1 > py) and px < x0 + (py - y0) * (dx / dy)
    return on or hits % 2 == 1


def tables(spark, points, polygons):
    rows = [(k, n + 1, float(x), float(y)) for k, ring in polygons.items() for n, (x, y) in enumerate(ring)]
    return spark.createDataFrame([(n, float(x), float(y)) for n, (x, y) in enumerate(points)], POINTS), spark.createDataFrame(rows, CORNERS)


def test_equals_all_pairs_of_all_sizes(spark):
    rng = np.random.default_rng(3)
    polygons = {}
    for k in range(60):  # sides from 1/100 to 100, stars and polygons that cross themselves
        n, size, centre = int(rng.integers(3, 40)), 10 ** rng.uniform(-2, 2), rng.uniform(-20, 20, 2)
        angles = np.sort(rng.uniform(0, 2 * np.pi, n)) if k % 3 else rng.uniform(0, 2 * np.pi, n)
        r = size * rng.uniform(0.2, 1, n)
        polygons[k] = [(centre[0] + a * math.cos(t), centre[1] + a * math.sin(t)) for a, t in zip(r, angles, strict=True)]
    polygons[100] = [(0, 0), (4, 0), (4, 4), (2, 1), (0, 4), (0, 0)]  # closed by its first corner
    polygons[101] = [(-8, -8), (8, -8), (8, 8), (-8, 8)]  # on borders of cells
    polygons[102] = [(3, 3)]
    polygons[103] = [(-5, 1), (5, 2)]
    points = [tuple(p) for p in rng.uniform(-30, 30, (600, 2))]
    points += [c for ring in polygons.values() for c in ring]  # corners
    points += [((a[0] + b[0]) / 2, (a[1] + b[1]) / 2) for ring in polygons.values() for a, b in zip(ring, ring[1:], strict=False)]  # on edges
    points += [(x, y) for x in range(-9, 10, 2) for y in range(-9, 10, 2)] + [(8, 8), (8, 0), (3, 3), (0, 1.5)] * 3  # repeated
    df, corners = tables(spark, points, polygons)
    got = sorted((r.item, r.polygon_id) for r in polygon.in_polygons(df, corners).collect())
    want = sorted((n, k) for n, (x, y) in enumerate(points) for k, ring in polygons.items() if holds(ring, float(x), float(y)))
    assert got == want
    assert len({k for _, k in want}) > 50


def test_equals_the_literal_route(spark):
    ring = [(0.0, 0.0), (5.0, 0.5), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0), (0.0, 0.0)]
    df, corners = tables(spark, [(i / 4, j / 4) for i in range(-4, 25) for j in range(-4, 20)], {7: ring})
    one = {r.item for r in lattice.polygon_mask(df, ring).where("inside").collect()}
    assert {r.item for r in polygon.in_polygons(df, corners).collect()} == one
    assert 100 < len(one) < 400


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, 0.5, 0.5), (2, None, 0.5), (3, 0.5, float("nan")), (4, float("inf"), 0.5), (5, 1e300, -1e300), (1, 0.5, 0.5)], POINTS).withColumn("level", F.lit("mine"))
    square = [(1, 1, 0.0, 0.0), (1, 2, 1.0, 0.0), (1, 3, 1.0, 1.0), (1, 4, 0.0, 1.0), (None, 1, 0.0, 0.0)]
    got = polygon.in_polygons(df, spark.createDataFrame(square, CORNERS))
    assert got.columns == ["item", "x", "y", "level", "polygon_id"]
    assert [(r.item, r.level, r.polygon_id) for r in got.collect()] == [(1, "mine", 1)] * 2
    none = spark.createDataFrame([], CORNERS)
    assert polygon.in_polygons(df, none).count() == 0
    assert polygon.in_polygons(df.limit(0), spark.createDataFrame(square, CORNERS)).count() == 0
    with pytest.raises(ValueError, match="polygon_id"):
        polygon.in_polygons(df.withColumn("polygon_id", F.lit(1)), none)
    for bad, text in (([(1, 1, 0.0, 0.0), (1, 3, 1.0, 1.0)], "not numbered"), ([(1, 1, 0.0, None), (1, 2, 1.0, 1.0)], "not finite")):
        with pytest.raises(Exception, match=text):
            polygon.in_polygons(df, spark.createDataFrame(bad, CORNERS)).collect()


def test_work_of_many_polygons(spark):
    """Cells of a cover grow with the corners, and no pair of a point and a polygon is made beyond shared cells."""
    corners = spark.range(10_000).select(
        F.col("id").alias("polygon_id"), F.posexplode(F.array(*[F.array(F.lit(x), F.lit(y)) for x, y in ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0))])).alias("n", "v")
    ).select("polygon_id", (F.col("n") + 1).alias("ord"), (F.col("polygon_id") % 100 + F.col("v")[0] * 0.9).alias("x"), (F.floor(F.col("polygon_id") / 100) + F.col("v")[1] * 0.9).alias("y"))
    cover = polygon.cover(polygon.bands(polygon._sized(polygon.edges(corners), 1e-9, 3)))
    assert cover.count() < 10_000 * 4 * 4**4
    points = spark.range(200_000).select("id", (F.pmod(F.hash("id"), F.lit(100_000)) / 1000).alias("x"), (F.pmod(F.hash("id", F.lit(1)), F.lit(100_000)) / 1000).alias("y"))
    got = polygon.in_polygons(points, corners)
    assert "CartesianProduct" not in got._jdf.queryExecution().toString() and "NestedLoop" not in got._jdf.queryExecution().toString()
    fine = (F.col("x") - F.floor("x") <= 0.9 + 1e-9) & (F.col("y") - F.floor("y") <= 0.9 + 1e-9)
    edge = (F.col("x") - F.floor("x") == 0) | (F.col("y") - F.floor("y") == 0)
    assert got.where(~edge).count() == points.where(fine & ~edge).count()


def test_equal_polygons_are_tested_once(spark):
    """Polygons with the same edges are one class; all of its members are named, and one that differs in a corner is another class."""
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    shapes = {7: square, 3: square, 5: square[1:] + square[:1], 9: [*square[:3], (0.0, 3.0)], 11: square}
    corners = spark.createDataFrame([(k, n, x, y) for k, v in shapes.items() for n, (x, y) in enumerate(v, 1)], "polygon_id long, ord int, x double, y double")
    assert {(r.polygon_id, r.class_id) for r in polygon.classes(polygon.edges(corners)).collect()} == {(3, 3), (5, 3), (7, 3), (11, 3), (9, 9)}
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 1.0, 3.9), (3, 5.0, 1.0)], "n int, x double, y double")
    assert sorted((r.n, r.polygon_id) for r in polygon.in_polygons(points, corners).collect()) == [(1, k) for k in (3, 5, 7, 9, 11)] + [(2, k) for k in (3, 5, 7, 11)]


def shuffled(spark, job):
    """Rows that a job's stages write for others."""
    sc = spark.sparkContext
    stages = lambda: {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (found.apply(k) for k in range(found.size()))}
    read = lambda: sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    found = read()
    old = stages()
    result = job()
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    found = read()
    return result, sum(n for k, n in stages().items() if k not in old)


def test_results_are_not_shuffled(spark):
    """Each of 5,000 points lies in each of 200 different squares; what is shuffled are points, edges and cells."""
    points = spark.range(5_000).select("id", (F.col("id") % 71 / 71).alias("x"), (F.floor(F.col("id") / 71) / 71).alias("y"))
    ring = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(x).alias("x"), F.lit(y).alias("y")) for n, (x, y) in enumerate([(-1.0, -1.0), (2.0, -1.0), (2.0, 2.0), (-1.0, 2.0)], 1)])
    corners = spark.range(200).select("id", F.explode(ring).alias("v")).select(F.col("id").alias("polygon_id"), F.col("v.n").alias("ord"), (F.col("v.x") * (1 + F.col("id") / 1000)).alias("x"), F.col("v.y").alias("y"))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows, moved = shuffled(spark, lambda: polygon.in_polygons(points, corners).count())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert rows == 1_000_000
    assert moved < 500_000


@pytest.mark.parametrize("near", [0, 2, 1_000])
def test_all_ways_of_a_place_to_its_polygons(spark, monkeypatch, near):
    """Edges carried by cells, few or many, or as rows; full cells in several parts; classes in several lists."""
    for name, value in (("_NEAR", near), ("_FEW", 1), ("_CROWD", 3), ("_MEMBERS", 2)):
        monkeypatch.setattr(polygon, name, value)
    rng = np.random.default_rng(11)
    star = [(4 * r * math.cos(t), 4 * r * math.sin(t)) for t, r in zip(rng.uniform(0, 2 * np.pi, 24), rng.uniform(0.2, 1, 24), strict=True)]
    teeth = [p for k in range(20) for p in ((k / 4 - 2.5, -3.0), (k / 4 - 2.4, 3.0))]
    square = [(-1.0, -1.0), (1.0, -1.0), (1.0, 1.0), (-1.0, 1.0)]
    polygons = {1: star, 2: teeth, **dict.fromkeys(range(3, 12), square), 12: [(-4.0, 0.0), (4.0, 0.0), (0.0, 2.0)], 13: [(0.5, 0.5)], 14: [(-1.0, 0.25), (1.0, 0.25)]}
    points = [tuple(p) for p in rng.uniform(-4, 4, (300, 2))] + [c for ring in polygons.values() for c in ring] + [(0.5, 0.5)] * 20 + [(0.3, 0.25), (1.0, 0.1)]
    df, corners = tables(spark, points, polygons)
    got = sorted((r.item, r.polygon_id) for r in polygon.in_polygons(df.withColumn("more", F.create_map(F.lit("a"), "item")) if near == 2 else df, corners).collect())
    assert got == sorted((n, k) for n, (x, y) in enumerate(points) for k, ring in polygons.items() if holds(ring, float(x), float(y)))
