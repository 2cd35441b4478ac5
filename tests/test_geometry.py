"""Nearness, regions, lines, projections and tiles against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cairnlake.functions import geo
from cairnlake.operators import lines, nearby


def haversine(a, b):
    s1, s2 = math.sin(math.radians(b[0] - a[0]) / 2), math.sin(math.radians(b[1] - a[1]) / 2)
    return 2 * geo.EARTH_M * math.asin(min(1, math.sqrt(s1 * s1 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * s2 * s2)))


@pytest.mark.parametrize("base", [(40.0, -75.0), (0.0, 0.0), (-60.0, 100.0), (80.0, 10.0)])
@pytest.mark.parametrize("hot", [4096, 3])
def test_pairs_within(spark, base, hot):
    rng = random.Random(1)
    pts = [(f"p{i}", base[0] + rng.uniform(-0.01, 0.01), base[1] + rng.uniform(-0.02, 0.02)) for i in range(150)]
    df = spark.createDataFrame([*pts, ("null", None, 1.0), ("nan", float("nan"), 1.0)], "id string, lat double, lon double")
    got = {(r.id_l, r.id_r) for r in nearby.pairs_within(df, df, "id", "id", "lat", "lon", 200.0, hot=hot).collect()}
    assert got == {(a[0], b[0]) for a in pts for b in pts if haversine(a[1:], b[1:]) <= 200.0}


def test_pairs_meet_once_and_empty_tables(spark):
    df = spark.createDataFrame([("a", 40.0, -75.0), ("b", 40.0, -75.0)], "id string, lat double, lon double")
    assert nearby.pairs_within(df, df, "id", "id", "lat", "lon", 10.0).count() == 4
    assert nearby.pairs_within(df.limit(0), df, "id", "id", "lat", "lon", 10.0).count() == 0
    assert nearby.nearest_within(df, df.limit(0), "id", "id", "lat", "lon", 10.0).count() == 0


def test_points_in_regions(spark):
    rng = random.Random(2)
    pts = [(i, rng.uniform(-3, 3), rng.uniform(-3, 3)) for i in range(300)]
    ring = [(-2.0, -2.0), (2.0, -1.0), (1.0, 2.0), (0.0, 0.0), (-1.5, 1.5)]

    def inside(x, y):
        hit = False
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                hit = not hit
        return hit

    p = spark.createDataFrame([*pts, (999, None, 0.0)], "id int, x double, y double")
    r = spark.createDataFrame([("r", ring), ("flat", ring[:2])], "region string, ring array<struct<x: double, y: double>>")
    got = {(q.id, q.region) for q in nearby.points_in_regions(p, r, "id", "region", "x", "y", "ring", 0.7).collect()}
    assert got == {(i, "r") for i, x, y in pts if inside(x, y)}


def test_projections_round_trip(spark):
    df = spark.createDataFrame([(-75.0, 41.0), (-120.5, 33.3), (-68.0, 47.9)], "lon double, lat double")
    x, y = geo.albers(F.col("lon"), F.col("lat"))
    back = df.select("lon", "lat", x.alias("x"), y.alias("y")).select("lon", "lat", *[c.alias(n) for c, n in zip(geo.albers_inverse(F.col("x"), F.col("y")), ("a", "b"))])
    for r in back.collect():
        assert abs(r.lon - r.a) < 1e-7 and abs(r.lat - r.b) < 1e-7


def test_area_keeps_true_scale(spark):
    """One square degree at 40 N in equal-area metres."""
    corners = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate([(-75.0, 40.0), (-74.0, 40.0), (-74.0, 41.0), (-75.0, 41.0)])], "i int, lon double, lat double")
    x, y = geo.albers(F.col("lon"), F.col("lat"))
    ring = corners.select("i", x.alias("x"), y.alias("y")).agg(F.array_sort(F.collect_list(F.struct("i", "x", "y"))).alias("r"))
    area = ring.select(geo.shoelace(F.transform("r", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))))).first()[0]
    assert abs(area / 9.39e9 - 1) < 0.01


def test_mile_at(spark):
    knots = F.array(*[F.struct(F.lit(a).alias("along"), F.lit(m).alias("mile")) for a, m in ((0.0, 10.0), (100.0, 20.0))])
    got = spark.range(1).select(*[lines.mile_at(knots, F.lit(v), 100.0) for v in (50.0, -100.0, 300.0, 0.0)]).first()
    assert [round(v, 6) for v in got] == [15.0, 9.0, 22.0, 10.0]


def test_resampled_carries_the_remainder(spark):
    df = spark.createDataFrame([(1, 30.0), (2, 0.0), (3, 45.0)], "line int, length double")
    got = [tuple(r) for r in lines.resampled(df, "line", "length", 25.0).orderBy("total").collect()]
    assert got == [(1, 0.0, 0.0), (1, 25.0, 25.0), (3, 20.0, 50.0), (3, 45.0, 75.0)]


def test_simplify():
    pts = [(0.0, 0.0), (1.0, 0.1), (2.0, 0.0), (3.0, 5.0), (4.0, 0.0)]
    assert lines.simplify(pts, 0.5) == [0, 2, 3, 4]
    assert lines.simplify(pts, 0) == [0, 1, 2, 3, 4]
    assert lines.simplify(pts[:2], 9) == [0, 1]


def test_greedy_clusters(spark):
    df = spark.createDataFrame([(1, "a", 1, 40.0, -75.0), (1, "b", 0, 40.0003, -75.0), (1, "c", 1, 40.0006, -75.0)], "block int, key string, rank int, lat double, lon double")
    got = {r.key: r["head"] for r in lines.greedy_clusters(df, "block", "key", "rank", "lat", "lon", 40.0).collect()}
    assert got == {"b": "b", "a": "b", "c": "b"}
