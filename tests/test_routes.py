"""Corridor, route and ranking operators at their edges and against brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from cairnlake.operators import corridor, lines, notes, routes, sequence


def test_segments_walk_every_cell_they_come_near(spark):
    rng = random.Random(2)
    rows = [(i, *(rng.uniform(-5, 5) for _ in range(4))) for i in range(40)] + [(100, 1.0, -3.0, 1.0, 3.0), (101, 2.0, 2.0, 2.0, 2.0), (102, -4.0, 0.5, 4.0, 0.5)]
    segs = spark.createDataFrame(rows, "seg int, ax double, ay double, bx double, by double")
    for margin in (0.0, 0.4):
        got = {(r.seg, r._cx, r._cy) for r in lines.cells_walked(segs, 0.7, margin).select("seg", "_cx", "_cy").collect()}
        for seg, ax, ay, bx, by in rows:
            for t in range(201):
                x, y = ax + (bx - ax) * t / 200, ay + (by - ay) * t / 200
                for dx, dy in itertools.product((-margin, 0, margin), repeat=2):
                    assert (seg, int((x + dx * 0.999) // 0.7), int((y + dy * 0.999) // 0.7)) in got


def _ring(*points):
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points])


def test_spans_inside_a_ring_that_is_not_convex(spark):
    u = _ring((0, 0), (6, 0), (6, 4), (4, 4), (4, 2), (2, 2), (2, 4), (0, 4))  # a U
    spans = lambda ax, ay, bx, by: [(round(s.low, 6), round(s.high, 6)) for s in spark.range(1).select(corridor.inside_spans(*map(F.lit, (ax, ay, bx, by)), u)).first()[0]]
    assert spans(-2.0, 3.0, 8.0, 3.0) == [(0.2, 0.4), (0.6, 0.8)]
    assert spans(1.0, 1.0, 5.0, 1.0) == [(0.0, 1.0)]
    assert spans(-1.0, 9.0, 8.0, 9.0) == [] and spans(3.0, 3.0, 3.0, 3.5) == []


def test_common_part_of_rings(spark):
    square = _ring((0, 0), (2, 0), (2, 2), (0, 2))
    area = lambda other: spark.range(1).select(corridor.geo.shoelace(corridor.clipped_ring(square, other))).first()[0]
    assert area(_ring((1, 1), (3, 1), (3, 3), (1, 3))) == pytest.approx(1.0)
    assert area(_ring((5, 5), (6, 5), (6, 6), (5, 6))) == 0.0
    assert area(_ring((1, -1), (3, 1), (1, 3), (-1, 1))) == pytest.approx(4.0)


@pytest.mark.parametrize("seed", [1, 2])
def test_chains_against_brute_force(spark, seed):
    rng = random.Random(seed)
    segs = [(i, rng.randrange(60), rng.randrange(60), rng.randrange(2)) for i in range(50)]
    segs = [s for s in segs if s[1] != s[2]]
    chain = {s[0]: s[0] for s in segs}
    ends: dict = {}
    for i, a, b, _ in segs:
        ends.setdefault(a, []).append(i)
        ends.setdefault(b, []).append(i)
    for _ in segs:
        for two in ends.values():
            if len(two) == 2 and segs[[s[0] for s in segs].index(two[0])][3] == segs[[s[0] for s in segs].index(two[1])][3]:
                chain[two[0]] = chain[two[1]] = min(chain[two[0]], chain[two[1]])
    got = {r.seg: r["chain"] for r in corridor.chains(spark.createDataFrame(segs, "seg int, a int, b int, blaze int"), "seg", "a", "b", ("blaze",)).collect()}
    assert got == chain


def test_seam_distance_and_its_histogram(spark):
    from cairnlake.operators import tiles

    rows = [(5, x, y) for x in range(12) for y in range(3)] + [(6, 0, 0)]
    t = spark.createDataFrame(rows, "z int, x int, y int")
    d = corridor.seam_distance(t, t.where("z = 5 and x = 4"), 3)
    got = {(r.z, r.x, r.y): r.distance for r in d.collect()}
    assert got == {(z, x, y): abs(x - 4) if z == 5 and abs(x - 4) <= 3 else None for z, x, y in rows}
    assert {r.distance: r.n for r in tiles.seam_histogram(d, 2).collect()} == {0: 3, 1: 6, 2: 12, None: 16}


def test_text_of_lines_survives(spark):
    points = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((-84.5, 34.25), (1e-7, -0.0), (3.0, 1234567.125))])
    back = spark.range(1).select(corridor.from_wkt(corridor.wkt(points)).alias("p")).first()["p"]
    assert [(p.x, p.y) for p in back] == [(-84.5, 34.25), (1e-7, 0.0), (3.0, 1234567.125)]


def test_running_totals_over_ranges(spark):
    rng = random.Random(3)
    rows = [(i, rng.randrange(9)) for i in rng.sample(range(1000), 300)]
    got = {r.k: (r.total, r.n) for r in sequence.running_totals(spark.createDataFrame(rows, "k int, v int").repartition(7), "k", {"total": F.col("v"), "n": F.lit(1)}).collect()}
    total, want = 0, {}
    for n, (k, v) in enumerate(sorted(rows), 1):
        total += v
        want[k] = (total, n)
    assert got == want
    assert sequence.running_totals(spark.createDataFrame([], "k int, v int"), "k", {"total": F.col("v")}).count() == 0


def test_beyond_the_most_recent(spark):
    rows = [(f"n{i:02}", "p", i // 3) for i in range(30)] + [("x", "q", 1), ("y", None, 1)]
    got = {r.id for r in notes.beyond_recent(spark.createDataFrame(rows, "id string, place string, at int"), "place", "at", "id", 4).collect()}
    kept = sorted(rows[:30], key=lambda r: (-r[2], r[0]))[:4]
    assert got == {r[0] for r in rows[:30]} - {r[0] for r in kept}


@pytest.mark.parametrize("low, high, want", [(2.5, 5.5, ["b", "c"]), (3.5, 5.5, ["b", "c", "d"]), (5.2, 5.8, ["c", "d"]), (20.0, 30.0, []), (9.0, 20.0, ["c", "d"]), (-5.0, 0.0, [])])
def test_slices_widen(spark, low, high, want):
    v = spark.createDataFrame([(1, "a", 1.0), (1, "b", 3.0), (1, "c", 5.0), (1, "d", 9.0), (2, "z", 5.4)], "part int, id string, mile double")
    got = routes.slice_between(v, "part", "mile", low, high)
    assert sorted(r.id for r in got.where("part = 1").collect()) == want
    assert got.where("part = 2").count() == 0  # one vertex is no line


def test_edits_of_a_plan(spark):
    import datetime

    day = lambda n: datetime.date(2026, 5, 1) + datetime.timedelta(days=n)
    days = spark.createDataFrame([("a", n, day(n), n != 1) for n in range(4)] + [("b", 0, day(0), True)], "plan string, n int, date date, walked boolean")
    more = routes.insert_day(days, "plan", "n", "date", 1, {"walked": F.lit(False)})
    assert sorted((r.plan, r.n, r.date, r.walked) for r in more.collect()) == [("a", 0, day(0), True), ("a", 1, day(1), False), ("a", 2, day(2), False), ("a", 3, day(3), True), ("a", 4, day(4), True), ("b", 0, day(0), True)]
    less = routes.remove_day(days, "plan", "n", "date", 1, ~F.col("walked"))
    assert sorted((r.plan, r.n, r.date) for r in less.collect()) == [("a", 0, day(0)), ("a", 1, day(1)), ("a", 2, day(2)), ("b", 0, day(0))]
    assert routes.remove_day(days, "plan", "n", "date", 2, ~F.col("walked")).count() == 5
