"""What grows with the tables: rows that operators write, not only what they give."""

import datetime
import math
import random

import duckdb
import pytest

from cairnlake.operators import lines
from cairnlake.plans import conditions
from cairnlake.plans import lines as line_plans


def _walked(monkeypatch):
    """Numbers of segments written into cells, one for each look."""
    seen, walk = [], lines.cells_walked

    def counted(segs, side, margin):
        seen.append(segs.count())
        return walk(segs, side, margin)

    monkeypatch.setattr(lines, "cells_walked", counted)
    return seen


def test_coincident_segments_are_written_once(spark, monkeypatch):
    """of lines laid over each other only the one that ties go to is looked at; all points get what brute force gives."""
    rng = random.Random(5)
    shape = [(float(10 * i), float(rng.randrange(40))) for i in range(8)]
    v = [(line, i, x, y) for line in range(60) for i, (x, y) in enumerate(shape)] + [(99, i, x, y + 45) for i, (x, y) in enumerate(shape)]
    segs = lines.segments(spark.createDataFrame(v, "line long, seq long, x double, y double"), "line", "seq", "x", "y")
    points = [(i, rng.randrange(-300, 1000) / 10, rng.randrange(-300, 1200) / 10) for i in range(300)] + [(900, None, 1.0), (901, *shape[3])]
    seen = _walked(monkeypatch)
    got = {r.point: (r.line, r.distance, r.along, r.foot_x, r.foot_y) for r in lines.nearest_segment(spark.createDataFrame(points, "point long, px double, py double"), segs, "point", "px", "py", "line", 30.0).collect()}
    assert set(seen) == {14}
    want = {}
    for point, px, py in points:
        best = (math.inf,)
        for line, up in ((0, 0), (99, 45)) if px is not None else ():
            along = 0.0
            for (ax, ay), (bx, by) in zip(shape, shape[1:]):
                dx, dy = bx - ax, by - ay
                t = max(0.0, min(1.0, ((px - ax) * dx + (py - ay - up) * dy) / (dx * dx + dy * dy)))
                fx, fy = ax + t * dx, ay + up + t * dy
                best = min(best, (round(math.hypot(px - fx, py - fy), 9), line, along + t * math.hypot(dx, dy), fx, fy))
                along += math.hypot(dx, dy)
        if best[0] <= 30:
            want[point] = best
    assert set(got) == set(want) and len(got) > 100
    for point, (line, *rest) in got.items():
        assert line == want[point][1]
        assert all(math.isclose(a, b, abs_tol=1e-6) for a, b in zip(rest, (want[point][0], *want[point][2:])))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_uncontradicted_without_pairs_of_notes(spark, same_rows, tmp_path, seed):
    """no pair of notes is made, and undated notes, notes without an account and equal times come out as in SQL."""
    rng = random.Random(seed)
    day = lambda: datetime.datetime(2026, 1, 1) + datetime.timedelta(days=rng.randrange(12))
    rows = [(str(rng.randrange(500)), rng.choice([None, "a", "b", "c", "d"]), rng.choice([None, *"pqrstuvwxyz"]), rng.choice([None, "dry", "not_found", "flowing", "flowing", "full"]), rng.choice([None, *(day() for _ in range(6))])) for _ in range(400)]
    rows += [("1000", None, "lone", "dry", day()), *(("1001", "a", place, "dry", day()) for place in ("one", "other")), *rows[:50]]
    spark.createDataFrame(rows, "id string, reporter_id string, poi_id string, observation string, observed_at timestamp_ntz").write.parquet(f"{tmp_path}/field_notes.parquet")
    con = duckdb.connect()
    con.execute(f"create view field_notes as select * from '{tmp_path}/field_notes.parquet/*.parquet'")
    df = conditions.j11_uncontradicted(spark, str(tmp_path))
    same_rows(df, con.sql(conditions.SQL["j11_uncontradicted"]).df())
    joins = [x for x in df._jdf.queryExecution().optimizedPlan().toString().split("\n") if " Join " in f" {x.strip(' :+-')} "]
    assert joins and not any(c in x for x in joins for c in "<>")


def test_nearest_of_repeated_orders(spark, same_rows, tmp_path, monkeypatch):
    """lines repeat after 575 of them, so twice the orders give the same segments to look at, and the rows of the SQL."""
    seen, con = _walked(monkeypatch), duckdb.connect()
    for n in (1, 2):
        d = str(tmp_path / str(n))
        spark.range(28750 * n).withColumnRenamed("id", "o_orderkey").write.parquet(f"{d}/orders.parquet")
        spark.range(400).withColumnRenamed("id", "p_partkey").write.parquet(f"{d}/part.parquet")
        df = line_plans.j17_nearest_segment(spark, d)
        assert set(seen) == {28175}
        for name in ("orders", "part"):
            con.execute(f"create or replace view {name} as select * from '{d}/{name}.parquet/*.parquet'")
        same_rows(df, con.sql(line_plans.SQL["j17_nearest_segment"]).df())


def test_lines_come_together_as_bare_keys(spark, tmp_path):
    """the one exchange that makes segments of orders carries their keys, not vertices."""
    spark.range(2000).withColumnRenamed("id", "o_orderkey").write.parquet(f"{tmp_path}/orders.parquet")
    segs = lines.segments(line_plans._vertices(spark, str(tmp_path), by_line=True), "line", "seq", "x", "y")
    plan = segs._jdf.queryExecution().executedPlan().toString().split("\n")
    (at,) = [i for i, x in enumerate(plan) if "Exchange" in x]
    assert not any("Project" in x for x in plan[at:]) and segs.count() == 1960
