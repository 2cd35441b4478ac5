"""Queries do the whole job: every row of their tables takes part, against brute force on small fixtures."""

import datetime
import math
import random

import pytest

from cairnlake.operators import identity, nearby, tables, tiles
from cairnlake.operators import lines as operators
from cairnlake.plans import lines, trail


@pytest.fixture
def data(spark, tmp_path):
    """Writes tables of a data directory from rows and a schema; returns the directory."""

    def write(**tables):
        for name, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def _feet(a, b):
    la, lo, lb, ob = map(math.radians, (*a, *b))
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((ob - lo) / 2) ** 2
    return 2 * 20902231.0 * math.asin(min(1.0, math.sqrt(h)))


def test_axis_steps_over_all_vertices(spark, data):
    notes = [(f"n{i}", f"r{i % 2}", f"p{i}" if i % 3 else None, 35.0 + (i * 7 % 5) / 100, -84.0 + (i * 3 % 7) / 100) for i in range(9)]
    notes += [("n0", *notes[0][1:]), ("x", "r0", None, None, -84.0)]
    d = data(field_notes=(notes, "id string, reporter_id string, poi_id string, lat double, lon double"))
    expected, mile = {}, 0.0
    for part in ("r0", "r1"):
        before = None
        for key, _, _, lat, lon in sorted(n for n in set(notes) if n[1] == part and n[3] is not None):
            mile += _feet(before, (lat, lon)) / 5280.0 if before else 0.0
            expected[key], before = mile, (lat, lon)
    got = {r["id"]: r["mile"] for r in trail.w21_axis(spark, d).collect()}
    assert len(expected) == 9 and got == pytest.approx(expected, abs=1e-4)


@pytest.fixture
def walks(data):
    """Four events of each of 60 users: a climb of 10 and one of 20 levels; the last event is a sign-up."""
    rows = [(u * 4 + i, datetime.datetime(2026, 1, 1) + datetime.timedelta(hours=i), u, "signup" if i == 3 else "view", v) for u in range(60) for i, v in enumerate((10.0, 11.0, 9.0, 11.0))]
    return data(events=(rows, "event_id long, ts timestamp, user_id long, event_type string, value double"))


def test_reversed_has_all_users(spark, walks):
    got = {(r["user_id"], r["event_id"]): (r["part_start"], r["step"]) for r in trail.w13_reversed(spark, walks).collect()}
    assert got == {(u, u * 4 + i): (i == 2, 4 - i) for u in range(60) for i in range(4)}


def test_walking_days_of_all_users(spark, walks):
    got = {r["event_id"]: r["walking_day"] for r in trail.w33_walking_days(spark, walks).collect()}
    assert got == {u * 4 + i: n for u in range(60) for i, n in enumerate((1, 2, 2, 3))}


def test_sweep_sums_all_users(spark, walks):
    got = {r["threshold"]: r["gain"] for r in trail.a42_sweep(spark, walks).collect()}
    assert got == {t: 60 * 30.0 for t in (0.0, 1.0, 2.0, 3.0, 4.0, 6.0, 10.0)}


@pytest.mark.parametrize("n", [60, 2003])
def test_exact_days_reach_every_stop(spark, data, n):
    d = data(part=([(k, k * 7 % 50) for k in range(n)], "p_partkey long, p_size int"))
    days = lines.dp2_exact(spark, d).toPandas().sort_values(["hike", "day"])
    hikes = -(-n // 50)
    assert (days.groupby("hike")["day"].count() == 20).all() and days["hike"].nunique() == hikes
    ends = days.groupby("hike").agg(first=("from_mile", "min"), last=("to_mile", "max"))
    miles = [k * 5 + k * 7 % 50 % 5 for k in range(n)]
    stops = [[m for k, m in enumerate(miles) if k * hikes // n == h] for h in range(hikes)]
    assert max(map(len, stops)) <= 50 and sum(map(len, stops)) == n
    assert list(zip(ends["first"], ends["last"])) == [(s[0], s[-1]) for s in stops]
    assert (days["to_mile"] - days["from_mile"]).max() <= 25


@pytest.mark.parametrize("seed", [1, 2])
def test_water_in_a_long_chain_is_clustered_as_a_whole(spark, data, seed):
    order = random.Random(seed).sample(range(40), 40)
    step = 40 / 111132.0
    rows = [(f"k{order[i]:02}", "osm_water", f"{i}", None, "water", None, -80.0, 40.0 + i * step, datetime.datetime(2026, 1, 1)) for i in range(40)]
    d = data(dim_pois=(rows, "poi_key string, source string, source_id string, name string, poi_type string, confidence string, longitude double, latitude double, loaded_at timestamp"))
    got = {r["poi_key"]: r["head"] for r in lines.w35_clusters(spark, d).collect()}
    assert got == {f"k{order[i]:02}": f"k{order[i - i % 2]:02}" for i in range(40)}


def test_linked_blocks_are_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(500 + (i * 37) % 100, 500 + ((i + 1) * 37) % 100) for i in range(99)] + [(999, 999)]
    least = {k: k for p in pairs for k in p}
    for _ in least:
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    got = operators.linked_blocks(spark.createDataFrame(pairs, "a int, b int"), "a", "b").collect()
    assert len(got) == len(least) and {r["key"]: r["block"] for r in got} == least


def test_owner_among_more_than_ten_thousand_cells(spark):
    cells = spark.range(0, 10_400, 1, 1).selectExpr("id as cell", "double(id) as west", "id + 1.0D as east", "0.0D as south", "1.0D as north")
    points = spark.range(0, 10_400, 100).selectExpr("id as tile", "id + 0.5D as x", "0.5D as y")
    assert tiles.owners(points, cells, ["tile"], "x", "y").where("tile <> cell").count() == 0


def test_successors_of_long_chains_and_odd_cycles(spark):
    rows = [(i, i < 300, i + 1) for i in range(301)] + [(1000, True, 1001), (1001, True, 1002), (1002, True, 1000)]
    got = identity.successors(spark.createDataFrame(rows, "id int, retired boolean, superseded_by int"), "id", "retired", "superseded_by").collect()
    assert {r["id"]: r["live"] for r in got} == {i: 300 if i < 1000 else None for i, _, _ in rows}


@pytest.mark.parametrize("taken, want", [([], "r"), (["r-2", "r-x", "r-02"], "r"), (["r", "r-3"], "r-2"), (["r", *(f"r-{i}" for i in range(2, 500))], "r-500")])
def test_next_suffix_however_many_are_taken(spark, taken, want):
    df = spark.createDataFrame([(t,) for t in taken], "release string")
    assert tables.next_with_suffix(df, "release", "r").collect() == [(want,)]


@pytest.mark.parametrize("sides", [(60, 5), (5, 60), (60, 60)])
def test_crowded_cells_are_split_on_either_side(spark, sides):
    rng = random.Random(9)
    a, b = ([(f"{n}{i}", 40.0 + rng.random() / 500, -75.0 + rng.random() / 500) for i in range(k)] for n, k in zip("ab", sides))
    schema = "k string, lat double, lon double"
    got = sorted(tuple(r)[:2] for r in nearby.pairs_within(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), "k", "k", "lat", "lon", 90.0, hot=8).collect())
    assert got == sorted((x[0], y[0]) for x in a for y in b if _feet(x[1:], y[1:]) <= 90.0 / 6371008.8 * 20902231.0)


def test_pairs_across_the_date_line_and_near_poles(spark):
    rng = random.Random(4)
    rows = [(f"k{i}", rng.choice([0.0, 52.0, 89.4, 89.995, -89.99]) + rng.random() / 200, rng.choice([179.99, -180.0, 180.0, -179.995, 0.0, 90.0]) + rng.random() / 400) for i in range(150)]
    rows = [(k, min(la, 90.0), lo if lo <= 180 else lo - 360) for k, la, lo in rows]
    df = spark.createDataFrame(rows, "k string, lat double, lon double")
    got = [tuple(r)[:2] for r in nearby.pairs_within(df, df, "k", "k", "lat", "lon", 900.0).collect()]
    assert sorted(got) == sorted((x[0], y[0]) for x in rows for y in rows if _feet(x[1:], y[1:]) <= 900.0 / 6371008.8 * 20902231.0)
