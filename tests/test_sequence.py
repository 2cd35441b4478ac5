"""Climbs, intervals, planning, identity, text and state at their edges."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from cairnlake.functions import effort, text, times
from cairnlake.operators import identity, notes, planning, tables
from cairnlake.operators import sequence as S
from cairnlake.sources import geojson

#: Levels, dead band, climb.
GAINS = [
    ([0, 100, 50, 150, 100, 200], 3, 300.0),
    ([], 3, 0.0),
    ([5], 3, 0.0),
    ([0, 1, 0, 1, 0], 3, 0.0),
    ([0, 10], 3, 10.0),
    ([10, 0], 3, 0.0),
    ([10, 8, 12, 9, 20], 3, 15.0),
    ([0, 2, 1, 4, 3, 6], 3, 6.0),
    ([0, 0, 0], 0, 0.0),
    ([3, 5, 4, 9], 0, 7.0),
]


@pytest.mark.parametrize("levels, band, gain", GAINS)
def test_ascent(spark, levels, band, gain):
    df = spark.createDataFrame([([float(v) for v in levels],)], "levels array<double>")
    assert df.select(S.ascent(F.col("levels"), float(band))).first()[0] == gain


def test_profile_breaks_at_nulls_and_part_starts(spark):
    rows = [(1, i, v, p) for i, (v, p) in enumerate([(0.0, True), (10.0, False), (None, False), (0.0, False), (5.0, False), (50.0, True), (60.0, False)])]
    df = spark.createDataFrame(rows, "k int, i int, v double, p boolean")
    assert S.ascent_over_profile(df, ["k"], ["i"], "v", 3.0, "p").first()["ascent"] == 25.0
    assert S.ascent_over_profile(df, ["k"], ["i"], "v", 3.0, "p", sign=-1).first()["ascent"] == 0.0


def test_climbs_start_at_the_end_of_level_ground(spark):
    pts = [(0, 5.0), (1, 5.0), (2, 9.0), (3, 1.0), (4, 1.0), (5, 8.0)]
    df = spark.createDataFrame([([{"at": a, "v": v} for a, v in pts],)], "l array<struct<at: int, v: double>>")
    assert [tuple(c) for c in df.select(S.climbs(F.col("l"), 3.0)).first()[0]] == [(1, 2), (4, 5)]


def test_intervals(spark):
    df = spark.createDataFrame([(1, 0.0, 2.0), (1, 4.0, 2.0), (1, 6.0, 7.0), (1, 5.0, 5.0), (1, None, 3.0), (1, 6.2, 6.3)], "k int, start double, end double")
    merged = S.merged_intervals(df, ["k"], "start", "end")
    assert [tuple(r) for r in merged.orderBy("start").collect()] == [(1, 0.0, 4.0), (1, 6.0, 7.0)]
    gaps = S.complement(merged, ["k"], 1.0, 10.0)
    assert [tuple(r) for r in gaps.orderBy("start").collect()] == [(1, 4.0, 6.0), (1, 7.0, 10.0)]
    assert S.complement(merged, ["k"], 6.1, 6.9).count() == 0
    assert S.clip(merged, 3.0, 6.5).count() == 2


def test_equal_runs_keep_null_as_a_key(spark):
    df = spark.createDataFrame([(1, 0.0, "a"), (1, 0.5, None), (1, 1.0, None), (1, 3.0, None)], "k int, at double, who string")
    got = S.equal_runs(df, ["k"], "at", "who", 0.75, 0.25).orderBy("start").collect()
    assert [(r.who, r.start, r.end) for r in got] == [("a", -0.25, 0.25), (None, 0.25, 1.25), (None, 2.75, 3.25)]


def brute_cost(miles, camp, chosen, target):
    nudge = (planning.CAMPSITE_MARGIN * target) ** 2
    price = lambda size: (planning.OVER_WEIGHT if size > target else 1.0) * (size - target) ** 2
    return sum(price(miles[b] - miles[a]) + (nudge if camp[b] else 0) for a, b in zip(chosen, chosen[1:]))


def planned(spark, hikes, **kw):
    df = spark.createDataFrame([(h, m, c) for h, (miles, camp) in enumerate(hikes) for m, c in zip(miles, camp)], "hike int, mile double, camp boolean")
    out = {}
    for r in planning.planned_days(df, "hike", "mile", "camp", 14.0, **kw).orderBy("hike", "day").collect():
        out.setdefault(r.hike, [hikes[r.hike][0].index(r.from_mile)]).append(hikes[r.hike][0].index(r.to_mile))
    return out


def test_plans_against_brute_force(spark):
    rng = random.Random(4)
    hikes = []
    for _ in range(20):
        miles = sorted({float(rng.randint(0, 60)) for _ in range(9)})
        hikes.append((miles, [rng.random() < 0.5 for _ in miles]))
    free, exact = planned(spark, hikes), planned(spark, hikes, days=4)
    for h, (miles, camp) in enumerate(hikes):
        n = len(miles)
        every = [[0, *c, n - 1] for k in range(n - 1) for c in itertools.combinations(range(1, n - 1), k)]
        legal = [c for c in every if all(miles[b] - miles[a] <= planning.CAP_MI or (b == a + 1 and miles[b] - miles[b - 1] > planning.CAP_MI) for a, b in zip(c, c[1:]))]
        assert brute_cost(miles, camp, free[h], 14.0) == pytest.approx(min(brute_cost(miles, camp, c, 14.0) for c in legal))
        four, target = [c for c in legal if len(c) == 5], (miles[-1] - miles[0]) / 4
        assert (h in exact) == bool(four)
        if four:
            assert brute_cost(miles, camp, exact[h], target) == pytest.approx(min(brute_cost(miles, camp, c, target) for c in four))


def test_plans_refuse(spark):
    assert planned(spark, [([1.0], [False])]) == {} and planned(spark, [([0.0, 1.0], [False, False])], days=2) == {}
    assert planned(spark, [([0.0, 90.0, 91.0], [False, True, False])]) == {0: [0, 1, 2]}


@pytest.mark.parametrize(
    "ledger, query, answer",
    [
        ([("a", False, None)], "a", "a"),
        ([("a", True, "b"), ("b", False, None)], "a", "b"),
        ([("a", True, "b"), ("b", True, "c"), ("c", False, None)], "a", "c"),
        ([("a", True, None)], "a", None),
        ([("a", True, "zz")], "a", None),
        ([("a", True, "b"), ("b", True, "a")], "a", None),
        ([("a", True, "a")], "a", None),
        ([("a", True, "b"), ("b", True, None)], "a", None),
        ([(f"n{i:02}", i < 60, f"n{i + 1:02}") for i in range(61)], "n00", "n60"),
    ],
)
def test_successors(spark, ledger, query, answer):
    df = spark.createDataFrame(ledger, "id string, retired boolean, superseded_by string")
    assert identity.successors(df, "id", "retired", "superseded_by").where(F.col("id") == query).first()["live"] == answer


def test_evidence_needs_margin_on_both_sides(spark):
    pairs = spark.createDataFrame([("a", "x", 4.0), ("a", "y", 2.0), ("b", "y", 3.0), ("c", "z", 3.0), ("d", "z", 2.5), ("e", "q", 2.0)], "old string, new string, score double")
    assert sorted(tuple(r)[:2] for r in identity.mutual_best(pairs).collect()) == [("a", "x"), ("b", "y")]


def test_disputes(spark):
    day = lambda n: f"2026-{1 + n // 28:02}-{1 + n % 28:02} 00:00:00"
    said = lambda p, who, n, bad, keeper=False: (p, who, day(n), bad, keeper)
    rows = [
        said("once", "u", 200, True), said("once", "u", 201, True),
        said("twice", "u", 200, True), said("twice", "v", 201, True),
        said("cleared", "u", 200, True), said("cleared", "v", 200, True), said("cleared", "w", 201, False), said("cleared", "x", 202, False),
        said("before", "u", 200, True), said("before", "v", 200, True), said("before", "w", 100, False), said("before", "x", 101, False),
        said("old", "u", 1, True), said("old", "v", 1, True),
        said("keeper", "k", 200, True, True), said("fine", "u", 200, False), said(None, "u", 200, True),
    ]
    df = spark.createDataFrame(rows, "p string, who string, at string, bad boolean, keeper boolean").withColumn("at", F.col("at").cast("timestamp_ntz"))
    out = notes.disputes(df, "p", "who", "at", F.col("bad"), F.col("keeper"), F.lit(day(210)).cast("timestamp_ntz"))
    assert {r.p: r.reported_missing for r in out.collect()} == {"once": False, "twice": True, "cleared": False, "before": True, "old": False, "keeper": True}


def test_names_and_numbers(spark):
    one = spark.range(1)
    get = lambda *c: list(one.select(*c).first())
    assert get(text.base_name(F.lit("Bald Mtn. Brook Lean-to Privy 2")), text.base_name(F.lit("Shelter")), text.normal_name(F.lit(None).cast("string"))) == ["bald mtn brook lean to", "", ""]
    assert get(text.names_agree(F.lit("A-B"), F.lit("x a b c")), text.names_agree(F.lit(""), F.lit("a"))) == [True, False]
    caps = [tuple(get(text.capacity(F.lit(v)))[0]) for v in ("8", "0", "8+8", "6o/8n", "10s/4c", "about 6")]
    assert caps == [(8, None), (None, "zero"), (8, None), (None, "two structures"), (10, None), (None, "no number")]
    assert get(*[text.mile_query(F.lit(v)) for v in ("mile 12.5", "MI 7", " 500 ", "x 5", "")]) == [12.5, 7.0, 500.0, None, None]
    assert get(*[text.licence_allowed(F.lit(v)) for v in ("CC0", "pd-usgov", "cc-by-sa-4.0", "cc-by-3.0", "", None)]) == [True, True, True, False, False, False]
    assert get(*[text.compass(F.lit(b)) for b in (0, 44, 337.5, 359)]) == ["north", "northeast", "north", "north"]
    assert get(text.joined(F.array(F.lit("a"), F.lit("b"), F.lit("c"))), text.joined(F.array(F.lit("a")))) == ["a, b and c", "a"]
    assert get(effort.tick_step(F.lit(12.0)), effort.tick_step(F.lit(0.0)), effort.tick_step(F.lit(100.0))) == [2.0, 1.0, 20.0]
    assert get(effort.grade_gate(F.lit(1.0), F.lit(0.0))[1], effort.grade_gate(F.lit(100.0), F.lit(100.0))[1]) == [True, False]
    assert get(times.staleness(F.lit(None).cast("timestamp_ntz"), F.current_timestamp())) == ["never"]
    assert get(text.surrogate_key(F.lit(None), F.lit("a")))[0] != get(text.surrogate_key(F.lit(""), F.lit("a")))[0]


def test_uploads(spark):
    stored = spark.createDataFrame([(1, "a", False, 5), (2, "b", True, 5), (3, "c", False, 5), (4, "d", False, 5), (5, "e", False, 5)], "id int, document string, deleted boolean, updated_at int")
    up = spark.createDataFrame([(9, "n", False, None), (1, "a2", False, 5), (2, None, True, 1), (3, "c", False, 1), (4, "d2", False, 1), (5, None, True, 1)], "id int, document string, deleted boolean, base_updated_at int")
    got = sorted((r.document or "", r.deleted, r.is_copy) for r in tables.resolve_uploads(up, stored).collect())
    assert got == [("", True, False), ("a2", False, False), ("d2", False, True), ("e", False, True), ("n", False, False)]


def test_geojson_round_trip(spark, tmp_path):
    (tmp_path / "a.geojson").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","id":"1","properties":{"n":"x"},"geometry":{"type":"Point","coordinates":[-74.5,41.0]}},{"type":"Feature","id":"2","properties":{},"geometry":null}]}')
    found, skipped = geojson.read_registered(spark, str(tmp_path), [("a", "a.geojson"), ("b", "b.geojson")], "2026-01-01 00:00:00")
    assert skipped == ["b"]
    assert [(r.id, r.lon, r.lat) for r in found["a"].orderBy("id").collect()] == [("1", -74.5, 41.0), ("2", None, None)]
    geojson.write_points(found["a"].where("lon is not null"), str(tmp_path / "out"), ["id"])
    assert spark.read.text(str(tmp_path / "out")).count() == 1
    geojson.write_points(found["a"].limit(0), str(tmp_path / "none"), ["id"])
    assert spark.read.text(str(tmp_path / "none")).count() == 0


def test_text_sources(spark, tmp_path):
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((1.5, 2.0), (3.0, 4.25), (0.0, 9.0))])
    back = spark.range(1).select(geojson.poly_rings(geojson.poly_text(ring, F.lit("r"))).alias("p")).first()["p"][0]
    assert [(p.x, p.y) for p in back] == [(1.5, 2.0), (3.0, 4.25), (0.0, 9.0)]
    several = "area\n1\n   1.0E+00   2.0\n   3.0   4.0\nEND\n!2\n   5.0   6.0\nEND\nEND\n"
    rings = spark.range(1).select(geojson.poly_rings(F.lit(several)).alias("p")).first()["p"]
    assert [[(p.x, p.y) for p in r] for r in rings] == [[(1.0, 2.0), (3.0, 4.0)], [(5.0, 6.0)]]
    (tmp_path / "s.tsv").write_text("z\tx\tlayer\n1\t2\twater\n1\t3\t \n")
    assert geojson.read_stats(spark, str(tmp_path / "s.tsv"), ["z", "layer"]).count() == 1
    with pytest.raises(ValueError):
        geojson.read_stats(spark, str(tmp_path / "s.tsv"), ["z", "layer", "bytes"])
    page = "<table><tr><th>h</th></tr><tr><td>a <b>1</b></td><td>2</td></tr></table>"
    assert spark.range(1).select(geojson.html_rows(F.lit(page))).first()[0] == [["a 1", "2"]]
    with pytest.raises(ValueError):
        geojson.guarded_write(spark.range(50), str(tmp_path / "w"), 200)
    assert not list(tmp_path.glob("w*"))
    assert geojson.guarded_write(spark.range(50), str(tmp_path / "w"), 90) == 50
    with pytest.raises(ValueError):
        geojson.guarded_write(spark.range(10), str(tmp_path / "w"), 50)
    assert geojson.guarded_write(spark.read.parquet(str(tmp_path / "w")).where("id < 45"), str(tmp_path / "w"), 50) == 45  # reads what it replaces
    assert spark.read.parquet(str(tmp_path / "w")).count() == 45 and [p.name for p in tmp_path.glob("w*")] == ["w"]


def test_stream_equals_batch(spark):
    from cairnlake.plans import lines, trail

    from .conftest import SMALL

    a = {(r.user_id, round(r.anchor, 6), r.way, r.turns) for r in lines.st02_stream(spark, SMALL).collect()}
    b = {(r.user_id, round(r.anchor, 6), r.way, r.turns) for r in trail.st02_direction(spark, SMALL).collect()}
    assert a == b
