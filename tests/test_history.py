"""Change logs, snapshot merges and profiles at their edges, and against brute force."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cairnlake.operators import history, profile, snapshots

SCHEMA = "k string, load int, a string, b string, at long, first string, _row int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def versions(spark, rows, names=("a", "b")):
    out = history.attribute_history(frame(spark, rows), "k", "load", {n: F.col(n) for n in names}, ["at"])
    return sorted(map(tuple, out.select("k", "first", "last", *names).collect()), key=str)


def test_versions_split_at_union_of_boundaries(spark):
    rows = [("p", 1, "x", "m", 1), ("p", 2, "x", "n", 1), ("p", 3, "y", "n", 1), ("p", 5, "y", "n", 1)]
    assert versions(spark, rows) == [("p", 1, 1, "x", "m"), ("p", 2, 2, "x", "n"), ("p", 3, 3, "y", "n"), ("p", 5, 5, "y", "n")]


def test_null_is_a_value_and_latest_delivery_counts(spark):
    rows = [("p", 1, None, "m", 1), ("p", 1, "z", "m", 0), ("p", 2, None, "m", 1), ("p", 2, None, "m", 1), ("p", 3, "q", "m", 1), (None, 1, "a", "b", 1)]
    assert versions(spark, rows, ("a",)) == [("p", 1, 2, None), ("p", 3, 3, "q")]


def test_empty_history(spark):
    assert versions(spark, []) == []


def test_each_attribute_has_its_own_intervals(spark):
    rows = frame(spark, [("p", 1, "x", "m", 1), ("p", 2, "x", "n", 1), ("p", 3, "y", "n", 1)])
    log = history.change_log(rows, "k", "load", ["a", "b"]).select("attribute", "value", "first", "last")
    assert sorted(map(tuple, log.collect())) == [("a", "x", 1, 2), ("a", "y", 3, 3), ("b", "m", 1, 1), ("b", "n", 2, 3)]


def test_versions_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(f"k{rng.randrange(12)}", rng.randint(1, 8), rng.choice(["x", "y", None]), rng.choice("mn"), rng.randrange(1000)) for _ in range(200)]
    best = {}
    for k, load, a, b, at in rows:
        key = (at, a is not None, a or "", b)
        if (k, load) not in best or key > best[k, load][0]:
            best[k, load] = (key, (a, b))
    want = []
    for k in {k for k, _ in best}:
        run = None
        for load in range(1, 10):
            now = best.get((k, load), (None, None))[1]
            if run and now != run[2]:
                want.append((k, run[0], run[1], *run[2]))
                run = None
            if now is not None:
                run = (run[0] if run else load, load, now)
    assert versions(spark, rows) == sorted(want, key=str)


SNAP = "source string, sid string, load int, lat double, lon double, at long, change_kind string"


def changes(spark, rows):
    df = spark.createDataFrame([(*r, "?") for r in rows], SNAP)
    out = snapshots.snapshot_changes(df, {"source": F.col("source"), "sid": F.col("sid")}, "load", {"lat": 1e-6, "lon": 1e-6}, ["at"])
    return sorted(map(tuple, out.select("load", "source", "sid", "change_kind").collect()))


def test_snapshot_changes(spark):
    rows = [
        ("s", "a", 1, 1.0, 1.0, 1),
        ("s", "a", 2, 1.0 + 5e-7, 1.0, 1),  # within the tolerance
        ("s", "a", 3, None, 1.0, 1),
        ("s", "b", 1, 2.0, 2.0, 1),
        ("s", "b", 3, 2.0, 2.0, 1),
        ("s", "c", 2, 3.0, 3.0, 1),
        ("s", "c", 2, 3.0, 3.0, 1),
        ("s", "c", 3, 3.1, 3.0, 1),
        ("s", "c", 3, 3.0, 3.0, 2),  # the later delivery counts
        (None, "d", 2, 0.0, 0.0, 1),
    ]
    assert changes(spark, rows) == [(2, "s", "b", "removed"), (2, "s", "c", "added"), (3, "s", "a", "changed"), (3, "s", "b", "added")]


def test_snapshot_changes_of_nothing(spark):
    assert changes(spark, []) == []
    assert changes(spark, [("s", "a", 4, 1.0, 1.0, 1)]) == []


def test_kept_snapshots_are_merged_where_they_lie(spark):
    from cairnlake.session import settings

    df = spark.createDataFrame([("s", f"k{i % 50:02}", i // 50 + 1, 1.0, 1.0, 1) for i in range(150)], "source string, sid string, load int, lat double, lon double, at long")
    kept = snapshots.keep_snapshots(df, {"source": F.col("source"), "sid": F.col("sid")}, "load", ["lat"], ["at"], ranges=4)
    files = {r["f"]: (r["lo"], r["hi"]) for r in spark.table(kept).groupBy(F.input_file_name().alias("f")).agg(F.min("sid").alias("lo"), F.max("sid").alias("hi")).collect()}
    spans = sorted(files.values())
    assert len(spans) > 1 and all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    with settings(spark, **snapshots.IN_RANGES):
        plan = snapshots.merged_loads(spark, kept, ["source", "sid"], "load", [1e-6])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert snapshots.changes_of_kept(spark, kept, ["source", "sid"], "load", [1e-6]).count() == 0


def test_snapshot_changes_against_brute_force(spark):
    rng = random.Random(5)
    rows = [("s", f"k{rng.randrange(40)}", rng.randrange(1, 6), rng.choice([None, 1.0, 2.0]), rng.choice([None, 1.0]), i) for i in range(300)]
    last: dict = {}
    for s, k, load, la, lo, at in rows:
        if at >= last.get((load, k), (-1,))[0]:
            last[load, k] = (at, la, lo)
    want = []
    for load in range(2, 6):
        for k in {k for _, k in last}:
            a, b = last.get((load - 1, k)), last.get((load, k))
            kind = "added" if b and not a else "removed" if a and not b else "changed" if a and b and a[1:] != b[1:] else None
            want += [(load, "s", k, kind)] if kind else []
    assert changes(spark, rows) == sorted(want)


WORDS, RANGES = {"t": ("ab", "cde")}, {"v": (-90.0, 90.0)}


def findings(spark, rows):
    df = spark.createDataFrame(rows, "load int, key string, t string, v double, mask string, n int")
    return sorted(map(tuple, profile.quality_findings(df, "load", "key", WORDS, RANGES).select("load", "field_name", "finding", "key").collect()))


def test_findings(spark):
    rows = [(1, f"k{i}", "ab", 1.0, "m", 1) for i in range(10)] + [(2, f"k{i}", "ab" if i < 6 else None if i < 8 else "zz", 91.0 if i == 0 else None if i == 1 else float("nan") if i == 2 else 1.0, "m", 1) for i in range(10)]
    rows += [(2, "k9", "zz", 1.0, "m", 1)]
    got = findings(spark, rows)
    assert (2, "v", "bad_value", "k0") in got and (2, "v", "bad_value", "k2") in got
    assert (2, "t", "bad_value", "k8") in got and got.count((2, "t", "bad_value", "k9")) == 1
    assert (2, "t", "null_shift", "") in got and (2, "t", "share_shift", "") in got
    assert (2, "v", "null_shift", "") not in got


def test_bad_values_come_through_patterns(spark):
    """A bad word of a dominant mask, a bad number of a dominant mask and one of a rare mask; no suspect patterns, no findings."""
    rows = [(1, f"k{i}", "ab" if i else "zz", 10.0 + i % 80, "m", 1) for i in range(200)] + [(1, "x", "cde", 95.0, "m", 1), (1, "y", "cde", 1000.0, "m", 1), (1, "z", "CDE", -7.0, "m", 1)]
    assert findings(spark, rows) == [(1, "t", "bad_value", "k0"), (1, "t", "bad_value", "z"), (1, "v", "bad_value", "x"), (1, "v", "bad_value", "y")]
    df = spark.createDataFrame(rows, "load int, key string, t string, v double, mask string, n int")
    cell = profile.cells(df.select("load", "key", "t", "v"), ["load", "key"], WORDS, RANGES)
    patterns = profile.mined_patterns(profile.mask_dictionary(cell, "load"), 0.05)
    assert {(r["mask"], r["word"], r["state"]) for r in patterns.where("suspect and field = 't'").collect()} == {("aa", None, "broken"), ("aaa", "cde", "clean"), ("AAA", None, "broken")}
    assert profile.violations(cell, patterns.where("mask = 'none'"), ["key"]).count() == 0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_no_share_moves_further_than_the_patterns(spark, seed):
    rng = random.Random(seed)
    rows = [(load, "k", rng.choice(["ab", "cde", "zz", None][: rng.randrange(1, 5)]), None, "m", 1) for load in (1, 2, 4) for _ in range(30)]
    df = spark.createDataFrame(rows, "load int, key string, t string, v double, mask string, n int")
    counted = profile.mask_dictionary(profile.cells(df, ["load"], WORDS, RANGES), "load")
    apart = {(r["load"], r["field"]): (r["of_all"], r["of_values"]) for r in profile.pattern_divergence(counted, "load").collect()}
    assert set(apart) == {(2, "t"), (2, "v")} and apart[2, "v"] == (0.0, None)
    share = lambda load, v: sum(r[2] == v for r in rows if r[0] == load) / 30
    assert apart[2, "t"][0] == pytest.approx(sum(abs(share(1, v) - share(2, v)) for v in ("ab", "cde", "zz", None)) / 2)


def test_no_findings_in_empty_table(spark):
    assert findings(spark, []) == []


@pytest.mark.parametrize("value, mask", [("Ab 9é", "Aa_9a"), ("", ""), ("a-1", "a-9"), ("語A", "uA")])
def test_masks(spark, value, mask):
    assert spark.range(1).select(profile.mask(F.lit(value))).first()[0] == mask


def test_number_masks(spark):
    df = spark.createDataFrame(pd.DataFrame({"v": [12.5, -7.0, 1e30, float("inf"), 0.0]})).select(profile.number_mask(F.col("v")))
    assert [r[0] for r in df.collect()] == ["99", "-9", "inf", "inf", "9"]
