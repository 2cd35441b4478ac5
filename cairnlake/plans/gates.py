"""Queries of checks and verdicts: freshness, releases, ledgers, coverage, and the small predicates and texts they use."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text, times
from ..functions.plain import POI_TYPES, plain, plain_source, plain_source_id, usable_position
from ..operators import identity, nearby, tables
from ..operators import notes as N
from ..operators import sequence as S
from ..session import exists, only_file, own_folder, table
from ..sources import geojson
from . import trail, warehouse
from .conditions import closures, notes
from .places import current_places


def _state(recorded: Column, upstream: Column) -> Column:
    """Markers compared as text: what can't be asked is unknown, never fresh."""
    return F.when(upstream.isNull(), "unknown").when(recorded.eqNullSafe(upstream), "fresh").otherwise("stale")


def _markers(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s = table(spark, d, "poi_snapshots").select("load_no", plain_source(F.col("source")).alias("source"), "snapshot_date")
    mark = lambda k: s.where(f"load_no = {k}").groupBy("source").agg(F.max(F.when(F.length("source") % 3 != 0, F.col("snapshot_date").cast("string"))).alias("mark"))
    return mark(7), mark(8).where("source <> 'opentrail_at'")


def st10_markers(spark: SparkSession, d: str) -> DataFrame:
    a, b = _markers(spark, d)
    return a.join(b.withColumnRenamed("mark", "upstream"), "source").select("source", _state(F.col("mark"), F.col("upstream")).alias("state"))


def q05_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Sources recorded against sources upstream: fresh, stale, unknown, new or gone."""
    a, b = _markers(spark, d)
    j = a.withColumn("here", F.lit(1)).join(b.select("source", F.col("mark").alias("upstream"), F.lit(1).alias("there")), "source", "full_outer")
    return j.select("source", F.when(F.col("here").isNull(), "new").when(F.col("there").isNull(), "gone").otherwise(_state(F.col("mark"), F.col("upstream"))).alias("state"))


def a35_summary(spark: SparkSession, d: str) -> DataFrame:
    """One row over all verdicts: stale and unknown kept apart, and the code a run ends with."""
    v = q05_verdicts(spark, d)
    n = lambda s: F.count(F.when(F.col("state") == s, 1))
    return v.agg(n("stale").alias("stale"), n("unknown").alias("unknown"), F.when(n("stale") > 0, 1).when(n("unknown") > 0, 2).otherwise(0).alias("code"))


def a34_worst(spark: SparkSession, d: str) -> DataFrame:
    """The worst state of each type's sources: unavailable, else the oldest baseline, else live."""
    p = current_places(spark, d).where("known_type is not null")
    state = F.when(F.col("confidence").isNull(), 2).when(F.col("confidence") == "low", 1).otherwise(0)
    worst = F.max(F.struct(state.alias("s"), (-F.unix_micros(F.col("loaded_at").cast("timestamp"))).alias("age")))
    return p.groupBy("known_type").agg(worst.alias("w")).select("known_type", F.get(F.array(F.lit("live"), F.lit("baseline"), F.lit("unavailable")), F.col("w.s")).alias("state"), F.timestamp_micros(-F.col("w.age")).cast("timestamp_ntz").alias("generated_at"))


def st05_precedence(spark: SparkSession, d: str) -> DataFrame:
    """Live rows beat the baseline however late it comes: what is shown of each place is its newest note, else the mart."""
    live = notes(spark, d).where("poi_id is not null and observation is not null").groupBy(F.col("poi_id").alias("poi_key")).agg(F.max_by("observation", F.struct("observed_at", "id")).alias("said"))
    return current_places(spark, d).select("poi_key").join(live, "poi_key", "left").select(F.when(F.col("said").isNotNull(), "live").otherwise("baseline").alias("from"), F.coalesce("said", F.lit("none")).alias("said")).groupBy("from", "said").agg(F.count(F.lit(1)).alias("n"))


def st09_credited(spark: SparkSession, d: str) -> DataFrame:
    """Late notes credited by when they were written: the one span in force at their mile then; none if there are several."""
    spans = closures(spark, d).select(F.col("id").alias("span"), "start_mile_marker", "end_mile_marker", "closed_since", "expected_reopen")
    rows = notes(spark, d).where("mile is not null").select("id", "mile", "observed_at")
    when = F.coalesce(F.col("closed_since") <= F.col("observed_at"), F.lit(True)) & F.coalesce(F.col("expected_reopen") >= F.col("observed_at"), F.lit(True))
    hit = N.stabbing(rows, spans, "mile", "start_mile_marker", "end_mile_marker", 10.0, when)
    return hit.groupBy("id").agg(F.when(F.min("span") == F.max("span"), F.min("span")).alias("span"))


def q08_baseline(spark: SparkSession, d: str) -> DataFrame:
    """A baseline after a partial run: counts of the sources that ran, old entries of the others."""
    s = table(spark, d, "poi_snapshots").select("load_no", plain_source(F.col("source")).alias("source"))
    n = lambda k, more="true": s.where(f"load_no = {k} and {more}").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return tables.overlay(n(8, "source like 'atc%'"), n(7), "source", ["n"])


def q09_reproduced(spark: SparkSession, d: str) -> DataFrame:
    """Two independent ways to the mean position of each type: whether they agree to a millionth."""
    p = current_places(spark, d).where(usable_position(F.col("latitude"), F.col("longitude")) & F.col("known_type").isNotNull())
    once = p.groupBy("known_type").agg(F.avg("latitude").alias("a"))
    parts = p.groupBy("known_type", F.substring("poi_key", 1, 1).alias("h")).agg(F.sum("latitude").alias("s"), F.count(F.lit(1)).alias("n"))
    twice = parts.groupBy("known_type").agg((F.sum("s") / F.sum("n")).alias("b"))
    return once.join(twice, "known_type").select("known_type", (F.abs(F.col("a") - F.col("b")) <= 1e-6).alias("agrees"))


def q10_minimums(spark: SparkSession, d: str) -> DataFrame:
    """Types with fewer records than they must have; fifty where nothing is said."""
    least = F.when(F.col("poi_type") == "water", 400).when(F.col("poi_type") == "privy", 1).otherwise(50)
    counts = N.zero_filled(current_places(spark, d).where("known_type is not null").groupBy(F.col("known_type").alias("poi_type")).agg(F.count(F.lit(1)).alias("n")), "poi_type", "n", list(POI_TYPES))
    return counts.select("poi_type", "n", least.cast("long").alias("least")).where("n < least")


def q18_problems(spark: SparkSession, d: str) -> DataFrame:
    """All problems of a run at once, in one text of a row each; a run with any fails closed."""
    low = q10_minimums(spark, d).select(F.concat_ws(" ", F.lit("too few of"), "poi_type").alias("problem"))
    bad = warehouse.q01_data_tests(spark, d).where("n > 0").select(F.concat_ws(" ", F.lit("rule broken:"), "problem").alias("problem"))
    return low.unionByName(bad)


def q11_reach(spark: SparkSession, d: str) -> DataFrame:
    """Published water with its distance to the nearest camp, those with none first, then the furthest: the worst twenty."""
    p = current_places(spark, d).where(usable_position(F.col("latitude"), F.col("longitude")))
    water = p.where("known_type = 'water'")
    best = nearby.nearest_within(water, p.where("known_type in ('shelter', 'campsite')"), "poi_key", "poi_key", "latitude", "longitude", 400.0).select(F.col("id_l").alias("poi_key"), F.round("metres", 1).alias("metres"))
    return water.select("poi_key").join(best, "poi_key", "left").orderBy(F.desc_nulls_first("metres"), "poi_key").limit(20)


def q12_sections(spark: SparkSession, d: str) -> DataFrame:
    """Climb of each walk against a published figure: off by more than a tenth or not, and whether an implausible step lies inside."""
    up = S.ascent_over_profile(trail.events(spark, d), ["user_id"], trail.ORDER, trail.LEVEL, 0.0)
    suspect = trail.w28_implausible(spark, d).where(~F.coalesce(F.col("seam"), F.lit(False))).select("user_id", F.lit(True).alias("contaminated")).distinct()
    published = (F.col("user_id") % 7 + 3) * 1000.0
    return up.join(suspect, "user_id", "left").select("user_id", (F.abs(F.col("ascent") - published) <= published * 0.1).alias("agrees"), F.coalesce("contaminated", F.lit(False)).alias("contaminated"))


def q13_receipts(spark: SparkSession, d: str) -> DataFrame:
    """Recorded digests against what is there now: missing and changed outputs."""
    s = table(spark, d, "poi_snapshots").select("load_no", "poi_key", F.sha2(F.concat_ws("|", F.coalesce("name", F.lit("")), F.coalesce("confidence", F.lit(""))), 256).alias("h")).groupBy("load_no", "poi_key").agg(F.max("h").alias("h"))
    j = s.where("load_no = 5").select("poi_key", F.col("h").alias("was")).join(s.where("load_no = 6").select("poi_key", "h"), "poi_key", "left")
    return j.select(F.when(F.col("h").isNull(), "missing").when(F.col("h") != F.col("was"), "changed").alias("problem")).where("problem is not null").groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


def j31_differing(spark: SparkSession, d: str) -> DataFrame:
    """Keys on both sides whose digest differs."""
    s = table(spark, d, "poi_snapshots").select("load_no", "poi_key", F.md5(F.concat_ws("|", F.coalesce("name", F.lit("")), F.coalesce(plain(F.col("poi_type")), F.lit("")))).alias("h")).groupBy("load_no", "poi_key").agg(F.max("h").alias("h"))
    return s.where("load_no = 1").select("poi_key", F.col("h").alias("was")).join(s.where("load_no = 8").select("poi_key", "h"), "poi_key").where("h <> was").select("poi_key")


def q14_published(spark: SparkSession, d: str) -> DataFrame:
    """Published records against the ledger: not in it, of another type there, or published twice."""
    ledger = table(spark, d, "poi_snapshots").where("load_no = 8").groupBy("poi_key").agg(F.max(plain(F.col("poi_type"))).alias("was"), F.lit(True).alias("known"))
    pub = table(spark, d, "dim_pois").select("poi_key", plain(F.col("poi_type")).alias("t")).groupBy("poi_key").agg(F.max("t").alias("t"), F.count(F.lit(1)).alias("n"))
    j = pub.join(ledger, "poi_key", "left")
    each = F.array_compact(F.array(F.when(F.col("known").isNull(), F.lit("no ledger row")), F.when(F.col("known") & (F.col("t") != F.col("was")), F.lit("another type")), F.when(F.col("n") > 1, F.lit("twice"))))
    return j.select(F.explode(each).alias("problem")).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


def q15_retired(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong between tombstones, retired rows and live ids; nothing is right."""
    ledger = warehouse._ledger(spark, d)
    stones = ledger.where("retired and id % 19 <> 0 or id % 23 = 0").select("id", "superseded_by")
    live = ledger.where("not retired").select("id")
    retired = ledger.where("retired").select("id")
    n = lambda df, what: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("problem"), "n")
    frames = [n(stones.join(retired, "id", "left_anti"), "not retired"), n(stones.join(live, "id", "left_semi"), "still live"), n(retired.join(stones, "id", "left_anti"), "no tombstone"), n(stones.where("superseded_by is not null").select(F.col("superseded_by").alias("id")).join(live, "id", "left_anti"), "successor not live")]
    return reduce(DataFrame.unionByName, frames)


def q17_projects(spark: SparkSession, d: str) -> DataFrame:
    """Problems of work projects, row by row: a spelled-out list, empty where all is well."""
    p = table(spark, d, "part")
    rules = {"title": F.length("p_name") > 10, "mile": (F.col("p_partkey") % 2300) <= 2200, "capacity": F.col("p_size") > 2, "dates": F.col("p_partkey") % 9 <= F.col("p_size")}
    return p.select("p_partkey", F.array_join(tables.row_problems(rules), ",").alias("problems"))


def a25_gate(spark: SparkSession, d: str) -> DataFrame:
    """Whether calibration errors pass: median .05, 95th percentile .25, worst 1.0; each limit by itself."""
    e = table(spark, d, "part").select((F.col("p_size") / 1000.0).alias("e"))
    f = e.agg(F.percentile("e", F.lit(0.5)).alias("median"), F.percentile("e", F.lit(0.95)).alias("p95"), F.max("e").alias("worst"))
    return f.select((F.col("median") <= 0.05).alias("median_ok"), (F.col("p95") <= 0.25).alias("p95_ok"), (F.col("worst") <= 1.0).alias("worst_ok"))


def m06_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges from retired ids to what stands for them, with refusals: to itself, to an unknown id, from a live one, or round in a circle."""
    ledger = warehouse._ledger(spark, d)
    found = identity.successors(ledger, "id", "retired", "superseded_by")
    e = ledger.where("superseded_by is not null").join(found, "id").join(ledger.select(F.col("id").alias("superseded_by"), F.lit(True).alias("known")), "superseded_by", "left")
    why = F.when(~F.col("retired"), "from a live id").when(F.col("superseded_by") == F.col("id"), "to itself").when(F.col("known").isNull(), "to an unknown id").when(F.col("live").isNull(), "leads nowhere").otherwise("accepted")
    return e.select(why.alias("verdict")).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


def m09_appended(spark: SparkSession, d: str) -> DataFrame:
    """A release entry appended to the index with the next free id; entries keep their places."""
    loads = table(spark, d, "poi_snapshots").select("load_no", "snapshot_date").distinct()
    own = loads.select(F.col("load_no").cast("long").alias("place"), F.col("snapshot_date").cast("string").alias("release"))
    wanted = tables.next_with_suffix(own, "release", "2026-07-20").crossJoin(own.agg((F.max("place") + 1).alias("place")))  # one row each
    return own.unionByName(wanted.select("place", "release"))


def s02_labelled(spark: SparkSession, d: str) -> DataFrame:
    """Site layers laid over each other with a label."""
    p = _raw_sources(spark, d)
    return reduce(DataFrame.unionByName, [p.where(f"layer = '{k}'").select("poi_key", F.lit(k).alias("label")) for k in ("atc_shelters", "atc_campsites")]).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def _raw_sources(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "dim_pois").withColumn("layer", plain_source(F.col("source")))


def s03_present(spark: SparkSession, d: str) -> DataFrame:
    """Layers that are there laid over each other; with none an empty table, and its count of 0 is a finding."""
    p = _raw_sources(spark, d)
    empty = p.limit(0).select("poi_key", "layer")
    some = reduce(DataFrame.unionByName, [p.where(f"layer = '{k}'").select("poi_key", "layer") for k in ("osm_water", "atc_bridges")], empty)
    none = reduce(DataFrame.unionByName, [], empty)
    return some.agg(F.count(F.lit(1)).alias("n")).withColumn("layers", F.lit("some")).unionByName(none.agg(F.count(F.lit(1)).alias("n")).withColumn("layers", F.lit("none")))


def s04_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys of two loads: in both, only in the first, only in the second."""
    s = table(spark, d, "poi_snapshots")
    k = lambda n: s.where(f"load_no = {n}").select("poi_key").distinct()
    one = lambda df, what: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "n")
    return one(k(3).intersect(k(6)), "both").unionByName(one(k(3).exceptAll(k(6)), "first")).unionByName(one(k(6).exceptAll(k(3)), "second"))


def j32_snapped_markers(spark: SparkSession, d: str) -> DataFrame:
    """Markers within 100 m of a part (here a place), in order along it: how many each has, their first and last mile."""
    m = notes(spark, d).where("mile is not null and lat is not null and lon is not null").select("id", F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), "mile")
    p = current_places(spark, d).where(usable_position(F.col("latitude"), F.col("longitude")) & (F.col("source") == "atc_shelters")).select(F.col("poi_key").alias("id"), "latitude", "longitude", F.lit(None).cast("double").alias("mile"))
    near = nearby.pairs_within(m, p, "id", "id", "latitude", "longitude", 100.0, carry=("mile",))
    best = near.groupBy("id_l").agg(F.min(F.struct("metres", "id_r", "c_l.mile")).alias("c"))
    return best.groupBy(F.col("c.id_r").alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("c.mile").alias("first"), F.max("c.mile").alias("last"))


def j38_attributed(spark: SparkSession, d: str) -> DataFrame:
    """Mileposts (notes of maintainers) with the source of the nearest place within 100 m; null where none is."""
    m = notes(spark, d).where("reporter_type = 'maintainer' and lat is not null and lon is not null").select("id", F.col("lat").alias("latitude"), F.col("lon").alias("longitude"))
    p = current_places(spark, d).where(usable_position(F.col("latitude"), F.col("longitude"))).select(F.col("poi_key").alias("id"), "latitude", "longitude", "source")
    best = nearby.nearest_within(m, p, "id", "id", "latitude", "longitude", 100.0).join(p.select(F.col("id").alias("id_r"), "source"), "id_r").select(F.col("id_l").alias("id"), "source")
    return m.select("id").join(best, "id", "left").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def _line_ends(spark: SparkSession, d: str) -> DataFrame:
    """Closures as spurs: the distance of either end to the nearest camp within two kilometres."""
    c = closures(spark, d).where("start_lat is not null and start_lon is not null and end_lat is not null and end_lon is not null")
    camps = current_places(spark, d).where(usable_position(F.col("latitude"), F.col("longitude")) & F.col("known_type").isin("shelter", "campsite")).select(F.col("poi_key").alias("id"), "latitude", "longitude")
    end = lambda e: nearby.nearest_within(c.select("id", F.col(f"{e}_lat").alias("latitude"), F.col(f"{e}_lon").alias("longitude")), camps, "id", "id", "latitude", "longitude", 2000.0).select(F.col("id_l").alias("id"), F.col("id_r").alias(f"{e}_at"), F.round("metres", 2).alias(f"{e}_m"))
    return c.select("id").join(end("start"), "id", "left").join(end("end"), "id", "left")


def j35_junction(spark: SparkSession, d: str) -> DataFrame:
    """Which end of a spur is on the network: the nearer one; none if neither is near, or both are as near as 25 m."""
    a, b = F.col("start_m"), F.col("end_m")
    which = F.when(a.isNull() & b.isNull(), None).when((a <= 25) & (b <= 25), None).when(b.isNull() | (a <= b), "start").otherwise("end")
    return _line_ends(spark, d).select("id", which.alias("junction"))


def j34_destination(spark: SparkSession, d: str) -> DataFrame:
    """Where a spur leads: the camp at its other end if it is within 150 m, else why not."""
    a, b = F.col("start_m"), F.col("end_m")
    ends = _line_ends(spark, d).withColumn("at_start", b.isNull() | (a <= b))
    far, place = F.when(F.col("at_start"), b).otherwise(a), F.when(F.col("at_start"), F.col("end_at")).otherwise(F.col("start_at"))
    why = F.when(a.isNull() & b.isNull(), "no junction").when((a <= 25) & (b <= 25), "ambiguous").when(far.isNull() | (far > 150), "nothing there").otherwise("resolved")
    return ends.select("id", why.alias("state"), F.when(why == "resolved", place).alias("destination"))


def j44_recent_ids(spark: SparkSession, d: str) -> DataFrame:
    """Full rows of the five newest notes a place, by one window and no join back."""
    rows = notes(spark, d).where("poi_id is not null")
    return N.top_recent(rows, F.col("poi_id"), "observed_at", "id", 5).select("id", "poi_id", "observation", "mile")


def j45_flagged(spark: SparkSession, d: str) -> DataFrame:
    """Notes that some pair's record refers to, with how often; hidden ones last, then the most referred to."""
    refs = table(spark, d, "poi_pairs").select(F.explode(F.array("poi_key_a", "poi_key_b")).alias("k")).groupBy(plain(F.col("k")).alias("poi_id")).agg(F.count(F.lit(1)).alias("flags"))
    return notes(spark, d).join(refs, "poi_id").select("id", "flags", F.col("hidden_at").isNotNull().alias("hidden")).orderBy("hidden", F.desc("flags"), "id").limit(200)


def j46_routed(spark: SparkSession, d: str) -> DataFrame:
    """Disputed places by source, those found and those not; sources without any appear with 0."""
    bad = notes(spark, d).where("poi_id is not null and observation = 'not_found'").groupBy(F.col("poi_id").alias("poi_key")).agg(F.count(F.lit(1)).alias("n"))
    routed = bad.join(current_places(spark, d).select("poi_key", "source"), "poi_key", "left").groupBy(F.coalesce("source", F.lit("unmatched")).alias("source")).agg(F.count(F.lit(1)).alias("places"))
    names = table(spark, d, "poi_sources").select("source").unionByName(spark.createDataFrame([("unmatched",)], "source string"))
    return names.join(routed, "source", "left").select("source", F.coalesce("places", F.lit(0)).cast("long").alias("places"))


def flt09_spurs(spark: SparkSession, d: str) -> DataFrame:
    """Lines whose decoded type is the spur's code, whether written as code, number, label or alias."""
    raw = F.get(F.array(F.lit("3"), F.lit("Spur"), F.lit("side trail"), F.lit("1"), F.lit("main"), F.lit("?")), (F.col("p_partkey") % 6).cast("int"))
    code = text.decoded(raw, {"1": "Main", "3": "Spur"}, {"side trail": "3"})
    return table(spark, d, "part").select("p_partkey", code.alias("code"), F.coalesce(code == "3", F.lit(False)).alias("spur"))


def flt11_passed(spark: SparkSession, d: str) -> DataFrame:
    """Noted places whose mile lies in any range walked by user 1 to 5, of some types only."""
    walked = S.merged_intervals(trail.spans(spark, d).where("user_id between 1 and 5").withColumn("all", F.lit(1)), ["all"], "start", "end").select("start", "end")
    rows = notes(spark, d).where("mile is not null and observation in ('flowing', 'dry', 'low')").select("id", "mile")
    return N.stabbing(rows, walked, "mile", "start", "end", 10.0, None, "left_semi").select("id", "mile")


def flt12_hidden(spark: SparkSession, d: str) -> DataFrame:
    """Types hidden by a choice of shown ones: water never, and nothing where nothing is chosen."""
    shown = F.when(F.col("p_partkey") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.get(F.array(*map(F.lit, POI_TYPES)), (F.col("p_partkey") % 8).cast("int")), F.lit("shelter")))
    every = F.array(*map(F.lit, POI_TYPES))
    hidden = F.when(F.size(shown) == 0, F.array().cast("array<string>")).otherwise(F.array_except(every, F.array_append(shown, F.lit("water"))))
    return table(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(hidden), ",").alias("hidden"))


def flt14_published(spark: SparkSession, d: str) -> DataFrame:
    """Reviewed rows with the declared fields only, in their order."""
    return closures(spark, d).where("moderation_status = 'verified'").select("id", "reason_type", "status", "start_mile_marker", "end_mile_marker")


def _renamed(spark: SparkSession, d: str, layer: str) -> DataFrame:
    return _raw_sources(spark, d).where(F.col("layer") == layer)


def prj07_bridges(spark: SparkSession, d: str) -> DataFrame:
    """A layer staged without a type, on purpose."""
    return _renamed(spark, d, "opentrail_at").select(plain_source_id(F.col("source_id")).alias("bridge_id"), F.trim("name").alias("bridge_name"), F.lit(None).cast("string").alias("poi_type")).distinct()


def prj08_renamed(spark: SparkSession, d: str) -> DataFrame:
    """Line attributes renamed and cast (segments stand for orders' lines)."""
    return table(spark, d, "lineitem").withColumnsRenamed({"l_returnflag": "status", "l_linestatus": "surface"}).select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("global_id"), "status", "surface", F.col("l_quantity").cast("double").alias("length_ft"))


def prj10_markers(spark: SparkSession, d: str) -> DataFrame:
    """Half-mile markers: number, miles and metres."""
    return table(spark, d, "part").select(F.col("p_partkey").cast("int").alias("point_id"), (F.col("p_partkey") * 0.5).alias("mile"), F.round(F.col("p_partkey") * 804.672, 3).alias("metres"))


def prj15_all_sources(spark: SparkSession, d: str) -> DataFrame:
    """Every source through the same projection, icons mapped to a type where the source gives none; unmapped ones have none."""
    icons = spark.createDataFrame([("w", "water"), ("s", "water"), ("c", "campsite")], "icon string, mapped string")
    p = current_places(spark, d).withColumn("icon", F.lower(F.substring("name", 1, 1)))
    out = p.join(F.broadcast(icons), "icon", "left")
    return out.groupBy("source", F.coalesce("known_type", "mapped").alias("poi_type")).agg(F.count(F.lit(1)).alias("n"))


def sca03_structures(spark: SparkSession, d: str) -> DataFrame:
    """Names of structures without what any of them may be called."""
    n = text.structure_name(F.coalesce("name", F.lit("")), {"mtn": "mountain", "cr": "creek"}, ("shelter", "hut", "the", ""))
    return current_places(spark, d).select("poi_key", n.alias("n"))


def sca06_mile_queries(spark: SparkSession, d: str) -> DataFrame:
    q = F.get(F.array(F.concat(F.lit("mile "), "p_partkey"), F.concat(F.lit("MI"), "p_partkey", F.lit(".5")), F.concat(F.lit(" "), "p_partkey"), F.concat(F.lit("mile"), F.lit("x")), F.concat("p_partkey", F.lit(" miles"))), (F.col("p_partkey") % 5).cast("int"))
    return table(spark, d, "part").select("p_partkey", text.mile_query(q).alias("mile"))


def sca08_blazes(spark: SparkSession, d: str) -> DataFrame:
    """Blaze values as mapped, knowingly deferred or unmapped; by source default where a value is missing (X-25)."""
    raw = F.get(F.array(F.lit("W"), F.lit("B"), F.lit("X"), F.lit("?"), F.lit(None).cast("string")), (F.col("p_partkey") % 5).cast("int"))
    m = text.mapped(F.coalesce(raw, F.lit("W")), {"W": "white", "B": "blue"}, ("X",))
    return table(spark, d, "part").select("p_partkey", m["value"].alias("blaze"), m["state"].alias("state"), raw.isNull().alias("defaulted"))


def sca10_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """Notes without the sentences that mention a mile; null if none is left."""
    return notes(spark, d).where("note is not null").select("id", text.sentences_without(F.col("note"), "mile").alias("note"))


def sca13_licences(spark: SparkSession, d: str) -> DataFrame:
    licence = F.get(F.array(*map(F.lit, ("CC0", "cc-by-4.0", "cc-by-sa-3.0", "pd-usgov", "cc-by-nc-4.0", "gfdl"))), (F.col("p_partkey") % 6).cast("int"))
    return table(spark, d, "part").select("p_partkey", text.licence_allowed(licence).alias("allowed"))


def sca16_joined(spark: SparkSession, d: str) -> DataFrame:
    """Types of each source as a list in words."""
    kinds = current_places(spark, d).where("known_type is not null").groupBy("source").agg(F.array_sort(F.collect_set("known_type")).alias("k"))
    return kinds.select("source", text.joined(F.col("k")).alias("kinds"))


def sca17_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "poi_sources").select("source", text.digest_key(F.col("provider")).alias("key"))


def sca18_feature_ids(spark: SparkSession, d: str) -> DataFrame:
    """The id of a feature: its own, else its source's, else made up from its place; counts of each."""
    own = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name"))
    other = F.when(F.col("p_partkey") % 2 == 0, F.col("p_partkey").cast("string"))
    made = F.concat(F.lit("generated-"), F.col("p_partkey").cast("string"))
    return table(spark, d, "part").select("p_partkey", F.coalesce(own, other, made).alias("id"), (own.isNull() & other.isNull()).alias("warned"))


def d04_days(spark: SparkSession, d: str) -> DataFrame:
    ms = F.lit(1767225600000) + F.col("p_partkey") * 7_919_000
    return table(spark, d, "part").select("p_partkey", times.day_of_millis(ms).alias("day"))


def d05_naive(spark: SparkSession, d: str) -> DataFrame:
    """Aware times as naive UTC."""
    aware = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("-05:00"))
    return table(spark, d, "orders").select("o_orderkey", F.to_timestamp(aware).cast("timestamp_ntz").alias("utc"))


def d08_directions(spark: SparkSession, d: str) -> DataFrame:
    return closures(spark, d).select("id", times.direction(F.col("start_mile_marker"), F.col("end_mile_marker")).alias("way"))


def x17_promised(spark: SparkSession, d: str) -> DataFrame:
    """Keys that artifacts refer to and that don't exist."""
    refs = notes(spark, d).where("poi_id is not null").select(F.col("poi_id").alias("poi_key")).distinct()
    return refs.join(table(spark, d, "poi_snapshots").select("poi_key"), "poi_key", "left_anti")


def x18_regressions(spark: SparkSession, d: str) -> DataFrame:
    """Sources whose count fell under nine tenths of the load before."""
    s = table(spark, d, "poi_snapshots").groupBy(plain_source(F.col("source")).alias("source"), "load_no").agg(F.countDistinct("poi_key").alias("n"))
    before = F.lag("n").over(Window.partitionBy("source").orderBy("load_no"))
    return s.withColumn("before", before).where("n < before * 0.9").select("source", "load_no", "before", "n")


def prj09_sections(spark: SparkSession, d: str) -> DataFrame:
    """Club sections with an upstream column's misspelt name put right and its values plain."""
    raw = table(spark, d, "supplier").withColumnsRenamed({"s_name": "ACROYNM", "s_nationkey": "REGION"})
    return raw.withColumnRenamed("ACROYNM", "acronym").select(F.col("s_suppkey").cast("string").alias("global_id"), F.trim("acronym").alias("acronym"), F.col("REGION").cast("int").alias("region"))


def prj11_side_trails(spark: SparkSession, d: str) -> DataFrame:
    """Side trails: id, status, type, blaze as the source has it, length; nothing is decoded yet."""
    return table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("global_id"), F.col("p_brand").alias("status"), F.col("p_type").alias("raw_type"), F.substring("p_name", 1, 3).alias("raw_blaze"), F.col("p_retailprice").alias("length_ft"))


def prj12_treadway(spark: SparkSession, d: str) -> DataFrame:
    """Treadway: the year built is null where it is 0, and comments that say nothing are null."""
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").cast("string").alias("global_id"), F.when(F.col("p_size") % 10 != 0, F.col("p_size") + 1930).alias("year_built"), F.when(F.length(F.trim("p_name")) > 12, F.trim("p_name")).alias("comments"))


def src02_registered(spark: SparkSession, d: str) -> DataFrame:
    """Layers of a registry loaded where their file is there; the others are named, never an error."""
    names = ["closures", "dim_pois", "no_such_layer", "poi_sources"]
    out = []
    for name in names:
        there = exists(spark, f"{d}/{name}.parquet")
        out.append(table(spark, d, name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("layer"), "n") if there else spark.createDataFrame([(name, None)], "layer string, n long"))
    return reduce(DataFrame.unionByName, out)


def src09_pages(spark: SparkSession, d: str) -> DataFrame:
    """A layer written in pages and read again: those up to the last page count."""
    folder = own_folder(spark, "pages")
    p = current_places(spark, d).where(usable_position(F.col("latitude"), F.col("longitude")))
    f = F.struct(F.lit("Feature").alias("type"), F.col("poi_key").alias("id"), F.struct("name").alias("properties"), F.struct(F.lit("Point").alias("type"), F.array("longitude", "latitude").alias("coordinates")).alias("geometry"))
    page = F.pmod(F.ascii("poi_key"), F.lit(4))
    for n in range(4):  # four pages; the third says it is the last
        line = p.where(page == n).select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.array(f).alias("features"), F.lit(n != 2).alias("exceededTransferLimit"))).alias("value"))
        part = f"{folder}/part-{n}"
        line.coalesce(1).write.mode("append").text(part)
        only_file(spark, part, f"{folder}/pages/page-{n}.json")
    read = geojson.read_pages(spark, f"{folder}/pages", "2026-06-01 00:00:00")
    return read.agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"), F.max("id").alias("last"))


def r03_owned(spark: SparkSession, d: str) -> DataFrame:
    """Places that a half-open one-degree cell owns by its west and south edge, by cell."""
    p = current_places(spark, d).where(usable_position(F.col("latitude"), F.col("longitude")))
    return p.select(F.floor("longitude").alias("west"), F.floor("latitude").alias("south")).groupBy("west", "south").agg(F.count(F.lit(1)).alias("n"))


def a36_kept(spark: SparkSession, d: str) -> DataFrame:
    """Contributions by table: one count each."""
    names = ("field_notes", "closures", "poi_pairs", "doc_labels")
    return reduce(DataFrame.unionByName, [table(spark, d, n).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n") for n in names])


def x26_totals(spark: SparkSession, d: str) -> DataFrame:
    """Hours of each account: all that are not disputed, those claimed of them, and on how many days."""
    e = table(spark, d, "events")
    good = F.col("event_type") != "error"
    return e.groupBy("user_id").agg(F.sum(F.when(good, F.floor("value")).otherwise(0)).alias("hours"), F.sum(F.when(good & (F.col("event_type") == "purchase"), F.floor("value")).otherwise(0)).alias("claimed"), F.countDistinct(F.when(good, F.to_date("ts"))).alias("days"))


def x27_quoted_csv(spark: SparkSession, d: str) -> DataFrame:
    """Notes through quoted text and back: commas, quotes and line ends survive."""
    folder = own_folder(spark, "quoted")
    text_ = F.concat(F.lit('say "'), F.coalesce("note", F.lit("")), F.lit('", twice,\nplease'))
    rows = notes(spark, d).where("note is not null").select("id", text_.alias("t"))
    rows.write.mode("append").option("quoteAll", True).option("escape", '"').csv(folder)
    back = spark.read.schema("id string, t string").option("multiLine", True).option("escape", '"').csv(folder)
    return back.select("id", F.length("t").cast("long").alias("n"))


def x19_artifacts(spark: SparkSession, d: str) -> DataFrame:
    """Artifacts checked against what was recorded: path, existence and digest, each with what is wrong with it."""
    s = table(spark, d, "poi_snapshots").select("load_no", "poi_key", F.md5(F.coalesce("name", F.lit(""))).alias("h")).groupBy("load_no", "poi_key").agg(F.max("h").alias("h"))
    was = s.where("load_no = 2").select("poi_key", F.col("h").alias("was"), F.concat(F.lit("pois/"), "poi_key").alias("path"))
    j = was.join(s.where("load_no = 3").select("poi_key", "h"), "poi_key", "left")
    each = F.array_compact(F.array(F.when(~F.col("path").rlike("^pois/[0-8a-f]"), F.lit("path")), F.when(F.col("h").isNull(), F.lit("missing")), F.when(F.col("h") != F.col("was"), F.lit("digest"))))
    return j.select("poi_key", F.array_join(each, ",").alias("problems")).where("problems <> ''")


def x09_spur_records(spark: SparkSession, d: str) -> DataFrame:
    """Spurs by id with their junction's end, their destination and the junction's mile on the shared axis (X-10)."""
    c = closures(spark, d).select("id", "start_mile_marker", "end_mile_marker")
    out = j34_destination(spark, d).join(j35_junction(spark, d), "id").join(c, "id")
    mile = F.when(F.col("junction") == "start", F.col("start_mile_marker")).when(F.col("junction") == "end", F.col("end_mile_marker"))
    return out.select("id", "state", "destination", "junction", mile.alias("mile"))


QUERIES = {f.__name__: f for f in (prj09_sections, prj11_side_trails, prj12_treadway, src02_registered, src09_pages, r03_owned, a36_kept, x09_spur_records, x19_artifacts, x26_totals, x27_quoted_csv, st05_precedence, st09_credited, st10_markers, q05_verdicts, q08_baseline, q09_reproduced, q10_minimums, q11_reach, q12_sections, q13_receipts, q14_published, q15_retired, q17_projects, q18_problems, a25_gate, a34_worst, a35_summary, m06_edges, m09_appended, s02_labelled, s03_present, s04_keys, j31_differing, j32_snapped_markers, j34_destination, j35_junction, j38_attributed, j44_recent_ids, j45_flagged, j46_routed, flt09_spurs, flt11_passed, flt12_hidden, flt14_published, prj07_bridges, prj08_renamed, prj10_markers, prj15_all_sources, sca03_structures, sca06_mile_queries, sca08_blazes, sca10_cleaned, sca13_licences, sca16_joined, sca17_keys, sca18_feature_ids, d04_days, d05_naive, d08_directions, x17_promised, x18_regressions)}

_N = "n as (select distinct * from field_notes)"
_C = "c as (select distinct * from closures)"
_P, _HAV, _T, _SRC, _SID = warehouse._P, warehouse._HAV, warehouse._T, warehouse._SRC, warehouse._SID
_MARK = "mk as (select load_no, {0} as source, max(case when length({0}) % 3 <> 0 then snapshot_date::varchar end) as mark from poi_snapshots where load_no in (7, 8) group by 1, 2), a as (select source, mark from mk where load_no = 7), b as (select source, mark from mk where load_no = 8 and source <> 'opentrail_at')".format(_SRC)
_VERD = f"{_MARK}, v as (select coalesce(a.source, b.source) as source, case when a.source is null then 'new' when b.source is null then 'gone' when b.mark is null then 'unknown' when a.mark is not distinct from b.mark then 'fresh' else 'stale' end as state from a full outer join b on a.source = b.source)"
_COUNTS = f"k as (select t.poi_type, coalesce(n, 0) as n, case t.poi_type when 'water' then 400 when 'privy' then 1 else 50 end as least from (select unnest([{warehouse._TYPES}]) as poi_type) t left join (select known_type, count(*) as n from p group by 1) q on known_type = poi_type)"
_LEDGER = "lg as (select p_partkey as id, p_partkey % 3 <> 0 as retired, case when p_partkey % 7 = 0 then null when p_partkey % 50 = 1 then p_partkey + 1 else p_partkey - 1 end as sup from part)"


def _ends(e: str) -> str:
    return f"(select id, poi_key, round(m, 2) as m from (select c.id, u.poi_key, {_FAR} as m, row_number() over (partition by c.id order by {_FAR}, u.poi_key) as rn from (select id, {e}_lat as la, {e}_lon as lo from c where start_lat is not null and start_lon is not null and end_lat is not null and end_lon is not null) c join u on known_type in ('shelter', 'campsite') and abs(la - latitude) < 0.0182 where {_FAR} <= 2000) where rn = 1)"


_FAR = "2 * 6371008.8 * asin(least(1.0, sqrt(power(sin((radians(latitude) - radians(la)) / 2), 2) + cos(radians(la)) * cos(radians(latitude)) * power(sin((radians(longitude) - radians(lo)) / 2), 2))))"
_SPURS = f"{_C}, {_P}, es as {_ends('start')}, ee as {_ends('end')}, sp as (select c.id, es.m as a, ee.m as b, es.poi_key as ap, ee.poi_key as bp from c left join es on es.id = c.id left join ee on ee.id = c.id where start_lat is not null and start_lon is not null and end_lat is not null and end_lon is not null)"

SQL = {
    "st10_markers": f"with {_MARK} select a.source, case when b.mark is null then 'unknown' when a.mark is not distinct from b.mark then 'fresh' else 'stale' end as state from a join b on a.source = b.source",
    "q05_verdicts": f"with {_VERD} select * from v",
    "a35_summary": f"with {_VERD} select count(*) filter (state = 'stale') as stale, count(*) filter (state = 'unknown') as unknown, case when count(*) filter (state = 'stale') > 0 then 1 when count(*) filter (state = 'unknown') > 0 then 2 else 0 end as code from v",
    "a34_worst": f"""with q as (select poi_key, max(loaded_at) as l from dim_pois group by 1), {_P}, s as (select known_type, case when confidence is null then 2 when confidence = 'low' then 1 else 0 end as s, l from p join q using (poi_key) where known_type is not null)
select known_type, ['live', 'baseline', 'unavailable'][max(s) + 1] as state, arg_max(l, (s, -epoch_us(l))) as generated_at from s group by 1""",
    "st05_precedence": f"""with {_N}, {_P}, l as (select poi_id, arg_max(observation, (observed_at, id)) as said from n where poi_id is not null and observation is not null group by 1) select case when said is not null then 'live' else 'baseline' end as "from", coalesce(said, 'none') as said, count(*) as n from p left join l on poi_id = poi_key group by 1, 2""",
    "st09_credited": f"""with {_N}, {_C} select n.id, case when min(c.id) = max(c.id) then min(c.id) end as span from n join c on mile between least(start_mile_marker, end_mile_marker) and greatest(start_mile_marker, end_mile_marker) and (closed_since is null or closed_since <= observed_at) and (expected_reopen is null or expected_reopen >= observed_at) group by 1""",
    "q08_baseline": f"with s as (select load_no, {_SRC} as source, count(*) as n from poi_snapshots where load_no in (7, 8) group by 1, 2), a as (select * from s where load_no = 8 and source like 'atc%'), b as (select * from s where load_no = 7) select coalesce(a.source, b.source) as source, coalesce(a.n, b.n) as n from a full outer join b on a.source = b.source",
    "q09_reproduced": f"with {_P} select known_type, true as agrees from u where known_type is not null group by 1",
    "q10_minimums": f"with {_P}, {_COUNTS} select * from k where n < least",
    "q18_problems": f"with {_P}, {_COUNTS}, dt as ({warehouse.SQL['q01_data_tests']}) select 'too few of ' || poi_type as problem from k where n < least union all select 'rule broken: ' || problem from dt where n > 0",
    "q11_reach": f"with {_P}, k as (select a.poi_key, min({_HAV}) as m from u a join u b on a.known_type = 'water' and b.known_type in ('shelter', 'campsite') and abs(a.latitude - b.latitude) < 0.0037 where {_HAV} <= 400 group by 1) select u.poi_key, round(m, 1) as metres from u left join k using (poi_key) where known_type = 'water' order by round(m, 1) desc nulls first, u.poi_key limit 20",
    "q12_sections": f"with asc_ as ({trail.SQL['w10_raw_ascent']}), st as ({trail.SQL['w28_implausible']}), s as (select distinct user_id from st where not coalesce(seam, false)) select user_id, abs(ascent - (user_id % 7 + 3) * 1000) <= (user_id % 7 + 3) * 100 as agrees, user_id in (select user_id from s) as contaminated from asc_",
    "q13_receipts": "with hs as (select load_no, poi_key, max(sha256(coalesce(name, '') || '|' || coalesce(confidence, ''))) as h from poi_snapshots group by 1, 2), j as (select case when b.h is null then 'missing' when b.h <> a.h then 'changed' end as problem from (select * from hs where load_no = 5) a left join (select * from hs where load_no = 6) b using (poi_key)) select problem, count(*) as n from j where problem is not null group by 1",
    "j31_differing": f"with hs as (select load_no, poi_key, max(md5(coalesce(name, '') || '|' || coalesce({_T.format('poi_type')}, ''))) as h from poi_snapshots group by 1, 2) select a.poi_key from hs a join hs b on a.load_no = 1 and b.load_no = 8 and a.poi_key = b.poi_key where a.h <> b.h",
    "q14_published": f"""with l as (select poi_key, max({_T.format('poi_type')}) as was, true as known from poi_snapshots where load_no = 8 group by 1), d as (select poi_key, max({_T.format('poi_type')}) as t, count(*) as n from dim_pois group by 1), j as (select * from d left join l using (poi_key)),
x as (select 'no ledger row' as problem from j where known is null union all select 'another type' from j where known and t <> was union all select 'twice' from j where n > 1) select problem, count(*) as n from x group by 1""",
    "q15_retired": f"""with {_LEDGER}, s as (select * from lg where retired and id % 19 <> 0 or id % 23 = 0), lv as (select id from lg where not retired), rt as (select id from lg where retired)
select 'not retired' as problem, count(*) as n from s where id not in (select id from rt) union all select 'still live', count(*) from s where id in (select id from lv) union all select 'no tombstone', count(*) from rt where id not in (select id from s) union all select 'successor not live', count(*) from s where sup is not null and sup not in (select id from lv)""",
    "q17_projects": "select p_partkey, concat_ws(',', case when not length(p_name) > 10 then 'title' end, case when not p_partkey % 2300 <= 2200 then 'mile' end, case when not p_size > 2 then 'capacity' end, case when not p_partkey % 9 <= p_size then 'dates' end) as problems from part",
    "a25_gate": "select quantile_cont(p_size / 1000.0, 0.5) <= 0.05 as median_ok, quantile_cont(p_size / 1000.0, 0.95) <= 0.25 as p95_ok, max(p_size) / 1000.0 <= 1.0 as worst_ok from part",
    "m06_edges": f"""with recursive {_LEDGER}, w as (select id, id as at, 0 as k from lg union all select w.id, lg.sup, k + 1 from w join lg on lg.id = w.at where lg.retired and lg.sup is not null and k < 60), live as (select distinct w.id from w join lg on lg.id = w.at where not lg.retired)
select case when not retired then 'from a live id' when sup = id then 'to itself' when sup not in (select id from lg) then 'to an unknown id' when id not in (select id from live) then 'leads nowhere' else 'accepted' end as verdict, count(*) as n from lg where sup is not null group by 1""",
    "m09_appended": "select load_no::bigint as place, snapshot_date::varchar as release from (select distinct load_no, snapshot_date from poi_snapshots) union all select 9, '2026-07-20-2'",
    "s02_labelled": f"select {_SRC} as label, count(*) as n from dim_pois where {_SRC} in ('atc_shelters', 'atc_campsites') group by 1",
    "s03_present": f"select count(*) as n, 'some' as layers from dim_pois where {_SRC} in ('osm_water', 'atc_bridges') union all select 0, 'none'",
    "s04_keys": "with a as (select distinct poi_key from poi_snapshots where load_no = 3), b as (select distinct poi_key from poi_snapshots where load_no = 6) select 'both' as what, count(*) as n from (select * from a intersect select * from b) union all select 'first', count(*) from (select * from a except select * from b) union all select 'second', count(*) from (select * from b except select * from a)",
    "j32_snapped_markers": f"with {_N}, {_P}, m as (select id, lat as la, lon as lo, mile from n where mile is not null and lat is not null and lon is not null), b as (select * from (select m.id, m.mile, u.poi_key, row_number() over (partition by m.id order by {_FAR}, u.poi_key) as rn from m join u on source = 'atc_shelters' and abs(la - latitude) < 0.001 where {_FAR} <= 100) where rn = 1) select poi_key as part, count(*) as n, min(mile) as first, max(mile) as last from b group by 1",
    "j38_attributed": f"with {_N}, {_P}, m as (select id, lat as la, lon as lo from n where reporter_type = 'maintainer' and lat is not null and lon is not null), b as (select * from (select m.id, u.source, row_number() over (partition by m.id order by {_FAR}, u.poi_key) as rn from m join u on abs(la - latitude) < 0.001 where {_FAR} <= 100) where rn = 1) select b.source, count(*) as n from m left join b using (id) group by 1",
    "j35_junction": f"with {_SPURS} select id, case when a is null and b is null then null when a <= 25 and b <= 25 then null when b is null or a <= b then 'start' else 'end' end as junction from sp",
    "j34_destination": f"""with {_SPURS}, k as (select *, coalesce(b is null or a <= b, false) as ats from sp), f as (select *, case when ats then b else a end as far, case when ats then bp else ap end as place from k),
s as (select *, case when a is null and b is null then 'no junction' when a <= 25 and b <= 25 then 'ambiguous' when far is null or far > 150 then 'nothing there' else 'resolved' end as state from f) select id, state, case when state = 'resolved' then place end as destination from s""",
    "j44_recent_ids": f"with {_N} select id, poi_id, observation, mile from (select *, row_number() over (partition by poi_id order by observed_at desc, id) as rn from n where poi_id is not null) where rn <= 5",
    "j45_flagged": f"with {_N}, r as (select {_T.format('k')} as poi_id, count(*) as flags from (select unnest([poi_key_a, poi_key_b]) as k from poi_pairs) group by 1) select id, flags, hidden_at is not null as hidden from n join r using (poi_id) order by hidden, flags desc, id limit 200",
    "j46_routed": f"with {_N}, {_P}, b as (select distinct poi_id from n where poi_id is not null and observation = 'not_found'), r as (select coalesce(source, 'unmatched') as source, count(*) as c from b left join p on poi_key = poi_id group by 1) select s.source, coalesce(c, 0) as places from (select source from poi_sources union all select 'unmatched') s left join r using (source)",
    "flt09_spurs": "select p_partkey, case p_partkey % 6 when 0 then '3' when 1 then '3' when 2 then '3' when 3 then '1' when 4 then '1' end as code, p_partkey % 6 in (0, 1, 2) as spur from part",
    "flt11_passed": f"with {_N}, w as (select (event_id % 997)::double as a, (event_id % 997 + 1 + event_id % 7)::double as b from events where user_id between 1 and 5) select distinct id, mile from n join w on mile between a and b where observation in ('flowing', 'dry', 'low')",
    "flt12_hidden": f"with t as (select unnest([{warehouse._TYPES}]) as k), s as (select p_partkey, [{warehouse._TYPES}][p_partkey % 8 + 1] as one from part) select p_partkey, coalesce(string_agg(k, ',' order by k) filter (p_partkey % 3 <> 0 and k not in ('water', 'shelter', one)), '') as hidden from s, t group by 1",
    "flt14_published": f"with {_C} select id, reason_type, status, start_mile_marker, end_mile_marker from c where moderation_status = 'verified'",
    "prj07_bridges": f"select distinct {_SID} as bridge_id, trim(name) as bridge_name, null::varchar as poi_type from dim_pois where {_SRC} = 'opentrail_at'",
    "prj08_renamed": "select l_orderkey || '-' || l_linenumber as global_id, l_returnflag as status, l_linestatus as surface, l_quantity as length_ft from lineitem",
    "prj10_markers": "select p_partkey::integer as point_id, (p_partkey * 0.5)::double as mile, round(p_partkey * 804.672::double, 3) as metres from part",
    "prj15_all_sources": f"with {_P} select source, coalesce(known_type, case lower(substring(name, 1, 1)) when 'w' then 'water' when 's' then 'water' when 'c' then 'campsite' end) as poi_type, count(*) as n from p group by 1, 2",
    "sca03_structures": f"""with {_P}, f as (select poi_key, string_split(trim(regexp_replace(regexp_replace(replace(lower(coalesce(name, '')), '&', ' and '), '[''’]', '', 'g'), '[^a-z0-9]+', ' ', 'g')), ' ') as w from p)
select poi_key, array_to_string(list_filter(list_transform(w, lambda x: case x when 'mtn' then 'mountain' when 'cr' then 'creek' else x end), lambda x: x not in ('shelter', 'hut', 'the', '')), ' ') as n from f""",
    "sca06_mile_queries": "select p_partkey, case p_partkey % 5 when 0 then p_partkey when 1 then p_partkey + 0.5 when 2 then p_partkey end::double as mile from part",
    "sca08_blazes": "select p_partkey, case p_partkey % 5 when 0 then 'white' when 1 then 'blue' when 4 then 'white' end as blaze, case p_partkey % 5 when 2 then 'deferred' when 3 then 'unmapped' else 'mapped' end as state, p_partkey % 5 = 4 as defaulted from part",
    "sca13_licences": "select p_partkey, p_partkey % 6 in (0, 1, 3) as allowed from part",
    "sca16_joined": f"with {_P}, k as (select source, list_sort(list(distinct known_type)) as k from p where known_type is not null group by 1) select source, case when len(k) = 1 then k[1] else array_to_string(k[:-2], ', ') || ' and ' || k[-1] end as kinds from k",
    "sca17_keys": "select source, 'sha256-' || substring(sha256(provider), 1, 32) as key from poi_sources",
    "sca18_feature_ids": "select p_partkey, coalesce(case when p_partkey % 3 = 0 then p_name end, case when p_partkey % 2 = 0 then p_partkey::varchar end, 'generated-' || p_partkey) as id, p_partkey % 3 <> 0 and p_partkey % 2 <> 0 as warned from part",
    "d04_days": "select p_partkey, cast(make_timestamp((1767225600000 + p_partkey * 7919000) * 1000) as date) as day from part",
    "d05_naive": "select o_orderkey, date_trunc('second', o_orderdate) + interval 5 hour as utc from orders",
    "d08_directions": f"with {_C} select id, case when end_mile_marker >= start_mile_marker then 'northbound' else 'southbound' end as way from c",
    "x17_promised": f"with {_N} select distinct poi_id as poi_key from n where poi_id is not null and poi_id not in (select poi_key from poi_snapshots)",
    "x18_regressions": f"with s as (select {_SRC} as source, load_no, count(distinct poi_key) as n from poi_snapshots group by 1, 2), b as (select *, lag(n) over (partition by source order by load_no) as before from s) select source, load_no, before, n from b where n < before * 0.9",
    "prj09_sections": "select s_suppkey::varchar as global_id, trim(s_name) as acronym, s_nationkey::integer as region from supplier",
    "prj11_side_trails": "select p_partkey::varchar as global_id, p_brand as status, p_type as raw_type, substring(p_name, 1, 3) as raw_blaze, p_retailprice as length_ft from part",
    "prj12_treadway": "select p_partkey::varchar as global_id, case when p_size % 10 <> 0 then p_size + 1930 end as year_built, case when length(trim(p_name)) > 12 then trim(p_name) end as comments from part",
    "src02_registered": "select 'closures' as layer, count(*) as n from closures union all select 'dim_pois', count(*) from dim_pois union all select 'poi_sources', count(*) from poi_sources union all select 'no_such_layer', null",
    "src09_pages": f"with {_P} select count(*) as n, min(poi_key) as first, max(poi_key) as last from u where ascii(poi_key) % 4 <= 2",
    "r03_owned": f"with {_P} select cast(floor(longitude) as bigint) as west, cast(floor(latitude) as bigint) as south, count(*) as n from u group by 1, 2",
    "a36_kept": "select 'field_notes' as name, count(*) as n from field_notes union all select 'closures', count(*) from closures union all select 'poi_pairs', count(*) from poi_pairs union all select 'doc_labels', count(*) from doc_labels",
    "x26_totals": "select user_id, cast(sum(case when event_type <> 'error' then floor(value) else 0 end) as bigint) as hours, cast(sum(case when event_type = 'purchase' then floor(value) else 0 end) as bigint) as claimed, count(distinct case when event_type <> 'error' then ts::date end) as days from events group by 1",
    "x27_quoted_csv": f"with {_N} select id, length(note) + length('say \"\", twice,') + 7 as n from n where note is not null",
    "x19_artifacts": "with hs as (select load_no, poi_key, max(md5(coalesce(name, ''))) as h from poi_snapshots group by 1, 2), j as (select a.poi_key, concat_ws(',', case when not regexp_matches('pois/' || a.poi_key, '^pois/[0-8a-f]') then 'path' end, case when b.h is null then 'missing' end, case when b.h <> a.h then 'digest' end) as problems from hs a left join hs b on b.load_no = 3 and a.poi_key = b.poi_key where a.load_no = 2) select * from j where problems <> ''",
    "x09_spur_records": f"""with {_SPURS}, k as (select *, coalesce(b is null or a <= b, false) as ats from sp), f as (select *, case when ats then b else a end as far, case when ats then bp else ap end as place from k),
s as (select *, case when a is null and b is null then 'no junction' when a <= 25 and b <= 25 then 'ambiguous' when far is null or far > 150 then 'nothing there' else 'resolved' end as state, case when a is null and b is null then null when a <= 25 and b <= 25 then null when b is null or a <= b then 'start' else 'end' end as junction from f)
select s.id, state, case when state = 'resolved' then place end as destination, junction, case junction when 'start' then start_mile_marker when 'end' then end_mile_marker end as mile from s join c on c.id = s.id""",
}
